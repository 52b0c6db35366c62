"""Intermediate tables of the text operators; see `sonde.functions.staging`."""

from __future__ import annotations

from sonde.functions.staging import by_uid, drop, new_path, remove, root, save

__all__ = ["by_uid", "drop", "new_path", "remove", "root", "save"]
