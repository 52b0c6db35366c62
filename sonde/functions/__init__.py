"""Helpers that operators share: ordering, staging, conventions and shipping."""
