"""Anchors of texts that stand one after another are those of each text alone, wherever pieces are cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sonde.llm import suffix_dedup

TEXTS = ["", "a" * 900, "short", "".join(chr(97 + k * k % 23) for k in range(1500)), "one two three " * 90, "x" * 399, "y" * 400]


@pytest.mark.parametrize("piece", [1, 1000, 1 << 17])
@pytest.mark.parametrize("unit", [suffix_dedup.BYTES, suffix_dedup.PASSAGE])
def test_pieces_change_no_anchor(monkeypatch, piece, unit):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    batch = pa.RecordBatch.from_pydict({"uid": range(len(TEXTS)), "text": TEXTS})
    got = set()
    for first, _, data, ends in suffix_dedup._elements(batch, unit):
        at, grams = suffix_dedup.anchors(data, unit, ends)
        row = np.searchsorted(ends, at, side="right")
        got |= set(zip((first + row).tolist(), (at - np.r_[0, ends][row]).tolist(), grams.tolist(), strict=True))
    alone = set()
    for k, text in enumerate(TEXTS):
        data = np.frombuffer(text.encode(), np.uint8)
        at, grams = suffix_dedup.anchors(suffix_dedup.word_hashes(data)[0] if unit.words else data, unit)
        alone |= {(k, a) for a in at.tolist()}
    assert {g[:2] for g in got} == alone
    assert alone
