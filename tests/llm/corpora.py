"""Small documents with what operators must cope with."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, row string, fp int, n_words string, `_quality` int"


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empty and very long texts, ties, repeats, near copies."""
    rng = random.Random(11)
    words = ["the", "of", "and", "license", "mit", "river", "stone", "Über", "naïve", "x1", "42", "cloud,", "tree.", "A", "é", "漢字", "it's", "###"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = "the old river ran past a grey stone and under the long bridge of the town where people of the valley met to trade wool and salt in the early years"
    out: list[tuple[int | None, str | None, str | None]] = [(k, prose(rng.randint(1, 120)), f"src{k % 4}") for k in range(30)]
    out += [(100, None, "src0"), (101, "", "src1"), (102, "  \n\t ", None), (None, base, "src2"), (103, base, None), (103, base, None), (104, base + " today", "src1"), (105, base.upper(), "src3")]
    out += [(106, "word " * 4000, "src0"), (107, "\n".join(["a line that is said again and again"] * 40), "src2"), (108, "one", "src2"), (109, "two words", "src9"), (110, "<|endoftext|> don't 'll", "src9")]
    return out


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None, str | None]] | None = None) -> DataFrame:
    """The documents with further columns whose names operators use themselves."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "u", "r", 7, "n", None) for d, t, s in rows], SCHEMA)


def plain(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
