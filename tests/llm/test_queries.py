"""The registered queries as a driver runs them: their columns, against SQL or plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from corpora import frame, plain, texts
from test_corpus import classes, fingerprint, shared_words, wanted_targets, without_repeats
from test_filters import ITEMS, LICENCES, WHITE

from sonde.llm import registry, token_counts, token_store


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A folder of documents and benchmark, and the documents' rows."""
    folder = tmp_path_factory.mktemp("tables")
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))
    rows = texts() + LICENCES + [(700 + k, f"{'abc'[k]} opening. {passage} and an end {k}", "src1") for k in range(3)] + [(710, ITEMS[0][1] + " " + passage[:300], None)]
    rows += [(720 + k, f"page {k} of 9 next\nown line number {'abcdefg'[k]} here", "s") for k in range(7)]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS[:3], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def result(spark, written, name: str) -> pd.DataFrame:
    return registry.QUERIES[name](spark, written[0]).toPandas()


def shown(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (float, np.floating)) else str(v).removesuffix(".0") for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_gives_the_same_rows(spark, written, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{written[0]}/{t}.parquet/*.parquet'")
    got, want = result(spark, written, name), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    whole = lambda df: df.apply(lambda c: c.astype("Int64") if c.dtype.kind in "iuf" and (c.dropna() % 1 == 0).all() else c)
    assert shown(whole(got)) == shown(whole(want))


def test_mixing_query(spark, written):
    got = result(spark, written, "op2_source_mixing")
    rows = written[1]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WHITE.findall(t or ""))
    targets = wanted_targets({s: sizes[s] for s in {s for *_, s in rows}})
    assert list(got.columns)[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    assert sorted({round(t, 6) for t in got["target"]}) == sorted({round(t, 6) for t in targets.values()})
    one, other = (plain(registry.QUERIES["op2_source_mixing"](spark, written[0]).collect()) for _ in range(2))
    assert one == other


def test_token_queries(spark, written):
    from tokenizers import Tokenizer

    rows = written[1]
    words, counts = Tokenizer.from_file(token_store.word_bpe()), Tokenizer.from_file(token_counts.byte_bpe())
    ids = lambda t: np.array([*words.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    got = registry.QUERIES["op3_token_store"](spark, written[0]).collect()
    assert plain((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == plain((d, len(ids(t)), zlib.crc32(ids(t).tobytes())) for d, t, _ in rows)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts)])[:-1].tolist()
    got = registry.QUERIES["op8_token_counts"](spark, written[0]).collect()
    n = {t: len(counts.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows}
    assert plain(tuple(r)[:4] for r in got) == plain((d, len((t or "").encode()), n[t], n[t] > 512) for d, t, _ in rows)


def test_near_copy_query(spark, written):
    rows = written[1]
    fps = [fingerprint(t) for _, t, _ in rows]
    label = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {c: min((d for (d, *_), x in zip(rows, label, strict=True) if x == c and d is not None), default=None) for c in label}
    got = registry.QUERIES["op4_simhash"](spark, written[0]).collect()
    assert plain(tuple(r)[:3] for r in got) == plain((d, f"{f:016x}", least[c]) for (d, *_), f, c in zip(rows, fps, label, strict=True))


def test_passage_query(spark, written):
    rows = written[1]
    got = registry.QUERIES["op9_suffix_dedup"](spark, written[0]).collect()
    want = [(d, size, gone, spans, hashlib.sha256(kept).hexdigest(), *more) for (d, kept, size, gone, spans), (_, *more) in zip(without_repeats(rows), shared_words(rows), strict=True)]
    assert plain(tuple(r) for r in got) == plain(want)
    assert sum(r["n_passages"] > 0 for r in got if r["doc_id"] is not None and 700 <= r["doc_id"] < 703) == 3


def test_score_query(spark, written):
    rows = written[1]
    got = registry.QUERIES["op6_context_tree"](spark, written[0]).collect()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    assert plain((r["doc_id"], r["held_out"], r["n_tokens"]) for r in got) == plain((d, fold(d), len(WHITE.findall(t or "")) + 1) for d, t, _ in rows)
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in got)
