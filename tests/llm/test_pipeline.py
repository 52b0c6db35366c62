"""The pipeline's stages against plain Python, each on what the one before kept."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from corpora import frame, texts
from test_corpus import classes
from test_filters import ITEMS, contaminated
from test_shingle_join import similarity

from sonde.llm import registry, token_store


def corpus(spark, tmp_path):
    prose = "the quick river of stone and salt ran on for the people in a valley that is far from the town as it was before number"
    more = [(500 + k, f"{prose} {'abcdefghij'[k]} and of the {k} days", f"src{k % 3}") for k in range(10)]
    rows = texts() + more + [(600, prose + " a and of the 0 days", "src1"), (601, ITEMS[0][1] + " " + prose, "src1")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS[:1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], str(tmp_path))
        if name != "token_store":
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{name}.parquet")
            out = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept.append(out)
    _, good, single, clean, mix, last = [[(r["doc_id"], r["text"]) if "text" in d.columns else r for r in d.collect()] for d in kept]
    assert {500, 509} <= {d for d, _ in good} and len(good) < len(rows)
    label = classes([t or "" for _, t in good], lambda a, b: similarity(a, b) >= 0.8)  # five words, as the stage has no contract of its own
    assert len(single) == len(set(label))
    hits = {d for d, _, n, _ in contaminated([(d, t, None) for d, t in single], ITEMS[:1]) if n}
    assert 601 in hits and {d for d, _ in clean} == {d for d, _ in single} - hits
    assert set(mix) <= set(clean) and max(Counter(mix).values()) <= 2
    library = Tokenizer.from_file(token_store.word_bpe())
    want = Counter((d, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t in mix)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in last) == want


def test_run_and_registry(spark, tmp_path):
    corpus(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    assert set(registry.ORACLES) < set(registry.QUERIES)


def test_run_over_nothing(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
