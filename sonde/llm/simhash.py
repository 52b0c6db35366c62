"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints (64 bits) link where they differ in at most ``MAX_BITS`` bits. The distinct
fingerprints are dealt into groups that agree on one of ``MAX_BITS + 1`` blocks of bits, as
two linked ones always do. A group of more than ``GROUP`` fingerprints is never gathered: its
free bits are cut into blocks again, which keeps every link and ends when so few bits are
free that a group cannot be larger. Within a group the fingerprints are sorted by Gray rank;
runs of neighbours form the nodes of a tree, each node holds the bits that its members share
and its parent does not, and a search adds up differences on the way down and leaves a node
as soon as they exceed the limit. A group gives a star for each of its local components
instead of pairs; the stars are joined into components by `components`.

Edge cases: a null or empty text has fingerprint zero and links like any other; null ids are
passed by when the smallest id is sought (null if the whole component has none); repeated
rows stay as rows; further columns have no influence; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions.shipping import map_batches
from sonde.llm import scratch, shingle_join
from sonde.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
GROUP = 4096
FANOUT = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The text's fingerprint as an unsigned number."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)], strict=False))
    return majority(np.fromiter((digest(g, SEED) for g in grams), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the fingerprint as the signed long `fp`."""
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t.as_py()) for t in b.column(len(others))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(values)], names=[*others, "fp"])

    return map_batches(docs.select(*others, text), run, schema)


# -- the index of one or more groups --------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the order of the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _index(fps: np.ndarray, group: np.ndarray) -> list[tuple]:
    """Levels of nodes over fingerprints that are sorted by group and Gray rank, leaves first.

    A level is (start of each node's children in the level below, their end, shared mask,
    shared pattern, group). Nodes never span groups; the last level has one node a group.
    """
    full = np.full(len(fps), ~np.uint64(0))
    levels = [(None, None, full, fps, group)]
    while True:
        _, _, mask, pattern, of = levels[-1]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        if len(first) == len(of):
            return levels
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        start = np.flatnonzero(place % FANOUT == 0)
        end = np.r_[start[1:], len(of)]
        both, either = np.bitwise_and.reduceat(pattern, start), np.bitwise_or.reduceat(pattern, start)
        shared = np.bitwise_and.reduceat(mask, start) & ~(both ^ either)
        levels.append((start, end, shared, both & shared, of[start]))


def _near(fps: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of fingerprints of one group that differ in at most `limit` bits."""
    levels = _index(fps, group)
    root_of = np.searchsorted(levels[-1][4], group)
    left, right = [], []
    for k in range(0, len(fps), GROUP):
        query = np.arange(k, min(k + GROUP, len(fps)))
        node = root_of[query]
        _, _, mask, pattern, _ = levels[-1]
        apart = np.bitwise_count((fps[query] ^ pattern[node]) & mask[node])
        for above, below in zip(levels[:0:-1], levels[-2::-1], strict=True):
            keep = apart <= limit
            query, node, apart = query[keep], node[keep], apart[keep]
            size = above[1][node] - above[0][node]
            child = np.repeat(above[0][node] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            query, apart, parent = np.repeat(query, size), np.repeat(apart, size), np.repeat(node, size)
            fresh = below[2][child] & ~above[2][parent]
            apart = apart + np.bitwise_count((fps[query] ^ below[3][child]) & fresh)
            node = child
        keep = (apart <= limit) & (query < node)
        left.append(query[keep])
        right.append(node[keep])
    return np.concatenate(left), np.concatenate(right)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place of each place's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def stars(fps: np.ndarray, group: np.ndarray, free: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) of the local components of each group; free: the bits not fixed by the group."""
    order = np.lexsort((gray_rank(fps & free), group))
    fps, group = fps[order], group[order]
    root = _roots(len(fps), *_near(fps, group, limit))
    tied = root != np.arange(len(fps))
    return fps[tied], fps[root[tied]]


# -- dealing fingerprints into groups -------------------------------------------------------


def _cut(free: int, parts: int) -> list[int]:
    """The bits of `free` in `parts` blocks of nearly the same size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[k * len(bits) // parts : (k + 1) * len(bits) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_stars(distinct: DataFrame, limit: int = MAX_BITS, most: int = GROUP) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints `fp` within `limit` bits."""
    everything = (1 << 64) - 1
    masks = _cut(everything, limit + 1)
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("fixed")) for m in masks])).alias("g"))
    out = None
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(part: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            fps, mask, fixed = (np.concatenate([p[k] for p in part]) for k in range(3))
            group = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (fixed[1:] != fixed[:-1])])
            a, b = stars(fps.view(np.uint64), group, ~mask.view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fps, mask, fixed = (batch.column(k).to_numpy() for k in range(3))
            # all but the last group of the batch is complete
            ends = np.flatnonzero((mask != mask[-1]) | (fixed != fixed[-1]))
            cut = ends[-1] + 1 if len(ends) else 0
            if cut:
                yield linked([*held, (fps[:cut], mask[:cut], fixed[:cut])])
                held = []
            elif held and (held[-1][1][-1] != mask[0] or held[-1][2][-1] != fixed[0]):
                yield linked(held)
                held = []
            held.append((fps[cut:], mask[cut:], fixed[cut:]))
        if held:
            yield linked(held)

    while True:
        rows = rows.select("fp", "g.mask", "g.fixed")
        counts = rows.groupBy("mask", "fixed").agg(F.count("*").alias("n")).filter("n > 1")
        sized = scratch.save(rows.join(counts, ["mask", "fixed"]), "groups")
        found = map_batches(sized.filter(F.col("n") <= most).select("fp", "mask", "fixed").repartition("mask", "fixed").sortWithinPartitions("mask", "fixed"), run, schema)
        out = found if out is None else out.unionByName(found)
        large = sized.filter(F.col("n") > most)
        finer = {m: [m | c for c in _cut(everything & ~m, limit + 1)] for m in masks}
        masks = [x for m in masks for x in finer[m]]
        if large.isEmpty():
            return out
        choose = F.create_map(*[e for m, subs in finer.items() for e in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        rows = large.select("fp", F.explode(F.transform(choose[F.col("mask")], lambda s: F.struct(s.alias("mask"), F.col("fp").bitwiseAND(s).alias("fixed")))).alias("g"))


def with_roots(marked: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint; root: one fingerprint for each component."""
    distinct = marked.select("fp").distinct()
    nodes = components(local_stars(distinct))
    return distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs."""
    marked = scratch.save(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    roots = scratch.save(with_roots(marked), "roots")
    of = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(roots.join(least, "root").drop("root"), "fp")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (a null id comes last)."""
    whole = scratch.by_uid(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    marked = scratch.save(fingerprints(whole.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "uid", F.col(f"row.`{text}`").alias("text"))), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("m"))  # equal texts go within their tasks
    first = least.join(with_roots(marked), "fp").groupBy("root").agg(F.min("m").alias("m"))
    return whole.join(first.select("m.uid"), "uid", "left_semi").select("row.*")


def near_pairs(sets: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of uids of sets (uid, fp): a star for each fingerprint and for each local component of the index."""
    first = scratch.save(sets.groupBy("fp").agg(F.min("uid").alias("one")), "fingerprints")
    same = sets.join(first, "fp").filter("uid <> one").select(F.col("one").alias("a"), F.col("uid").alias("b"))
    end = lambda name: first.select(F.col("fp").alias(f"{name}_fp"), F.col("one").alias(name))
    near = local_stars(first.select("fp"), limit).select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).distinct().join(end("a"), "a_fp").join(end("b"), "b_fp")
    return same.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def keep_one_of_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_BITS + 1) -> DataFrame:
    """docs with one row of each group of similar texts: that with the smallest id (a null id comes last).

    Similar are texts whose five-word shingles have a Jaccard similarity of 0.8 or more; groups
    are the components of all such pairs. Fingerprints over these shingles, searched by the
    Gray-order index within `limit` bits, bring most of them together, and each pair is
    compared in full. At that similarity fingerprints may differ in a dozen bits, which no
    index of blocks covers, so pairs further apart are found by the exact join of
    `shingle_join`; no pair is lost, whatever bits it differs in.
    """
    whole = scratch.by_uid(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")))
    texts = whole.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "uid", F.col(f"row.`{text}`").alias("text"))
    named = scratch.save(shingle_join.named_sets(texts, docs.schema[doc_id].dataType, majority), "sets")
    least = scratch.save(named.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("m")).select("m"), "least")  # equal sets go within their tasks
    sets = scratch.save(named.join(least.select("m.uid"), "uid", "left_semi"), "distinct")
    scratch.drop(named)
    near = shingle_join.similar(scratch.save(near_pairs(sets.select("uid", "fp"), limit), "pairs"), texts)
    roots = components(shingle_join.similar_links(sets, texts, near)).select(F.col("node").alias("uid"), "root")
    of = least.select("m", F.col("m.uid").alias("uid")).join(roots, "uid", "left").select("m", F.coalesce("root", "uid").alias("root"))
    first = of.groupBy("root").agg(F.min("m").alias("m"))
    return whole.join(first.select("m.uid"), "uid", "left_semi").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
