"""Near-duplicates by word shingles: a set join with prefix filters, exact for its threshold.

Two texts are near-duplicates if the sets of their runs of ``SHINGLE`` words have a Jaccard
similarity of ``NEAR`` or more. All sets are put into one order, from rare shingles to common
ones; two similar sets then share a shingle among the first fifth of each. Such shingles give
candidates, sizes and places rule most of them out, and the rest are compared in full. How
common a shingle is comes from a table of ``BUCKETS`` counts: it only makes the order, so that
texts which share a common line do not all meet, and no result depends on it.

Texts with equal sets are one. The others meet two texts of each shared shingle, unless links
that are known already tie them: one that is drawn, and the one with the fewest rarer shingles,
which in a group of near copies is the text that they vary. Then they meet one of the first and
one of the last component that are left there; only what is not of one component after that
meets in pairs, so that a large group of near copies is not compared each with each. Of these
pairs only such are kept whose sketches, the parities of ``SKETCH`` classes of shingles, differ
in no more bits than two similar sets differ in shingles. `simhash` calls this for the pairs that
its fingerprints do not bring together.

A text of fewer words than a shingle has all of them as its only one, as has an empty or null
text. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions.shipping import map_batches
from sonde.llm import scratch
from sonde.llm.components import components

SHINGLE = 5
#: The similarity as a fraction.
NEAR = (4, 5)
BUCKETS, BLOCK, PIVOTS = 1 << 20, 1 << 12, 3
#: Bits of a sketch. Sets of some thousand shingles and more have random ones, which rule nothing out.
SKETCH = 1 << 10
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def shingles(text: str | None) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], _U)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, _U)
    for k in range(SHINGLE):
        h = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15) + w[k : k + n]
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> _U(32)))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h & _U(BUCKETS - 1)).astype(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """For each of SKETCH classes whether an odd number of the hashes falls into it, as signed longs.

    A hash that only one of two sets has changes one bit, so the sketches of two sets differ in
    no more bits than the sets differ in hashes.
    """
    odd = np.bincount((h >> _U(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _commonness(texts: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each bucket; BUCKETS numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for b in batches:
            for t in b.column(0):
                held.append(_buckets(shingles(t.as_py())))
                size += len(held[-1])
                if size > BUCKETS:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(BUCKETS // BLOCK), pa.int64()), "n": pa.array([x.tobytes() for x in total.astype("<u4").reshape(-1, BLOCK)], pa.binary())})

    def add(part: pa.Table) -> pa.Table:
        rows = np.sum([np.frombuffer(x, "<u4").astype(np.int64) for x in part.column("n").to_pylist()], axis=0)
        return pa.table({"block": part.column("block")[:1], "n": pa.array([rows.astype("<i8").tobytes()], pa.binary())})

    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.int64)
    for r in map_batches(texts, count, "block long, n binary").groupBy("block").applyInArrow(add, "block long, n binary").collect():
        out[r["block"]] = np.frombuffer(r["n"], "<i8")
    return out.ravel()


def named_sets(texts: DataFrame, doc_id: T.DataType, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """(doc_id, uid, of, n, fp, sketch, prefix): the set's name, its size, what fingerprint says of
    its hashes (as a signed long), its sketch, and its first shingles in the common order."""
    order = texts.sparkSession.sparkContext.broadcast(_commonness(texts.select("text")))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, marks, sketches, prefixes = [], [], [], [], []
            for t in b.column(2):
                h = shingles(t.as_py())
                names.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sizes.append(len(h))
                marks.append(fingerprint(h))
                sketches.append(sketch(h))
                first = len(h) - -(-NEAR[0] * len(h) // NEAR[1]) + 1
                prefixes.append(h[np.lexsort((h, order.value[_buckets(h)]))[:first]].view(np.int64))
            offsets = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
            values = np.concatenate([*prefixes, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(marks, _U).view(np.int64)), pa.array(sketches, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "uid", "of", "n", "fp", "sketch", "prefix"])

    schema = T.StructType([T.StructField("doc_id", doc_id), T.StructField("uid", T.LongType()), T.StructField("of", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return map_batches(texts.select("doc_id", "uid", "text"), run, schema)


def _enough(common: Column, na: Column, nb: Column) -> Column:
    """Whether so many common shingles make two sets of these sizes similar."""
    return (NEAR[0] + NEAR[1]) * common >= NEAR[0] * (na + nb)


def _possible(a: str, b: str) -> Column:
    """Whether sets whose first common shingle stands at these places can be similar at all.

    A similar pair meets at its first common shingle, so it may be passed by at all later ones.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    most = F.least(c(a, "n") - c(a, "at"), c(b, "n") - c(b, "at"))
    return _enough(most, c(a, "n"), c(b, "n")) & _enough(F.least(c(a, "n"), c(b, "n")), c(a, "n"), c(b, "n"))


def _close(x: str, y: str, na: Column, nb: Column) -> Column:
    """Whether sets of these sizes can be similar by their sketches; similar ones differ in so few hashes."""
    differ = sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(SKETCH // 64)), F.lit(0))
    return (NEAR[0] + NEAR[1]) * differ <= (NEAR[1] - NEAR[0]) * (na + nb)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of uids whose sets are similar, compared in full, as a saved table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in part.column(1)], pa.list_(pa.int64()))], names=["uid", "h"])

    asked = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    sets = scratch.save(map_batches(texts.join(asked, "uid", "left_semi").select("uid", "text"), run, "uid long, h array<long>"), "sets")
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("h").alias("y")), "b")
    near = scratch.save(both.filter(_enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"), "near")
    scratch.drop(sets)
    return near


def similar_links(sets: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs; sets has uid, n, sketch and prefix.

    known: links of similar pairs that were found before; they are among the result.
    """
    postings = sets.select("uid", "n", F.posexplode("prefix").alias("at", "token"))
    one = Window.partitionBy("token")
    # which text the others meet depends on the shingle, so that a group has a few of them
    drawn = F.struct(F.xxhash64("uid", F.pmod("token", F.lit(PIVOTS))).alias("draw"), "uid", "n", "at")
    middle = F.struct("at", drawn.alias("of"))
    met = postings.select("*", F.count("*").over(one).alias("k"), F.min("n").over(one).alias("fewest"), F.min(drawn).over(one).alias("pivot"), F.min(middle).over(one).alias("middle"))
    # a shingle that stands too far back even for the smallest of these sets is nowhere a similar pair's first common one
    possible = met.filter((F.col("k") > 1) & _enough(F.col("n") - F.col("at"), F.col("n"), F.col("fewest")))
    shared = scratch.save(possible.select("token", F.struct("uid", "n", "at").alias("m"), "pivot", F.col("middle.of").alias("middle")), "shared")
    roots = scratch.save(components(known).select(F.col("node").alias("uid"), "root"), "roots")

    def compared(pairs: DataFrame, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The pairs of different components that were compared, all links, and their components."""
        end = lambda name: roots.select(F.col("uid").alias(name), F.col("root").alias(f"root_{name}"))
        apart = pairs.distinct().join(end("a"), "a", "left").join(end("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        tried = scratch.save(apart.select("a", "b"), "tried")
        links = links.unionByName(similar(tried, texts))
        return tried, links, scratch.save(components(links).select(F.col("node").alias("uid"), "root"), "roots")

    def several(roots: DataFrame) -> DataFrame:
        """Rows of the shingles that more than one component shares, with a text of the first and the last of these."""
        of = shared.select("token", "m", F.col("m.uid").alias("uid")).join(roots, "uid", "left").select("token", "m", F.coalesce("root", "uid").alias("root"))
        ends = of.groupBy("token").agg(F.min(F.struct("root", "m.at", "m")).alias("lo"), F.max(F.struct("root", -F.col("m.at"), "m")).alias("hi")).filter("lo.root < hi.root")
        return of.join(ends, "token")

    pair = lambda a, b: (F.least(f"{a}.uid", f"{b}.uid").alias("a"), F.greatest(f"{a}.uid", f"{b}.uid").alias("b"))
    to_pivots = shared.select("m", F.explode(F.array("pivot", "middle")).alias("o")).filter((F.col("m.uid") != F.col("o.uid")) & _possible("m", "o"))
    tried, links, roots = compared(to_pivots.select(*pair("m", "o")), known, roots)
    left = several(roots)
    meets = lambda side: left.select("m", "root", F.col(f"{side}.root").alias("other"), F.col(f"{side}.m").alias("o"))
    to_ends = meets("lo").unionByName(meets("hi")).filter((F.col("root") != F.col("other")) & _possible("m", "o"))
    again, links, roots = compared(to_ends.select(*pair("m", "o")).join(tried, ["a", "b"], "left_anti"), links, roots)
    sketches = sets.select(F.col("uid").alias("of"), "sketch")
    apart = scratch.save(several(roots).select("token", "m", "root").join(sketches, F.col("m.uid") == F.col("of")).drop("of"), "apart")
    other = apart.select("token", F.col("m").alias("o"), F.col("root").alias("other"), F.col("sketch").alias("sketch_o"))
    near = _possible("m", "o") & _close("sketch", "sketch_o", F.col("m.n"), F.col("o.n"))
    pairs = apart.join(other, "token").filter((F.col("root") < F.col("other")) & near).select(*pair("m", "o")).distinct()
    rest = scratch.save(pairs.join(tried.unionByName(again), ["a", "b"], "left_anti"), "rest")
    return links.unionByName(similar(rest, texts))
