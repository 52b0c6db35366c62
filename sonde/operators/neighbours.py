"""Approximate cosine neighbourhoods: random hyperplanes, orderings and exact checks.

Objects are rows of (_id, _vec). Signatures are longs. All orderings are numbered in one
plan: equal permuted signatures are counted, running sums of the counts give each of them its
first position, and ids order the objects within. Pairs that stand close in an ordering meet
through blocks of `band` positions, so each object is dealt out three times for an ordering
instead of `band` times, and no join is without an equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonde.functions import staging
from sonde.functions.shipping import map_batches, runs_of


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Cosine of two vectors with known norms; 0 if either is nothing."""
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def unit(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


class NeighbourhoodGraph:
    """Edges between objects whose cosine reaches a threshold, found near in some ordering."""

    def __init__(self, bits: int = 16, permutations: int = 30, band: int = 30, min_similarity: float = 0.9, seed: int = 42):
        if not 1 <= bits <= 62:
            raise ValueError(f"bits has to be from 1 to 62, not {bits}")
        if permutations < 1 or band < 1:
            raise ValueError("permutations and band have to be positive")
        if not -1 <= min_similarity <= 1:
            raise ValueError(f"{min_similarity} is no cosine")
        self.bits, self.permutations, self.band, self.min_similarity, self.seed = bits, permutations, band, min_similarity, seed

    def planes(self, width: int) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.bits, width))

    def orders(self) -> list[list[int]]:
        """For each ordering, the bit that stands at each place, most significant first."""
        rng = np.random.default_rng(self.seed + 1)
        return [rng.permutation(self.bits).tolist() for _ in range(self.permutations)]

    def signed(self, objects: DataFrame, width: int) -> DataFrame:
        """objects with `_sig`, of which the bit k tells the side of plane k, and `_norm`."""
        planes = F.array(*[F.array(*[F.lit(float(w)) for w in h]) for h in self.planes(width)])
        sides = F.transform(planes, lambda h, k: F.when(dot(F.col("_vec"), h) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
        return objects.withColumn("_sig", F.aggregate(sides, F.lit(0).cast("long"), lambda s, x: s + x)).withColumn("_norm", norm(F.col("_vec")))

    def positions(self, signed: DataFrame) -> DataFrame:
        """(_perm, _id, _pos): the place of each object in each ordering."""
        moved = []
        for p, order in enumerate(self.orders()):
            value = None
            for place, bit in enumerate(order):
                b = F.shiftleft(F.shiftright("_sig", bit).bitwiseAND(F.lit(1).cast("long")), self.bits - 1 - place)
                value = b if value is None else value + b
            moved.append(F.struct(F.lit(p).alias("_perm"), value.cast("long").alias("_key")))
        rows = signed.select("_id", F.explode(F.array(*moved)).alias("m")).select("m._perm", "m._key", "_id")
        # a bucket is one signature and a range of ids, so that none outgrows a task
        rows = rows.withColumn("_range", F.shiftright("_id", 20))
        counts = rows.groupBy("_perm", "_key", "_range").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("_perm").orderBy("_key", "_range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        within = Window.partitionBy("_perm", "_key", "_range").orderBy("_id")
        numbered = rows.withColumn("_k", F.row_number().over(within))
        return numbered.join(offsets, ["_perm", "_key", "_range"]).select("_perm", "_id", (F.col("_before") + F.col("_k") - 1).cast("long").alias("_pos"))

    def candidates(self, signed: DataFrame) -> DataFrame:
        """Distinct (_src, _dst), _src < _dst, at most `band` places apart in some ordering."""
        placed = self.positions(signed)
        block = F.floor(F.col("_pos") / self.band)
        left = placed.withColumn("_block", block)
        right = placed.select("_perm", F.col("_id").alias("_other"), F.col("_pos").alias("_pos2"), F.explode(F.array(block, block - 1)).alias("_block"))
        near = left.join(right, ["_perm", "_block"]).filter((F.col("_pos2") > F.col("_pos")) & (F.col("_pos2") <= F.col("_pos") + self.band))
        pairs = near.select(F.least("_id", "_other").alias("_src"), F.greatest("_id", "_other").alias("_dst"))
        return pairs.filter("_src <> _dst").distinct()

    def similarities(self, candidates: DataFrame, signed: DataFrame) -> DataFrame:
        """(_src, _dst, similarity) of the candidates that reach the threshold."""
        side = lambda name: signed.select(F.col("_id").alias(name), F.col("_vec").alias(f"{name}_v"), F.col("_norm").alias(f"{name}_n"))
        both = candidates.join(side("_src"), "_src").join(side("_dst"), "_dst")
        value = cosine(F.col("_src_v"), F.col("_dst_v"), F.col("_src_n"), F.col("_dst_n"))
        return both.select("_src", "_dst", value.alias("similarity")).filter(F.col("similarity") >= self.min_similarity)

    def edges(self, objects: DataFrame, width: int) -> DataFrame:
        signed = staging.save(self.signed(objects.select("_id", "_vec"), width), "signed")
        return self.similarities(self.candidates(signed), signed)


#: Rows of a block at most, blocks at least (of SMALL rows), and cells of a product that are held at once.
BLOCK, BLOCKS, SMALL = 8192, 8, 256
CELLS = 1 << 22


def _meetings(objects: DataFrame, visit: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """What `visit` makes of all pairs of rows; work grows with the square of the rows.

    Every block of rows meets every other one, and itself, in one cell. A task's cells come one
    after another, sorted. visit takes an iterator over (ids, ids, cosines, which of them count)
    of some rows of a block by a whole other one, and yields batches.
    """
    objects = objects.filter("_vec IS NOT NULL").select("_id", "_vec")
    n = objects.count()
    blocks = max(1, -(-n // block), min(BLOCKS, -(-n // SMALL)))
    own, other = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o")
    cell = (F.least("_b", "_o") * F.lit(blocks).cast("long") + F.greatest("_b", "_o")).alias("_cell")
    dealt = objects.select("*", own).select("*", other).select(cell, "_b", "_id", "_vec")
    dealt = dealt.repartition(min(blocks * (blocks + 1) // 2, 4096), "_cell").sortWithinPartitions("_cell", "_b", "_id")

    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = t.column("_vec").combine_chunks()
        x = x.flatten().to_numpy().astype(np.float64).reshape(len(x), -1)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return t.column("_id").to_numpy(), np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        for t in runs_of(batches):
            cell = t.column("_cell")[0].as_py()
            of = t.column("_b").to_numpy()
            (i, u), (j, v) = (side(t.filter(pa.array(of == k))) for k in (cell // blocks, cell % blocks))
            step = max(1, CELLS // max(1, len(j)))
            for k in range(0, len(i), step):
                some = i[k : k + step]
                yield some, j, u[k : k + step] @ v.T, some[:, None] < j if cell // blocks == cell % blocks else None

    return map_batches(dealt, lambda batches: visit(products(batches)), schema)


def cosine_pairs(objects: DataFrame, min_similarity: float, block: int = BLOCK) -> DataFrame:
    """(_src, _dst, similarity) of all pairs that reach a threshold: the exact graph.

    Work grows with the square of the rows; `NeighbourhoodGraph` is the way for large sets.
    """

    def visit(cells: Iterator) -> Iterator[pa.RecordBatch]:
        for i, j, near, counts in cells:
            hit = near >= min_similarity
            if counts is not None:
                hit &= counts  # a block with itself
            x, y = np.nonzero(hit)
            a, b, value = i[x], j[y], near[x, y]
            for k in range(0, len(a), _PAIRS):
                s = slice(k, k + _PAIRS)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[s], b[s])), pa.array(np.maximum(a[s], b[s])), pa.array(value[s])], names=["_src", "_dst", "similarity"])

    return _meetings(objects, visit, "_src long, _dst long, similarity double", block)


#: Pairs in a batch.
_PAIRS = 1 << 17
#: Leading bits of a cosine by which pairs are counted, pass after pass; the last are all.
_LEVELS, _BITS = (15, 31, 47, 52), 52
#: As many values as this are no longer counted by their bits.
FEW = 1 << 18


def cosine_quantiles(objects: DataFrame, shares: list[float], block: int = BLOCK, few: int = FEW) -> list[float | None]:
    """The exact quantiles of the cosines of all pairs, interpolated between neighbours; None without a pair.

    No pair is kept: a pass counts cosines by their leading bits, and the next one looks only
    at those that share the bits of a rank that is sought, until they are few enough to sort.
    """

    def keys(near: np.ndarray) -> np.ndarray:
        return (np.clip(near + 1, 0, 2) * float(1 << _BITS)).astype(np.int64)

    def counted(level: int, above: int, wanted: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """How many cosines have which leading bits, of those whose first bits `above` are wanted."""

        def visit(cells: Iterator) -> Iterator[pa.RecordBatch]:
            first = np.zeros((1 << (level + 1)) + 1, np.int64) if wanted is None else None
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for _, _, near, counts in cells:
                key = keys(near if counts is None else near[counts]).ravel()
                if wanted is None:
                    first += np.bincount(key >> (_BITS - level), minlength=len(first))
                    continue
                key = key[np.isin(key >> (_BITS - above), wanted)] >> (_BITS - level)
                found.append(np.unique(key, return_counts=True))
                if sum(len(k) for k, _ in found) > few:
                    found = [_summed(found)]
            if wanted is None:
                some = np.flatnonzero(first)
                found = [(some, first[some])]
            if found:
                key, n = _summed(found)
                for k in range(0, len(key), _PAIRS):
                    yield pa.RecordBatch.from_arrays([pa.array(key[k : k + _PAIRS]), pa.array(n[k : k + _PAIRS])], names=["key", "n"])

        rows = _meetings(objects, visit, "key long, n long", block).groupBy("key").agg(F.sum("n").alias("n")).sort("key").toArrow()  # at most 2^16 for each rank, or about `few`
        return rows["key"].to_numpy(), rows["n"].to_numpy()

    level, above = _LEVELS[0], -2
    key, n = counted(level, above, None)
    if not len(key):
        return [None] * len(shares)
    places = [s * (int(n.sum()) - 1) for s in shares]
    rank = {r: (0, 0) for p in places for r in (int(np.floor(p)), int(np.ceil(p)))}  # leading bits, and how many come before them
    while True:
        sizes = {}
        for r, (group, before) in rank.items():
            of = key >> (level - above) == group
            upto = np.cumsum(n[of])
            at = int(np.searchsorted(upto[:-1], r - before, side="right"))
            rank[r] = (int(key[of][at]), before + int(upto[at] - n[of][at]))
            sizes[rank[r][0]] = int(n[of][at])
        if level == _BITS:
            break
        level, above = _BITS if sum(sizes.values()) <= few else _LEVELS[_LEVELS.index(level) + 1], level
        key, n = counted(level, above, sorted(sizes))
    value = {r: group / (1 << _BITS) - 1 for r, (group, _) in rank.items()}
    return [value[int(np.floor(p))] * (np.ceil(p) - p) + value[int(np.ceil(p))] * (p - np.floor(p)) if p % 1 else value[int(p)] for p in places]


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate([n for _, n in found])).astype(np.int64)
