"""Token ids in a content-addressed store.

Texts become ids by a public tokenizer. A rolling hash over the last ``ROLL`` ids cuts each
document's ids into chunks, so that equal passages give equal chunks wherever they stand. A
chunk is named by the SHA-256 of its ids and stored once; a document is a recipe, the names
of its chunks in order under a Merkle root; a manifest ties ranges of recipes together.

The store's folder holds three Parquet tables:
  packs     a row for each chunk: digest, n_ids, ids (little-endian, 2 bytes an id where all
            fit, else 4); and the documents' recipes as they came, without a start
  recipes   doc_id, start, n_tokens, root, digests, sizes; in ascending doc_id order
  manifest  first and last doc_id, documents, ids and Merkle root of each range of recipes

The tokenizer in use never joins characters over ASCII white space, so each distinct word of
a batch is encoded once by the library and its ids are laid out by array operations.

Edge cases: a null or empty text has the end id alone; doc_ids have to be numbers; null ones come first; rows with
equal ids are separate documents in a fixed order; further columns are ignored; an empty
table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions.shipping import map_batches
from sonde.llm import scratch
from sonde.llm.running import running_sums

END_ID = 1
ROLL, CUT_BITS, LONGEST = 16, 10, 8192
BATCH_BYTES, KNOWN_WORDS, SEEN_CHUNKS = 8_000_000, 800_000, 100_000
_MARK = "\x00"
#: Letters whose lower case is one letter and that no composition changes, and ASCII signs
#: (no apostrophe, which may open a contraction) behind them. Under the steps that _COMMON
#: lists, both are encoded apart.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
_COMMON = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class WordEncoder:
    """Ids of texts, by the ids of their white-space words.

    A word of plain letters, as most are, is taken apart into its letters in lower case and the
    signs behind them, which the general rules would do as well. Parts and all other words are
    kept with their ids from one batch to the next, up to known_words of them.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        self.known_words = known_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = None
        parts = (self.whole.normalizer, self.whole.pre_tokenizer)
        if all(parts) and tuple(json.loads(p.__getstate__()) for p in parts) == _COMMON:
            self.bare = Tokenizer(self.whole.model)  # the same model, not a copy
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.whole.encode(f"a {_MARK} a", add_special_tokens=False).ids
        self.mark = mark[1] if len(mark) == 3 else None
        self._forget()

    def _forget(self) -> None:
        # ids of part k stand from ends[k] to ends[k + 1]; the first two parts are the end id and nothing
        self.parts: dict[str, int] = {}
        self.others: dict[str, int] = {}
        self.pool, self.ends = np.array([END_ID], np.uint32), np.array([0, 1, 1], np.int32)

    def _encoded(self, tokenizer, words: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids and their numbers for each word; many words are given at once, with marks between."""
        each = lambda part: [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        ids, length = [], []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            got = each([f" {_MARK} ".join([*part, ""])])[0]
            ends = np.flatnonzero(got == self.mark)
            if self.mark is None or len(ends) != len(part):  # a word gives the mark's id: each for itself
                alone = each(part)
                ids += alone
                length += map(len, alone)
            else:
                ids.append(np.delete(got, ends))
                length += (np.diff(np.r_[-1, ends]) - 1).tolist()
        return ids, length

    def _places(self, words: pa.Array, known: dict[str, int], tokenizer) -> np.ndarray:
        """The number of each word's ids; new words are encoded and added."""
        coded = words.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        found = list(map(known.get, texts))
        new = [w for w, at in zip(texts, found, strict=True) if at is None]
        if new:
            ids, length = self._encoded(tokenizer, new)
            places = range(len(self.ends) - 1, len(self.ends) - 1 + len(new))
            known.update(zip(new, places, strict=True))
            self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(length, dtype=np.int32)].astype(np.int32)
            self.pool = np.concatenate([self.pool, *ids])
            added = iter(places)
            found = [next(added) if at is None else at for at in found]
        return np.array(found, np.int32)[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end id, and where each text's ids end."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        if len(self.parts) + len(self.others) > self.known_words:
            self._forget()
        words = coded.dictionary
        place = np.ones((len(words), 2), np.int32)
        apart = pc.extract_regex(words, _PLAIN) if self.bare is not None else pa.nulls(len(words), pa.struct([("letters", pa.string()), ("signs", pa.string())]))
        plain = pc.is_valid(apart).to_numpy(zero_copy_only=False)
        some = apart.filter(pc.is_valid(apart))
        signs = some.field("signs").dictionary_encode()
        place[plain, 0] = self._places(pc.utf8_lower(some.field("letters")), self.parts, self.bare)
        of_signs = np.array([1 if not t else self._places(pa.array([t]), self.parts, self.bare)[0] for t in signs.dictionary.to_pylist()], np.int32)
        place[plain, 1] = of_signs[signs.indices.to_numpy()]
        place[~plain, 0] = self._places(words.filter(pc.is_null(apart)), self.others, self.whole)
        offsets = lists.offsets.to_numpy()
        word = np.insert(place[coded.indices.to_numpy()], offsets[1:], (0, 1), axis=0).ravel()
        ids = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.pool)).take(pa.array(word)).flatten().to_numpy()
        upto = np.cumsum(np.diff(self.ends)[word], dtype=np.int64)[1::2]
        return ids, upto[offsets[1:] + np.arange(len(texts))]


@cache
def _encoder(path: str, known_words: int) -> WordEncoder:
    """One for each worker process, so that later tasks know the words of earlier ones."""
    return WordEncoder(path, known_words)


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end: at documents' ends and where the hash of the last ids says so."""
    gear = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    gear ^= gear >> np.uint64(29)
    gear *= np.uint64(0xBF58476D1CE4E5B9)
    rolled = gear.copy()
    for k in range(1, ROLL):
        rolled[k:] += gear[:-k] << np.uint64(k)
    hit = (rolled >> np.uint64(64 - CUT_BITS)) == 0
    begin = np.r_[0, ends[:-1]][: len(ends)].astype(np.int64)
    early = np.minimum(begin[:, None] + np.arange(ROLL - 1), ends[:, None] - 1)
    hit[np.unique(early)] = False  # the window would reach into another document
    hit[1:] &= ~hit[:-1]  # in a run of equal ids, only its first
    at = np.union1d(np.flatnonzero(hit) + 1, ends[ends > begin])
    size = np.diff(np.r_[0, at])
    if len(size) and size.max() > LONGEST:
        more = [np.arange(a - s + LONGEST, a, LONGEST) for a, s in zip(at[size > LONGEST], size[size > LONGEST], strict=True)]
        at = np.union1d(at, np.concatenate(more))
    return at


def merkle_root(digests: list[bytes]) -> bytes:
    """The root over digests in order; that of none is the SHA-256 of nothing."""
    if not digests:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() for k in range(0, len(level), 2)]
    return level[0]


def pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


_STAGED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("uid", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType()),
        T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("digest", T.BinaryType()), T.StructField("n_ids", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    ]
)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about BATCH_BYTES of text, of a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + BATCH_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _stage(path: str, known_words: int = KNOWN_WORDS):
    """Rows of two kinds: a document's recipe, and a chunk that the task has not given before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(path, known_words), set()
        schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("digest", pa.binary()), ("n_ids", pa.int32()), ("ids", pa.binary())])
        for piece in (p for b in batches for p in _slices(b, 2)):
            ids, ends = encoder.encode(piece.column(2))
            at = cuts(ids, ends)
            wide = ids.astype("<u4").tobytes()
            begin = np.r_[0, at[:-1]]
            names = [hashlib.sha256(wide[4 * a : 4 * b]).digest() for a, b in zip(begin.tolist(), at.tolist(), strict=True)]
            last = np.searchsorted(at, ends, side="right")
            first = np.r_[0, last[:-1]]
            digests = [names[a:b] for a, b in zip(first, last, strict=True)]
            sizes = [(at[a:b] - begin[a:b]).astype(np.int32) for a, b in zip(first, last, strict=True)]
            n, none = piece.num_rows, pa.nulls
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), piece.column(1), pa.array(ends - np.r_[0, ends[:-1]], pa.int64()), pa.array([merkle_root(d) for d in digests], pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), none(n, pa.binary()), none(n, pa.int32()), none(n, pa.binary())], schema=schema)
            if len(seen) > SEEN_CHUNKS:
                seen.clear()
            new = [k for k, d in enumerate(names) if d not in seen and not seen.add(d)]
            n = len(new)
            yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.list_(pa.binary())), none(n, pa.list_(pa.int32())), pa.array([names[k] for k in new], pa.binary()), pa.array([int(at[k] - begin[k]) for k in new], pa.int32()), pa.array([pack(ids[begin[k] : at[k]]) for k in new], pa.binary())], schema=schema)

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with equal digests lie in one task, at most one from each writer; one of them stays."""
    seen: set[bytes] = set()
    for b in batches:
        keep = [k for k, d in enumerate(b.column("digest").to_pylist()) if d is None or (d not in seen and not seen.add(d))]
        yield b if len(keep) == b.num_rows else b.take(pa.array(keep, pa.int64()))


def write_store(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", known_words: int = KNOWN_WORDS) -> None:
    """Writes the store of all rows of docs to a new folder `path`.

    known_words bounds what a worker remembers: more costs memory, fewer cost time.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    staged = map_batches(rows, _stage(tokenizer, known_words), _STAGED)
    dealt = staged.repartition(parts, F.coalesce("digest", F.col("uid").cast("string").cast("binary")))
    written = map_batches(dealt, _first_of_each, _STAGED).write.option("compression", "lz4").option("parquet.enable.dictionary", "false")
    written.parquet(f"{path}/packs")
    recipes = spark.read.schema(_STAGED).parquet(f"{path}/packs").filter("digest IS NULL").select("doc_id", "uid", "n_tokens", "root", "digests", "sizes")
    placed = running_sums(recipes, ["doc_id", "uid"], {"start": "n_tokens"})
    ordered = placed.repartitionByRange(parts, "start", "uid").sortWithinPartitions("start", "uid")
    ordered.select("doc_id", "start", "n_tokens", "root", "digests", "sizes").write.option("compression", "zstd").parquet(f"{path}/recipes")
    spark.read.parquet(f"{path}/recipes").transform(_manifest).write.parquet(f"{path}/manifest")


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n_ids, ids) of each stored chunk."""
    return spark.read.schema(_STAGED).parquet(f"{path}/packs").filter("digest IS NOT NULL").select("digest", "n_ids", "ids")


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row for each range of the recipes: bounds, sums and the Merkle root of their roots."""
    schema = T.StructType([T.StructField("first_start", T.LongType()), T.StructField("first_doc", T.LongType()), T.StructField("last_doc", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                b = b.sort_by("start")
                ids = [x for x in b.column(0).to_pylist() if x is not None]
                yield pa.RecordBatch.from_pydict({"first_start": [b.column(1)[0].as_py()], "first_doc": [min(ids, default=None)], "last_doc": [max(ids, default=None)], "n_docs": [b.num_rows], "n_tokens": [pc.sum(b.column(2)).as_py()], "root": [merkle_root(b.column(3).to_pylist())]}, schema=pa.schema([("first_start", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]))

    return map_batches(recipes.select("doc_id", "start", "n_tokens", "root"), run, schema)


# -- reading back ---------------------------------------------------------------------------


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


@cache
def _doubled(k: int) -> tuple[int, ...]:
    """What 2**k zero bits do to a CRC-32 register, as a matrix over single bits."""
    if k == 0:
        return (0xEDB88320, *[1 << i for i in range(31)])
    half = _doubled(k - 1)
    return tuple(_times(half, row) for row in half)


@lru_cache(65536)
def _zeros(n_bytes: int) -> tuple[int, ...]:
    out, bits, k = tuple(1 << i for i in range(32)), n_bytes * 8, 0
    while bits:
        if bits & 1:
            out = tuple(_times(_doubled(k), row) for row in out)
        bits >>= 1
        k += 1
    return out


def crc_joined(first: int, second: int, n_bytes: int) -> int:
    """The CRC-32 of two strings in a row, from theirs and the second one's length."""
    return _times(_zeros(n_bytes), first) ^ second


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(digest, crc) of each stored chunk, read back and held against its name."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("crc", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, crcs = b.column(0).to_pylist(), []
            for name, n, data in zip(names, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = unpack(data, n).tobytes()
                if len(ids) != 4 * n or hashlib.sha256(ids).digest() != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crcs, pa.int64())], names=["digest", "crc"])

    return map_batches(stored_chunks(spark, path), run, schema)


def _check_totals(recipes: DataFrame, manifest: DataFrame) -> None:
    """Stops unless there are as many recipes and ids as the manifest says."""
    total = lambda df, n: tuple(df.agg(n, F.coalesce(F.sum("n_tokens"), F.lit(0))).first())
    have, want = total(recipes, F.count("*")), total(manifest, F.coalesce(F.sum("n_docs"), F.lit(0)))
    if have != want:
        raise ValueError(f"the store has {have[0]} recipes of {have[1]} ids, its manifest {want[0]} of {want[1]}")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document.

    Chunks are read and verified; a document's CRC is joined from those of its chunks, and its
    Merkle root is built again from the names under which they were found.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    _check_totals(recipes, spark.read.parquet(f"{path}/manifest"))
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode(F.arrays_zip("digests", "sizes")).alias("at", "c"))
    # a chunk that the store lacks stays as a null and stops the reading
    found = parts.select("doc_id", "start", "n_tokens", "root", "at", F.col("c.digests").alias("digest"), F.col("c.sizes").alias("size")).join(chunk_sums(spark, path), "digest", "left")
    # a document has an id at least, so that its start is its own
    docs = found.groupBy("start").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("root").alias("root"), F.sort_array(F.collect_list(F.struct("at", "size", "crc", "digest"))).alias("c"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for start, n, root, got in zip(b.column("start").to_pylist(), b.column("n_tokens").to_pylist(), b.column("root").to_pylist(), b.column("c").to_pylist(), strict=True):
                if any(x["crc"] is None for x in got) or sum(x["size"] for x in got) != n or merkle_root([x["digest"] for x in got]) != root:
                    raise ValueError(f"the document at {start} cannot be put together")
                crc = 0
                for x in got:
                    crc = crc_joined(crc, x["crc"], 4 * x["size"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(docs, run, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) with each document's ids as little-endian 4-byte numbers."""
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("ids", T.BinaryType())])

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unpack(d, n).tobytes() for n, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.binary())], names=["digest", "ids"])

    chunks = map_batches(stored_chunks(spark, path), wide, schema)
    whole = parts.join(chunks, "digest").groupBy("start").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("c"))
    return whole.select("doc_id", "start", F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def tokenized(docs: DataFrame, tokenizer: str, path: str | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """Writes docs to a store (by default in the shared folder) and reads its digests back."""
    spark = docs.sparkSession
    path = path or scratch.new_path(spark, "token-store")
    write_store(docs, path, tokenizer, known_words=known_words)
    return read_digests(spark, path)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenized(docs, word_bpe())
