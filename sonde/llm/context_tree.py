"""Language-model scores by context-tree weighting over bytes.

Texts are read as bytes (A-Z in lower case) closed by a zero byte. A byte is eight binary
decisions, each with a tree of its own over the ``DEPTH`` bytes before; a node holds how
often either outcome was seen in its context. The weighted probability of a node is half its
Krichevsky-Trofimov estimate and half the product of its children's, so all depths are mixed,
and what a byte costs follows from the mixture along its path.

Counts come from byte strings of DEPTH + 1 bytes of all training documents, summed with
partial sums; all of them are kept, so the model grows with the corpus. It is never gathered.
Strings are dealt into ``GROUPS`` by the last ``TOP`` bytes of their context, so that a group
holds whole subtrees. Groups first weigh theirs and report only sums for the nodes above, of
which there are less than 256 to the power of TOP; with these everywhere, they then answer
which probability each string of each batch of documents has. A context that was never seen
is scored as the longest part of it that was.

Beside it stands a unigram base with one added to each count. Its counts are not gathered
either: documents lie in batches of about ``BATCH_BYTES``, each batch asks once for
each of its words, and gets back their counts. Words are told apart by 64-bit hashes.

Edge cases: a null or empty text is the end alone; a null id counts as an empty id when
documents are held out; repeated rows train and are scored as often as they stand there; a
table without training documents gives uniform bits and a base of one unknown word; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sonde.functions.shipping import map_batches, release, ship
from sonde.llm import scratch

DEPTH, TOP, GROUPS = 5, 2, 128
#: Strings that a group is asked for in one task, on the average; more are dealt to several tasks.
ASKED = 1_000_000
BATCH_BYTES, PIECE_BYTES = 32_000_000, 2_000_000
FOLDS, HELD_OUT = 7, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = "\n"  # the end's word; no white-space word can be this
_U = np.uint64


# -- the model ------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, by Stirling's series from 8 on."""
    y, shift = np.asarray(x, np.float64).copy(), np.zeros(len(x))
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r / 1680))) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov probability of so many zeros and ones, as a logarithm."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def levels(strings: np.ndarray, n: np.ndarray, top: int = 0, depth: int = DEPTH) -> list[Level]:
    """(key, zeros, ones) of the nodes of each depth from `top` on, keys ascending, from counted strings.

    A key is the context's bytes, the latest last, then a byte that starts with a one and the
    bits decided so far.
    """
    out = []
    for d in range(depth, top - 1, -1):
        if d < depth:
            strings, n = summed(strings & _U((1 << 8 * (d + 1)) - 1), n)
        context, byte = (strings >> _U(8)) << _U(8), strings & _U(255)
        key = np.concatenate([context | (byte >> _U(8 - j)) | _U(1 << j) for j in range(8)])
        one = np.concatenate([(byte >> _U(7 - j)) & _U(1) for j in range(8)]).astype(np.int64) * np.tile(n, 8)
        node, zeros, ones = summed(key, np.tile(n, 8) - one, one)
        out.append((node, zeros, ones))
    return out[::-1]


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, ascending, with sums of its values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _parent(key: np.ndarray, depth: int) -> np.ndarray:
    """The key without the earliest byte of a context of depth + 1 bytes."""
    return ((key >> _U(8) & _U((1 << 8 * depth) - 1)) << _U(8)) | (key & _U(255))


def _node(zeros: np.ndarray, ones: np.ndarray, split: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logarithm of the weighted probability, the estimate of a one and the weight of stopping there."""
    here = log_estimate(zeros, ones)
    whole = here if split is None else np.logaddexp(here, split) - math.log(2)
    stop = np.ones(len(here)) if split is None else np.exp(here - math.log(2) - whole)
    return whole, (ones + 0.5) / (zeros + ones + 1), stop


def weigh(nodes: list[Level], top: int = 0, split: np.ndarray | None = None) -> tuple[list[Level], np.ndarray]:
    """(key, estimate of a one, weight of stopping there) of each depth, and the first depth's logarithms.

    split has what the children of the last depth give together, if it has any.
    """
    out: list = [None] * len(nodes)
    whole = np.zeros(0)
    for k in range(len(nodes) - 1, -1, -1):
        key, zeros, ones = nodes[k]
        if k < len(nodes) - 1:
            split = np.bincount(np.searchsorted(key, _parent(nodes[k + 1][0], top + k)), whole, len(key))
        whole, guess, stop = _node(zeros, ones, split)
        out[k] = (key, guess, stop)
    return out, whole


def log_probabilities(model: list[Level], grams: np.ndarray) -> np.ndarray:
    """log10 of the probability of each string's last byte after those before it.

    grams ascend. Strings that end alike share what shallow contexts say, so each depth is
    looked up once for each distinct end, from the empty context downwards.
    """
    ends, parent = [grams], []
    for d in range(len(model) - 2, -1, -1):
        shorter, inverse = np.unique(ends[-1] & _U((1 << 8 * (d + 1)) - 1), return_inverse=True)
        ends.append(shorter)
        parent.append(inverse)
    ends, parent = ends[::-1], [None, *parent[::-1]]
    total = np.zeros(len(grams))
    for bit in range(8):
        # settled probability, weight that is left, and the estimate and stop of the last node met
        done, left, estimate, stop = np.full(1, 0.5), np.zeros(1), np.zeros(1), np.zeros(1)
        for d, (key, guesses, stops) in enumerate(model):
            end = ends[d]
            if d:
                done, left, estimate, stop = (x[parent[d]] for x in (done, left, estimate, stop))
            else:
                done, left, estimate, stop = (np.repeat(x, len(end)) for x in (done, left, estimate, stop))
            wanted = ((end >> _U(8)) << _U(8)) | ((end & _U(255)) >> _U(8 - bit)) | _U(1 << bit)
            at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            hit = key[at] == wanted if len(key) else np.zeros(len(end), bool)
            at = at[hit]
            share = left * estimate
            done = np.where(hit, done + share * stop, done + share) if d else np.where(hit, 0.0, done)
            left = np.where(hit, left * (1 - stop), 0.0) if d else hit.astype(np.float64)
            estimate, stop = np.zeros(len(end)), np.zeros(len(end))
            estimate[hit], stop[hit] = guesses[at], stops[at]
        p = done + left * estimate
        total += np.log10(np.where((grams >> _U(7 - bit)) & _U(1) == 1, p, 1 - p))
    return total


def grams_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The strings that end at each byte and end of the texts, and where each text's stop."""
    pad = b"\0" * depth
    raw = np.frombuffer(b"".join(part for t in texts for part in (pad, t, b"\0")), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    n = max(0, len(raw) - depth)
    grams = np.zeros(n, _U)
    for k in range(depth + 1):
        grams <<= _U(8)
        grams |= raw[k : k + n]
    between = np.cumsum(size + depth)[:-1, None] - depth + np.arange(depth)  # strings that end before a text
    inside = np.ones(n, bool)
    inside[between] = False
    return grams[inside], np.cumsum(size)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _words(texts: pa.Array) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """The texts in lower case as bytes, all their words, and where each text's words begin and end."""
    lower = [(t or "").encode().translate(_LOWER) for t in texts.to_pylist()]
    lists = pc.ascii_split_whitespace(pa.array(lower, pa.binary()).cast(pa.string()))
    words = lists.flatten()
    real = pc.not_equal(words, "")  # white space at a text's ends leaves nothing behind
    return lower, words.filter(real), np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy()]


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), _U, len(words)).view(np.int64)


# -- the distributed part -------------------------------------------------------------------


_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, rows): documents in compressed pieces of about PIECE_BYTES, numbered by batches of about BATCH_BYTES."""
    number, size = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        if not b.num_rows:
            continue
        upto = size + np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = np.flatnonzero(np.r_[True, np.diff(upto // PIECE_BYTES) > 0])
        for s, e in zip(first.tolist(), [*first[1:].tolist(), b.num_rows], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=_PACKED) as out:
                out.write_batch(b.slice(s, e - s))
            yield pa.RecordBatch.from_arrays([pa.array([number + upto[s] // BATCH_BYTES], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "rows"])
        size = int(upto[-1])


def _documents(rows) -> pa.RecordBatch:
    """One piece of documents (doc_id, text)."""
    return pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _group(strings: np.ndarray) -> np.ndarray:
    """The group of each string, by the last TOP bytes of its context."""
    last = strings >> _U(8) & _U((1 << 8 * TOP) - 1)
    return ((last * _U(40503) & _U(0xFFFF)) >> _U(9)).astype(np.int64)


def _group_column(key: str) -> Column:
    last = F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    return F.shiftright((last * 40503).bitwiseAND(F.lit(0xFFFF)), 9)


def _packed(strings: np.ndarray) -> bytes:
    """Ascending strings as differences, byte planes apart, which compress well."""
    return np.diff(strings, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


_COUNTED = pa.schema([("batch", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("g", pa.int64()), ("asked", pa.binary())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: (batch, key, n) for each word of a batch with its number in training
    documents, (key, n) for strings of training documents, and (batch, g, asked) with all strings."""

    def rows(**columns) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(columns.values())))
        for k in range(0, n, 100_000):
            size = min(100_000, n - k)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][k : k + size], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _COUNTED], schema=_COUNTED)

    def finished(batch: int, words: list, strings: list) -> Iterator[pa.RecordBatch]:
        key, n = summed(*(np.concatenate(p) for p in zip(*words, strict=True)))
        yield from rows(batch=np.full(len(key), batch), key=key, n=n)
        if strings:
            key, n = summed(*(np.concatenate(p) for p in zip(*strings, strict=True)))
            yield from rows(key=key[n > 0].view(np.int64), n=n[n > 0])
            group = _group(key)
            some = np.unique(group)
            for k in range(0, len(some), 16):
                yield from rows(batch=np.full(len(some[k : k + 16]), batch), g=some[k : k + 16], asked=[_packed(key[group == g]) for g in some[k : k + 16]])

    release()
    open_, words, strings = None, [], []
    for b in batches:
        for batch, rows_ in zip(b.column("batch").to_pylist(), b.column("rows"), strict=True):
            if batch != open_ and open_ is not None:
                yield from finished(open_, words, strings)
                words, strings = [], []
                release()
            open_, own = batch, _documents(rows_)
            train = np.array([not held_out(d) for d in own.column(0).to_pylist()], bool)
            lower, every, offsets = _words(own.column(1))
            flat = every.dictionary_encode()
            of = np.repeat(train, np.diff(offsets))
            n = np.bincount(flat.indices.to_numpy()[of], minlength=len(flat.dictionary))
            words.append((np.r_[_hashes(flat.dictionary), _hashes(pa.array([_END]))], np.r_[n, train.sum()].astype(np.int64)))
            for learn in (True, False):
                for part in _pieces([t for t, yes in zip(lower, train, strict=True) if yes == learn]):
                    key, n = np.unique(grams_of(part)[0], return_counts=True)
                    strings.append((key, n.astype(np.int64) * learn))
                    if sum(len(k) for k, _ in strings) > 2_000_000:
                        strings = [summed(*(np.concatenate(p) for p in zip(*strings, strict=True)))]
            if len(words) > 8:
                words = [summed(*(np.concatenate(p) for p in zip(*words, strict=True)))]
    if open_ is not None:
        yield from finished(open_, words, strings)
    del words, strings
    release()


def _pieces(texts: list[bytes], most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _sorted_strings(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return summed(t.column("key").to_numpy().view(_U), t.column("n").to_numpy())


def top_model(strings: DataFrame) -> list[Level]:
    """The weighed nodes above depth TOP, from (g, key, n).

    Groups give sums for the nodes of depth TOP - 1: less than 256 to the power of TOP rows come
    to the driver, whatever the corpus.
    """

    def run(t: pa.Table) -> pa.Table:
        release()
        nodes = levels(*_sorted_strings(t), TOP)
        _, whole = weigh(nodes, TOP)
        key, zeros, ones, split = summed(_parent(nodes[0][0], TOP - 1), nodes[0][1], nodes[0][2], whole)
        return pa.table({"key": pa.array(key.view(np.int64)), "zeros": pa.array(zeros), "ones": pa.array(ones), "split": pa.array(split)})

    sums = strings.groupBy("g").applyInArrow(run, "key long, zeros long, ones long, split double")
    exact = F.sum(F.col("split").cast("decimal(38,12)")).cast("double")  # the same in any order
    rows = sums.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), exact.alias("split")).toArrow()
    key = rows.column("key").to_numpy().view(_U)
    order = np.argsort(key)
    key, zeros, ones, split = key[order], *(rows.column(n).to_numpy()[order] for n in ("zeros", "ones", "split"))
    nodes = [(key, zeros, ones)]
    for d in range(TOP - 2, -1, -1):
        nodes.append(summed(_parent(nodes[-1][0], d), *nodes[-1][1:]))
    return weigh(nodes[::-1], 0, split)[0]


def answers(strings: DataFrame, asked: DataFrame, top, tasks: int) -> DataFrame:
    """(batch, asked, logs): asked (batch, g, asked) with the log10 of each string's probability."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        model = [*top.value, *weigh(levels(*_sorted_strings(left), TOP), TOP)[0]]
        each = [_unpacked(x) for x in right.column("asked").to_pylist()]
        every = np.unique(np.concatenate(each)) if each else np.zeros(0, _U)
        logs = log_probabilities(model, every) if each else np.zeros(0)
        return pa.table({"batch": right.column("batch"), "asked": right.column("asked"), "logs": pa.array([logs[np.searchsorted(every, x)].tobytes() for x in each], pa.binary())})

    salted = strings.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    dealt = asked.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(tasks).cast("long")))
    return salted.groupBy("g", "salt").cogroup(dealt.groupBy("g", "salt")).applyInArrow(run, "batch long, asked binary, logs binary")


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", asked_strings: int = ASKED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = docs.sparkSession
    ship(spark)
    ids = docs.schema[doc_id].dataType
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = scratch.save(map_batches(texts, _batched, "batch long, rows binary"), "texts")
    counted = scratch.save(map_batches(held, _counted, "batch long, key long, n long, g long, asked binary"), "counts")
    strings = counted.filter("batch IS NULL").groupBy("key").agg(F.sum("n").alias("n")).withColumn("g", _group_column("key"))
    strings = scratch.save(strings, "strings")
    top = spark.sparkContext.broadcast(top_model(strings))  # less than 256 to the power of TOP nodes
    asked = counted.filter("asked IS NOT NULL").select("batch", "g", "asked")
    size = asked.agg(F.coalesce(F.sum(F.length("asked")), F.lit(0))).first()[0] // 8
    answered = answers(strings, asked, top, max(1, -(-size // (GROUPS * asked_strings))))

    words = counted.filter("batch IS NOT NULL AND key IS NOT NULL").select("batch", "key", "n")
    sums = scratch.save(words.groupBy("key").agg(F.sum("n").alias("c")), "words")
    n_all, n_kinds = sums.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    known = words.join(sums, "key").select("batch", "key", "c")
    right_rows = known.unionByName(answered, allowMissingColumns=True)
    schema = pa.schema([("doc_id", to_arrow_type(ids)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        of_words = right.filter(pc.is_valid(right.column("key")))
        order = np.argsort(of_words.column("key").to_numpy())
        key, count = of_words.column("key").to_numpy()[order], of_words.column("c").to_numpy()[order]
        of_strings = right.filter(pc.is_valid(right.column("asked")))
        every = np.concatenate([_unpacked(x) for x in of_strings.column("asked").to_pylist()])
        logs = np.concatenate([np.frombuffer(x) for x in of_strings.column("logs").to_pylist()])
        order = np.argsort(every)
        every, logs = every[order], logs[order]
        unit = math.log10(n_all + n_kinds + 1)
        out = []
        for rows in (r for part in left.column("rows").chunks for r in part):
            b = _documents(rows)
            lower, words_, offsets = _words(b.column(1))
            flat = words_.dictionary_encode()
            c = count[np.searchsorted(key, _hashes(flat.dictionary))] if len(flat.dictionary) else np.zeros(0, np.int64)
            end = count[np.searchsorted(key, _hashes(pa.array([_END])))][0]
            per, seen = np.log10(c + 1.0)[flat.indices.to_numpy()], (c > 0)[flat.indices.to_numpy()]
            n = np.diff(offsets).astype(np.int64) + 1
            base = np.array([math.fsum(per[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]) + math.log10(end + 1.0) - n * unit
            n_known = np.diff(np.r_[0, np.cumsum(seen)][offsets]) + int(end > 0)
            fold = [held_out(d) for d in b.column(0).to_pylist()]
            out.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(fold), pa.array(n), pa.array(n_known), pa.array(np.full(len(n), n_all, np.int64)), pa.array(base), pa.array(text_scores(every, logs, lower))], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    spark_schema = T.StructType([T.StructField("doc_id", ids), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    # a task for each batch, however many there are
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held.select("batch").distinct().count())
    left_rows, right_rows = (df.repartition(tasks, "batch") for df in (held, right_rows))
    return left_rows.groupBy("batch").cogroup(right_rows.groupBy("batch")).applyInArrow(run, spark_schema)


def text_scores(every: np.ndarray, logs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """log10 of each text's probability, its end included; every ascends and has all strings of the texts."""
    out = [np.zeros(0)]
    for part in _pieces(texts):
        grams, ends = grams_of(part)
        distinct, inverse = np.unique(grams, return_inverse=True)
        cost = logs[np.searchsorted(every, distinct)][inverse]
        out.append(np.add.reduceat(cost, np.r_[0, ends[:-1]]))
    return np.concatenate(out)


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
