"""Token counts by a finite-state form of a byte-level BPE tokenizer.

Two machines replace the tokenizer:

* the splitter, a table-driven automaton over classes of characters that marks where
  pre-tokens start. Texts are cut into chunks of ``CHUNK`` symbols; all chunks advance side
  by side, each first as a map from every state it may begin in to the state it ends in. The
  maps compose, by a parallel prefix scan, into the state each chunk really begins in, and a
  second pass then gives the marks.
* the counter, a transducer over the bytes of a pre-token whose transitions carry the change
  of the number of tokens that the bytes so far encode to. Its state holds, for every place
  from which a token may still reach on, the token that ends there and how many tokens fewer
  there were; it is compiled from the merges as states are met.

A class is asked of the library itself, once for each code point. Strings of added tokens
stand for themselves, as by the library's default.

Edge cases: a null or empty text has 0 bytes and tokens; null ids, ties, repeated rows and
further columns are passed through or ignored; very long words cost their length; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde.functions.shipping import map_batches

LIMIT = 512
CHUNK = 512
BATCH_BYTES, MOST_STATES, MOST_WORDS = 8_000_000, 300_000, 600_000

# -- the splitter ---------------------------------------------------------------------------

#: Classes: letters (those of contractions apart), numbers, blank, other white space, other, apostrophe, end of a text.
_L, _C, _R, _V, _E, _LL, _N, _B, _W, _O, _Q, _END = range(12)
#: States: nothing open, in letters, numbers, others, an apostrophe that may open a contraction, that with r, v or l, white space that ends with a blank or not.
_NEW, _IN_L, _IN_N, _IN_O, _A, _AR, _AV, _AL, _WB, _WW = range(10)
_LETTERS = (_L, _C, _R, _V, _E, _LL)
_HERE, _BEFORE = 1, 2  # a pre-token starts at this symbol, at the one before


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the marks for each class and state."""
    into = {**dict.fromkeys(_LETTERS, _IN_L), _N: _IN_N, _B: _WB, _W: _WW, _O: _IN_O, _Q: _A}
    going, marks = np.zeros((12, 10), np.uint8), np.zeros((12, 10), np.uint8)
    for state in range(10):
        for c in range(11):
            to, mark = into[c], _HERE
            if (state == _IN_L and c in _LETTERS) or (state == _IN_N and c == _N):
                mark = 0
            elif state == _IN_O and c in (_O, _Q):
                to, mark = _IN_O, 0
            elif state == _A:
                if c == _C:
                    to, mark = _NEW, 0
                elif c in (_R, _V, _LL):
                    to, mark = {_R: _AR, _V: _AV, _LL: _AL}[c], 0
                elif c in (_O, _Q):
                    to, mark = _IN_O, 0
            elif state in (_AR, _AV, _AL):
                if c == (_LL if state == _AL else _E):
                    to, mark = _NEW, 0
                else:  # no contraction: the letter before opens a pre-token
                    mark = _BEFORE | (0 if c in _LETTERS else _HERE)
            elif state in (_WB, _WW):
                if c in (_B, _W):
                    mark = 0
                elif state == _WB:  # the last blank belongs to what follows
                    to, mark = (_IN_O if c == _Q else into[c]), _BEFORE
                else:
                    mark = _BEFORE | _HERE
            going[c, state], marks[c, state] = to, mark
        marks[_END, state] = _BEFORE if state in (_AR, _AV, _AL) else 0
    return going, marks


_GOING, _MARKS = _tables()


def scan(classes: np.ndarray) -> np.ndarray:
    """Marks of all symbols, from the state in which nothing is open."""
    n = len(classes)
    pad = -n % CHUNK
    grid = np.ascontiguousarray(np.r_[classes, np.full(pad, _END, np.uint8)].reshape(-1, CHUNK).T)
    going, marks = _GOING.ravel(), _MARKS.ravel()
    states = _GOING.shape[1]
    grid = grid.astype(np.int16) * states
    maps = np.tile(np.arange(states, dtype=np.uint8)[:, None], (1, grid.shape[1]))
    for k in range(CHUNK):
        maps = going[grid[k] + maps]
        if k % 16 == 15 and len(maps) > 1 and (maps == maps[0]).all():
            maps = maps[:1]  # whatever they began in, all are in the same state by now
    begins = compose(np.broadcast_to(maps, (states, grid.shape[1])))
    out = np.empty(grid.shape, np.uint8)
    state = begins
    for k in range(CHUNK):
        at = grid[k] + state
        out[k] = marks[at]
        state = going[at]
    return out.T.reshape(-1)[:n]


def compose(maps: np.ndarray) -> np.ndarray:
    """The state in which each chunk begins, by a scan that composes maps (state, chunk)."""
    upto, step = maps.copy(), 1
    while step < maps.shape[1]:
        upto[:, step:] = np.take_along_axis(upto[:, step:], upto[:, :-step], 0)
        step *= 2
    return np.r_[np.uint8(_NEW), upto[_NEW, :-1]]


# -- the counter ----------------------------------------------------------------------------


@cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class CountingTransducer:
    """Numbers of tokens of byte strings, by transitions that are compiled as they are met."""

    def __init__(self, model: dict):
        to = _byte_of()
        raw = lambda s: bytes(to[c] for c in s)
        self.token = {raw(s): i for s, i in model["vocab"].items() if all(c in to for c in s)}
        self.text = {i: s for s, i in self.token.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merge = {}
        for rank, (a, b) in enumerate(pairs):
            self.merge.setdefault((self.token[raw(a)], self.token[raw(b)]), (rank, self.token[raw(a) + raw(b)]))
        self.prefixes = {t[:k] for t in self.token for k in range(len(t) + 1)}
        self.valid: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        # a state: for each place that a token may reach on from, (bytes since, token that ends there, tokens fewer than now)
        first = ((b"", -1, 0),)
        self.states, self.number, self.next = [first], {first: 0}, {}

    def _encode(self, data: bytes) -> list[int]:
        ids = [self.token[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            found = [(self.merge[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge]
            if not found:
                break
            (_, new), k = min(found)
            ids[k : k + 2] = [new]
        return ids

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b may come after token a (-1: at the start)."""
        if (a, b) not in self.valid:
            if len(self.valid) > 4 * MOST_STATES:
                self.valid.clear()
            self.valid[a, b] = self._encode(self.text[b]) == [b] if a < 0 else self._follows(-1, b) and self._encode(self.text[a] + self.text[b]) == [a, b]
        return self.valid[a, b]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        now = [(since + bytes((byte,)), last, less) for since, last, less in self.states[state]]
        token, before = next((self.token[s], less) for s, last, less in now if s in self.token and self._follows(last, self.token[s]))
        change = 1 - before
        key = (*[(s, last, less + change) for s, last, less in now if s in self.prefixes], (b"", token, 0))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], change

    def count(self, data: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self._forget()
        state, total, known = 0, 0, self.next
        for b in data:
            step = known.get(state << 8 | b)
            if step is None:
                step = known[state << 8 | b] = self._compile(state, b)
            state = step[0]
            total += step[1]
        return total


class TokenCounter:
    """Numbers of tokens of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or not spec["pre_tokenizer"]["use_regex"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normalizer can be compiled")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.transducer = CountingTransducer(spec["model"])
        self.classes = np.full(0x110000, 255, np.uint8)
        self.words: dict[str, int] = {}

    def _class(self, code: int) -> int:
        c, split = chr(code), self.library.pre_tokenizer.pre_tokenize_str
        if c in "'stmdrvel ":
            return {"'": _Q, "r": _R, "v": _V, "e": _E, "l": _LL, " ": _B}.get(c, _C)
        return next((k for probe, k in (("a", _L), ("1", _N), ("!", _O)) if len(split(probe + c)) == 1), _W)

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        got = self.classes[codes]
        if (got == 255).any():
            for code in np.unique(codes[got == 255]).tolist():
                self.classes[code] = self._class(code)
            got = self.classes[codes]
        return got

    def _count_words(self, words: list[str]) -> np.ndarray:
        known, count = self.words, self.transducer.count
        if len(known) > MOST_WORDS:
            known.clear()
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            n = known.get(w)
            if n is None:
                n = count(w.encode())
                if len(w) <= 64:
                    known[w] = n
            out[k] = n
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, of, extra = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if self.added is not None and self.added.search(text):
                pieces = self.added.split(text)
                extra[k] = len(pieces) - 1
            else:
                pieces = (text,)
            for p in pieces:
                if p:
                    parts.append(p)
                    of.append(k)
        if not parts:
            return extra
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        symbols = np.insert(self._classes(codes), ends, _END)
        width = np.insert(((codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000) + 1), ends, 0)
        marks = scan(symbols)
        starts = (marks & _HERE) > 0
        starts[:-1] |= (marks[1:] & _BEFORE) > 0
        at = np.flatnonzero(starts)
        upto = np.cumsum(width, dtype=np.int64)
        offsets = np.r_[upto[at] - width[at], upto[-1]].astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(joined.encode())).dictionary_encode()
        per_word = self._count_words(words.dictionary.to_pylist())[words.indices.to_numpy()]
        sums = np.r_[0, np.cumsum(per_word)]
        last = np.searchsorted(at, ends + np.arange(len(ends)))
        return extra + np.bincount(of, sums[last] - sums[np.r_[0, last[:-1]]], len(texts)).astype(np.int64)


@cache
def _counter(path: str) -> TokenCounter:
    """One for each worker process, so that later tasks find what earlier ones compiled."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit."""
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in batches:
            texts = pc.fill_null(b.column(len(others)), "")
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            total, begin = np.cumsum(size), 0
            counted = []
            while begin < b.num_rows:
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + BATCH_BYTES, side="right")))
                counted.append(counter.counts(texts.slice(begin, end - begin).to_pylist()))
                begin = end
            n = np.concatenate([*counted, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size), pa.array(n), pa.array(n > limit)], names=[*others, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(*others, F.col(text)), run, schema)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), byte_bpe())
