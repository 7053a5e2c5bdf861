"""Encoding of texts with a public byte-level BPE vocabulary.

Batched numpy merge rounds. The words of many texts lie in one flat array of
symbols. A round looks up every adjacent pair by binary search over the sorted
pair keys of the vocabulary, finds each word's lowest rank and joins all pairs
of that rank at once; words without a known pair are done. A pair's rank is the
id of what it makes, and what contains a symbol ranks above it, so joining
equal pairs together gives the same as one at a time.

Words repeat, so a task remembers the ids of words it has met (bounded).
Defined results: null and empty texts have an empty list; special tokens'
strings are ordinary text; any text length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..runtime import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published rule for cutting a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int64).max
#: Bytes of the largest vocabulary file that is sent to the tasks.
LARGEST = 64 << 20
#: Words remembered per task.
MEMO = 200_000


class Vocabulary:
    """Ranks as arrays: byte symbols and the sorted keys of joinable pairs."""

    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, made = [], []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.word = regex.compile(WORDS)

    def _ranks(self, symbols: np.ndarray) -> np.ndarray:
        pairs = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.made[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_s, done_o = [], []
        while len(symbols):
            rank = self._ranks(symbols) if len(symbols) > 1 else np.empty(0, np.int64)
            rank = np.append(np.where(owner[1:] == owner[:-1], rank, _NONE), _NONE)
            starts = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
            sizes = np.diff(np.append(starts, len(symbols)))
            low = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = low != _NONE
            if not open_.all():
                done_s.append(symbols[~open_])
                done_o.append(owner[~open_])
                symbols, owner, rank, low = symbols[open_], owner[open_], rank[open_], low[open_]
                if not len(symbols):
                    break
            join = rank == low
            # of overlapping equal pairs (a a a) every second one is joined, from the left
            prev = np.concatenate(([False], join[:-1]))
            if (join & prev).any():
                first = np.flatnonzero(join & ~prev)
                where = np.flatnonzero(join)
                begin = first[np.searchsorted(first, where, "right") - 1]
                join = np.zeros(len(join), bool)
                join[where[(where - begin) % 2 == 0]] = True
            symbols = np.where(join, low, symbols)
            keep = np.ones(len(symbols), bool)
            keep[1:] = ~join[:-1]
            symbols, owner = symbols[keep], owner[keep]
        if not done_s:
            return [[] for _ in words]
        owner, symbols = np.concatenate(done_o), np.concatenate(done_s)
        order = np.argsort(owner, kind="stable")
        flat = symbols[order].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str | None], memo: dict[str, list[int]] | None = None) -> list[list[int]]:
        memo = {} if memo is None else memo
        find = self.word.findall
        cut = [find(t) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({w for words in cut for w in words})
        if new:
            memo.update(zip(new, self.encode_words([w.encode("utf-8", "replace") for w in new])))
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += memo[w]
            out.append(ids)
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


_BUILT: dict[str, Vocabulary] = {}


def _built(key: str, data: Callable[[], bytes]) -> Vocabulary:
    if key not in _BUILT:
        _BUILT[key] = Vocabulary(data())
    return _BUILT[key]


#: Texts and characters cut into words at a time.
_TEXTS, _CHARS = 512, 2_000_000


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY, ids_as: str = "ids") -> DataFrame:
    """``id_col`` and the list of token ids, one row per row of ``df``. No shuffle.
    The driver reads the vocabulary, of at most ``LARGEST`` bytes, and sends it to
    the tasks; a worker process builds its tables once."""
    with open(path, "rb") as f:
        data = f.read(LARGEST + 1)
    if len(data) > LARGEST:
        raise ValueError(f"a vocabulary of more than {LARGEST} bytes")
    sent, key = df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, memo = _built(key, lambda: sent.value), {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and hi - lo < _TEXTS and (hi == lo or chars + len(texts[hi] or "") <= _CHARS):
                    chars += len(texts[hi] or "")
                    hi += 1
                ids = voc.encode(texts[lo:hi], memo)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["_id", "ids"])
                lo = hi

    return spread(src).mapInArrow(encode, f"_id {kind}, ids array<int>").select(F.col("_id").alias(id_col), F.col("ids").alias(ids_as))
