"""SentencePiece BPE encoding and decoding with numpy.

All distinct words of a slice of texts form one flat array of symbols. In each round the best score of a word's
adjacent pairs is taken by a segmented minimum of ranks, the leftmost pair with it is merged in all words at
once, and the arrays are compacted; words without a mergeable pair leave. That is the library's order of
merges: the best score first, of equals the leftmost. Words of more than ``LONG`` symbols, for which rounds
would be many, are merged by a heap in the same order.

A word starts at a run of white space marks; no piece of the vocabulary crosses such a border (checked when a
model is loaded), so words can be encoded one by one. Characters outside the vocabulary become byte pieces.

Edge cases: a null text is empty and has no ids; repeated rows yield a row each; an empty table yields no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, slices, tidy

MARK = "▁"
LONG = 256
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NEVER = np.iinfo(np.int32).max


class PieceModel:
    """One BPE model file of the sentencepiece library, with byte pieces and no other normalisation than marks."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        probe = "  a  b\tﬁ ć  "
        if sp.normalize(probe) != self.marked(probe):
            raise ValueError(f"{path} normalises texts in a way that is not supported")
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError(f"{path} has no byte pieces")
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {self.pieces[i]: i for i in usual}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
            raise ValueError(f"{path} has pieces with white space inside")
        score = np.array([sp.get_score(i) for i in range(n)])
        # Dense ranks of scores; equal scores have equal ranks.
        rank = np.zeros(n, np.int32)
        rank[usual] = np.unique(-score[usual], return_inverse=True)[1]
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None:
                    pairs[a * n + b] = i
        self.n, self.ids = n, ids
        self.key = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.key.tolist()], np.int32)
        self.order = rank[self.made]
        self.pair = {k: (int(r), int(m)) for k, r, m in zip(self.key.tolist(), self.order, self.made, strict=True)}
        #: Of code points: the piece, or a negative number that stands for the code point itself.
        self.char = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.text = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.byte = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.cache = WordCache(self._fill, limit)

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.n + b, -1)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        hit = self.key[at] == key
        return np.where(hit, self.order[at], NEVER), np.where(hit, self.made[at], -1)

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, number of symbols of each word) of words that are not empty."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        symbol = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbol, done_word = [], []

        def last_of(word):
            return np.append(word[1:] != word[:-1], True)

        rank, made = self._ranks(symbol, np.append(symbol[1:], -1))
        rank[last_of(word)] = NEVER
        while len(symbol):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(start, len(word)))
            best = np.minimum.reduceat(rank, start)
            over = np.repeat(best == NEVER, size)
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
                left = ~over
                symbol, word, rank, made = symbol[left], word[left], rank[left], made[left]
                size, best = size[best != NEVER], best[best != NEVER]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]  # the leftmost of each word
            symbol[at] = made[at]
            alive = np.ones(len(symbol), bool)
            alive[at + 1] = False
            at -= np.arange(len(at))  # where the merged symbols are after the second ones have gone
            symbol, word, rank, made = symbol[alive], word[alive], rank[alive], made[alive]
            before = at[at > 0] - 1
            new = np.concatenate([at, before])
            after = np.minimum(new + 1, len(symbol) - 1)
            r, m = self._ranks(symbol[new], symbol[after])
            r[(word[after] != word[new]) | (after == new)] = NEVER
            rank[new], made[new] = r, m
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def merge_heap(self, word: str) -> list[int]:
        """Symbols of one long word, merged in the same order."""
        symbol = self.char[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n, pair, size = len(symbol), self.pair, self.n
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def look(i, j):
            if symbol[i] >= 0 and symbol[j] >= 0 and (x := pair.get(symbol[i] * size + symbol[j])):
                return (x[0], i, x[1], symbol[i], symbol[j])
            return None

        heap = [x for i in range(n - 1) if (x := look(i, i + 1))]
        heapify(heap)
        gone = [False] * n
        while heap:
            _, i, made, a, b = heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], gone[j] = made, True
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if x := look(i, k):
                    heappush(heap, x)
            if (h := before[i]) >= 0 and (x := look(h, i)):
                heappush(heap, x)
        return [s for s, g in zip(symbol, gone, strict=True) if not g]

    def _ids(self, symbols: list[int]) -> list[int]:
        if min(symbols) >= 0:
            return symbols
        return [x for s in symbols for x in ([s] if s >= 0 else [self.byte_id[b] for b in chr(-1 - s).encode()])]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i in set(range(len(words))).difference(short):
            out[i] = self._ids(self.merge_heap(words[i]))
        symbols, sizes = self.merge_rounds([words[i] for i in short])
        symbols, end = symbols.tolist(), 0
        for i, k in zip(short, sizes.tolist(), strict=True):
            out[i] = self._ids(symbols[end : end + k])
            end += k
        return out

    def _fill(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each word: ids in decimal, joined by commas; its decoded bytes."""
        return [(",".join(map(str, ids)).encode(), self._bytes(ids)) for ids in self.encode_words(words)]

    @staticmethod
    def words(text: str) -> list[str]:
        """A text's words; joined they are the marked text."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return WORD.findall(PieceModel.marked(text))
        return [MARK + w for w in text.split(" ")]

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        return [i for ids in (self.encode_words(words) if words else []) for i in ids]

    def _bytes(self, ids: list[int]) -> bytes:
        byte, text = self.byte, self.text
        return b"".join(bytes((byte[i],)) if i in byte else text[i] for i in ids)

    def decode(self, ids: list[int]) -> str:
        """As the library: the first mark is dropped, each byte outside valid UTF-8 becomes U+FFFD."""
        out, run, first = [], bytearray(), True

        def flush():
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode() + "�")
                    del run[: e.start + 1]

        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                first = False
                continue
            flush()
            t = self.text[i].decode()
            if first and i not in self.control:
                t = t[1:] if self.pieces[i].startswith(MARK) else t
                first = False
            out.append(t)
        flush()
        return "".join(out)


_models: dict[str, PieceModel] = {}


def piece_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _models:
            _models[model] = PieceModel(model)
        m = _models[model]
        for batch in batches:
            n, a, b = [], [], []
            for _, texts in slices(batch.column(1)):
                words = [m.words(t) for t in texts]
                get = m.cache.table(words).__getitem__
                for ws in words:
                    found = list(map(get, ws))
                    ids, text = b",".join([x for x, _ in found]), b"".join([x for _, x in found])
                    n.append(ids.count(b",") + 1 if ids else 0)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(text[1:]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, model: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with a column of ids (array of int); a column of that name is replaced."""
    return _with(docs, model, text_col, to, "array<int>", lambda m, xs: [m.encode(x or "") for x in xs])


def decode_column(docs: DataFrame, model: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with a column of decoded text; null ids count as none."""
    return _with(docs, model, ids_col, to, "string", lambda m, xs: [m.decode(x or []) for x in xs])


def _with(docs: DataFrame, model: str, column: str, to: str, kind: str, f) -> DataFrame:
    @F.pandas_udf(kind)
    def udf(xs: pd.Series) -> pd.Series:
        if model not in _models:
            _models[model] = PieceModel(model)
        return pd.Series(f(_models[model], [x if isinstance(x, str) else None if x is None else list(x) for x in xs]), dtype=object)

    return docs.withColumn(to, udf(F.col(column)))
