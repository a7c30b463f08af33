"""Token counts of byte-level byte-pair vocabularies, without making the tokens.

A pre-token's bytes form a linked list; a heap holds the ranks of its adjacent pairs. The pair with the lowest
rank (the leftmost of equals) is merged again and again; the count is the number of bytes less the merges, and no
identifiers are put out. Texts are first cut into units (white space, then what follows it up to the next white
space), within which the pre-tokens lie; the counts of distinct units are kept in a bounded cache.

Edge cases: a null text counts as empty and has 0 tokens; texts of any length are read whole in bounded slices;
repeated rows are counted once each; an empty table yields no row; strings of added tokens inside a text count
as one token, as is the library's default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, slices, tidy

#: Fixed value: characters with Unicode's White_Space property, for a character class.
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the pre-token pattern of byte-level vocabularies, with its white space spelt out.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class ByteBpeCounter:
    """Counts for one tokenizers file (byte-level BPE, no normaliser, no prefix space)."""

    def __init__(self, path: str, limit: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or odd or model.get("ignore_merges") or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in printable]
        char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}
        symbol = {char[b]: b for b in range(256)}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            made = symbol.setdefault(left + right, len(symbol))
            self.rank[symbol[left], symbol[right]] = len(self.made)
            self.made.append(made)
        self.pre_token = regex.compile(PRE_TOKEN)
        added = [x["content"] for x in spec["added_tokens"]]
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.added = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.cache = WordCache(lambda units: [self.unit(u) for u in units], limit)

    def pre_token_count(self, data: bytes) -> int:
        n, rank, made = len(data), self.rank, self.made
        symbol = list(data)
        heap = [r * n + i for i, pair in enumerate(zip(symbol, symbol[1:], strict=False)) if (r := rank.get(pair)) is not None]
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j >= n or symbol[i] < 0 or rank.get((symbol[i], symbol[j])) != r:
                continue  # one of the two has been merged meanwhile
            merges += 1
            here = symbol[i] = made[r]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((here, symbol[k]))) is not None:
                    heappush(heap, q * n + i)
            if (h := before[i]) >= 0 and (q := rank.get((symbol[h], here))) is not None:
                heappush(heap, q * n + h)
        return n - merges

    def unit(self, unit: str) -> int:
        return sum(self.pre_token_count(x.encode()) for x in self.pre_token.findall(unit))

    def count(self, texts: list[str]) -> list[int]:
        parts = [(i, p) for i, t in enumerate(texts) for p in (self.added.split(t) if self.added else [t])]
        units = [UNIT.findall(p) for _, p in parts]
        get = self.cache.table(units).__getitem__
        out = [-1 if self.added else 0] * len(texts)  # one added token between two parts
        for (i, _), us in zip(parts, units, strict=True):
            out[i] += sum(map(get, us)) + bool(self.added)
        return out


_counters: dict[str, ByteBpeCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = ByteBpeCounter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            n = [c for _, texts in slices(batch.column(1)) for c in counter.count(texts)]
            sizes = pc.cast(pc.fill_null(pc.binary_length(batch.column(1).cast(pa.large_binary())), 0), pa.int64())
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
