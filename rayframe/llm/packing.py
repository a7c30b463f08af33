"""Packing of token sequences by vector bin packing with the dot-product heuristic.

An item has three sizes: tokens, segments (one each) and loss-bearing tokens. A bin (a training sequence)
has a limit on each. Of the items held (a bounded lookahead), the one that fits and whose sizes have the
largest dot product with the open bin's remaining room goes in next. Where none fits, the item of which most
can be placed is cut and its first part fills the bin; items that may not be cut leave the bin as it is.

Each input partition is packed by itself while it streams, so nothing is shuffled and a lost task can be run
again alone. What is left open at the end of a partition is cut into runs whose lengths are powers of two,
which need no padding.

Edge cases: a null text is empty and yields the end token alone; repeated rows are packed once each; an empty
table yields no piece; long documents are cut; equal scores go to the item in the first place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, tidy

#: Bytes of text whose distinct words are encoded together.
BATCH_BYTES = 12 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments, loss-bearing tokens. ``lookahead``: items held to choose from."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096
    lookahead: int = 256


class VectorPacker:
    """Packs a stream of items; ``add`` and ``close`` return the placed pieces of bins that closed.

    An item is (key, length, loss): ``loss`` of its ``length`` tokens bear loss, the last ones (prompt first,
    answer after it), which is how a cut shares them out. A placed piece is (key, start, length, loss, bin
    number, offset). With ``cut=False`` an item beyond the limits raises ValueError.
    """

    def __init__(self, limits: Limits, cut: bool = True):
        if min(limits.tokens, limits.segments, limits.loss, limits.lookahead) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.cut = limits, cut
        self.limit = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        self.size = np.zeros((limits.lookahead, 3), np.int64)  # of the held items; zeros: a free place
        self.item: list = [None] * limits.lookahead  # (key, start)
        self.free = list(range(limits.lookahead))[::-1]
        self.count = 0
        self._open()

    def _open(self) -> None:
        self.room, self.pieces = self.limit.copy(), []

    def add(self, key, length: int, loss: int) -> list:
        if not self.cut and (length > self.limits.tokens or loss > self.limits.loss):
            raise ValueError(f"item {key!r} is larger than a sequence and may not be cut")
        if not length:
            return []
        place = self.free.pop()
        self.size[place], self.item[place] = (length, 1, loss), (key, 0)
        out: list = []
        while not self.free:
            out += self._step()
        return out

    def _take(self, place: int, length: int, loss: int) -> None:
        """Puts the first ``length`` tokens of a held item into the open bin."""
        key, start = self.item[place]
        self.pieces.append((key, start, length, loss, self.count, int(self.limit[0] - self.room[0])))
        self.room -= (length, 1, loss)
        self.size[place] -= (length, 0, loss)
        if self.size[place, 0]:
            self.item[place] = (key, start + length)
        else:
            self.size[place], self.item[place] = 0, None
            self.free.append(place)

    def _step(self) -> list:
        """Places one item, or fills and closes the open bin."""
        fits = (self.size[:, 0] > 0) & (self.size <= self.room).all(1)
        if fits.any():
            # Sizes and room as shares of the limits, so that no dimension outweighs another by its unit.
            score = np.where(fits, (self.size / self.limit) @ (self.room / self.limit), -1.0)
            place = int(score.argmax())
            self._take(place, int(self.size[place, 0]), int(self.size[place, 2]))
            if self.room.min() > 0 or (self.room[0] and self.room[1] and not self.size[:, 2].any()):
                return []
        elif self.cut and self.room[0] and self.room[1] and self.size[:, 0].any():
            length, _, loss = self.size.T
            # A prefix of n tokens bears max(0, n - (length - loss)) of them: as long as tokens and loss allow.
            n = np.minimum(np.minimum(self.room[0], length), length - loss + self.room[2])
            place = int(n.argmax())
            if n[place] > 0:
                n = int(n[place])
                self._take(place, n, max(0, n - int(length[place] - loss[place])))
        out = self.pieces
        self.count += 1
        self._open()
        return out

    def close(self) -> list:
        """All that is left; the last open bin is cut into runs with power-of-two lengths if cuts are allowed."""
        out: list = []
        while self.size[:, 0].any():
            out += self._step()
        pieces, left, number = self.pieces, sum(p[2] for p in self.pieces), 0
        self._open()
        if not pieces:
            return out
        self.count += 1
        if not self.cut:
            return out + pieces
        room = size = 0
        for key, start, length, loss, _, _ in pieces:
            while length:
                if not room:
                    room = size = 1 << (left.bit_length() - 1)
                    number, self.count = self.count, self.count + 1
                n = min(length, room)
                part = max(0, n - (length - loss))
                out.append((key, start, n, part, number, size - room))
                start, length, loss, room, left = start + n, length - n, loss - part, room - n, left - n
        return out


#: Letters that are one character in either case and in composed form, then a point or comma.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ȟ]+[.,]?$"


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] one after the other."""
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


class WordIds:
    """Ids of a tokenizers file, exact for texts cut at white space.

    The file's normaliser turns white space into one space and its pre-tokeniser drops it, so a text's ids are
    those of its white-space-separated words in turn. The distinct words of a batch are encoded once each; ids of
    texts are then gathered by numpy. Texts in which a word holds an added token's string, or white space beyond
    what the tokeniser knows, go through the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer = self.tokenizer.normalizer
        self.whole = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # White space to the splitter but not to the tokeniser's pattern.
        self.whole += ["\x1c", "\x1d", "\x1e", "\x1f", "\u180e"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.mark = {m: self._each([m])[0] for m in ".,"}
        if any(len(x) != 1 for x in self.mark.values()):
            raise ValueError(f"{path} has no tokens for a point and a comma")

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for i in range(0, len(texts), 20_000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]

    def _lists(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, numbers of ids) of texts."""
        ids = self._each(texts)
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(x) for x in ids], np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of lower-case letters: many to a text, as that is faster; their ends tell them apart."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            self.tokenizer.normalizer = None  # it would leave these words as they are
            try:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            finally:
                self.tokenizer.normalizer = self.normalizer
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(part):
                ids, size = self._lists(part)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, numbers of ids) of distinct words."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        some = words.filter(pa.array(plain))
        mark = np.zeros(len(some), "<u4")
        for m, ids in self.mark.items():
            mark[pc.ends_with(some, m).to_numpy(zero_copy_only=False)] = ids[0]
        letters = pc.dictionary_encode(pc.utf8_rtrim(pc.utf8_lower(some), ".,"))
        flat, size = self._letters(letters.dictionary.to_pylist())
        other_flat, other_size = self._lists(words.filter(pa.array(~plain)).to_pylist())
        code = letters.indices.to_numpy()
        start = np.cumsum(size) - size
        both, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        both[plain], begin[plain] = size[code] + (mark > 0), start[code]
        both[~plain], begin[~plain] = other_size, len(flat) + np.cumsum(other_size) - other_size
        out = _gather(np.concatenate([flat, other_flat, np.zeros(1, "<u4")]), begin, both)
        last = np.cumsum(both)[plain] - 1
        out[last[mark > 0]] = mark[mark > 0]  # the place after the letters' ids holds the mark's
        return out, both

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes; null counts as empty."""
        usual = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        offsets = np.frombuffer(usual.buffers()[1], np.int64)[usual.offset : usual.offset + len(usual) + 1]
        data = usual.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b""
        odd = {}
        if any(x.encode() in data for x in self.whole):
            odd = {i: t for i, t in enumerate(usual.to_pylist()) if any(x in t for x in self.whole)}
            blank = np.zeros(len(usual), bool)
            blank[list(odd)] = True
            usual = pc.if_else(pa.array(blank), pa.scalar("", pa.large_string()), usual)
        del data
        split = pc.utf8_split_whitespace(usual)
        words = pc.dictionary_encode(split.flatten())
        flat, size = self._words(words.dictionary)
        code, of_text = words.indices.to_numpy(), split.offsets.to_numpy()
        each = size[code]
        ids = _gather(flat, (np.cumsum(size) - size)[code], each)
        end = np.append(0, np.cumsum(each))[of_text]
        out = [ids[a:b].tobytes() for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]
        for i, t in odd.items():
            out[i] = self._each([t])[0].tobytes()
        return out


_word_ids: dict[str, WordIds] = {}


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, limits: Limits = Limits(), batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences; see the module's text for the method.

    ``batch_bytes``: of text whose distinct words are encoded together; fewer take less memory and more time.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss. All tokens of a
    document bear loss. ``sequence_id`` is the partition's number times 2^33 plus the bin's.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_packer(vocabulary, end_id, limits, batch_bytes)), SCHEMA)


def pack_examples(examples: DataFrame, vocabulary: str, end_id: int = 2, limits: Limits = Limits(4096, 32, 2048), batch_bytes: int = BATCH_BYTES, id_col: str = "example_id", prompt_col: str = "prompt", answer_col: str = "answer") -> DataFrame:
    """The same for instruction data: a prompt's tokens bear no loss, an answer's and the end's do.

    An example is its prompt's tokens, its answer's, and the end; null counts as empty. Columns as those of ``pack_documents``.
    """
    rows = examples.select(F.col(id_col).cast("long").alias("doc_id"), F.col(answer_col).alias("text"), F.col(prompt_col).alias("prompt"))
    return rows.mapInArrow(tidy(_packer(vocabulary, end_id, limits, batch_bytes)), SCHEMA)


def examples(conversations: DataFrame, answers: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """example_id, conv_id, prompt, answer: one for each answer, with the turns since the one before as its prompt.

    Turns after the last answer make an example without an answer. Turns without a number come first; a turn without
    a conversation is one of its own. One task reads a conversation, whatever the number of conversations.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), (role == answers).alias("answers"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = turns.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "answers", "text")).otherwise(0))
    in_turn = Window.partitionBy("conv_id", "own").orderBy(F.asc_nulls_first("turn"), "answers", "text").rowsBetween(Window.unboundedPreceding, -1)
    numbered = turns.withColumn("part", F.coalesce(F.sum(F.col("answers").cast("long")).over(in_turn), F.lit(0)))
    said = F.array_sort(F.collect_list(F.when(~F.col("answers"), F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "text"))))
    grouped = numbered.groupBy("conv_id", "own", "part").agg(F.array_join(F.transform(said, lambda t: t["text"]), "\n").alias("prompt"), F.max(F.when(F.col("answers"), F.col("text"))).alias("answer"))
    number = F.when(F.col("conv_id").isNull(), F.col("own").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("conv_id").cast("long") * F.lit(1 << 20) + F.col("part"))
    return grouped.select(number.alias("example_id"), "conv_id", "prompt", "answer")


def _packer(vocabulary: str, end_id: int, limits: Limits, batch_bytes: int):
    """For mapInArrow over (doc_id, text), or (doc_id, answer, prompt): rows of SCHEMA."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        if vocabulary not in _word_ids:
            _word_ids[vocabulary] = WordIds(vocabulary)
        words = _word_ids[vocabulary]
        packer, held, end = VectorPacker(limits), {}, end_id.to_bytes(4, "little")
        serial = 0

        def rows(pieces):
            cols = [[] for _ in range(8)]
            for key, start, length, loss, number, offset in pieces:
                doc_id, data, left = held[key]
                for c, v in zip(cols, (doc_id, start, length, zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)]), len(data) // 4, base + number, offset, loss), strict=True):
                    c.append(v)
                if left == length:
                    del held[key]
                else:
                    held[key] = (doc_id, data, left - length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in runs(batch.column(1), batch_bytes):
                done = []
                prompts = words.encode(batch.column(2).slice(first, len(texts))) if batch.num_columns > 2 else None
                for k, data in enumerate(words.encode(texts)):
                    data += end
                    loss = len(data) // 4
                    if prompts:
                        data = prompts[k] + data
                    held[serial] = (ids[first + k], data, len(data) // 4)
                    done += packer.add(serial, len(data) // 4, loss)
                    serial += 1
                if done:
                    yield rows(done)
        if done := packer.close():
            yield rows(done)

    return pack
