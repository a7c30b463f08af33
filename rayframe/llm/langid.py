"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of labelled text. A text is parsed into
phrases: from where the last phrase ended, the longest match in the sample, then on from there. The number of
phrases times the logarithm of the sample's length, per symbol, estimates the cross entropy; the language with
the least wins. Transitions that end a phrase lead to states of their own, so that numpy walks many blocks of
many texts through all automata at once. Texts are parsed whole, in blocks of ``BLOCK`` symbols, each of which
starts a phrase.

The sample is bounded: per language ``sample_texts`` distinct texts, those with the least hashes, each with its first
``sample_chars // 4`` characters, and ``sample_chars`` symbols together, or fewer where there are so many languages
that all samples would pass ``model_chars``. Every label is a language, but for null and ``und``. Sample sizes and
the broadcast model follow from these parameters alone. A forced end of a phrase adds at most one phrase a block.

Edge cases: null text, or none with letters, gives ``und`` and score 0; of equal entropies the language first
in order wins; without labelled rows all is ``und``; copies count once in a sample; repeated rows yield a row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, slices, tidy

BLOCK = 1024
#: Letters that have a symbol of their own, the most frequent ones; the others share one.
LETTERS = 126


def suffix_automaton(text: list[int], size: int) -> np.ndarray:
    """(states, size) transitions of the automaton of all substrings of ``text``; -1: none. State 0 is the root."""
    to: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new, p = len(to), last
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out = np.full((len(to), size), -1, np.int32)
    for s, row in enumerate(to):
        for c, t in row.items():
            out[s, c] = t
    return out


def symbols(text: str, lookup: np.ndarray) -> np.ndarray:
    """Symbols of a text in lower case: runs of anything but letters are one 0."""
    s = lookup[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    return s[(s != 0) | (np.append(1, s[:-1]) != 0)] if len(s) else s


@dataclass
class Model:
    names: list[str]
    bits: np.ndarray  # per phrase, of each language
    letters: str
    table: np.ndarray | None  # [state * size + symbol] -> next state * size
    size: int

    def lookup(self) -> np.ndarray:
        """Of code points: 0 for anything but letters, the last symbol for letters without one of their own."""
        out = np.zeros(0x110000, np.uint8)
        out[[i for i in range(0x110000) if chr(i).isalpha()]] = self.size - 1
        for i, c in enumerate(self.letters):
            out[ord(c)] = i + 1
        return out


def train(texts: dict[str, list[str]], sample_chars: int) -> Model:
    """The model of a bounded sample: texts by language."""
    names = sorted(texts)
    count = Counter(c for n in names for t in texts[n] for c in t.lower() if c.isalpha())
    letters = "".join(sorted(c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]))
    model = Model(names, np.zeros(len(names)), letters, None, len(letters) + 2)
    lookup, size, n = model.lookup(), model.size, len(names)
    parts, state = [], n * size + n  # first a state for each language and first symbol of a phrase, then the starts
    fresh = np.zeros((n, size, size), np.int32)
    start = np.zeros((n, size), np.int32)
    for k, name in enumerate(names):
        text: list[int] = [0]
        for t in texts[name]:
            s = symbols(t, lookup).tolist()
            text += [*s[: max(0, sample_chars - len(text))], 0]
        rows = suffix_automaton(text, size)
        model.bits[k] = log2(max(2, len(text)))
        new_phrase = k * size + np.arange(size, dtype=np.int32)
        after = np.where(rows >= 0, rows + state, new_phrase)
        for c in range(size):
            fresh[k, c] = after[rows[0, c]] if rows[0, c] >= 0 else new_phrase
        start[k] = new_phrase
        parts.append(after)
        state += len(rows)
    if names:
        model.table = (np.concatenate([fresh.reshape(-1, size), start, *parts]) * size).astype(np.int32).ravel()
    return model


def phrases(texts: list[str], model: Model, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((texts, languages) numbers of phrases, numbers of symbols; 0 symbols: no letter)."""
    n, size = len(model.names), model.size
    coded = [symbols(t, lookup) for t in texts]
    lengths = np.array([len(s) if s.any() else 0 for s in coded])
    blocks = [(i, j) for i, m in enumerate(lengths.tolist()) for j in range(0, m, BLOCK)]
    out = np.zeros((len(texts), n), np.int64)
    blocks.sort(key=lambda b: b[1] - lengths[b[0]])  # whole blocks and then by length, the longest first
    for at in range(0, len(blocks), 4096):
        part = blocks[at : at + 4096]
        each = np.array([min(BLOCK, lengths[i] - j) for i, j in part])
        text = np.zeros((each.max(), len(part)), np.int32)
        for k, (i, j) in enumerate(part):
            text[: each[k], k] = coded[i][j : j + BLOCK]
        alive = np.searchsorted(-each, -np.arange(len(text)), "left")  # blocks with more symbols than each step's number
        where = np.repeat((n * size + np.arange(n, dtype=np.int32)) * size, len(part)).reshape(n, -1)
        count = np.zeros(where.shape, np.int32)
        for step, m in enumerate(alive.tolist()):
            here = model.table[where[:, :m] + text[step, :m]]
            count[:, :m] += here < n * size * size
            where[:, :m] = here
        np.add.at(out, [i for i, _ in part], count.T)
    return out, lengths


_lookups: dict[str, np.ndarray] = {}


def sample(docs: DataFrame, learn: Column, sample_texts: int, sample_chars: int, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """The bounded sample, collected: texts by language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), learn.alias("learn")).filter("learn AND lang IS NOT NULL AND lang <> 'und'")
    named = rows.filter("text IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    # Hashes alone are ranked, each distinct one once, so that copies and long texts cost a language nothing; first
    # within 32 shares of a language, as one language may have most rows.
    least = named.select("lang", "hash").distinct()
    for by in (["lang", F.pmod("hash", F.lit(32))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("hash"))
        least = least.withColumn("rank", rank).filter(F.col("rank") <= sample_texts).select("lang", "hash")
    least = docs.sparkSession.createDataFrame([tuple(r) for r in least.collect()], "lang string, hash long")  # sample_texts rows a language
    some = named.join(F.broadcast(least), ["lang", "hash"]).select("lang", "hash", F.substring("text", 1, sample_chars // 4).alias("text"))
    once = some.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(once.collect(), key=lambda r: (r["lang"], r["hash"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, learn: Column | None = None, sample_texts: int = 64, sample_chars: int = 60_000, model_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (1 less the least entropy over the second least, so 0 to 1).

    ``learn``: the rows that may be learned from; by default those whose crc32 of the id modulo 4 is not 2.
    ``model_chars``: most symbols of all languages' samples together.
    """
    learn = crc_mod(F.col(id_col), 4) != 2 if learn is None else learn
    predict = predictor(docs, learn, sample_texts, sample_chars, model_chars, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        predict(pa.array([], pa.string()), done=True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~learn).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, accept: list[str] | None = None, min_score: float = 0.0, learn: Column | None = None, sample_texts: int = 64, sample_chars: int = 60_000, model_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns as they are.

    ``accept``: the languages that stay; by default all. ``min_score``: the least score that stays.
    """
    learn = crc_mod(F.col(id_col), 4) != 2 if learn is None else learn
    predict = predictor(docs, learn, sample_texts, sample_chars, model_chars, text_col, lang_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = predict(batch.column(at))
            yield batch.filter(pa.array([b != "und" and s >= min_score and (accept is None or b in accept) for b, s in zip(best, score, strict=True)], pa.bool_()))
        predict(pa.array([], pa.string()), done=True)

    return docs.mapInArrow(tidy(run), docs.schema)


def predictor(docs: DataFrame, learn: Column, sample_texts: int, sample_chars: int, model_chars: int, text_col: str, lang_col: str):
    """A function for executors, from an Arrow array of texts to (languages, scores), with the model trained on ``docs``."""
    texts = sample(docs, learn, sample_texts, sample_chars, text_col, lang_col)
    model = train(texts, min(sample_chars, model_chars // max(1, len(texts))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array, done: bool = False) -> tuple[list[str], list[float]]:
        if done:  # an idle worker would hold on to the model; the next task reads it again from the local disk
            vars(shared).pop("_value", None)
            return [], []
        m = shared.value
        if m.letters not in _lookups:
            _lookups.clear()
            _lookups[m.letters] = m.lookup()
        best: list[str] = []
        score: list[float] = []
        for _, part in slices(texts):
            if not m.names:
                best += ["und"] * len(part)
                score += [0.0] * len(part)
                continue
            count, length = phrases(part, m, _lookups[m.letters])
            bits = count * m.bits / np.maximum(length, 1)[:, None]
            order = np.argsort(bits, axis=1, kind="stable")
            first = np.take_along_axis(bits, order[:, :1], 1)[:, 0]
            second = np.take_along_axis(bits, order[:, 1:2], 1)[:, 0] if len(m.names) > 1 else np.full(len(part), np.inf)
            sure = np.where(length > 0, 1 - first / np.maximum(second, 1e-300), 0.0)
            best += [m.names[k] if n else "und" for k, n in zip(order[:, 0].tolist(), length.tolist(), strict=True)]
            score += np.clip(sure, 0.0, 1.0).tolist()
        return best, score

    return predict
