"""Language-model scoring by subword lattices.

A word's lattice has an edge for every piece of an existing subword vocabulary that fits, and for every byte. The
vocabulary's scores are ranks of merges, not log probabilities, so they cannot weight segmentations as they are: the
pieces' weights start from 1 / (rank + 10) and are re-estimated on all distinct training words by expectation
maximisation. A log-space forward recursion adds up all segmentations of a word, however long, into its marginal
probability; no probability has a floor. Word-initial and later pieces are normalised apart, the later ones together with the word's end, so
the probabilities of all words sum to at most 1.

A text is the sequence of its words and an end. A token's probability is its discounted relative frequency, and the
mass that discounting frees goes to the lattice:

    Q_k(w) = (c - d) / N + d V / N * lattice_k(w)              c, N, V over all training texts
    P_k(w) = (c_k - d) / N_k + d V_k / N_k * Q_k(w)            c_k, N_k, V_k over those of language k
    P(text) = sum over k of pi_k * product over tokens of P_k  (the text's language is summed over)

so the score is the logarithm of the text's marginal probability over segmentations and languages. Pieces have
weights of their own for each language.

Texts are tokenised once, into blocks of bounded size with a list of distinct words each. Counts of all words are
added up over all blocks, and each block gets the figures of its own words back; neither the vocabulary nor the
counts are ever in one place. Each word is shuffled once a block at most, however often it occurs.

Edge cases: a null or blank text is the end alone; bytes outside the vocabulary's characters have edges of their own;
a null language is a class of its own; without training
rows every count is zero; repeated rows yield a row each; an empty table yields no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep, slices, tidy

DISCOUNT = 0.75
#: A block ends after so many distinct words or tokens.
BLOCK_WORDS, BLOCK_TOKENS = 600_000, 8_000_000
#: Words up to so many bytes are summed up as plain probabilities where doubles hold them; others as logarithms.
LONG = 64
#: Most words times places of a group that is walked at once.
CELLS = 2_000_000
BLOCKS = "block long, idx int, word binary, n array<int>, doc_id long, held_out boolean, tokens binary"


class Lattice:
    """Piece edges over bytes, with log weights; node 0 of the trie is its root. A word is led by a space."""

    def __init__(self, pieces: list[bytes]):
        #: All single bytes, then the pieces; word-initial ones start with a space.
        self.pieces = sorted({bytes((b,)) for b in range(256)} | {p for p in pieces if p})
        children: list[dict] = [{}]
        of = [-1]
        for i, p in enumerate(self.pieces):
            at = 0
            for b in p:
                if (to := children[at].get(b)) is None:
                    to = children[at][b] = len(children)
                    children.append({})
                    of.append(-1)
                at = to
            of[at] = i
        self.dead = len(children)
        self.next = np.full((self.dead + 1, 256), self.dead, np.uint16 if self.dead < 65535 else np.int32)
        for at, row in enumerate(children):
            if row:
                self.next[at, list(row)] = list(row.values())
        self.piece = np.array([*of, -1], np.int32)
        self.initial = np.array([p[:1] == b" " for p in self.pieces])

    def weights(self, counts: np.ndarray, end: float) -> tuple[np.ndarray, float]:
        """(log weights of pieces, of the word's end) from counts; each byte has a little of its own."""
        c = counts + np.array([0.01 if len(p) == 1 else 0.0 for p in self.pieces])
        start, later = c[self.initial].sum(), c[~self.initial].sum() + max(end, 0.01)
        with np.errstate(divide="ignore"):
            return np.log(np.where(self.initial, c / start, c / later)), float(np.log(max(end, 0.01) / later))

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, byte codes as (length, words)) of words of one length; each has its leading space."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            step = max(1, min(20_000, CELLS // int(sizes[at[0]]))) if len(at) else 1
            for i in range(0, len(at), step):
                part = at[i : i + step]
                if len(part):
                    codes = np.frombuffer(b"".join(b" " + words[k] for k in part.tolist()), np.uint8)
                    yield part, np.ascontiguousarray(codes.reshape(len(part), -1).T)

    def _edges(self, codes: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
        """(end, words, trie nodes) of the edges from place ``i``; codes are (length, words)."""
        m, n = codes.shape
        node, at = np.zeros(n, self.next.dtype), np.arange(n)
        for j in range(i, m):
            node = self.next[node, codes[j, at]]
            live = node != self.dead
            if live.mean() < 0.7:
                node, at = node[live], at[live]
                if not len(at):
                    return
            yield j + 1, at, node

    def forward(self, codes: np.ndarray, lp: np.ndarray) -> np.ndarray:
        """(length + 1, words) log sums over all segmentations of each prefix; ``lp``: of nodes."""
        m, n = codes.shape
        alpha = np.full((m + 1, n), -np.inf)
        alpha[0] = 0
        for i in range(m):
            for j, at, node in self._edges(codes, i):
                alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + lp[node])
        return alpha

    def of_nodes(self, log_p: np.ndarray) -> np.ndarray:
        return np.append(log_p, -np.inf)[self.piece]

    def score(self, words: list[bytes], log_p: np.ndarray, log_end: float) -> np.ndarray:
        """Natural log of each word's marginal probability; minus infinity for the empty word, a text's end."""
        out, lp = np.full(len(words), -np.inf), self.of_nodes(log_p)
        for at, codes in self._groups(words):
            if codes.shape[0] > 1:
                out[at] = self.forward(codes, lp)[-1] + log_end
        return out

    def expected(self, words: list[bytes], log_p: np.ndarray, log_end: float) -> tuple[np.ndarray, float]:
        """(expected counts of pieces, number of words) of distinct words, by forward and backward sums.

        Words of up to ``LONG`` bytes use plain probabilities; longer ones, and those that leave the range of
        doubles, use logarithms, to the same result.
        """
        lp = self.of_nodes(log_p)
        total, n_words, p, far = np.zeros(len(self.pieces)), 0, np.exp(lp), []
        piece = np.where(self.piece < 0, len(total), self.piece)
        for places, codes in self._groups(words):
            m, n = codes.shape
            if m < 2:
                continue
            if m > LONG:
                far += places.tolist()
                continue
            alpha, beta = np.zeros((m + 1, n)), np.zeros((m + 1, n))
            alpha[0] = beta[m] = 1
            edges = [list(self._edges(codes, i)) for i in range(m)]
            for i, own in enumerate(edges):
                for j, at, node in own:
                    alpha[j, at] += alpha[i, at] * p[node]
            held = alpha[m] > 1e-250
            far += places[~held].tolist()
            whole = np.where(held, alpha[m], np.inf)
            n_words += int(held.sum())
            for i in range(m - 1, -1, -1):
                for j, at, node in edges[i]:
                    edge = p[node] * beta[j, at]
                    beta[i, at] += edge
                    total += np.bincount(piece[node], alpha[i, at] * edge / whole[at], len(total) + 1)[:-1]
        if far:
            more = np.zeros(len(total) + 1)
            for _, codes in self._groups([words[k] for k in far]):
                m, n = codes.shape
                alpha, beta = self.forward(codes, lp), np.full((m + 1, n), -np.inf)
                beta[m] = 0
                held = alpha[m] > -np.inf
                whole = np.where(held, alpha[m], np.inf)
                n_words += int(held.sum())
                for i in range(m - 1, -1, -1):
                    for j, at, node in self._edges(codes, i):
                        edge = lp[node] + beta[j, at]
                        beta[i, at] = np.logaddexp(beta[i, at], edge)
                        np.add.at(more, piece[node], np.exp(alpha[i, at] + edge - whole[at]))
            total += more[:-1]
        return total, float(n_words)


def blocks(docs: DataFrame, learn: Column, classes: list, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows of BLOCKS: for each block its distinct words (training counts by class) and its texts as word numbers."""
    place = {c: i for i, c in enumerate(classes)}
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=1).compress
        block, number, texts_of, held = TaskContext.get().partitionId() << 24, {b"": 0}, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, k = list(number), max(1, len(classes))
            counts = np.zeros((len(words), k), np.int32)
            for c in range(k):
                if own := [tokens for _, out, cls, tokens in texts_of if not out and cls == c]:
                    counts[:, c] = np.bincount(np.concatenate(own), minlength=len(words))
            for i in range(0, len(words), 50_000):
                n = len(words[i : i + 50_000])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(counts[i : i + n].ravel()), k).cast(pa.list_(pa.int32()))
                none = [pa.nulls(n, t) for t in kinds[4:]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, kinds[0]), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(words[i : i + n], pa.binary()), lists, *none], names)
            for i in range(0, len(texts_of), 2000):
                part = texts_of[i : i + 2000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, kinds[0]), *[pa.nulls(n, t) for t in kinds[1:4]], pa.array([x[0] for x in part], kinds[4]), pa.array([x[1] for x in part], kinds[5]), pa.array([pack(x[3].tobytes()) for x in part], kinds[6])], names)

        for batch in batches:
            ids, outs, langs = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for first, texts in slices(batch.column(3)):
                for i, t in enumerate(texts, first):
                    words = t.encode("utf-8", "surrogatepass").lower().split()
                    for w in set(words).difference(number):
                        number[w] = len(number)
                    tokens = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
                    texts_of.append((ids[i], outs[i], place.get(langs[i], len(classes) - 1), np.append(tokens, np.uint32(0))))
                    held += len(words) + 1
                    if len(number) > BLOCK_WORDS or held > BLOCK_TOKENS:
                        yield from flush()
                        block, number, texts_of, held = block + 1, {b"": 0}, [], 0
        if texts_of:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~learn).alias("held_out"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), BLOCKS)


def model_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model, with a space as the mark of a word's start, and weights by their scores' ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    # Texts are in lower case; a space is only ever a word's first byte.
    found = {p: sp.get_score(i) for i in usual if (p := sp.id_to_piece(i).replace("▁", " ").encode()) == p.lower() and b" " not in p[1:]}
    order = sorted(found, key=lambda p: (-found[p], p))
    return order, 1.0 / (np.arange(len(order)) + 10.0)


def mixed(c: np.ndarray, n: float, types: float, lower: np.ndarray) -> np.ndarray:
    """Log of (c - d) / n + d types / n * exp(lower), with no floor: only words without a count lack the first term."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / n), np.log(DISCOUNT * types / n) + lower)


_lattices: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(model_pieces(path)[0])
    return _lattices[path]


def score(docs: DataFrame, vocabulary: str, learn: Column | None = None, rounds: int = 2, languages: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of probabilities).

    ``learn``: the rows to learn from, by default those whose crc32 of the id modulo 7 is not 2. ``languages``: most
    classes of texts; the rarer languages share the last one with the least frequent that has a class.
    """
    learn = crc_mod(F.col(id_col), 7) != 2 if learn is None else learn
    counted = docs.filter(learn).groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    classes = [r["lang"] for r in counted] or [None]
    k = len(classes)
    rows = keep(blocks(docs, learn, classes, id_col, text_col, lang_col), "blocks")
    words = rows.filter("word IS NOT NULL").select("block", "idx", "word", "n")
    vocabulary_rows = keep(words.groupBy("word").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(k)]).alias("n")), "words")
    count = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = vocabulary_rows.agg(F.sum(count), F.count(F.when(count > 0, 1)), *[F.sum(F.col("n")[i]) for i in range(k)], *[F.count(F.when(F.col("n")[i] > 0, 1)) for i in range(k)]).first()
    tokens, types = sums[0] or 0, sums[1] or 0
    class_tokens, class_types = [x or 0 for x in sums[2 : 2 + k]], [x or 0 for x in sums[2 + k :]]
    ends = vocabulary_rows.filter(F.octet_length("word") == 0).select("n").first()
    texts = list(ends[0]) if ends else [0] * k

    lattice = _lattice(vocabulary)
    pieces, first = model_pieces(vocabulary)
    at = {p: i for i, p in enumerate(lattice.pieces)}
    start = np.zeros(len(lattice.pieces))
    start[[at[p] for p in pieces]] = first
    weights = [lattice.weights(start, float(first.sum()) / 4)] * k
    spark = docs.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)  # one number a piece and class

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = _lattice(vocabulary)
            total, n = np.zeros((k, len(lattice.pieces))), np.zeros(k)
            for batch in batches:
                found = batch.column(0).to_pylist()
                seen = batch.column(1).flatten().to_numpy().reshape(-1, k) > 0
                for c in range(k):
                    part, m = lattice.expected([found[i] for i in np.flatnonzero(seen[:, c]).tolist()], *shared.value[c])
                    total[c] += part
                    n[c] += m
            for c in range(k):
                some = np.flatnonzero(total[c] > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array([c] * (len(some) + 1), pa.int32()), pa.array([*some.tolist(), -1], pa.int32()), pa.array([*total[c][some].tolist(), n[c]], pa.float64())], ["class", "piece", "n"])

        got = vocabulary_rows.filter(count > 0).select("word", "n").mapInArrow(tidy(expect), "class int, piece int, n double").groupBy("class", "piece").agg(F.sum("n").alias("n"))
        counts, n_words = np.zeros((k, len(lattice.pieces))), np.zeros(k)
        for c, piece, n in got.collect():  # at most one row a piece and class
            if piece < 0:
                n_words[c] = n
            else:
                counts[c, piece] = n
        weights = [lattice.weights(counts[c], n_words[c]) if n_words[c] else weights[c] for c in range(k)]
    shared = spark.sparkContext.broadcast(weights)

    big_n = float(tokens)

    def lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            n = batch.column(1).flatten().to_numpy().reshape(-1, k)
            sub = np.stack([_lattice(vocabulary).score(found, *shared.value[c]) for c in range(k)], 1)
            c = n.sum(1)
            log_p = np.empty((len(found), k))
            for i in range(k):
                if tokens:
                    p = mixed(c, big_n, types, sub[:, i])
                else:  # nothing to learn from: an end with probability 1/2, else a word of the lattice
                    p = np.log(0.5) + np.where(np.array([not w for w in found], bool), 0.0, sub[:, i])
                if class_tokens[i]:
                    p = mixed(n[:, i], class_tokens[i], class_types[i], p)
                log_p[:, i] = p
            lists = pa.FixedSizeListArray.from_arrays(pa.array(log_p.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c), lists], ["word", "c", "log_p"])

    scored = vocabulary_rows.select("word", "n").mapInArrow(tidy(lattices), "word binary, c long, log_p array<double>")
    figures = words.select("block", "idx", "word").join(scored, "word").select(F.col("block").alias("given_block"), "idx", "c", "log_p")
    of_texts = rows.filter("word IS NULL").select(F.col("block").alias("own_block"), "doc_id", "held_out", "tokens")
    prior = np.log(np.maximum(np.array(texts, float), 1e-12) / max(1, sum(texts)))

    def finish(own: pa.Table, given: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        size = given.num_rows
        idx = given["idx"].to_numpy()
        c, log_p = np.zeros(size, np.int64), np.zeros((size, k))
        c[idx] = given["c"].to_numpy()
        log_p[idx] = given["log_p"].combine_chunks().flatten().to_numpy().reshape(size, k)
        base = np.log10((c + 1) / (big_n + types + 1))
        out = [[] for _ in range(4)]
        for blob in own["tokens"]:
            t = np.frombuffer(unpack(blob.as_buffer().to_pybytes()), np.uint32)
            each = prior + log_p[t].sum(0)
            top = each.max()
            for o, v in zip(out, (len(t), int((c[t] > 0).sum()), float(base[t].sum()), float((top + np.log(np.exp(each - top).sum())) / np.log(10))), strict=True):
                o.append(v)
        m = own.num_rows
        return pa.table({"doc_id": own["doc_id"], "held_out": own["held_out"], "n_tokens": pa.array(out[0], pa.int64()), "n_known": pa.array(out[1], pa.int64()), "train_tokens": pa.array([tokens] * m, pa.int64()), "base_score": pa.array(out[2], pa.float64()), "score": pa.array(out[3], pa.float64())})

    # As many tasks as there are blocks, whose size is bounded, so that no task gets more of them as the corpus grows.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), of_texts.select("own_block").distinct().count())
    of_texts, figures = of_texts.repartition(parts, "own_block"), figures.repartition(parts, "given_block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return of_texts.groupBy("own_block").cogroup(figures.groupBy("given_block")).applyInArrow(finish, schema)
