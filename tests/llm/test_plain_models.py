"""Predictions, scores and fingerprints of whole texts against plain versions of the models."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from rayframe.llm import imatch, langid, lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_languages_of_whole_texts(spark, documents):
    """Phrases by searching the samples for each longest match; blocks add at most a phrase each."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    chars = 3000
    texts = langid.sample(documents, learn, 64, chars, "text", "lang")
    got = {r.doc_id: r for r in langid.identify(documents, sample_chars=chars).collect()}

    def plain(text):
        out = []
        for c in text.lower():
            if c.isalpha() or not out or out[-1] != " ":
                out.append(c if c.isalpha() else " ")
        return "".join(out)

    known = set("".join(t.lower() for ts in texts.values() for t in ts))
    assert len({c for c in known if c.isalpha()}) <= langid.LETTERS
    fold = lambda t: "".join(c if c == " " or c in known else "\0" for c in plain(t))
    samples = {}
    for name, ts in texts.items():
        s = " "
        for t in ts:
            s += fold(t)[: max(0, chars - len(s))] + " "
        samples[name] = s

    def parse(s, text):
        n = at = 0
        while at < len(s):
            end = at
            while end < len(s) and s[at : end + 1] in text:
                end += 1
            n, at = n + 1, max(end, at + 1)  # a symbol that the sample lacks is a phrase of its own
        return n

    rows = documents.orderBy("doc_id").limit(60).collect()
    assert any(len(r.text or "") > 1500 for r in rows)
    for r in rows:
        s = fold(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        blocks = [s[i : i + langid.BLOCK] for i in range(0, len(s), langid.BLOCK)]
        bits = {}
        for name, text in samples.items():
            cut, whole = sum(parse(b, text) for b in blocks), parse(s, text)
            assert whole <= cut < whole + len(blocks)
            bits[name] = cut * math.log2(len(text)) / len(s)
        first, second = sorted(bits.values())[:2]
        best = min(sorted(bits), key=bits.get)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert got[r.doc_id].lang_pred == best and math.isclose(got[r.doc_id].score, 1 - first / second if second else 0, abs_tol=1e-9)


def test_every_language_has_a_share_of_the_model(spark):
    rows = [(i, f"{chr(97 + i % 20) * 3}{i} " * 50, f"l{i % 20}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, F.lit(True), model_chars=20 * 300).collect()
    assert {r.lang_pred for r in got} == {f"l{i}" for i in range(20)}
    kept = langid.identified(df, accept=["l3", "l4"], learn=F.lit(True))
    assert kept.columns == df.columns and {r.lang for r in kept.collect()} <= {"l3", "l4"} and kept.count() == 20


def logsum(xs):
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def plain_scores(rows, learned, classes):
    """Natural logs of whole texts' probabilities, from sums over all segmentations, word by word."""
    order, first = lattice.model_pieces(MODEL)
    every = sorted({bytes((b,)) for b in range(256)} | set(order))
    longest = max(map(len, every))

    def weights(counts, end):
        c = {p: counts.get(p, 0.0) + (0.01 if len(p) == 1 else 0.0) for p in every}
        lead = sum(v for p, v in c.items() if p[:1] == b" ")
        rest = sum(v for p, v in c.items() if p[:1] != b" ") + max(end, 0.01)
        return {p: math.log(v / (lead if p[:1] == b" " else rest)) for p, v in c.items() if v}, math.log(max(end, 0.01) / rest)

    def forward(w, lp):
        alpha = [0.0]
        for j in range(1, len(w) + 1):
            alpha.append(logsum([alpha[i] + lp[w[i:j]] for i in range(max(0, j - longest), j) if w[i:j] in lp] or [-math.inf]))
        return alpha

    tokens = [[*(t or "").encode().lower().split(), b""] for _, t, _ in rows]
    place = {c: min(i, len(classes) - 1) for i, c in enumerate(classes)}
    of = [place.get(lang, len(classes) - 1) for _, _, lang in rows]
    n = [Counter(t for i, ts in enumerate(tokens) if i in learned and of[i] == k for t in ts) for k in range(len(classes))]
    all_n = sum(n, Counter())
    models = []
    for k in range(len(classes)):
        lp, end = weights(dict(zip(order, first, strict=True)), float(first.sum()) / 4)
        for _ in range(2):
            counts, number = Counter(), 0
            for w in (b" " + x for x in n[k] if x):
                alpha = forward(w, lp)
                beta = [-math.inf] * len(w) + [0.0]
                for i in reversed(range(len(w))):
                    beta[i] = logsum([lp[w[i:j]] + beta[j] for j in range(i + 1, min(len(w), i + longest) + 1) if w[i:j] in lp] or [-math.inf])
                for i in range(len(w)):
                    for j in range(i + 1, min(len(w), i + longest) + 1):
                        if w[i:j] in lp:
                            counts[w[i:j]] += math.exp(alpha[i] + lp[w[i:j]] + beta[j] - alpha[-1])
                number += 1
            if number:
                lp, end = weights({p: c for p, c in counts.items() if c > 1e-9}, float(number))
        models.append((lp, end))
    d, big, types = lattice.DISCOUNT, sum(all_n.values()), len(all_n)
    cache = {}

    def log_p(w, k):
        if (w, k) not in cache:
            sub = forward(b" " + w, models[k][0])[-1] + models[k][1] if w else -math.inf
            q = logsum([math.log((all_n[w] - d) / big) if all_n[w] else -math.inf, math.log(d * types / big) + sub])
            if (nk := sum(n[k].values())) > 0:
                q = logsum([math.log((n[k][w] - d) / nk) if n[k][w] else -math.inf, math.log(d * len(n[k]) / nk) + q])
            cache[w, k] = q
        return cache[w, k]

    ends = [c[b""] for c in n]
    return [logsum([math.log(max(ends[k], 1e-12) / sum(ends)) + sum(log_p(w, k) for w in ts) for k in range(len(classes))]) for ts in tokens]


def test_scores_of_whole_texts(spark, documents):
    rows = [(r.doc_id, (r.text or "")[:120], r.lang) for r in documents.orderBy("doc_id").limit(40).collect()]
    rows += [(1000, "x" * 200, "en"), (1001, "x" * 3000, "en"), (1002, "un mot " + "é" * 70, "fr"), (1003, None, None), (1004, "日本語" * 40, "ja")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {i for i, r in enumerate(rows) if r[0] < 30}
    classes = [k for k, _ in sorted(Counter(rows[i][2] for i in learned).items(), key=lambda x: (-x[1], x[0]))]
    want = dict(zip((r[0] for r in rows), plain_scores(rows, learned, classes), strict=True))
    got = {r.doc_id: r.score for r in lattice.score(df, MODEL, learn=df.doc_id < 30).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert math.isclose(got[k], v / math.log(10), rel_tol=1e-9), k
    assert got[1001] < got[1000] - 500


def test_fingerprints_of_whole_texts(spark, documents):
    """I-Match by sets and single hashes: the lexicon's band, the subsets, the likenesses."""
    rows = [(r.doc_id, r.text or "") for r in documents.orderBy("doc_id").collect()]
    low, high = 0.05, 0.2
    terms = lambda t: set(re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower()))
    df = Counter(w for _, t in rows for w in terms(t))
    band = {w for w, n in df.items() if max(low * len(rows), sum(df.values()) / 500_000, 1) <= n <= high * len(rows)}
    mask = (1 << 64) - 1

    def member(h):
        """Which of the 128 subsets keep a term: all; then 16 each with 2, 3, ... words of 16 random bits in common."""
        stream = []
        for k in range(11):
            z = (h + 0x9E3779B97F4A7C15 * (k + 1)) & mask
            z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
            z ^= z >> 31
            stream += [z >> 16 * i & 0xFFFF for i in range(4)]
        out, used = [], 0
        for g in range(8):
            bits = 0xFFFF
            for x in stream[used : used + g + 2]:
                bits &= x
            used += g + 2
            out += [bits >> i & 1 for i in range(16)]
        return [1, *out[1:]]

    cache = {}

    def fingerprint(t):
        own = sorted(terms(t) & band) or sorted(terms(t))
        kept = [b""] * 128
        for w in own:
            if w not in cache:
                h = xxhash.xxh64_intdigest(w)
                cache[w] = (h.to_bytes(8, "little"), member(h))
            data, bits = cache[w]
            kept = [k + data if b else k for k, b in zip(kept, bits, strict=True)]
        return [xxhash.xxh32_intdigest(k) % 0xFFFF + 1 if k else 0 for k in kept]

    def like(a, b):
        best, either, same = 0.0, 0, 0
        total = sum(1 for x, y in zip(a, b, strict=True) if x or y)
        if not total:
            return 1.0
        for g in range(7, -1, -1):
            for x, y in zip(a[16 * g : 16 * g + 16], b[16 * g : 16 * g + 16], strict=True):
                either += bool(x or y)
                same += bool(x and x == y)
            if either >= min(imatch.LEAST, total):
                best = max(best, same / either)
        return best

    got = {r.doc_id: r for r in imatch.fingerprint_edits(documents, low, high).collect()}
    for k in range(0, len(rows), 5):
        (i, t), (_, after) = rows[k], rows[(k + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        r = got[i]
        assert r.fingerprint == "".join(f"{x:04x}" for x in a) and r.edited_fingerprint == "".join(f"{x:04x}" for x in b)
        assert math.isclose(r.near_edited, like(a, b)) and math.isclose(r.near_next, like(a, c))


def test_many_null_ids_are_spread(spark):
    rows = [(None, f"text {i} of many") for i in range(300)] + [(i, f"own {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = imatch.fingerprint_edits(df)
    assert got.count() == 400
    by_task = Counter(r.p for r in got.filter("doc_id IS NULL").select(F.spark_partition_id().alias("p")).collect())
    assert len(by_task) >= 2
    # Every text is the next of exactly one: the edits' second halves come from all texts.
    want = defaultdict(int)
    for _, t in rows:
        want[len(t)] += 1
    assert Counter(r.n_chars for r in got.collect()) == want


@pytest.mark.parametrize("n", [3, 7])
def test_words_up_to_a_length_have_at_most_all_probability(n):
    lat = lattice.Lattice([b" a", b" b", b"ab", b"ba", b"bb"])
    weights = lat.weights(np.where(np.isin(np.array(lat.pieces, object), [b" ", b"a", b"b", b" a", b" b", b"ab", b"ba", b"bb"]), 1e3, 0.0), 2e3)
    words = [bytes(x) for m in range(1, n + 1) for x in (np.array(list(np.ndindex(*[2] * m)), np.uint8) + 97)]
    assert np.exp(lat.score(words, *weights)).sum() < 1
