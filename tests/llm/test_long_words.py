"""Lattice scores of long words: all segmentations, and no floor."""

import math

import numpy as np
import public_tokenizers

from rayframe.llm import lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_all_segmentations_of_long_words():
    lat = lattice.Lattice([b" a", b"ab", b"b", b"ba"])
    log_p, end = lat.weights(np.arange(1.0, 1 + len(lat.pieces)), 3.0)
    p = dict(zip(lat.pieces, np.exp(log_p), strict=True))
    for n in (62, 63, 64, 65, 150):
        word = b" " + (b"ab" * n)[:n]
        alpha = [1.0]
        for j in range(1, len(word) + 1):
            alpha.append(sum(alpha[i] * p.get(word[i:j], 0.0) for i in range(max(0, j - 2), j)))
        beta = [0.0] * len(word) + [1.0]
        for i in reversed(range(len(word))):
            beta[i] = sum(p.get(word[i:j], 0.0) * beta[j] for j in range(i + 1, min(len(word), i + 2) + 1))
        want = {x: sum(alpha[i] * p[x] * beta[i + len(x)] for i in range(len(word) - len(x) + 1) if word[i : i + len(x)] == x) / alpha[-1] for x in lat.pieces}
        assert math.isclose(lat.score([word[1:]], log_p, end)[0], math.log(alpha[-1]) + end, rel_tol=1e-9)
        counts, words = lat.expected([word[1:]], log_p, end)
        assert words == 1 and np.allclose(counts, [want[x] for x in lat.pieces])


def test_longer_junk_scores_less(spark):
    rows = [(0, "a few words of text to learn from", "en")] + [(i, "q7" * n, "en") for i, n in ((1, 100), (2, 400), (3, 1600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in lattice.score(df, MODEL, learn=df.doc_id == 0).collect()}
    assert all(map(math.isfinite, got.values())) and got[3] < 3 * got[2] < 9 * got[1] < -900
