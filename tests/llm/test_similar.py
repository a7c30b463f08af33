"""SimHash near copies at a similarity against all pairs of shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from rayframe.llm import graph, similar


def shingle_sets(rows, words):
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        yield {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def components(rows, words=5, similarity=0.8):
    sets = list(shingle_sets(rows, words))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    return graph.forest(len(rows), *np.array(near, int).reshape(-1, 2).T)


def kept(rows, words=5, similarity=0.8):
    label, least = components(rows, words, similarity).tolist(), {}
    for r, k in zip(rows, label, strict=True):
        least[k] = min(least.get(k, r[0]), r[0])
    return {r[0] for r, k in zip(rows, label, strict=True) if least[k] == r[0]}


def corpus():
    rng, rows = random.Random(7), []
    line = " ".join(f"license{i}" for i in range(30))
    for i in range(60):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 40, 200]))]
        rows.append((len(rows), " ".join(text) + (f" {line}" if i % 2 else "")))
        for _ in range(rng.randrange(4)):  # from equal but for case, over about the threshold, to far off
            for _ in range(rng.randrange(1 + len(text) // 12)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(text).upper() + (f" {line}" if i % 2 else "")))
    return [*rows, (len(rows), None), (len(rows) + 1, " ")]


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_against_all_pairs(spark, bucket):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for words, similarity in ((5, 0.8), (2, 0.5)):
        got = {r.doc_id for r in similar.distinct_documents(df, words, similarity, bucket=bucket).collect()}
        want = kept(rows, words, similarity)
        # Nothing goes that a link of that similarity does not lead to, and of what should go 0.95 goes at least.
        assert got >= want and len(got) < len(rows) - 10
        assert len(rows) - len(got) >= 0.95 * (len(rows) - len(want))


def copies_of_one():
    """A base and copies with up to a tenth of the words changed each: most pairs are below the threshold."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        text = list(base)
        for _ in range(rng.randrange(1, 12)):
            text[rng.randrange(150)] = f"y{rng.randrange(9000)}"
        rows.append((i, " ".join(text)))
    return rows


def test_recall_and_precision(spark):
    """Of the documents that should go 0.95 go at least, none that should stay; so in a large group of unequal copies."""
    for rows in (copies_of_one(), [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got, want = {r.doc_id for r in similar.distinct_documents(df).collect()}, kept(rows)
        assert got >= want
        assert len(rows) - len(got) >= 0.95 * (len(rows) - len(want)) > 0


def test_no_link_is_lost_behind_nearer_pairs(spark):
    """Groups of copies whose pairs lie about the threshold: nearer fingerprints span them, and not all of those links hold."""
    rng, rows = random.Random(11), []
    for _ in range(2):
        base = [f"w{rng.randrange(9000)}" for _ in range(400)]
        for _ in range(100):
            text = list(base)
            for _ in range(rng.randrange(4, 7)):
                text[rng.randrange(400)] = f"y{rng.randrange(9000)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bucket in (20_000, 40):
        assert {r.doc_id for r in similar.distinct_documents(df, bucket=bucket).select("doc_id").collect()} == kept(rows)


def test_long_fingerprints_tell_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.9):
        n = 400
        both = round(2 * n * j / (1 + j))
        h = np.unique(rng.integers(0, 2**64, 4 * n, dtype=np.uint64))
        a, b = similar.long_fingerprint(h[:n]), similar.long_fingerprint(np.append(h[:both], h[n : 2 * n - both]))
        d = int(np.bitwise_count(a ^ b).sum())
        assert abs(d - 1024 * np.arccos(both / n) / np.pi) < 60
        assert (d <= similar.radius(0.8, 1024)) == (j >= 0.8)


def test_spanning_forest_is_the_nearest():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, m = 30, 80
        a, b, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        k = similar.spanning(n, a, b, w)
        label, total = list(range(n)), 0
        for i in np.argsort(w, kind="stable"):
            x, y = label[a[i]], label[b[i]]
            if x != y:
                total += w[i]
                label = [y if v == x else v for v in label]
        assert w[k].sum() == total and len(k) == n - len(set(label))
        assert (graph.forest(n, a[k], b[k]) == graph.forest(n, a, b)).all()


def test_pipeline_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 500")
    got = corpus_pipeline.near(spark, docs, "/root/testdata/sf0.01")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.select("doc_id").collect()} == kept([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(odd, empty):
    got = similar.distinct_documents(odd)
    assert got.columns == odd.columns and similar.distinct_documents(empty).count() == 0
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (1, 3, None, 10, 11, 12)))


def test_short_texts(spark):
    """Pairs of 8 and 9 words (sets of 4 and 5) and of 16 to 18 words, at a similarity of just 0.8: the later of each goes."""
    rows, n = [], 0
    for i in range(400):
        words = [f"w{i}x{j}" for j in range(9)]
        rows += [(n, " ".join(words[:8])), (n + 1, " ".join(words))]
        n += 2
    for i in range(200):
        words = [f"v{i}x{j}" for j in range(19)]  # 12 and 15 shingles
        rows += [(n, " ".join(words[:16])), (n + 1, " ".join(words))]
        n += 2
    left = sorted(r.doc_id for r in similar.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect())
    assert left == list(range(0, n, 2))


def test_chances():
    """Bits of small sets differ as often as random hashes say; the radius is never below the limit's."""
    assert [round(similar.differing(n, 0.8), 4) for n in (1, 3, 4, 5, 12)] == [0, 0, 0.1875, 0.1562, 0.1611]
    rng = np.random.default_rng(1)
    for n, more in ((4, 1), (12, 3)):
        bits = rng.integers(0, 2, (n + more, 200_000))
        apart = ((2 * bits[:n].sum(0) > n) != (2 * bits.sum(0) > n + more)).mean()
        assert abs(apart - similar.differing(n, 0.8)) < 0.005 or n == 12 and apart <= similar.differing(n, 0.8) + 0.005
    assert similar.radii(0.8, 1024).min() == similar.radius(0.8, 1024) == 201 and similar.radii(0.8, 1024)[4] > 230
