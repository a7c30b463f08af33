"""Exact and near deduplication against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rayframe.llm import exact_dedup, graph, queries, simhash

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = queries.op2_exact_dedup(spark, SF)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(exact_dedup.SQL).fetchall())


def test_exact_edges(odd, empty):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()), key=str)
    blank = [x for x in got if x[2] == 4]
    assert sorted(map(str, blank)) == sorted(map(str, [(3, 3, 4, True), (3, 3, 4, False), (None, 3, 4, False), (9, 3, 4, False)]))
    assert (1, 1, 1, True) in got and (None, None, 1, True) in got
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.distinct_documents(empty).count() == 0
    stays = exact_dedup.distinct_documents(odd)
    assert stays.columns == odd.columns and stays.count() == len(got) - 3


def test_colliding_digests(spark):
    df = spark.createDataFrame([(i, f"t{i % 37}  x") for i in range(300)], "doc_id long, text string")
    whole, short = (sorted(map(tuple, exact_dedup.exact_dedup(df, digest_bits=b).collect())) for b in (256, 8))
    assert whole == short and sum(r[3] for r in whole) == 37


def brute(rows, words, radius):
    fp = np.array([simhash.fingerprint(t or "", words) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = graph.forest(len(rows), *np.nonzero(near))
    least: dict = {}
    for (d, _), k in zip(rows, label.tolist(), strict=True):
        least[k] = min((x for x in (least.get(k), d) if x is not None), default=None)
    return sorted(((d, format(int(f), "016x"), least[k]) for (d, _), f, k in zip(rows, fp, label.tolist(), strict=True)), key=str)


def test_fingerprint_by_hand():
    import xxhash

    text = "The  Cat sat\non THE mat é"
    words = ["the", "cat", "sat", "on", "the", "mat", "é"]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text, 3) == want
    assert simhash.fingerprint(" \n", 3) == 0 and simhash.fingerprint("A b", 3) == xxhash.xxh64_intdigest(b"a b", 42)


def test_query(spark, documents):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in documents.collect()], 3, 2)


@pytest.mark.parametrize("bucket", [20_000, 40])
def test_large_buckets(spark, bucket):
    rng = random.Random(2)
    base, rows = [rng.choice("abcdefghij") * 3 for _ in range(300)], []
    for i in range(300):
        x = list(base)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(300)] = str(rng.random())
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(df, 3, 2, bucket=bucket).collect()), key=str)
    assert got == brute(rows, 3, 2)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_near_pairs(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 2, 63, 64, 65, 500):
        fp = rng.integers(0, 2**64, max(1, n // 6), dtype=np.uint64)[rng.integers(0, max(1, n // 6), n)]
        for i in range(n):
            for _ in range(rng.integers(0, 4)):
                fp[i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        group = np.sort(rng.integers(0, max(1, n // 40), n))
        a, b = simhash.near_pairs(fp, group, radius)
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        i, j = np.nonzero(near & (group[:, None] == group[None, :]))
        found, every = graph.forest(n, a, b), graph.forest(n, *np.nonzero(near))
        assert (found[i] == found[j]).all() and (every[a] == every[b]).all()


def test_near_edges(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(odd).collect()), key=str) == brute(rows, 5, 2)
    assert simhash.near_dedup(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[103] == got[101] == got[100] == 100 and len(got) == 64


def test_deliveries(spark, tmp_path):
    """A later delivery meets the state of the earlier ones; repeating one changes nothing."""
    one = [(10, "a b"), (11, "c"), (12, "a  b")]
    two = [(5, "c"), (20, "a\tb"), (21, "new"), (None, "c")]
    for name, rows in (("one", one), ("two", two)):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/{name}")
    state = f"file://{tmp_path}/state"

    def deliver(name):
        got = exact_dedup.deliver(spark.read.parquet(f"{tmp_path}/{name}"), state, name)
        return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str)

    assert deliver("one") == sorted([(10, 10, 2, True), (11, 11, 1, True), (12, 10, 2, False)], key=str)
    second = sorted([(5, 5, 3, True), (20, 10, 3, False), (21, 21, 1, True), (None, 5, 3, False)], key=str)
    assert deliver("two") == second and deliver("two") == second
    assert deliver("one") == sorted([(10, 10, 3, True), (11, 5, 3, False), (12, 10, 3, False)], key=str)


def test_a_delivery_that_failed_half_way(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    state = f"file://{tmp_path}/state"
    # Digests that a lost driver left unfinished, and none of which the stream has seen.
    spark.createDataFrame([(b"x", (False, 1, "f", 0), "x")], exact_dedup.DIGESTS).write.parquet(f"{state}/digests/d")
    (tmp_path / "state/digests/d/_SUCCESS").unlink()
    got = exact_dedup.deliver(docs, state, "d")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(i, i % 7, len(range(i % 7, 50, 7))) for i in range(50)]


def test_bitmap_passes_every_hit(spark, monkeypatch):
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"), "id")
    hits = rows.filter("id % 10 = 0").select("key")
    for bits, most in ((1 << 27, 210), (32768, 300)):
        monkeypatch.setattr(exact_dedup, "BITMAP", bits)
        got = {r.id for r in exact_dedup._marked(rows, hits).collect()}
        assert got >= set(range(0, 2000, 10)) and len(got) <= most
