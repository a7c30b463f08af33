"""Fill-in-the-middle against plain Python, over odd texts, and the query against SQL."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from rayframe.llm import infill

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNITS.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digests(row, text):
    return *row[:5], hashlib.sha256(row[5].encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_odd(spark, odd, empty):
    texts = ["<", "<P", "P>", "<P>", "a <S> b", "<M>", "< P>", " ", "\t\n", "a", " a", "a ", "\x0b\x0c\x85  x", "𝔘𝔫𝔦 𝔠𝔬𝔡𝔢", "<<P <<S <M", "\x00 \x1c"]
    more = spark.createDataFrame([(i, t) for k, t in enumerate(texts) for i in range(100 * k, 100 * k + 40)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", F.lit(1).alias("n"), F.lit("x").alias("form"), F.lit("u").alias("units")).unionByName(more, allowMissingColumns=True)
    rows = docs.collect()
    got = sorted(map(tuple, infill.infill_digests(docs).collect()), key=str)
    assert got == sorted((digests(plain(r.doc_id, r.text), r.text) for r in rows), key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert infill.infill_digests(empty).count() == 0


def test_arrange(spark):
    docs = spark.createDataFrame([(i, f"w{i} and  then <x>\n" * (i % 7)) for i in range(300)], "doc_id long, text string")
    rows = infill.arrange(docs, seed=7, rate=100, spm=50).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert all(r.back == r.text for r in rows) and all((r.form == "plain") == (r.text == "") for r in rows)
    assert all(r.prefix + r.middle + r.suffix == r.text for r in rows if r.form != "plain")
    assert sorted((r.doc_id, r.form, r.output) for r in rows) == sorted((i, w[2], w[5]) for i, w in ((r.doc_id, plain(r.doc_id, r.text, 7, 100, 50)) for r in rows))
    assert 80 < sum(r.form == "spm" for r in rows) < 180


def test_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}')")
    docs = spark.read.parquet(path)
    out = infill.infill_digests(docs)
    want = sorted(con.execute(f"select {', '.join(out.columns)} from ({infill.SQL})").fetchall())
    assert sorted(map(tuple, out.collect())) == want == sorted(digests(plain(r.doc_id, r.text), r.text) for r in docs.select("doc_id", "text").collect())
