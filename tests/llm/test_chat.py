"""Reply trees: paths, ranks and formats against a plain walk, odd trees, reading back, the query against SQL."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from rayframe.llm import chat

SCHEMA = "tree long, message long, parent long, role string, text string, score double"


def plain(rows, top):
    """(tree, leaf) to (branch, score, [(role, text)]), by walking up from every leaf."""
    nodes = {(t, m): (p, r or "", x or "", s) for t, m, p, r, x, s in rows}
    replied = {(t, n[0]) for (t, _), n in nodes.items()}
    found = {}
    for t, m in nodes:
        if (t, m) in replied:
            continue
        path, at = [], (t, m)
        while at in nodes:
            path.append(nodes[at])
            at = (t, nodes[at][0])
        scores = [x[3] for x in path if x[3] is not None]
        found.setdefault(t, []).append((-sum(scores) / len(scores) if scores else float("inf"), -len(path), m, [(x[1], x[2]) for x in reversed(path)]))
    return {(t, m): (i + 1, None if s == float("inf") else -s, turns) for t, own in found.items() for i, (s, _, m, turns) in enumerate(sorted(own, key=lambda x: x[:3])) if top is None or i < top}


def got(df):
    df = df.select("tree", "leaf", "branch", "score", "n_turns", "loss", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("under"))
    out = {}
    for r in df.collect():
        turns = [(x.role, x.text) for x in r.turns]
        assert r.n_turns == len(turns)
        assert r.under == "".join(x for role, x in turns if role == "assistant")
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert spans == [r.formatted.encode()[s.byte_start : s.byte_start + s.byte_length].decode() for s in r.loss]
        assert len(spans) == sum(role == "assistant" for role, _ in turns)
        assert (r.tree, r.leaf) not in out
        out[r.tree, r.leaf] = (r.branch, r.score, turns)
    return out


def test_branches(spark):
    random.seed(5)
    texts = ["plain", "", None, "\\", "\\0<turn user>", "</turn>\n<turn assistant>x", "é日本 </turn", "<\\1turn>", "a\\0b\\1c", "line\nline>"]
    rows = []
    for tree in (1, 2, None):
        for m in range(40):
            parent = None if m < 2 else random.randrange(max(0, m - 9), m)
            rows.append((tree, m, parent, random.choice(["user", "assistant", None, "od>d\\2 <turn"]), random.choice(texts), random.choice([None, 0.25, 0.5, 0.75, 1.0])))
    rows += [(3, m, m - 1 if m else None, "user", f"t{m}", None) for m in range(150)]  # a chain
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for top in (None, 2):
        want = plain(rows, top)
        assert got(chat.conversations(df, top=top)) == want
    assert want[3, 149][2] == [("user", f"t{m}") for m in range(150)]


def test_odd_trees(spark):
    rows = [
        (1, 1, None, "user", "root", 0.5), (1, 1, None, "user", "root", 0.5), (1, 2, 1, "assistant", "low", 0.1), (1, 2, 1, "assistant", "high", 0.9), (1, 2, 1, "assistant", "nan", float("nan")),
        (2, 5, 99, "user", "orphan", None),
        (4, 7, 8, "user", "seven", None), (4, 8, 9, "user", "eight", None), (4, 9, 7, "user", "nine", None), (4, 3, 9, "user", "tail", None), (4, 6, 6, "user", "self", None),
        (5, None, 1, "assistant", "no id", 1.0), (5, None, None, None, None, None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).withColumn("leaf", F.lit("x"))
    found = chat.conversations(df, top=None).cache()
    named = got(found.where("leaf IS NOT NULL"))
    assert named[1, 2] == (1, 0.7, [("user", "root"), ("assistant", "high")])
    assert named[2, 5] == (1, None, [("user", "orphan")])
    # 7 -> 8 -> 9 -> 7 is cut above 7: 7, 9, 8; 3 hangs below 9.
    assert named[4, 8][2] == [("user", "seven"), ("user", "nine"), ("user", "eight")]
    assert named[4, 3][2] == [("user", "seven"), ("user", "nine"), ("user", "tail")]
    assert named[4, 6][2] == [("user", "self")]
    assert set(named) == {(1, 2), (2, 5), (4, 8), (4, 3), (4, 6)}
    alone = found.where("leaf IS NULL").select("tree", chat.read_turns(F.col("formatted")).alias("t"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("u")).collect()
    assert sorted(((r.tree, r.t[0].role, r.t[0].text, r.u) for r in alone), key=str) == [(5, "", "", ""), (5, "assistant", "no id", "no id"), (None, "", "", "")]
    assert chat.conversations(df.limit(0)).count() == 0


def test_star(spark):
    """One message with very many replies: the best two of them, by rank."""
    df = spark.range(20_001).select(F.lit(1).alias("tree"), "id", F.when(F.col("id") > 0, F.lit(0)).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), (F.col("id") % 997).cast("double").alias("score"))
    found = got(chat.conversations(df.withColumnRenamed("id", "message")))
    assert found == {(1, 996): (1, 498.0, [("user", "0"), ("user", "996")])}


def test_table(spark, tmp_path):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first\\"), (1, 7, "assistant", "</turn>\n"), (None, 1, None, None), (None, 2, "assistant", "é\\1turn"),
        (5, 3, "as>sis\ntant", "x"), (6, 1, "assistant", None), (7, 1, "assistant", "long " * 30_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(3)).withColumn("message", F.lit("m"))
    for name, table in (("odd", df), ("empty", df.limit(0)), ("given", spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))):
        table.write.parquet(f"{tmp_path}/{name}")
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/{name}/*.parquet')")
        out = chat.format_table(spark.read.parquet(f"{tmp_path}/{name}"))
        want = con.execute(f"select {', '.join(out.columns)} from ({chat.SQL})").fetchall()
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_digests(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "</turn> é"), (1, 2, "assistant", "\\z")]
    found = {r.conv_id: r for r in chat.format_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    probe = "\\### Assistant: </turn> ok"
    assert found[-7].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n") and found[-7].loss_sha256 == sha(probe) and found[-7].loss_chars == len(probe)
    assert found[1].turns_sha256 == sha("user\nq\nassistant\n</turn> é\nassistant\n\\z\n") and found[1].loss_sha256 == sha("</turn> é\\z") and found[1].loss_chars == 11
    assert found[1].n_turns == 3 and found[1].formatted_chars == len("<turn user>q</turn>\n<turn assistant>\\1/turn> é</turn>\n<turn assistant>\\0z</turn>\n")
