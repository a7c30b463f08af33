"""Packing of instruction data: loss on answers only, and all three limits at work."""

from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rayframe.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "r"), (1, 4, "assistant", "b"), (1, 5, "user", "t"), (2, 0, "assistant", "x"), (3, 0, "user", None), (None, None, None, "n")]
    got = packing.examples(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted(((r.conv_id, r.prompt, r.answer) for r in got), key=str) == sorted([(1, "s\nq", "a"), (1, "r", "b"), (1, "t", None), (2, "", "x"), (3, "", None), (None, "n", None)], key=str)
    assert len({r.example_id for r in got}) == len(got)
    assert packing.examples(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_all_limits_bind(spark):
    examples = packing.examples(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    short = [(10**12 + i, 0, "", "yes") for i in range(300)]  # many segments, few tokens
    talk = [(2 * 10**12 + i, 0, "why " * 300, "so") for i in range(60)]  # many tokens, little loss
    answers = [(3 * 10**12 + i, 0, "why", "so " * 90) for i in range(60)]  # all loss
    more = spark.createDataFrame(short + talk + answers, "example_id long, conv_id long, prompt string, answer string")
    docs = examples.unionByName(more).repartition(2, "example_id")
    limits = packing.Limits(1024, 12, 256, 64)
    pieces = packing.pack_examples(docs, VOCABULARY, limits=limits).collect()
    tok = Tokenizer.from_file(VOCABULARY)
    sizes = {r.example_id: [len(tok.encode(x or "", add_special_tokens=False).ids) for x in (r.prompt, r.answer)] for r in docs.collect()}
    seen = defaultdict(list)
    for r in pieces:
        seen[r.doc_id].append(r)
    assert seen.keys() == sizes.keys()
    for k, (prompt, answer) in sizes.items():
        at = 0
        for r in sorted(seen[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == prompt + answer + 1
            at += r.length
            assert r.n_loss == max(0, at - max(prompt, r.start))
        assert at == prompt + answer + 1
    bins = defaultdict(lambda: np.zeros(3, int))
    for r in pieces:
        bins[r.sequence_id] += (r.length, 1, r.n_loss)
    full = np.array(list(bins.values()))
    assert (full <= (1024, 12, 256)).all()
    assert ((full == (1024, 12, 256)).sum(0) > 0).all()
    assert len(bins) < 1.35 * max(full.sum(0) / (1024, 12, 256))


def test_odd_examples(spark):
    rows = [(1, None, None), (1, None, None), (None, "a", None), (4, "x " * 5000, "y")]
    df = spark.createDataFrame(rows, "example_id long, prompt string, answer string")
    got = packing.pack_examples(df, VOCABULARY).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 2 and sum(r.n_loss for r in got if r.doc_id == 4) > 1
    assert packing.pack_examples(df.limit(0), VOCABULARY).count() == 0
