"""The pipeline against its stages' plain versions, stage by stage."""

from test_similar import kept

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "pack"]
    from rayframe.llm.common import keep

    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in docs.collect()]
        got = keep(stage(spark, docs, SF), name)
        assert got.columns == documents.columns
        if name == "language":
            want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
        elif name == "exact":
            first: dict = {}
            for r in sorted(rows):
                first.setdefault(normal(r[1]), r)
            want = list(first.values())
        else:
            ids = kept([(r[0], r[1]) for r in rows])
            want = [r for r in rows if r[0] in ids]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        docs = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def normal(text):
    out, blank = [], False
    for c in text or "":
        if c in " \t\n\v\f\r":
            if not blank:
                out.append(" ")
            blank = True
        else:
            out.append(c)
            blank = False
    return "".join(out)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_and_empty_tables(spark, odd, empty):
    """All stages, one after the other, over nulls, copies, long texts, names that clash, and no rows at all."""
    from rayframe.llm.common import keep

    for df in (odd, empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = keep(stage(spark, docs, SF), name)
            assert docs.columns == df.columns
        ids = sorted(str(r.doc_id) for r in docs.collect())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sorted({str(r.doc_id) for r in packed}) == ids
        if df is odd:  # no learned language for texts without a letter; the two spellings of one text are one
            assert ids == ["1", "11", "12", "None"]
