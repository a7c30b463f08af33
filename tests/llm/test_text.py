"""WARC, language identification, extraction, scoring and I-Match."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from rayframe.llm import html_text, imatch, langid, lattice, queries, warc

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def warc_brute(rows):
    best: dict = {}
    for k, (i, _, h) in enumerate(rows):
        rank = (-(2**63) if i is None else i, k)
        best[h or ""] = max(best.get(h or "", rank), rank)
    out = []
    for k, (i, _, h) in enumerate(rows):
        body, (top, at) = (h or "").encode(), best[h or ""]
        other = None if at == k or top == -(2**63) else top
        out.append((i, len(body), warc.base32_sha1(body), "response" if at == k else "revisit", other))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [100, 1 << 14])
def test_warc(spark, segment):
    rng = random.Random(1)
    some = [None, "", "same\r\n\r\nWARC/1.1\r\n" * 7]
    rows = [(i, f"http://x/\r\n{i}" if i % 3 else None, rng.choice([*some, "é" * rng.randint(1, 20_000), "日本\r\n\r\n" * rng.randint(1, 2000)])) for i in range(60)]
    rows += [(5, "u", "dup"), (5, "u", "dup"), (None, None, None), (None, None, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted(map(tuple, warc.round_trip(df, segment).collect()), key=str) == warc_brute(rows)


def test_warc_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op3_warc(spark, SF).collect()), key=str) == warc_brute(rows)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_segments(spark, tmp_path):
    whole = [x + b"\r\n\r\n" for x in warc.records(1, "urn:a", "http://a", b"p" * 500, None, 150)]
    assert len(whole) > 3
    for name, parts in (("missing", whole[:1] + whole[2:]), ("shuffled", whole[::-1]), ("open", whole[:-1])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(parts[:2]))
        (tmp_path / name / "b.warc").write_bytes(b"".join(parts[2:]))
        r = warc.read_archives(spark, f"file://{tmp_path}/{name}").collect()
        assert len(r) == 1 and (r[0].problem is None) == (name == "shuffled")
        assert name != "shuffled" or bytes(r[0].payload) == b"p" * 500
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert [r[1] for r in warc.parse(whole[0][:-60])] == ["broken"]



def test_automaton():
    rng = random.Random(3)
    text = [rng.randrange(3) for _ in range(60)]
    rows = langid.suffix_automaton(text, 4)
    parts = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 7))}
    for k in range(1, 5):
        for word in np.ndindex(*[3] * k):
            state = 0
            for c in word:
                state = rows[state, c] if state >= 0 else -1
            assert (state >= 0) == (word in parts)


def test_cross_parsing():
    samples = {"a": ["the cat sat on the mat"], "b": ["der hund und die katze sind da"]}
    model = langid.train(samples, 1000)
    lookup = model.lookup()
    for text in ("The dog and the cat", "und", "ЖЖ x", "", "123"):
        got, n = langid.phrases([text], model, lookup)
        s = langid.symbols(text, lookup).tolist()
        for k, name in enumerate(model.names):
            sample = [0, *langid.symbols(samples[name][0], lookup).tolist(), 0]
            subs = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
            count = i = 0
            while i < len(s) and any(s):
                j = i + 1
                while j < len(s) and tuple(s[i : j + 1]) in subs:
                    j += 1
                i, count = j, count + 1
            assert got[0, k] == count and (n[0] == 0) == (not any(s))


def test_language_query(spark, odd, empty):
    got = queries.op4_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) == 1000
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    found = langid.identify(odd).collect()
    assert len(found) == odd.count() and {r.lang_pred for r in found if r.doc_id in (3, 9, 10)} == {"und"}
    assert langid.identify(empty).count() == 0
    kept = langid.identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 11, 12, None}
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_extraction(spark):
    rows = queries.op5_main_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x)))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extraction_edges(spark):
    side = (
        "<html><body><header>Site</header><div id='cookie-notice'>We use cookies</div><div class=layout><div class='sidebar'><p>Other long text, in a side bar, which is long enough, yes, it is.</p></div>"
        "<div class=content><h1>Title here</h1><p>First paragraph, long enough, of prose with <a href=x>link</a> inside it.<p>Second &lt;one&gt;, also of <i>some</i> length, with\n\nwhite   space.<ul><li>item one<li>item two</ul>"
        "<form><input><button>Send</button></form><div class='comments'><p>Reader says, this is nice, and long enough to count, really.</p></div></div></div><footer>bye</footer>"
    )
    cases = {
        side: "Title here\nFirst paragraph, long enough, of prose with link inside it.\nSecond <one>, also of some length, with white space.\nitem one\nitem two",
        "": "", "just text": "just text", "<p>Hello &amp; bye": "Hello & bye", "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc", "<p>a < b</p><p>1 <2</p>": "a < b\n1 <2",
        "<div>" * 3000 + "<p>deep text</p>": "deep text", "<div><p>Some text that is long enough, yes.</p><p>More <a hre": "Some text that is long enough, yes.\nMore", "<nav>a</nav><script>x</script>": "",
    }
    assert html_text.main_text(None) == ""
    for page, text in cases.items():
        assert html_text.main_text(page) == text
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=str) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_lattice_by_hand():
    lat = lattice.Lattice([b" a", b"ab", b"b", b"ba"])
    weights = lat.weights(np.arange(1.0, 1 + len(lat.pieces)), 3.0)
    p = dict(zip(lat.pieces, np.exp(weights[0]), strict=True))
    starts = [x for x in p if x[:1] == b" "]
    assert abs(sum(p[x] for x in starts) - 1) < 1e-9 and abs(sum(v for x, v in p.items() if x not in starts) + math.exp(weights[1]) - 1) < 1e-9

    def total(s):
        return 1.0 if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    words = [b"abba", b"a", b"zab", b"bababa"]
    got = lat.score(words, *weights)
    assert np.allclose(got, [math.log(total(b" " + w)) + weights[1] for w in words])

    def uses(s):
        """(probability, expected uses times probability) over all segmentations."""
        if not s:
            return 1.0, Counter()
        q, n = 0.0, Counter()
        for k in range(1, len(s) + 1):
            if s[:k] in p:
                r, m = uses(s[k:])
                q += p[s[:k]] * r
                n[s[:k]] += p[s[:k]] * r
                for x, v in m.items():
                    n[x] += p[s[:k]] * v
        return q, n

    counts, n = lat.expected(words, *weights)
    want = Counter()
    for w in words:
        q, m = uses(b" " + w)
        for x, v in m.items():
            want[x] += v / q
    assert n == len(words) and np.allclose(counts, [want[x] for x in lat.pieces])


def scores_hold(df, rows):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [[*(r.text or "").encode().lower().split(), b""] for r in rows]
    c = Counter(t for r, ts in zip(rows, tokens, strict=True) if not held(r.doc_id) for t in ts)
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for r, ts in zip(rows, tokens, strict=True):
        want[r.doc_id].append((held(r.doc_id), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)))
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score < 0 and any(tuple(r)[1:5] == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9) for w in want[r.doc_id])
    return got


def test_scores(spark, documents, odd, empty, monkeypatch):
    got = scores_hold(queries.op7_lattice(spark, SF), documents.collect())
    train = [r for r in got if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)
    scores_hold(lattice.score(odd, MODEL), odd.collect())
    assert lattice.score(empty, MODEL).count() == 0
    none = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    assert lattice.score(none, MODEL, learn=F.lit(False)).first().train_tokens == 0


def test_word_probabilities_sum_to_less_than_one():
    lat = lattice.Lattice([b" a", b" b", b"ab", b"ba", b"bb"])
    weights = lat.weights(np.where(np.isin(np.array(lat.pieces, object), [b" ", b"a", b"b", b" a", b" b", b"ab", b"ba", b"bb"]), 1e6, 0.0), 2e6)  # far above what single bytes get anyway
    words = [bytes(x) for n in range(1, 9) for x in (np.array(list(np.ndindex(*[2] * n)), np.uint8) + 97)]
    assert 0.5 < np.exp(lat.score(words, *weights)).sum() < 1


def test_imatch(spark, documents, odd, empty):
    for df in (documents, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: -1 if r[0] is None else r[0])
        want = defaultdict(set)
        for k, (i, x) in enumerate(rows):
            # Which of several rows with one id comes next is open to the order of ties.
            other = next((rows[(k + d) % len(rows)][0] for d in range(1, len(rows)) if rows[(k + d) % len(rows)][0] != i), i)
            nexts = {t for j, t in rows if j in (i, other)}
            want[i] |= {(len(x), hashlib.sha256((x[: len(x) - len(x) // 2] + t[: len(x) // 2]).encode()).hexdigest()) for t in nexts}
        got = imatch.fingerprint_edits(df).collect()
        assert len(got) == len(rows) and all((r.n_chars, r.edited_sha256) in want[r.doc_id] for r in got)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        same = defaultdict(set)
        text = defaultdict(set)
        for i, x in rows:
            text[i].add(x)
        for r in got:
            if len(text[r.doc_id]) == 1:
                same[next(iter(text[r.doc_id]))].add(r.fingerprint)
        assert all(len(s) == 1 for s in same.values())
        if df is documents:
            assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)
    assert imatch.fingerprint_edits(empty).count() == 0


def test_lexicon(spark):
    df = spark.createDataFrame([(i, f"all half{i % 2} quarter{i % 4} own{i}") for i in range(40)], "doc_id long, text string")
    assert imatch.lexicon(df, 0.1, 0.3) == [b"quarter0", b"quarter1", b"quarter2", b"quarter3"]
    assert len(imatch.lexicon(df, 0.0, 1.0, terms=8)) <= 8
    of = imatch.Fingerprinter([b"a", b"b"])
    assert imatch.likeness(of("a b c"), of("B, a.")) == 1.0 and imatch.likeness(of(""), of("a")) == 0.0 and imatch.likeness(of(""), of("?")) == 1.0


def test_memberships():
    bits = imatch.memberships(imatch.hashes([b"%d" % i for i in range(4000)]))
    share = bits.mean(0).reshape(8, 16).mean(1)
    assert bits.shape == (4000, 128) and bits[:, 0].all()
    assert all(abs(s - 2.0 ** -(g + 2)) < 0.3 * 2.0 ** -(g + 2) for g, s in enumerate(share) if g)


def test_broken_archives(spark, tmp_path):
    """What is broken is reported, and what is whole is read."""
    import gzip

    good = [b"".join(x + b"\r\n\r\n" for x in warc.records(i, f"urn:{i}", "u", b"payload %d" % i, None, 1 << 20)) for i in range(4)]
    wrong = good[1].replace(b"Content-Length: ", b"Content-Length: x", 1)
    (tmp_path / "a.warc").write_bytes(good[0] + wrong + good[2])
    (tmp_path / "b.warc").write_bytes(b"nonsense" + good[3][:-30])
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(good[1]) + gzip.compress(good[3]))
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(good[1])[:-10])
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got if r.problem is None) == [(0, b"payload 0"), (1, b"payload 1"), (2, b"payload 2"), (3, b"payload 3")]
    assert [r.record_type for r in got if r.problem] == ["broken"] * sum(bool(r.problem) for r in got) and sum(bool(r.problem) for r in got) == 3


def test_malformed_sizes():
    """Sizes that are no plain numbers are refused, and bytes changed at random end in rows or problems."""
    import random

    for size in (b"-6", b"+5", b"1_0", b"0x5", b"", b" 5 5", b"f" * 40):
        with pytest.raises(ValueError):
            warc.dechunked(b"1\r\nX\r\n" + size + b"\r\nhello\r\n0\r\n\r\n")
    assert warc.dechunked(b"5 ;x=y\r\nhello\r\n0\r\n\r\n") == b"hello"
    good = b"".join(x + b"\r\n\r\n" for i in range(3) for x in warc.records(i, f"urn:{i}", "u", b"payload %d " % i * 30, None, 200))
    first = good.index(b"Content-Length: ") + 16
    for length in (b"-163", b"+163", b"1_63", b"9" * 30, b"163x", b""):
        rows = list(warc.parse(good[:first] + length + good[good.index(b"\r\n", first) :]))
        assert rows[0][1] == "broken" and len(rows) == len(list(warc.parse(good)))
    for name in (b"Page-ID: ", b"WARC-Segment-Number: "):
        rows = list(warc.parse(good.replace(name, name + b"9" * 25, 1)))
        assert [r[1] for r in rows].count("broken") == 1
    rng = random.Random(4)
    for _ in range(300):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        for row in warc.parse(bytes(data)):
            if row[1] == "response":
                try:
                    warc.payload_of(row[9])
                except ValueError:
                    pass
