"""Token counts, pieces and packing against the libraries and by their own invariants."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from rayframe.llm import packing, pieces, queries, token_counts

SF = "/root/testdata/sf0.001"
ALPHABET = [*"aetin ron  \n\t\x85\xa0　\x1c\x1f᠎​▁éßİΣςＡ①日本語한국🎉½²٣'sre.,!-_<>|#0123456789ﬁ", "<|endoftext|>", "<|startoftext|>", "don't", " the", "</s>", "<0x41>"]


@pytest.fixture(scope="module")
def texts(documents):
    rng = random.Random(5)
    made = ["".join(rng.choices(ALPHABET, k=rng.choice([1, 3, 8, 30, 80]))) for _ in range(3000)]
    return [*made, "", "a" * 2000, " " * 500, "ab" * 1500, "▁" * 37, "日本語" * 400, "\n\n\n x", "thethethe" * 100, *[r.text for r in documents.collect()]]


def test_counts(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.ByteBpeCounter(path, limit=100).count(texts) == want


def test_counts_refuse_other_files():
    with pytest.raises(ValueError):
        token_counts.ByteBpeCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces(texts, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.PieceModel(path)
    want = library.encode(texts)
    assert [model.encode(t) for t in texts] == want
    assert [model.decode(x) for x in want] == [library.decode(x) for x in want]
    monkeypatch.setattr(pieces, "LONG", 4)  # the heap in place of the rounds
    assert [model.encode(t) for t in texts[:400]] == want[:400]
    rng = random.Random(1)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 1, 2, 0, 29871]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_piece_queries(spark, documents, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (documents, odd):
        want = []
        for r in df.collect():
            ids = library.encode(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert sorted(map(tuple, pieces.piece_digests(df, path).collect()), key=str) == sorted(want, key=str)
    assert pieces.piece_digests(empty, path).count() == 0
    there = pieces.decode_column(pieces.encode_column(odd, path), path)
    assert all(r.decoded == (r.text or "") for r in there.collect())


def test_count_query(spark, documents, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (documents, odd):
        want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in df.collect()]
        assert sorted(map(tuple, token_counts.token_counts(df, path).collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty, path).count() == 0


def test_word_ids(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert packing.WordIds(path).encode(texts) == want


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 5, 40, 4), packing.Limits(64, 3, 64, 8)])
def test_packer(cut, limits):
    rng = random.Random(1)
    packer, out, items = packing.VectorPacker(limits, cut), [], {}
    for k in range(1500):
        n = rng.choice([0, 1, 2, 3, rng.randint(1, limits.tokens * (3 if cut else 1))])
        items[k] = (n, rng.randint(0, n if cut else min(n, limits.loss)))
        out += packer.add(k, *items[k])
    out += packer.close()
    pieces_of, bins = defaultdict(list), defaultdict(list)
    for key, start, length, loss, number, offset in out:
        pieces_of[key].append((start, length, loss))
        bins[number].append((offset, length, loss))
    for k, (n, loss) in items.items():
        end = 0
        for start, length, _ in sorted(pieces_of[k]):
            assert start == end and length > 0
            end += length
        assert end == n and sum(p[2] for p in pieces_of[k]) == loss and (cut or len(pieces_of[k]) <= 1)
    for own in bins.values():
        end = 0
        for offset, length, _ in sorted(own):
            assert offset == end
            end += length
        assert end <= limits.tokens and len(own) <= limits.segments and sum(p[2] for p in own) <= limits.loss
    if not cut:
        with pytest.raises(ValueError):
            packer.add("x", limits.tokens + 1, 0)


def pieces_hold(df, rows, tokens=4096):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for r in rows:
        ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 2])
    bins, seen = defaultdict(list), defaultdict(int)
    for p in df.collect():
        assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
        bins[p.sequence_id].append((p.offset, p.length))
        seen[p.doc_id] += p.length
    assert seen == {k: sum(map(len, v)) for k, v in ids.items()}
    padding = 0
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= tokens
        padding += 0 if end & (end - 1) == 0 else tokens - end
    return padding / max(1, sum(seen.values()))


def test_packing_query(spark, documents, odd, empty):
    assert pieces_hold(queries.op6_packing(spark, SF), documents.collect()) < 0.01
    path = public_tokenizers.path("word_bpe_49k.json")
    assert pieces_hold(packing.pack_documents(odd, path), odd.collect()) < 0.01
    assert packing.pack_documents(empty, path).count() == 0
