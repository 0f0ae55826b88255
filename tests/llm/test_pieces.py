import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces._model(None)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


HARD = ["", " ", "  ", "\n", " \n ", "a", " a", "a  b   c ", "x\n\ny", "a \n b", "▁", "a▁b ▁ c", "é ñ ß 你好 🙂́", "\x00 a\x01", "</s> <s> <unk> <0x41>", "a\tb\r\nc", "word" * 3000, "a" * 5000 + " " * 40 + "\n" * 9, "﻿x y�", "   lead", "trail   "]


def same(model, library, text):
    want = library.encode(text, add_eos=True)
    ids, begin, end = model.encode(text)
    assert ids == want
    assert model.decode(ids) == library.decode(want)
    n, a, b = model.digest(text)
    assert n == len(want)
    assert a == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert b == hashlib.sha256(library.decode(want).encode()).hexdigest()
    data = text.encode()
    assert all(x <= y for x, y in zip(begin, end, strict=True))
    # the distinct spans, in order, tile the text
    at = 0
    for x, y in zip(begin, end, strict=True):
        assert x <= at
        at = max(at, y)
    assert at == len(data)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(model, library, text):
    same(model, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁abthe.é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(model, library, text):
    same(model, library, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_matches_the_library(rule):
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = pieces.PieceModel(norm.serialized_model_proto())
    for text in [*HARD, "ﬁne ① ｱｲｳ ㌔ Ａｂｃ", "  many   spaces　here  ", "Ångström ﷺ ½"]:
        if "\x00" in text:
            continue
        want, offsets = norm.normalize(text, with_offsets=True)
        got, source = model.normalise(text)
        assert got == want, text
        chars = [len(text.encode()[:i].decode()) for i in source]
        starts, at = [], 0
        for c in got:
            starts.append(at)
            at += len(c.encode())
        assert [chars[i] for i in starts] == list(offsets)[: len(starts)], text


def test_table(spark, library):
    rows = [(1, "the cat\nsat", "x"), (2, None, "y"), (3, "", None), (None, "é", "z"), (1, "the cat\nsat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.digest_documents(docs).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.ids_sha256): r.n_tokens for r in got}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        assert by[(i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] == len(ids)
    encoded = pieces.encode_documents(docs)
    back = {(r.doc_id, r.text) for r in pieces.decode_documents(encoded).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert pieces.digest_documents(docs.limit(0)).count() == 0


def test_whole_corpus_equals_the_library(spark, sf_small, library):
    from tidewell.llm.registry import QUERIES

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_piece_codec"](spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for r in docs:
        ids = library.encode(r.text or "", add_eos=True)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def brute_spans(model, text):
    """Each piece's bytes in normalise()'s text, looked up in its alignment one by one."""
    normal, source = model.normalise(text)
    data, at, left, out = normal.encode(), 0, 0, []
    for k in model.encode(text)[0][:-1]:
        if model.types[k] == pieces.BYTE:
            if not left:
                width = left = len(data[at:].decode()[0].encode())
            left -= 1
            out.append((source[at], source[at + width]))
            at += 0 if left else width
        else:
            width = len(model.pieces[k].encode())
            out.append((source[at], source[at + width]))
            at += width
    assert at == len(data)
    return [*out, (source[-1], source[-1])]


def spans_digest(spans):
    return hashlib.sha256(b"".join(x.to_bytes(4, "little") for span in spans for x in span)).hexdigest()


@pytest.mark.parametrize("text", HARD)
def test_spans_of_hard_texts(model, text):
    normal, source = model.aligned(text)
    assert (normal, source.tolist()) == model.normalise(text)
    want = brute_spans(model, text)
    assert list(zip(*model.encode(text)[1:], strict=True)) == want
    assert model.digests(text)[3] == spans_digest(want)


def test_the_query_gives_the_spans(spark, sf_small, model):
    from tidewell.llm.registry import QUERIES

    got = {r.doc_id: r.spans_sha256 for r in QUERIES["op10_piece_codec"](spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").limit(60).collect()
    assert all(got[r.doc_id] == spans_digest(brute_spans(model, r.text or "")) for r in docs)


@pytest.fixture(scope="module")
def without_bytes():
    """The same vocabulary in a model that has no byte pieces: an unknown character is the unknown piece."""
    with open(pieces.default_model(), "rb") as f:
        data = f.read()
    out = b""
    for field, _, value, raw in pieces.proto_fields(data):
        if field == 1:
            parts = list(pieces.proto_fields(value))
            kind = {f: v for f, _, v, _ in parts}.get(3, pieces.NORMAL)
            raw = pieces._delimited(1, b"".join(r for f, _, _, r in parts if f != 3) + bytes([24, pieces.UNUSED if kind == pieces.BYTE else kind]))
        elif field == 2:
            raw = pieces._delimited(2, b"".join(r for f, _, _, r in pieces.proto_fields(value) if f != 35))
        out += raw
    return out


@pytest.mark.parametrize("text", ["🙂", "a 🙂🙃 b", "x\x01y \x02\x02z end", "plain words", "", "🙂\n🙂 \x01", "é\x01" * 50])
def test_a_model_without_byte_fallback(without_bytes, text):
    own, library = pieces.PieceModel(without_bytes), sentencepiece.SentencePieceProcessor(model_proto=without_bytes)
    same(own, library, text)
    normal, source = own.normalise(text)
    at, want = 0, []
    for piece in library.encode(text, out_type=str):
        n = len(piece.encode())
        assert normal.encode()[at : at + n] == piece.encode()
        want.append((source[at], source[at + n]))
        at += n
    assert list(zip(*own.encode(text)[1:], strict=True)) == [*want, (source[-1], source[-1])]


def test_results_do_not_depend_on_the_cache(model, monkeypatch):
    texts = [f"word{i % 7} other{i} words{i % 3} é🙂{i}" for i in range(60)]
    want = [model.digests(t) for t in texts]
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", 8)
    small = pieces._model(None)
    assert [small.digests(t) for t in texts] == want and len(small._new) <= 8
