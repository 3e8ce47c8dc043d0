import hashlib

import pytest
from helpers import SCHEMA, edge_rows, edge_table, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import pieces
from quirelake.llm.queries import default_vocabulary, op6_sentencepiece

CODEC = pieces.codec(default_vocabulary())
TEXTS = ["", " ", "   two  spaces ", "a\x00b", "😀 x\n\n\ty", "▁a ▁ b", "x" * 5000, "ab" * 300, "İıſK <s></s> <0x41>", "é" * 50, "﻿​�", "don't   stop", prose(2, 3000), "日本語のテキスト", "\r\n\x85 "]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(text):
    ids = CODEC.encode(text)
    assert ids == CODEC.library.encode(text, add_eos=True)
    assert CODEC.decode(ids) == CODEC.library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_the_same_as_library(text):
    ids = CODEC.encode(text)
    assert ids == CODEC.library.encode(text, add_eos=True)
    assert CODEC.decode(ids) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abehnrt ▁", min_size=1, max_size=40))
def test_both_agendas_agree(part):
    long = [s for s in CODEC._merge_long(part) if s]
    assert long == CODEC._merge_short(part)


def test_kept_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 40)
    codec = pieces.PieceCodec(default_vocabulary())
    text = prose(9, 2000)
    assert codec.encode(text) == codec.library.encode(text, add_eos=True)
    assert len(codec.parts) + len(codec.parts.older) <= 41


def test_cuts_are_proven_over_all_pieces(monkeypatch):
    solo = pieces.prove_cuts(CODEC.cost)
    assert solo and all(c not in p for p in CODEC.cost for c in solo) and CODEC.lead == solo[0]
    assert pieces.prove_cuts(["ab", "a▁b"]) is None and pieces.prove_cuts(["▁▁a", "ab", "x"]) == "".join(map(chr, range(97))) + "".join(map(chr, range(99, 128)))
    # A vocabulary with a piece across a cut isn't cut, and every text is compared.
    monkeypatch.setattr(pieces, "prove_cuts", lambda _: None)
    codec = pieces.PieceCodec(default_vocabulary())
    texts = [t for t in TEXTS if len(t) < 1000]
    assert codec.lead is None and codec.checked(texts)[0] == [codec.library.encode(t, add_eos=True) for t in texts]


def test_preparation_is_read_from_the_model_file():
    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3, value])
        return bytes([number << 3 | 2, len(value)]) + value

    model = CODEC.library.serialized_model_proto()
    assert pieces.taken_as_it_stands(model)
    plain = field(3, field(1, b"identity") + field(4, 0))
    assert pieces.taken_as_it_stands(field(1, field(1, b"a")) + plain)
    assert list(pieces.fields(field(1, b"xy") + field(2, 5) + bytes([3 << 3 | 5]) + b"1234")) == [(1, b"xy"), (2, 5), (3, b"1234")]
    for other in (field(3, field(2, b"table") + field(4, 0)), field(3, b""), field(3, field(3, 0) + field(4, 0)), field(3, field(4, 0) + field(5, 0)), plain + field(1, field(1, b"a") + field(3, 4)), b""):
        assert not pieces.taken_as_it_stands(other)


def test_mismatch_is_an_error():
    codec = pieces.PieceCodec(default_vocabulary())
    codec.cost = {p: -c for p, c in codec.cost.items()}
    with pytest.raises(pieces.PieceMismatch):
        codec.checked(["the weather there"])


def test_edge_rows(spark):
    rows = pieces.encode_documents(edge_table(spark), default_vocabulary()).collect()
    want = sorted((r[0] or -1, CODEC.library.encode(r[1] or "", add_eos=True)) for r in edge_rows())
    assert sorted((r.id or -1, r.ids) for r in rows) == want
    assert pieces.encode_documents(spark.createDataFrame([], SCHEMA), default_vocabulary()).count() == 0


def test_query_digests(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op6_sentencepiece(spark, sf_dir).collect():
        ids = CODEC.library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(CODEC.library.decode(ids)))
