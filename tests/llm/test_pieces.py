"""Encoding in pieces against the library, with its own character maps and offsets."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from mlscout.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = "ab  Zß漢字😀ﬁ①ｶﾞ́Å 　▁\t\n.,…​ﬃ½가가 "


def library_maps():
    out = {"identity": b""}
    for name in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf"):
        model = proto.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto())
        out[name] = model.normalizer_spec.precompiled_charsmap
    return out


MAPS = library_maps()
FLAGS = [(p, s, e) for p in (False, True) for s in (False, True) for e in (False, True)]
PAIRS = {}


def pair(name, flags):
    if (name, flags) not in PAIRS:
        prefix, squeeze, escape = flags
        spec = proto.NormalizerSpec(
            name=name, precompiled_charsmap=MAPS[name], add_dummy_prefix=prefix,
            remove_extra_whitespaces=squeeze, escape_whitespaces=escape,
        )
        theirs = sentencepiece.SentencePieceNormalizer(normalizer_spec=spec)
        own = pieces.Normaliser(
            pieces.CharacterMap(MAPS[name]), prefix=prefix, squeeze=squeeze, escape=escape, suffix=False
        )
        PAIRS[name, flags] = own, theirs
    return PAIRS[name, flags]


@pytest.mark.parametrize("name", list(MAPS))
@settings(max_examples=60, deadline=None)
@given(text=st.one_of(st.text(alphabet=AWKWARD, max_size=30), st.text(max_size=20)))
def test_normaliser_equals_the_library(name, text):
    for flags in FLAGS:
        own, theirs = pair(name, flags)
        body, origin = own(text)
        expected, _ = theirs.normalize(text, with_offsets=True)
        assert body.decode() == expected
        assert len(origin) == len(body) + 1 and (np.diff(origin) >= 0).all()


@pytest.mark.parametrize("name", list(MAPS))
@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=AWKWARD, max_size=40))
def test_spans_equal_the_library(name, text, tmp_path_factory):
    """Ids and spans with the character maps put into the model; the library's spans are the standard."""
    for squeeze in (False, True):
        key = (name, squeeze, "model")
        if key not in PAIRS:
            model = proto.ModelProto()
            with open(MODEL, "rb") as file:
                model.ParseFromString(file.read())
            model.normalizer_spec.precompiled_charsmap = MAPS[name]
            model.normalizer_spec.remove_extra_whitespaces = squeeze
            model.pieces.add(piece="AbZ", score=0, type=proto.ModelProto.SentencePiece.USER_DEFINED)
            path = tmp_path_factory.mktemp("model") / "own.model"
            path.write_bytes(model.SerializeToString())
            PAIRS[key] = pieces.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
        own, library = PAIRS[key]
        for some in (text, text + "AbZ" + text):
            ids, begins, ends = own.encode(some)
            found = library.encode(some, return_type="proto").pieces
            assert ids == [p.id for p in found]
            for p, begin, end in zip(found, begins.tolist(), ends.tolist()):
                if p.piece.startswith("<0x") and len(p.piece) == 6:
                    # the library gives a character to its last byte, here each byte has its own
                    assert p.begin <= begin <= end and (not p.surface or end == p.end)
                else:
                    assert (begin, end) == (p.begin, p.end)


def expected_row(library, doc_id, text):
    ids = library.encode(text or "")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids) if ids else "")


def test_round_trip_equals_the_library(spark, data, edge_docs, edge_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    real = spark.read.parquet(f"{data}/documents.parquet")
    texts = [(r[0], r[1]) for r in real.select("doc_id", "text").collect()]
    for docs, rows in ((edge_docs, [(r[0], r[1]) for r in edge_rows]), (real, texts)):
        got = [tuple(r)[:4] for r in pieces.round_trip(docs, MODEL).collect()]
        assert sorted(got, key=str) == sorted((expected_row(library, *r) for r in rows), key=str)


def test_encode_and_decode_columns(edge_docs, no_docs):
    back = pieces.decode(pieces.encode(edge_docs, MODEL), MODEL)
    assert set(edge_docs.columns) - {"ids"} <= set(back.columns)
    assert back.filter("decoded <> coalesce(text, '')").count() == 0
    spans = back.selectExpr("octet_length(coalesce(text, '')) AS n", "element_at(ends, -1) AS last", "begins[0] AS b")
    assert spans.filter("n > 0 AND (last <> n OR b <> 0)").count() == 0
    assert pieces.round_trip(no_docs, MODEL).count() == 0
    assert pieces.encode(no_docs, MODEL).count() == 0


def test_unknown_pieces_keep_their_spans(tmp_path):
    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.byte_fallback = False
    for piece in model.pieces:
        if piece.type == proto.ModelProto.SentencePiece.BYTE:
            piece.type = proto.ModelProto.SentencePiece.UNUSED
    path = tmp_path / "own.model"
    path.write_bytes(model.SerializeToString())
    own, library = pieces.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ("a 𓀀𓀁 b", "𓀀", "x𓀀"):
        ids, begins, ends = own.encode(text)
        found = library.encode(text, return_type="proto").pieces
        assert list(zip(ids, begins.tolist(), ends.tolist())) == [(p.id, p.begin, p.end) for p in found]
