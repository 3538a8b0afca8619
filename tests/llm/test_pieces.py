import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a\n\n b  c   ", "▁x▁▁y", "\x00é𐍈" * 50, "a" * 3000, "1234 56", "<s>hi</s><0x41> [INST]", "ﬁ①Å　é",
         "x\n\n y_z  ²./a", "²²²² ²", "été, §§ñ", "\n", "don't -- stop;\tnow", "ünïcode " * 300, "日本語 テスト", "áb"]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model(PATH))


def unpacked(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_both_agendas_give_the_library_ids(model):
    for text, packed in zip(TEXTS, model.encode(TEXTS)):
        want = model.library.encode(text, add_bos=True, add_eos=True)
        assert unpacked(packed) == want
        if text:
            assert model.merge("▁" + text.replace(" ", "▁")) == want[1:-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eTthn.,▁\n²é1_'\x00語"), max_size=60), max_size=4))
def test_random_texts(model, texts):
    assert [unpacked(p) for p in model.encode(texts)] == model.library.encode(texts, add_bos=True, add_eos=True)


def test_query_on_the_smallest_table(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_nulls_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "k"), (1, "", None), (None, "a b", "x")], "doc_id long, text string, ids string")
    out = pieces.encode_documents(docs, pieces.read_model(PATH))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((len(r.ids) // 4, r.decoded) for r in out.collect())
    assert got == [(2, ""), (2, ""), (4, "a b")]
    assert pieces.encode_documents(docs.limit(0), pieces.read_model(PATH)).count() == 0
