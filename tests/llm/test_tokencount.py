import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from marketloom.llm import pieces, queries, tokencount

TEXTS = ["", " ", "  a", "a\n\n b  c   ", "\x00é𐍈" * 50, "1234 56", "<s>hi</s><0x41> <0x4", "ﬁ①Å　é", "ünïcode " * 300,
         "²²²² ².", "日本語 テスト", "don't -- stop;\tnow ▁x▁▁y"]


@pytest.fixture(scope="module")
def vocabulary():
    return tokencount.vocabulary_of(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


@pytest.fixture(scope="module")
def exact(vocabulary):
    tokenizer = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=True))

    def count(text):
        return len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids) if text else 0

    return count


@pytest.fixture(scope="module")
def own(vocabulary):
    return tokencount.Unigram(vocabulary)


def test_counts_of_the_tokenizer(own, exact, vocabulary):
    whole = tokencount.Unigram(vocabulary, whole=True)
    for text in TEXTS:
        assert own.count(text) == whole.count(text) == exact(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab eTthn.,▁\n²é1_'\x00語<0x4>"), max_size=60))
def test_random_texts(own, exact, text):
    assert own.count(text) == exact(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("▁abc"), max_size=25))
def test_ties_of_a_small_vocabulary(text):
    vocabulary = [("▁", -2.0), ("▁a", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("bb", -2.0)]
    vocabulary += [(f"<0x{b:02X}>", -50.0) for b in range(256)]
    tokenizer = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=True))
    want = len(tokenizer.encode("▁" + text).ids) if text else 0
    assert tokencount.Unigram(vocabulary).count(text) == want


def test_query_nulls_and_clashing_columns(spark, vocabulary, exact):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: exact(t) for i, t in texts.items()}
    docs = spark.createDataFrame([(1, None, "x"), (1, "", None), (None, "a b", "y")], "doc_id long, text string, n_tokens string")
    out = tokencount.with_token_counts(docs, vocabulary)
    assert out.columns == docs.columns and sorted(r.n_tokens for r in out.collect()) == [0, 0, 2]
    assert tokencount.with_token_counts(docs.limit(0), vocabulary).count() == 0
