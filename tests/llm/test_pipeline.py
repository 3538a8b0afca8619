from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_decontaminate import by_definition as bench_words
from test_linededup import by_definition as cut_lines
from test_simhash import by_definition as fingerprint
from test_simhash import classes

import corpus_pipeline
from marketloom.llm import toxicity

SF = "/root/testdata/sf0.001"


def near_classes(docs):
    """doc_id -> smallest linked id, by comparing all fingerprints."""
    prints = {i: fingerprint(t) for i, t in docs.items()}
    pairs = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    return classes(pairs, docs)


def test_stage_names_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(0), SF).columns == docs.columns, name
        assert step(spark, docs.limit(0), SF).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_run_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    calm = docs.select("doc_id", "text", model.score(F.col("text")).alias("s")).filter("s < 0.5").collect()
    texts = {r.doc_id: r.text for r in calm}
    texts = dict(zip(texts, [kept for kept, _, _ in cut_lines(list(texts.values()), 10, 1)]))
    near = near_classes(texts)
    texts = {i: t for i, t in texts.items() if near[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i in list(texts):
        n, hit, _ = bench_words(texts[i], items)
        if hit and 20 * hit >= n:
            del texts[i]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    assert 0 < len(texts) < docs.count()
    for r in rows:
        assert r.text == texts[r.doc_id] and r.n_tokens == len(r.ids) // 4
        assert r.decoded == lib.decode(lib.encode(r.text, add_bos=True, add_eos=True))


def test_pipeline_survives_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "calm text", "en", None, 9),
            (None, "calm text without id", "de", "s", -1), (3, "x\n" * 3000, "en", "s", 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    kept = docs.collect()
    assert {r.doc_id for r in kept} >= {1, 2, 3} and len(kept) >= 4
