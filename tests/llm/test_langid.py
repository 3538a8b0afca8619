import itertools
import random

import numpy as np
import pytest

from marketloom.llm import langid, queries


@pytest.mark.parametrize("seed", range(4))
def test_paths_are_the_best_ones(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(size=(12, 3)).astype(np.float32) * 4
    codes = [rng.integers(0, 12, n) for n in (0, 1, 6, 3, 7, 7, 0, 2)]
    for code, path in zip(codes, langid.best_paths(codes, scores, 3.0)):
        def worth(p):
            return sum(scores[c, s] for c, s in zip(code, p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))

        best = max(map(worth, itertools.product(range(3), repeat=len(code))))
        assert len(path) == len(code) and abs(worth(path.tolist()) - best) < 1e-3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_langid(spark, sf).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert len(held) > 200 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_scripts_spans_nulls_and_unknown(spark):
    rng = random.Random(1)
    words = {"xx": ["bana", "nab", "aban"], "yy": ["zork", "korz", "rokz"], "ru": ["мир", "дом", "рим"]}
    rows = [(lang, " ".join(rng.choices(w, k=30)), "x") for lang, w in words.items() for _ in range(30)]
    docs = spark.createDataFrame([*rows, (None, "bana", "n"), ("xx", None, "n")], "lang string, text string, score string")
    model = langid.fit(docs, switch=6.0)
    assert model.languages == ["ru", "xx", "yy"] and set(model.scripts) == {"latin", "cyrillic"}
    mixed = "Bana nab aban bana nab. Zork korz, rokz zork korz!\n12 мир дом"
    texts = [mixed, None, "", "12 !?", "語語", "zork " * 5000, "aban"]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "i int, text string, lang string")
    got = {r.i: r.f for r in frame.select("i", langid.labelled(frame.text, model, spans=True).alias("f")).collect()}
    assert [(mixed[s.start:s.end], s.lang) for s in got[0].spans] == [
        ("Bana nab aban bana nab", "xx"), ("Zork korz, rokz zork korz", "yy"), ("мир дом", "ru")]
    assert [got[i].lang for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang in model.languages
    assert got[5].lang == "yy" and got[5].score == 1.0 and got[6].lang == "xx"
    empty = langid.fit(docs.limit(0))
    assert [r.f.lang for r in frame.select(langid.labelled(frame.text, empty).alias("f")).collect()] == ["und"] * 7
    assert frame.limit(0).select(langid.labelled(frame.text, model).alias("f")).count() == 0


def test_letters_marks_and_lower_case(spark):
    assert langid.WORD.findall("हिन्दी ²½①Ⅷ a1b e\u0301t") == ["हिन्दी", "a", "b", "e\u0301t"]
    rows = [("xx", "bana nab aban " * 9), ("yy", "zork korz rokz " * 9)] * 20
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), switch=4.0)
    text = "İBANA NAB aban İnab bana. zork korz rokz zork"
    frame = spark.createDataFrame([(0, "²½ ① Ⅷ 12"), (1, text), (2, "\u0301\u0301")], "i int, text string")
    got = {r.i: r.f for r in frame.select("i", langid.labelled(frame.text, model, spans=True).alias("f")).collect()}
    assert got[0].lang == got[2].lang == "und" and got[0].score == 0
    assert [(text[s.start:s.end], s.lang) for s in got[1].spans] == [
        ("İBANA NAB aban İnab bana", "xx"), ("zork korz rokz zork", "yy")]


def test_word_scores_by_definition(spark):
    """Log probabilities of a plain naive Bayes over the same n-gram buckets; languages of other scripts are out."""
    rng = random.Random(2)
    rows = [(lang, " ".join("".join(rng.choices(letters, k=rng.randrange(1, 8))) for _ in range(60)))
            for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "абвгд")) for _ in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    counts = {x: np.full(1 << langid.BITS, 0.5) for x in model.languages}
    for lang, text in rows:
        for word in text.split():
            for bucket in langid.gram_buckets([word])[0]:
                counts[lang][bucket] += 1
    for word in ["abc", "feg", "вага", "zzz"]:
        for lang, score in zip(model.languages, model.word_scores([word])[0]):
            want = sum(np.log(counts[lang][b] / counts[lang].sum()) for b in langid.gram_buckets([word])[0])
            other = (lang == "cc") != ("а" <= word[0])
            assert score < -1e5 if other else abs(score - want) < 1e-2
