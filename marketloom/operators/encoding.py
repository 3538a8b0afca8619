"""Categorical encoding and feature matrices."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.scale import (
    clean_number, dense_codes, quantiles, salted_join, scalars, value_counts,
)
from marketloom.session import materialise

# Category and platform flags of the feature matrix.
FLAG_CATEGORIES = [
    "layer-1", "smart-contract-platform", "defi", "nft", "gaming", "meme", "stablecoin", "metaverse", "dao",
    "privacy", "exchange", "yield-farming", "lending", "scaling",
]
FLAG_PLATFORMS = [
    "ethereum", "binance-smart-chain", "solana", "polygon", "avalanche", "tron", "fantom", "arbitrum", "optimism",
    "cosmos",
]


def code_table(df: DataFrame, column: str) -> DataFrame:
    """``(column, _code)``: distinct values numbered in sorted order, built by range partitions."""
    return dense_codes(df, column)


def auto_columns(df: DataFrame, max_unique: int) -> list[str]:
    """Text columns with 2..max_unique distinct values."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return []
    about = df.agg(*[F.approx_count_distinct(c).alias(str(n)) for n, c in enumerate(text)]).first()
    close = [c for n, c in enumerate(text) if about[n] <= 1.3 * max_unique + 2]  # sure of the others in one pass
    counts = df.agg(*[F.countDistinct(c).alias(str(n)) for n, c in enumerate(close)]).first() if close else []
    return [c for c, n in zip(close, counts) if 1 < n <= max_unique]


def encode_categorical(
    df: DataFrame, columns: list[str] | None = None, method: str = "onehot", drop_original: bool = True,
    max_unique: int = 20,
) -> DataFrame:
    """One-hot, ordinal, binary or frequency encoding (``target`` falls back to frequency) (P5)."""
    columns = [c for c in (columns or auto_columns(df, max_unique)) if c in df.columns]
    out = df
    for c in columns:
        if method == "onehot":
            found = df.select(c).distinct().limit(max_unique + 2).collect()  # at most max_unique + 2 values
            values = [r[0] for r in found]
            if len([v for v in values if v is not None]) > max_unique:
                continue
            labels = sorted("missing" if v is None else str(v) for v in values)
            filled = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
            out = out.withColumns({f"{c}_{v}": (filled == v).cast("double") for v in labels})
        elif method in ("ordinal", "binary"):
            filled = df.withColumn(c, F.coalesce(F.col(c), F.lit("missing"))) if method == "ordinal" else df
            codes = code_table(filled, c)
            base = out.withColumn("_key", F.coalesce(F.col(c), F.lit("missing")) if method == "ordinal" else F.col(c))
            joined = salted_join(base, codes.withColumnRenamed(c, "_key"), ["_key"], how="left").drop("_key")
            if method == "ordinal":
                out = joined.withColumn(f"{c}_encoded", F.col("_code").cast("double")).drop("_code")
            else:
                n = (codes.agg(F.max("_code")).first()[0] or 0) + 1
                nulls = df.agg(F.bool_or(F.col(c).isNull())).first()[0]
                bits = max(1, (n if nulls else n - 1).bit_length())  # null has a code of its own, all bits set
                code = F.coalesce("_code", F.lit((1 << bits) - 1))
                out = joined.withColumns(
                    {f"{c}_bin_{b}": F.shiftright(code, b).bitwiseAND(F.lit(1)).cast("int") for b in range(bits)}
                ).drop("_code")
        else:
            n = scalars(df, n=F.count(c))["n"]
            freq = value_counts(df, c).select(c, (F.col("n") / n).alias(f"{c}_freq"))
            out = salted_join(out, freq, [c], how="left")
        if drop_original:
            out = out.drop(c)
    return out


def _filled(c: str, default: float = 0.0) -> Column:
    return F.coalesce(clean_number(F.col(c)), F.lit(default))


def item_features(
    items: DataFrame, regular: list[str], logged: list[str], social: list[str], scores: list[str],
    tops: dict[str, str], top: int = 15,
) -> DataFrame:
    """Model features (P6a): robust-scaled numbers, log min-max groups, scores / 100, one-hot of the commonest names.

    ``tops`` maps a categorical column to its output prefix. Names beyond the ``top`` commonest become ``other``.
    """
    base = items.select(
        "id", *tops,
        *[_filled(c).alias(f"r_{c}") for c in regular],
        *[F.log1p(_filled(c)).alias(f"l_{c}") for c in dict.fromkeys([*logged, *social])],
        *[(_filled(c, 50.0) / 100).alias(c) for c in scores],
    )
    robust = [f"r_{c}" for c in regular]
    out: list[Column] = [F.col("id")]
    if robust:
        rows = quantiles(base, robust, [0.25, 0.5, 0.75]).collect()  # three rows per column
        q = {(r["column"], r["prob"]): r["value"] for r in rows}
        for c in regular:
            spread = q[(f"r_{c}", 0.75)] - q[(f"r_{c}", 0.25)]
            out.append(((F.col(f"r_{c}") - q[(f"r_{c}", 0.5)]) / (spread if spread else 1.0)).alias(c))
    scaled = list(dict.fromkeys([*logged, *social]))
    b = scalars(base, **{f"lo_{c}": F.min(f"l_{c}") for c in scaled}, **{f"hi_{c}": F.max(f"l_{c}") for c in scaled})
    for c in scaled:
        span = F.nullif(b[f"hi_{c}"] - b[f"lo_{c}"], F.lit(0.0))
        out.append(F.coalesce((F.col(f"l_{c}") - b[f"lo_{c}"]) / span, F.lit(0.0)).alias(f"{c}_scaled"))
    out += [F.col(c) for c in scores]
    for c, prefix in tops.items():
        common = [
            r[0] for r in value_counts(items, c).orderBy(F.desc("n"), F.asc(c)).limit(top).collect()  # at most top rows
        ]
        short = F.when(F.col(c).isin(common), F.col(c)).otherwise("other")
        rest = items.filter(~F.coalesce(F.col(c).isin(common), F.lit(False))).isEmpty()
        for name in sorted(common) + ([] if rest else ["other"]):
            out.append((short == name).cast("double").alias(f"{prefix}_{name}"))
    return base.select(*out)


def _first_hits(values: Column, names: list[str]) -> Column:
    """For every text the first name it contains, as an array of names."""
    low = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(v))

    def hit(v: Column) -> Column:
        return F.coalesce(*[F.when(v.contains(n), n) for n in names], F.lit(""))

    return F.transform(low, hit)


def flag_features(items: DataFrame, numeric: list[str], logged: list[str]) -> DataFrame:
    """Feature matrix (P6b): log min-max numbers plus category and platform flags, first hit per value."""
    from marketloom.plans.similarity import scaled_numeric

    base = items.select("id", "categories", "platforms", *numeric)
    scaled = scaled_numeric(base, numeric, logged, constant="zero")
    cats = _first_hits(F.col("categories"), FLAG_CATEGORIES)
    plats = _first_hits(F.map_keys("platforms"), FLAG_PLATFORMS)
    hits = scaled.withColumns({"_c": cats, "_p": plats})
    return hits.select(
        "id", *numeric,
        *[F.array_contains("_c", n).cast("double").alias(f"cat_{n}") for n in FLAG_CATEGORIES],
        *[F.array_contains("_p", n).cast("double").alias(f"plat_{n}") for n in FLAG_PLATFORMS],
    )


WORD = r"[\p{L}\p{N}_]{2,}"  # words of two or more letters, digits or underscores


def english_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w for t in StopWordsRemover.loadDefaultStopWords("english") for w in re.findall(r"\w\w+", t.lower())})


def tf_idf(
    docs: DataFrame, key: str, text: str, max_terms: int = 100, min_df: int = 5, max_df: float = 0.9,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """Unit-length TF-IDF weights ``(key, term, weight)`` over the most frequent terms.

    Whole texts are split into words; smoothed idf is ``ln((1 + n) / (1 + df)) + 1``. Only the vocabulary of at most
    ``max_terms`` terms is small and joined as such.
    """
    stops = english_stop_words() if stop_words is None else stop_words
    rows, keys = docs.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    n = F.lit(rows)
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    word_lists = docs.select(key, F.filter(found, lambda t: ~t.isin(stops)).alias("words"))

    def counts(lists: DataFrame) -> DataFrame:
        return lists.select(key, F.explode("words").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))

    if rows == keys:  # a key is one text: terms add up in front of the shuffle
        marked = F.concat(
            F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("tf"))),
            F.transform("words", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("tf"))))
        terms = word_lists.select(F.explode(marked).alias("m")).groupBy("m.term").agg(
            F.sum("m.df").alias("df"), F.sum("m.tf").alias("total"))
    else:
        terms = counts(word_lists).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    vocabulary = materialise(
        terms.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        .orderBy(F.desc("total"), F.asc("term")).limit(max_terms)
        .select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    wanted = [r[0] for r in vocabulary.select("term").collect()]  # <= max_terms rows
    tf = counts(word_lists.select(key, F.filter("words", lambda t: t.isin(wanted)).alias("words")))
    weighted = materialise(tf.join(F.broadcast(vocabulary), "term").withColumn("w", F.col("tf") * F.col("idf")))  # read twice
    length = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return weighted.join(length, key).select(key, "term", (F.col("w") / F.col("len")).alias("weight"))


def text_components(weights: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Truncated SVD of the TF-IDF matrix: ``text_feature_1..k`` per document.

    Every partition of documents adds up its own small Gram matrix (terms x terms, bounded by the vocabulary); the
    partial sums are added by Spark and only the final matrix is decomposed on the driver. The sign of a component
    is fixed by its largest loading.
    """
    terms = [r[0] for r in weights.select("term").distinct().orderBy("term").collect()]  # the bounded vocabulary
    m = len(terms)
    at = {t: i for i, t in enumerate(terms)}
    rows = weights.groupBy(key).agg(F.collect_list("term").alias("t"), F.collect_list("weight").alias("w"))

    def gram(batches):
        total = np.zeros((m, m))
        for frame in batches:
            x = np.zeros((len(frame), m))
            for r, (ts, ws) in enumerate(zip(frame["t"], frame["w"])):
                x[r, [at[t] for t in ts]] = ws
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(m), "row": list(total)})

    parts = rows.select("t", "w").mapInPandas(gram, "i int, row array<double>")
    summed = parts.groupBy("i").agg(*[F.sum(F.col("row")[c]).alias(f"c{c}") for c in range(m)]).orderBy("i").collect()
    matrix = np.array([[r[f"c{c}"] for c in range(m)] for r in summed])
    values, vectors = np.linalg.eigh(matrix)
    load = vectors[:, np.argsort(values)[::-1][:k]]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    table = F.create_map(*[x for i, t in enumerate(terms) for x in (
        F.lit(t), F.array(*[F.lit(float(v)) for v in load[i]]))])
    return weights.withColumn("_l", table[F.col("term")]).groupBy(key).agg(
        *[F.sum(F.col("weight") * F.col("_l")[c]).alias(f"text_feature_{c + 1}") for c in range(load.shape[1])])


def text_features(items: DataFrame, key: str, text: str, k: int = 5, **options) -> DataFrame:
    """Description length and text components; components are skipped when over 80 % of texts are empty."""
    sized = items.withColumn("description_length", F.length(F.coalesce(text, F.lit(""))))
    empty = sized.agg(F.avg((F.col("description_length") == 0).cast("double"))).first()[0]
    if empty is None or empty > 0.8:
        return sized
    parts = text_components(materialise(tf_idf(items, key, text, **options)), key, k)  # read three times
    return sized.join(parts, key, "left").fillna(0.0, [c for c in parts.columns if c != key])
