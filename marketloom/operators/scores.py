"""Item scores on a 0..100 scale (M1-M7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.scale import clean_number, quantile_scalars, scalars


def _num(c: str) -> Column:
    return F.coalesce(clean_number(F.col(c)), F.lit(0.0))


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def popularity_score() -> Column:
    """M1: log-scaled market and community size."""
    return 100 * (
        0.35 * F.log1p(_num("market_cap")) / 30
        + 0.25 * F.log1p(_num("total_volume")) / 25
        + 0.15 * F.log1p(_num("reddit_subscribers")) / 15
        + 0.15 * F.log1p(_num("twitter_followers")) / 15
        + 0.10 * F.log1p(_num("github_stars")) / 10
    )


def trend_score(available: list[str]) -> Column:
    """M2: clipped price changes around the neutral 50; 50 when the daily change is not in the table."""
    weights = [("price_change_percentage_24h", 0.6), ("price_change_percentage_7d", 0.3),
               ("price_change_percentage_30d", 0.1)]
    if weights[0][0] not in available:
        return F.lit(50.0)
    total = F.lit(0.0)
    for name, w in weights:
        if name in available:
            total = total + w * _clip(_num(name) / 100, -1.0, 1.0)
    return 50 + total * 50


def basic_scores(items: DataFrame) -> DataFrame:
    return items.withColumns(
        {"popularity_score": popularity_score(), "trend_score": trend_score(items.columns)})


def social_engagement(items: DataFrame) -> DataFrame:
    """M3: followers per million of market value, logged, relative to the 95th percentile."""
    cap = scalars(items, m=F.max(_num("market_cap")))["m"]
    ratio = (_num("reddit_subscribers") + _num("twitter_followers")) / F.nullif(
        _num("market_cap") / 1_000_000, F.lit(0.0))
    rated = items.withColumn("_ratio", ratio)
    med = quantile_scalars(rated, "_ratio", m=0.5)["m"]
    logged = rated.withColumn("_eng", F.log1p(F.coalesce("_ratio", med)))
    top = quantile_scalars(logged, "_eng", p=0.95)["p"]
    score = F.when(cap > 0, _clip(100 * F.col("_eng") / F.nullif(top, F.lit(0.0)), 0.0, 100.0)).otherwise(50.0)
    return logged.withColumn("social_engagement_score", score).drop("_ratio", "_eng")


def maturity(items: DataFrame, as_of: Column) -> DataFrame:
    """M4: age against the 95th percentile plus log market value; missing ages take the median."""
    aged = items.withColumn("age_days", F.datediff(as_of, F.col("genesis_date")).cast("double"))
    med = quantile_scalars(aged, "age_days", m=0.5)["m"]
    filled = aged.withColumn("age_days", F.coalesce("age_days", med))
    top = quantile_scalars(filled, "age_days", p=0.95)["p"]
    age = _clip(F.col("age_days") / F.nullif(top, F.lit(0.0)), 0.0, 1.0)
    score = _clip(100 * (0.6 * age + 0.4 * F.log1p(_num("market_cap")) / 30), 0.0, 100.0)
    return filled.withColumn("maturity_score", F.coalesce(score, F.lit(50.0)))


def developer_activity(items: DataFrame) -> DataFrame:
    """M5: log stars plus log forks against the 95th percentile; 0 when that percentile is 0."""
    logged = items.withColumn("_dev", F.log1p(_num("github_stars")) + F.log1p(_num("github_forks")))
    top = quantile_scalars(logged, "_dev", p=0.95)["p"]
    score = F.when(top > 0, 100 * _clip(F.col("_dev") / top, 0.0, 1.0)).otherwise(0.0)
    return logged.withColumn("developer_activity_score", score).drop("_dev")


def stored_scores(items: DataFrame) -> DataFrame:
    """M6: the variant kept with stored items: other popularity weights, social score, short chain and category rule."""

    def log(c: str, scale: float) -> Column:
        return F.when(_num(c) > 0, F.log1p(_num(c)) / scale).otherwise(0.0)

    reddit, twitter = log("reddit_subscribers", 15), log("twitter_followers", 15)
    names = F.map_keys("platforms")
    return items.withColumns(
        {
            "popularity_score": 100
            * (0.4 * log("market_cap", 30) + 0.3 * log("total_volume", 25) + 0.15 * reddit + 0.15 * twitter),
            "social_score": 50 * (reddit + twitter),
            "primary_category": F.coalesce(F.lower(F.try_element_at("categories", F.lit(1))), F.lit("unknown")),
            "chain": F.when(F.array_contains(names, "ethereum"), "ethereum")
            .when(F.array_contains(names, "binance-smart-chain"), "binance-smart-chain")
            .otherwise(F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("unknown"))),
        }
    )


def trending_boost(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """M7: neutral 50 for all items; ranked ones get ``popularity + 30 + 5 * (8 - min(8, place))``, place from 0."""
    place = ranked.select(F.col("id"), F.col("place"))
    boost = F.col("popularity_score") + 30 + 5 * (8 - F.least(F.lit(8), F.col("place")))
    return items.join(place, "id", "left").withColumn(
        "trend_score", F.when(F.col("place").isNotNull(), boost).otherwise(50.0)).drop("place")
