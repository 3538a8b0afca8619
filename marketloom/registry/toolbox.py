"""Filters, joins, aggregates, JSON, dates, cleaning, encoding and scores."""

from functools import reduce

from pyspark.sql import functions as F

from marketloom import fixtures as fx
from marketloom.functions import canonical as ca
from marketloom.functions import convert as cv
from marketloom.functions import jsonops as js
from marketloom.functions import privacy as pv
from marketloom.functions import timefeat as tf
from marketloom.operators import aggregates as ag
from marketloom.operators import cleaning as cl
from marketloom.operators import encoding as en
from marketloom.operators import filters as fl
from marketloom.operators import joins as jn
from marketloom.operators import scores as sc
from marketloom.operators.scale import top_k, use_all_cores
from marketloom.operators.scale import value_counts as scale_counts
from marketloom.plans.recommend import attach_items, top_catalog
from marketloom.registry.base import query, r6
from marketloom.registry.recs import SCORED
from marketloom.session import materialise

V = fx.with_views
AS_OF = "2026-01-01"


def as_long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- filters ------------------------------------------------------------------------------------------------------


@query("filter_dataframe", """SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
  WHERE p_size BETWEEN 5 AND 40 AND p_brand NOT IN ('Brand#1', 'Brand#2') AND regexp_matches(p_name, 'w.d|ring')
    AND p_type LIKE '%M%' AND p_type <> 'PROMO' AND p_retailprice >= 905.0""")
def filter_dataframe(spark, sf):
    part = fx.table(spark, sf, "part").withColumn("kind", F.col("p_type"))
    out = fl.filter_dataframe(
        part,
        {"p_size": [5, 40], "p_brand": ["Brand#1", "Brand#2"], "p_name": "w.d|ring", "p_type": ["M"],
         "kind": "PROMO", "p_retailprice": 905.0, "no_such_column": 1},
        {"p_size": "between", "p_brand": "not in", "p_name": "contains", "p_type": "contains", "kind": "!=",
         "p_retailprice": ">="},
    )
    return out.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("filter_dataframe_or", """WITH p AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS b FROM part)
  SELECT p_partkey, b FROM p WHERE b IS NULL OR p_name LIKE 'red%' OR p_type LIKE '%Y' OR p_size = 3""")
def filter_dataframe_or(spark, sf):
    part = fx.table(spark, sf, "part").withColumn("b", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")))
    return fl.filter_dataframe(
        part, {"b": None, "p_name": "red", "p_type": "Y", "p_size": 3},
        {"b": "isnull", "p_name": "startswith", "p_type": "endswith", "p_size": "="}, "or").select("p_partkey", "b")


@query("catalog_query", V("items", SCORED + """, f AS (SELECT * FROM scored WHERE (primary_category = 'small'
    OR list_contains(categories, 'small')) AND (name ILIKE '%in%' OR symbol ILIKE '%in%' OR CAST(id AS VARCHAR) ILIKE '%in%'))
  SELECT id, name, symbol, chain, primary_category, round(popularity_score, 6) AS popularity_score,
         (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 70 AS has_more
  FROM f ORDER BY popularity_score DESC, id LIMIT 50 OFFSET 20"""))
def catalog_query(spark, sf):
    page = fl.catalog_query(
        sc.basic_scores(fx.items(spark, sf)), category="small", search="in", limit=50, offset=20)
    return page.select(
        "id", "name", "symbol", "chain", "primary_category", r6("popularity_score"), "total", "has_more")


@query("item_lookup", V("items", "SELECT id, name, symbol, chain, primary_category, current_price FROM items WHERE id = 42"))
def item_lookup(spark, sf):
    return fl.item_lookup(fx.items(spark, sf), 42).select(
        "id", "name", "symbol", "chain", "primary_category", "current_price")


@query("user_history", V("interactions items", """SELECT i.event_id, i.user_id, i.item_id, i.interaction_type, i.weight, i.ts,
    t.name, t.symbol, t.chain, t.primary_category FROM interactions i JOIN items t ON t.id = i.item_id
  WHERE i.user_id = 8 ORDER BY i.ts DESC, i.event_id LIMIT 20 OFFSET 5"""))
def user_history(spark, sf):
    return fl.user_history(fx.interactions(spark, sf), fx.items(spark, sf), 8, 20, 5).select(
        "event_id", "user_id", "item_id", "interaction_type", "weight", "ts", "name", "symbol", "chain",
        "primary_category")


@query("ensure_types", """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN NULL
    ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0) AS current_price FROM events""")
def ensure_types(spark, sf):
    raw = fx.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 7 == 0, None)
        .otherwise(F.col("value").cast("string")).alias("current_price"))
    return cv.ensure_types(raw).select("event_id", "current_price")


@query("safe_convert", """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'f' WHEN 2 THEN '12'
      WHEN 3 THEN '3.5' WHEN 4 THEN NULL ELSE 'maybe' END AS v FROM events)
  SELECT event_id, coalesce(TRY_CAST(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN v END AS BIGINT), -1) AS as_int,
    coalesce(TRY_CAST(v AS DOUBLE), 0.5) AS as_float,
    CASE WHEN v IS NULL THEN false WHEN lower(v) IN ('true','t','yes','y','1') THEN true
         WHEN lower(v) IN ('false','f','no','n','0') THEN false ELSE true END AS as_bool FROM t""")
def safe_convert(spark, sf):
    m = F.col("event_id") % 6
    t = fx.table(spark, sf, "events").select(
        "event_id",
        F.when(m == 0, "Yes").when(m == 1, "f").when(m == 2, "12").when(m == 3, "3.5").when(m == 4, None)
        .otherwise("maybe").alias("v"))
    return t.select(
        "event_id", cv.safe_convert(F.col("v"), "int", -1).alias("as_int"),
        cv.safe_convert(F.col("v"), "float", 0.5).alias("as_float"),
        cv.safe_convert(F.col("v"), "bool", False).alias("as_bool"))


@query("ensure_categorical", """SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS primary_category,
    CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE p_brand END AS chain FROM part""")
def ensure_categorical(spark, sf):
    raw = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("categories"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("chain"))
    return cv.ensure_categorical(raw).select("id", "primary_category", "chain")


@query("narrow_types", """WITH e AS (SELECT unnest(['l_discount','l_extendedprice','l_linenumber','l_linestatus','l_orderkey','l_partkey',
    'l_quantity','l_returnflag','l_suppkey','l_tax']) AS "column"),
  m AS (SELECT max(l_orderkey) AS o, max(l_partkey) AS p, max(l_suppkey) AS s, count(*) AS n FROM lineitem),
  fit AS (SELECT "column", n, CASE "column" WHEN 'l_orderkey' THEN o WHEN 'l_partkey' THEN p WHEN 'l_suppkey' THEN s
    WHEN 'l_linenumber' THEN 1 END AS top FROM e, m)
  SELECT "column", CASE WHEN top IS NOT NULL THEN CASE WHEN top < 128 THEN 'tinyint' WHEN top < 32768 THEN 'smallint'
      WHEN top < 2147483648 THEN 'int' ELSE 'bigint' END
    WHEN "column" IN ('l_linestatus','l_returnflag') THEN 'category'
    WHEN (SELECT CASE "column" WHEN 'l_discount' THEN bool_and(l_discount = l_discount::FLOAT::DOUBLE)
      WHEN 'l_extendedprice' THEN bool_and(l_extendedprice = l_extendedprice::FLOAT::DOUBLE)
      WHEN 'l_quantity' THEN bool_and(l_quantity = l_quantity::FLOAT::DOUBLE)
      ELSE bool_and(l_tax = l_tax::FLOAT::DOUBLE) END FROM lineitem) THEN 'float' ELSE 'double' END AS "type", n AS rows FROM fit""")
def narrow_types(spark, sf):
    return cv.type_report(fx.table(spark, sf, "lineitem"))


# --- joins and sets -----------------------------------------------------------------------------------------------


@query("merge_dataframes", """WITH a AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey::DOUBLE END AS id, p_name AS label
    FROM part),
  b AS (SELECT CASE WHEN s_suppkey = 5 THEN NULL ELSE (s_suppkey * 30)::DOUBLE END AS id, s_name AS label FROM supplier)
  SELECT coalesce(a.id, b.id) AS id, a.label AS label_x, b.label AS label_y,
    CASE WHEN a.label IS NOT NULL AND b.label IS NOT NULL THEN 'both' WHEN a.label IS NOT NULL THEN 'left_only'
         ELSE 'right_only' END AS _merge
  FROM a FULL OUTER JOIN b ON a.id IS NOT DISTINCT FROM b.id""")
def merge_dataframes(spark, sf):
    part = fx.table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"))
    supplier = fx.table(spark, sf, "supplier").select(
        F.when(F.col("s_suppkey") != 5, (F.col("s_suppkey") * 30).cast("double")).alias("id"), F.col("s_name").alias("label"))
    return jn.merge_dataframes(part, supplier, ["id"], "outer", validate="m:1", indicator=True)


@query("enrich_items", """WITH cat AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS stars,
    'base ' || p_name AS description, p_brand AS chain FROM part),
  det AS (SELECT p_partkey AS id, p_size + 100 AS stars, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'detail' END AS description
    FROM part WHERE p_size > 25)
  SELECT c.id, coalesce(d.stars, c.stars) AS stars,
    CASE WHEN length(d.description) > 0 THEN d.description ELSE c.description END AS description,
    CASE WHEN d.id IS NULL OR c.id % 6 = 0 THEN c.chain ELSE 'solana' END AS chain FROM cat c LEFT JOIN det d ON c.id = d.id""")
def enrich_items(spark, sf):
    k, part = F.col("p_partkey"), fx.table(spark, sf, "part")
    items = part.select(
        k.alias("id"), F.when(k % 4 != 0, F.col("p_size")).alias("stars"),
        F.concat(F.lit("base "), "p_name").alias("description"), F.col("p_brand").alias("chain"),
        F.create_map().cast("map<string,string>").alias("platforms"))
    details = part.filter("p_size > 25").select(
        k.alias("id"), (F.col("p_size") + 100).alias("stars"),
        F.when(k % 5 == 0, "").otherwise("detail").alias("description"),
        F.when(k % 6 == 0, F.create_map().cast("map<string,string>")).otherwise(
            F.create_map(F.lit("Sol"), F.lit("0x"))).alias("platforms"))
    return jn.enrich_items(items, details).select("id", "stars", "description", "chain")


@query("attach_item_details", """SELECT e.event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 25 AS item_id,
    coalesce(p_name, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 25 AS VARCHAR)) AS name,
    coalesce(p_brand, 'unknown') AS chain
  FROM events e LEFT JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT) * 25""")
def attach_item_details(spark, sf):
    recs = fx.raw_interactions(spark, sf).select("event_id", (F.col("item_id") * 25).alias("item_id"))
    items = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("chain"))
    return attach_items(recs, items, ["name", "chain"])


@query("portfolio_items", V("portfolios", "SELECT DISTINCT user_id, project_id FROM portfolios JOIN part ON p_partkey = project_id WHERE amount > 0"))
def portfolio_items(spark, sf):
    return jn.portfolio_items(
        fx.portfolios(spark, sf), fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id")))


@query("price_alerts", V("price_alerts", """SELECT a.alert_id, a.user_id, a.project_id, a.alert_type, round(a.target_price, 6) AS target_price,
    p_retailprice AS current_price, 'Price Alert: ' || p_name || ' is now ' || a.alert_type AS title
  FROM price_alerts a JOIN part ON p_partkey = a.project_id
  WHERE (a.alert_type = 'above' AND p_retailprice >= a.target_price)
     OR (a.alert_type = 'below' AND p_retailprice <= a.target_price)"""))
def price_alerts(spark, sf):
    items = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("current_price"))
    return jn.triggered_alerts(fx.price_alerts(spark, sf), items).select(
        "alert_id", "user_id", "project_id", "alert_type", r6("target_price"), "current_price", "title")


@query("top_popular", V("items", SCORED + """SELECT id AS item_id, round(popularity_score/100, 6) AS score,
    row_number() OVER (ORDER BY round(popularity_score, 8) DESC, id) AS rank FROM scored QUALIFY rank <= 25""".replace("SELECT", " SELECT", 1)))
def top_popular(spark, sf):
    out = top_catalog(sc.basic_scores(fx.items(spark, sf)), "popularity_score", 25)
    return as_long(out.withColumn("score", r6("score")), "rank")


@query("top_trending", V("items", SCORED + """ SELECT id AS item_id, round(trend_score/100, 6) AS score,
    row_number() OVER (ORDER BY round(trend_score, 8) DESC, id) AS rank FROM scored QUALIFY rank <= 25"""))
def top_trending(spark, sf):
    out = top_catalog(sc.basic_scores(fx.items(spark, sf)), "trend_score", 25)
    return as_long(out.withColumn("score", r6("score")), "rank")


@query("top_by_market_cap", V("items", """SELECT id, market_cap FROM (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE round(market_cap, 4) END AS market_cap,
    current_price FROM items) WHERE current_price > 0 ORDER BY market_cap DESC NULLS LAST, id LIMIT 50"""))
def top_by_market_cap(spark, sf):
    items = fx.items(spark, sf).select(
        "id", F.when(F.col("id") % 7 != 0, F.round("market_cap", 4)).alias("market_cap"), "current_price")
    return jn.top_by_market_cap(items, 50).select("id", "market_cap")


@query("union_dedupe", """WITH u AS (
    SELECT p_partkey AS id, p_name AS name, 0 AS source_rank FROM part WHERE p_size > 25 UNION ALL
    SELECT p_partkey, upper(p_name), 1 FROM part WHERE p_type = 'SMALL' UNION ALL
    SELECT p_partkey, p_type, 2 FROM part)
  SELECT id, name, source_rank FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_rank) = 1""")
def union_dedupe(spark, sf):
    part = fx.table(spark, sf, "part")
    k = F.col("p_partkey")
    return jn.union_dedupe(
        [part.filter("p_size > 25").select(k.alias("id"), F.col("p_name").alias("name")),
         part.filter("p_type = 'SMALL'").select(k.alias("id"), F.upper("p_name").alias("name")),
         part.select(k.alias("id"), F.col("p_type").alias("name"))],
        "id", [F.col("name")])


@query("top_k_per_group", V("items", SCORED + """ SELECT primary_category, id, round(popularity_score, 6) AS popularity_score,
    row_number() OVER (PARTITION BY primary_category ORDER BY round(popularity_score, 8) DESC, id) AS rank FROM scored QUALIFY rank <= 5"""))
def top_k_per_group(spark, sf):
    items = sc.basic_scores(fx.items(spark, sf))
    best = top_k(items, ["primary_category"], [F.round("popularity_score", 8).desc(), F.col("id")], 5)
    return as_long(best.select("primary_category", "id", r6("popularity_score"), "rank"), "rank")


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return scale_counts(fx.table(spark, sf, "events"), "event_type")


@query("except_seen", """WITH c AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  s AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events WHERE event_type <> 'error')
  SELECT user_id, item_id FROM c EXCEPT SELECT user_id, item_id FROM s""")
def except_seen(spark, sf):
    return jn.except_seen(
        fx.ratings_large(spark, sf).select("user_id", "item_id"), fx.ratings(spark, sf))


# --- aggregates ---------------------------------------------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]


def pivot_sql(expr: str) -> str:
    cols = ", ".join(f"{expr.format(t=t)} AS {t}" for t in TYPES)
    return f"SELECT user_id, {cols} FROM events GROUP BY user_id"


@query("pivot_table", pivot_sql("round(coalesce(avg(value) FILTER (event_type = '{t}'), 0), 6)"))
def pivot_table(spark, sf):
    wide = ag.pivot_table(fx.table(spark, sf, "events"), ["user_id"], "event_type", "value", "mean", 0.0)
    return wide.select("user_id", *[r6(t) for t in TYPES])


@query("pivot_table_median", pivot_sql("round(quantile_cont(value, 0.5) FILTER (event_type = '{t}'), 6)"))
def pivot_table_median(spark, sf):
    wide = ag.pivot_table(fx.table(spark, sf, "events"), ["user_id"], "event_type", "value", "median")
    return wide.select("user_id", *[r6(t) for t in TYPES])


@query("pivot_table_last", pivot_sql("arg_max(value, event_id) FILTER (event_type = '{t}')"))
def pivot_table_last(spark, sf):
    return ag.pivot_table(
        fx.table(spark, sf, "events"), ["user_id"], "event_type", "value", "last", order="event_id"
    ).select("user_id", *TYPES)


@query("time_windows", """WITH e AS (SELECT date_trunc('week', ts) AS time_window, event_type, value, user_id FROM events),
  m AS (SELECT time_window, event_type, row_number() OVER (PARTITION BY time_window ORDER BY count(*) DESC, event_type) AS r
        FROM e GROUP BY 1, 2)
  SELECT e.time_window, round(avg(value), 6) AS value_mean, min(value) AS value_min, max(value) AS value_max,
    round(stddev_samp(value), 6) AS value_std, max(m.event_type) AS event_type_mode, count(DISTINCT e.event_type) AS event_type_nunique
  FROM e JOIN m ON m.time_window = e.time_window AND m.r = 1 GROUP BY e.time_window""")
def time_windows(spark, sf):
    out = ag.time_windows(fx.table(spark, sf, "events").select("ts", "value", "event_type"), "ts", "1W")
    return out.withColumns({"value_mean": r6("value_mean"), "value_std": r6("value_std")})


@query("time_windows_grouped", """SELECT date_trunc('month', l_shipdate) AS time_window, l_returnflag, sum(l_quantity) AS l_quantity_sum,
    count(l_tax) AS l_tax_count FROM lineitem GROUP BY 1, 2""")
def time_windows_grouped(spark, sf):
    return ag.time_windows(
        fx.table(spark, sf, "lineitem"), "l_shipdate", "1M", ["l_returnflag"],
        {"l_quantity": ["sum"], "l_tax": ["count"]})


def history_sql(body: str, limit: int) -> str:
    return V("prices", f"""h AS ({body}), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC) AS k FROM h)
  SELECT project_id, "timestamp", round(price + 1e-9, 6) AS price, round(volume, 6) AS volume, round(market_cap, 6) AS market_cap
  FROM r WHERE k <= {limit}""")


@query("history_buckets_4h", history_sql('SELECT * FROM prices WHERE hour("timestamp") % 4 = 0', 168))
def history_buckets_4h(spark, sf):
    h = ag.history_buckets(fx.prices(spark, sf), "4h", "7d")
    return h.select("project_id", "timestamp", r6(F.col("price") + 1e-9, "price"), r6("volume"), r6("market_cap"))


@query("history_buckets_1d", history_sql("""SELECT project_id, date_trunc('day', "timestamp") AS "timestamp", avg(price) AS price,
    sum(volume) AS volume, max(market_cap) AS market_cap FROM prices GROUP BY 1, 2""", 24))
def history_buckets_1d(spark, sf):
    h = ag.history_buckets(fx.prices(spark, sf), "1d", "1d")
    return h.select("project_id", "timestamp", r6(F.col("price") + 1e-9, "price"), r6("volume"), r6("market_cap"))


@query("history_buckets_1w", history_sql("""SELECT project_id, date_trunc('week', "timestamp") AS "timestamp", avg(price) AS price,
    sum(volume) AS volume, max(market_cap) AS market_cap FROM prices GROUP BY 1, 2""", 168))
def history_buckets_1w(spark, sf):
    h = ag.history_buckets(fx.prices(spark, sf), "1w", "7d")
    return h.select("project_id", "timestamp", r6(F.col("price") + 1e-9, "price"), r6("volume"), r6("market_cap"))


@query("history_buckets_1h", history_sql("SELECT * FROM prices", 1_000_000_000))
def history_buckets_1h(spark, sf):
    h = ag.history_buckets(fx.prices(spark, sf), "1h", "all")
    return h.select("project_id", "timestamp", r6(F.col("price") + 1e-9, "price"), r6("volume"), r6("market_cap"))


@query("category_counts", V("items", "SELECT primary_category, count(*) AS n FROM items WHERE primary_category IS NOT NULL AND primary_category <> 'unknown' GROUP BY 1"))
def category_counts(spark, sf):
    return ag.name_counts(fx.items(spark, sf), "primary_category")


@query("chain_counts", V("items", "SELECT chain, count(*) AS n FROM items GROUP BY 1"))
def chain_counts(spark, sf):
    return ag.name_counts(fx.items(spark, sf), "chain")


@query("user_item_max", V("interactions", """SELECT user_id, item_id, CAST(max(weight) AS DOUBLE) AS rating FROM interactions
  WHERE item_id IN (SELECT p_partkey FROM part) GROUP BY 1, 2"""))
def user_item_max(spark, sf):
    catalog = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return ag.user_item_max(fx.interactions(spark, sf), catalog)


@query("interaction_stats", V("interactions", """SELECT round(avg(n), 6) AS items_per_user,
    (SELECT round(avg(m), 6) FROM (SELECT count(DISTINCT user_id) AS m FROM interactions GROUP BY item_id)) AS users_per_item
  FROM (SELECT count(DISTINCT item_id) AS n FROM interactions GROUP BY user_id)"""))
def interaction_stats(spark, sf):
    return ag.interaction_stats(fx.interactions(spark, sf)).select(r6("items_per_user"), r6("users_per_item"))


@query("matrix_stats", V("ratings_large", """SELECT count(*) AS filled, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
    round(1 - count(*)::DOUBLE / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS sparsity FROM ratings_large"""))
def matrix_stats(spark, sf):
    return ag.matrix_stats(fx.ratings_large(spark, sf)).withColumn("sparsity", r6("sparsity"))


@query("rating_histogram", V("ratings_large", "SELECT CAST(least(floor(rating - 0) + 1, 5) AS INT) AS bin, count(*) AS n FROM ratings_large GROUP BY 1"))
def rating_histogram(spark, sf):
    return ag.histogram(fx.ratings_large(spark, sf), "rating", 0.0, 5.0, 5)


NUMS = ["l_quantity", "l_extendedprice", "l_discount"]
PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1:]]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS corr FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in PAIRS))
def correlation_matrix(spark, sf):
    return ag.correlation(fx.table(spark, sf, "lineitem"), NUMS).withColumn("corr", r6("corr"))


RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NUMS)


@query("correlation_spearman", f"WITH r AS (SELECT {RANKS} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS corr FROM r" for a, b in PAIRS))
def correlation_spearman(spark, sf):
    return ag.correlation(fx.table(spark, sf, "lineitem"), NUMS, "spearman").withColumn("corr", r6("corr"))


@query("correlation_kendall", """WITH c AS (SELECT p_size AS x, p_retailprice AS y, count(*) AS w FROM part GROUP BY 1, 2),
  s AS (SELECT sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) > 0 THEN a.w * b.w ELSE 0 END) / 2 AS con,
               sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) < 0 THEN a.w * b.w ELSE 0 END) / 2 AS dis FROM c a, c b),
  n AS (SELECT count(*)::DOUBLE AS n FROM part),
  tx AS (SELECT sum(t * (t - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS t FROM part GROUP BY p_size)),
  ty AS (SELECT sum(t * (t - 1) / 2) AS t FROM (SELECT count(*)::DOUBLE AS t FROM part GROUP BY p_retailprice))
  SELECT 'p_size' AS a, 'p_retailprice' AS b, CAST(n.n AS BIGINT) AS n,
    round((con - dis) / sqrt((n.n*(n.n-1)/2 - tx.t) * (n.n*(n.n-1)/2 - ty.t)), 6) AS corr FROM s, n, tx, ty""")
def correlation_kendall(spark, sf):
    part = fx.table(spark, sf, "part")
    return ag.correlation(part, ["p_size", "p_retailprice"], "kendall").withColumn("corr", r6("corr"))


@query("score_by_group", V("items", SCORED + """ SELECT primary_category, round(avg(popularity_score), 6) AS mean_score, count(*) AS n
  FROM scored GROUP BY 1 ORDER BY 2 DESC LIMIT 10"""))
def score_by_group(spark, sf):
    out = ag.score_by_group(sc.basic_scores(fx.items(spark, sf)), "primary_category", "popularity_score")
    return out.withColumn("mean_score", r6("mean_score"))


@query("describe", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
    min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
    round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem""" for c in NUMS))
def describe(spark, sf):
    out = ag.describe(fx.table(spark, sf, "lineitem"), NUMS)
    return out.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query("average_rank", """SELECT l_extendedprice AS value, count(*) AS n, min(r) + (count(*) - 1) / 2.0::DOUBLE AS rank
  FROM (SELECT l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY 1""")
def average_rank(spark, sf):
    from marketloom.operators.scale import average_ranks

    return average_ranks(fx.table(spark, sf, "lineitem"), "l_extendedprice").withColumnRenamed("l_extendedprice", "value")


# --- JSON, names, dates, privacy ----------------------------------------------------------------------------------


@query("parse_json_columns", V("tagged_items", "SELECT id, array_to_string(categories, '|') AS categories, array_to_string(platform_keys, '|') AS platforms FROM tagged_items"))
def parse_json_columns(spark, sf):
    out = js.parse_json_columns(fx.tagged_items(spark, sf), ["categories", "platforms"])
    return out.select("id", F.array_join("categories", "|").alias("categories"),
                      F.array_join(F.map_keys("platforms"), "|").alias("platforms"))


@query("flatten_json", """SELECT event_id, 'a.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL
  SELECT event_id, 'b[0]', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'b[1].t', event_type FROM events""")
def flatten_json(spark, sf):
    doc = F.concat(F.lit('{"a":'), "props", F.lit(',"b":['), F.col("user_id").cast("string"), F.lit(',{"t":"'),
                   "event_type", F.lit('"}]}'))
    return js.flatten_json(fx.table(spark, sf, "events").select("event_id", doc.alias("doc")), "event_id", "doc", 3)


@query("walk_json", """WITH d AS (SELECT event_id, '{"p":' || props || ',"l":[' || user_id || ',{"t":"' || event_type || '[1]"}]' ||
    CASE WHEN event_id % 3 = 0 THEN ',"d":{"e":{"f":[true,null,[' || user_id || ',{}]]}}' ELSE '' END || '}' AS doc FROM events)
  SELECT event_id, substr(t.fullkey, 3) AS path, t.atom ->> '$' AS value FROM d, json_tree(d.doc) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def walk_json(spark, sf):
    deep = F.when(F.col("event_id") % 3 == 0, F.concat(
        F.lit(',"d":{"e":{"f":[true,null,['), F.col("user_id").cast("string"), F.lit(',{}]]}}'))).otherwise("")
    doc = F.concat(F.lit('{"p":'), "props", F.lit(',"l":['), F.col("user_id").cast("string"), F.lit(',{"t":"'),
                   "event_type", F.lit('[1]"}]'), deep, F.lit("}"))
    return js.walk_json(fx.table(spark, sf, "events").select("event_id", doc.alias("doc")), "event_id", "doc")


@query("extract_nested", """SELECT event_id, unnest([CAST(user_id AS VARCHAR), event_type]) AS doc_list, json_extract_string(props, '$.k') AS "doc_a.k"
  FROM events""")
def extract_nested(spark, sf):
    doc = F.concat(F.lit('{"a":'), "props", F.lit(',"list":["'), F.col("user_id").cast("string"), F.lit('","'),
                   "event_type", F.lit('"]}'))
    df = fx.table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return js.extract_nested(df, "doc", ["list", "a.k"], flatten_lists=True)


def alias_case(lists: str, table: dict, priority: list, fragment: bool) -> str:
    exact = " ".join(f"WHEN list_contains({lists}, '{p}') THEN '{p}'" for p in priority)
    low = f"list_transform({lists}, lambda x: lower(x))"

    def test(name, aliases):
        if fragment:
            hit = " OR ".join(f"contains(x, '{a}')" for a in aliases)
            return f"len(list_filter({low}, lambda x: {hit})) > 0"
        names = ", ".join(f"'{a}'" for a in [name, *aliases])
        return f"list_has_any({low}, [{names}])"

    other = " ".join(f"WHEN {test(n, a)} THEN '{n}'" for n, a in table.items())
    return f"CASE {exact} {other}"


@query("primary_chain", V("tagged_items", f"""SELECT id, {alias_case('platform_keys', ca.CHAIN_ALIASES, ca.PRIORITY_CHAINS, False)}
    ELSE coalesce(platform_keys[1], 'unknown') END AS chain FROM tagged_items"""))
def primary_chain(spark, sf):
    parsed = js.parse_json_columns(fx.tagged_items(spark, sf), ["platforms"])
    return parsed.select("id", ca.primary_chain(F.col("platforms")).alias("chain"))


LOW_CATS = "list_transform(categories, lambda x: lower(x))"


@query("primary_category", V("tagged_items", f"""SELECT id, {alias_case(LOW_CATS, ca.CATEGORY_ALIASES, ca.PRIORITY_CATEGORIES, True)}
    ELSE coalesce(lower(categories[1]), 'unknown') END AS primary_category FROM tagged_items"""))
def primary_category(spark, sf):
    parsed = js.parse_json_columns(fx.tagged_items(spark, sf), ["categories"])
    return parsed.select("id", ca.primary_category(F.col("categories")).alias("primary_category"))


def respell_case(col: str, table: dict) -> str:
    return f"CASE lower({col}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE lower({col}) END"


@query("canonical_values", V("tagged_items", f"""SELECT id, {respell_case('coalesce(platform_keys[1], NULL)', ca.CHAIN_SPELLINGS)} AS chain,
    {respell_case('categories[1]', ca.CATEGORY_SPELLINGS)} AS primary_category,
    CASE WHEN id % 5 = 0 THEN 0 ELSE CAST(id AS DOUBLE) END AS market_cap, 0.0::DOUBLE AS total_volume FROM tagged_items"""))
def canonical_values(spark, sf):
    parsed = js.parse_json_columns(fx.tagged_items(spark, sf), ["categories", "platforms"])
    k = F.col("id")
    raw = parsed.select(
        "id", F.try_element_at(F.map_keys("platforms"), F.lit(1)).alias("chain"),
        F.try_element_at("categories", F.lit(1)).alias("primary_category"),
        F.when(k % 5 == 0, F.lit(float("inf"))).otherwise(k.cast("double")).alias("market_cap"))
    return ca.verify_items(raw, ["market_cap", "total_volume"]).select(
        "id", "chain", "primary_category", "market_cap", "total_volume")


@query("time_features", """SELECT event_id, year(ts) AS t_year, quarter(ts) AS t_quarter, month(ts) AS t_month, day(ts) AS t_day,
    isodow(ts) - 1 AS t_day_of_week, dayofyear(ts) AS t_day_of_year, week(ts) AS t_week_of_year, hour(ts) AS t_hour,
    minute(ts) AS t_minute, CAST(day(ts) = 1 AS INT) AS t_is_month_start,
    CAST(day(ts::DATE + 1) = 1 AS INT) AS t_is_month_end,
    CAST(ts::DATE = date_trunc('quarter', ts) AS INT) AS t_is_quarter_start,
    CAST(ts::DATE + 1 = date_trunc('quarter', ts::DATE + 1) AS INT) AS t_is_quarter_end,
    CAST(dayofyear(ts) = 1 AS INT) AS t_is_year_start, CAST(dayofyear(ts::DATE + 1) = 1 AS INT) AS t_is_year_end,
    CAST(isodow(ts) >= 6 AS INT) AS t_is_weekend FROM events""")
def time_features(spark, sf):
    return tf.time_features(fx.table(spark, sf, "events").select("event_id", "ts"), "ts", drop_original=True, prefix="t_")


@query("age_days", V("items", f"""a AS (SELECT id, CASE WHEN id % 7 <> 0 THEN CAST(date_diff('day', genesis_date, DATE '{AS_OF}') AS DOUBLE) END AS d FROM items)
  SELECT id, coalesce(d, (SELECT quantile_cont(d, 0.5) FROM a)) AS age_days FROM a"""))
def age_days(spark, sf):
    items = fx.items(spark, sf).select("id", F.when(F.col("id") % 7 != 0, F.col("genesis_date")).alias("genesis_date"))
    return tf.age_days(items, "genesis_date", F.lit(AS_OF).cast("date")).select("id", "age_days")


@query("anonymize", """SELECT c_custkey, sha256(c_name || 'pepper') AS hashed,
    CASE WHEN length(c_mktsegment) <= 4 THEN repeat('*', length(c_mktsegment))
         ELSE substr(c_mktsegment, 1, 2) || repeat('*', length(c_mktsegment) - 4) || right(c_mktsegment, 2) END AS masked,
    dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code, round_even(c_acctbal, -1) AS tens,
    substr(c_name, 1, 1) || '_' || CAST(length(c_name) - 1 AS VARCHAR) AS short FROM customer""")
def anonymize(spark, sf):
    c = fx.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("hashed"), F.col("c_mktsegment").alias("masked"),
        F.col("c_mktsegment").alias("code"), F.col("c_acctbal").alias("tens"), F.col("c_name").alias("short"))
    steps = [("hashed", "hash"), ("masked", "mask"), ("code", "categorical"), ("tens", "obfuscate"),
             ("short", "obfuscate")]
    return reduce(lambda d, s: pv.anonymize(d, s[0], s[1], salt="pepper"), steps, c)


@query("anonymize_noise", """WITH s AS (SELECT stddev_samp(c_acctbal) * 0.1::DOUBLE AS sd FROM customer),
  u AS (SELECT c_custkey, c_acctbal, (CAST('0x' || substr(md5(c_custkey || ':42'), 1, 10) AS BIGINT) + 1)::DOUBLE / 1099511627777 AS a,
    (CAST('0x' || substr(md5(c_custkey || ':43'), 1, 10) AS BIGINT) + 1)::DOUBLE / 1099511627777 AS b FROM customer)
  SELECT c_custkey, c_acctbal, round(c_acctbal + sqrt(-2 * ln(a)) * cos(2 * pi() * b) * sd, 6) AS c_acctbal_anon FROM u, s""")
def anonymize_noise(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    noise = pv.anonymize(c, "c_acctbal", "noise", keep_original=True, key=["c_custkey"], seed=42)
    return noise.withColumn("c_acctbal_anon", r6("c_acctbal_anon"))


# --- cleaning, scaling, encoding ----------------------------------------------------------------------------------

GAPS = """g AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_id % 11 <> 0 THEN value END AS price, CASE WHEN event_id % 13 <> 0 THEN event_type END AS kind,
  CASE WHEN event_id % 17 <> 0 THEN user_id::DOUBLE END AS mean_of, CASE WHEN event_id % 19 <> 0 THEN props END AS props FROM events)"""


def gaps(spark, sf):
    e = F.col("event_id")
    return fx.table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.when(e % 7 != 0, F.col("value")).alias("value"),
        F.when(e % 11 != 0, F.col("value")).alias("price"), F.when(e % 13 != 0, F.col("event_type")).alias("kind"),
        F.when(e % 17 != 0, F.col("user_id").cast("double")).alias("mean_of"), F.when(e % 19 != 0, F.col("props")).alias("props"))


@query("fill_missing", f"""WITH {GAPS} SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM g)), 6) AS value,
    coalesce(price, 0) AS price, coalesce(kind, (SELECT kind FROM g WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind,
    round(coalesce(mean_of, (SELECT avg(mean_of) FROM g)), 6) AS mean_of, coalesce(props, '') AS props FROM g""")
def fill_missing(spark, sf):
    out = cl.fill_missing(gaps(spark, sf).drop("ts", "user_id"), {"mean_of": "mean"})
    return out.select("event_id", r6("value"), "price", "kind", r6("mean_of"), "props")


@query("fill_missing_ordered", f"""WITH {GAPS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM g),
  f AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pp,
      first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER a AS np,
      last_value(kind IGNORE NULLS) OVER b AS pk, first_value(kind IGNORE NULLS) OVER a AS nk,
      last_value(price IGNORE NULLS) OVER b AS ppr, first_value(price IGNORE NULLS) OVER a AS npr
    FROM o WINDOW b AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  a AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, user_id, round(coalesce(value, pv + (nv - pv) * (p - pp) / nullif(np - pp, 0), pv, nv), 6) AS value,
    coalesce(npr, ppr) AS price, coalesce(pk, nk) AS kind FROM f""")
def fill_missing_ordered(spark, sf):
    out = cl.fill_missing(
        gaps(spark, sf).select("event_id", "ts", "user_id", "value", "price", "kind"),
        {"value": "interpolate", "price": "bfill", "kind": "ffill"},
        keys=["user_id"], order=["ts", "event_id"], bucket=F.date_trunc("day", "ts"))
    return out.select("event_id", "user_id", r6("value"), "price", "kind")


@query("fill_item_defaults", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END AS current_price,
    CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE p_brand END AS chain, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2020-03-04' END AS genesis_date FROM part""")
def fill_item_defaults(spark, sf):
    k = F.col("p_partkey")
    raw = fx.table(spark, sf, "part").select(
        k.alias("id"),
        F.when(k % 6 == 0, float("nan")).when(k % 3 == 0, float("inf")).otherwise(F.col("p_retailprice")).alias("current_price"),
        F.when(k % 4 != 0, F.col("p_brand")).alias("chain"),
        F.when(k % 5 == 0, "not a date").otherwise("2020-03-04").alias("genesis_date"))
    return cl.fill_item_defaults(raw, ["current_price"])


X = "l_extendedprice"
NORM_STATS = f"""s AS (SELECT min({X}) AS lo, max({X}) AS hi, avg({X}) AS m, stddev_samp({X}) AS sd, max(abs({X})) AS ma,
  quantile_cont({X}, 0.25) AS q1, quantile_cont({X}, 0.5) AS q2, quantile_cont({X}, 0.75) AS q3 FROM lineitem)"""
METHODS = {
    "minmax": "({x} - lo) / (hi - lo)", "zscore": "({x} - m) / sd", "maxabs": "{x} / ma", "log": "ln(1 + {x})",
    "robust": "({x} - q2) / (q3 - q1)",
}


@query("normalize", f"WITH {NORM_STATS} SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({e.format(x=X)}, 6) AS {m}" for m, e in METHODS.items()) + " FROM lineitem, s")
def normalize(spark, sf):
    df = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(X).alias(m) for m in METHODS])
    out = reduce(lambda d, m: cl.normalize(d, m, m), METHODS, df)
    return out.select("l_orderkey", "l_linenumber", *[r6(m) for m in METHODS])


@query("normalize_quantile", f"""SELECT l_orderkey, l_linenumber, round((rank() OVER (ORDER BY {X}) + (count(*) OVER (PARTITION BY {X}) - 1) / 2.0::DOUBLE)
    / count(*) OVER (), 6) AS v FROM lineitem""")
def normalize_quantile(spark, sf):
    df = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col(X).alias("v"))
    return cl.normalize(df, "v", "quantile").withColumn("v", r6("v"))


@query("normalize_clipped", f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
  c AS (SELECT event_id, least(greatest(value, q1 - 1.5::DOUBLE*(q3-q1)), q3 + 1.5::DOUBLE*(q3-q1)) AS v FROM events, q)
  SELECT event_id, round(-1 + (v - min(v) OVER ()) * 2 / (max(v) OVER () - min(v) OVER ()), 6) AS v FROM c""")
def normalize_clipped(spark, sf):
    df = fx.table(spark, sf, "events").select("event_id", F.col("value").alias("v"))
    return cl.normalize(df, "v", "minmax", (-1.0, 1.0), handle_outliers=True).withColumn("v", r6("v"))


@query("outliers", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS sd,
    quantile_cont(value, 0.5) AS med FROM events),
  d AS (SELECT quantile_cont(abs(value - med), 0.5) * 1.4826::DOUBLE AS mad FROM events, q)
  SELECT event_id, (value < q1 - 1.5::DOUBLE*(q3-q1) OR value > q3 + 1.5::DOUBLE*(q3-q1)) AS iqr, abs((value-m)/sd) > 2 AS zscore,
    abs(0.6745::DOUBLE*(value-med)/mad) > 2 AS modified FROM events, q, d""")
def outliers(spark, sf):
    df = fx.table(spark, sf, "events").select("event_id", "value")
    for name, method, threshold in (("iqr", "iqr", 1.5), ("zscore", "zscore", 2.0), ("modified", "modified_zscore", 2.0)):
        df = cl.outlier_flag(df, "value", method, threshold).withColumnRenamed("is_outlier", name)
    return df.drop("value")


ENC = "CASE WHEN p_partkey % 9 <> 0 THEN p_type END"


def enc_part(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("t"))


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("encode_ordinal", f"""WITH p AS (SELECT p_partkey, {ENC} AS t FROM part)
  SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(t, 'missing')) - 1 AS DOUBLE) AS t_encoded FROM p""")
def encode_ordinal(spark, sf):
    return en.encode_categorical(enc_part(spark, sf), ["t"], "ordinal")


@query("encode_binary", f"""WITH p AS (SELECT p_partkey, {ENC} AS t FROM part),
  d AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS c FROM (SELECT DISTINCT t FROM p WHERE t IS NOT NULL))
  SELECT p_partkey, CAST(coalesce(c, 7) & 1 AS INT) AS t_bin_0, CAST((coalesce(c, 7) >> 1) & 1 AS INT) AS t_bin_1,
    CAST((coalesce(c, 7) >> 2) & 1 AS INT) AS t_bin_2 FROM p LEFT JOIN d ON d.t = p.t""")
def encode_binary(spark, sf):
    return en.encode_categorical(enc_part(spark, sf), ["t"], "binary")


@query("encode_frequency", f"""WITH p AS (SELECT p_partkey, {ENC} AS t FROM part)
  SELECT p_partkey, CASE WHEN t IS NOT NULL THEN round(count(*) OVER (PARTITION BY t)::DOUBLE / count(t) OVER (), 6) END AS t_freq FROM p""")
def encode_frequency(spark, sf):
    return en.encode_categorical(enc_part(spark, sf), ["t"], "frequency").withColumn("t_freq", r6("t_freq"))


@query("encode_onehot", f"""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS t FROM orders)
  SELECT o_orderkey, """ + ", ".join(f"CAST(coalesce(t, 'missing') = '{v}' AS DOUBLE) AS t_{v}" for v in ("F", "O", "P", "missing")) + " FROM p")
def encode_onehot(spark, sf):
    df = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("t"))
    out = en.encode_categorical(df, ["t"], "onehot")
    return out.select("o_orderkey", *[F.col(c) for c in sorted(out.columns) if c != "o_orderkey"])


REGULAR = ["price_change_percentage_24h", "price_change_percentage_7d", "github_stars"]
FEATS = """, q AS (SELECT {q} FROM items),
  b AS (SELECT {b} FROM items),
  top AS (SELECT chain FROM items GROUP BY 1 ORDER BY count(*) DESC, chain LIMIT 15)
  SELECT id, {r}, {l}, round(popularity_score / 100, 6) AS popularity_score,
    CAST(chain NOT IN (SELECT chain FROM top) AS DOUBLE) AS chain_other,
    CAST(primary_category = 'economy' AS DOUBLE) AS category_economy FROM scored, q, b""".format(
    q=", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}" for c in REGULAR),
    b=", ".join(f"min(ln(1+{c})) AS lo_{c}, max(ln(1+{c})) AS hi_{c}" for c in ("market_cap", "total_volume", "github_stars")),
    r=", ".join(f"round(({c} - m_{c}) / i_{c}, 6) AS {c}" for c in REGULAR),
    l=", ".join(f"round((ln(1+{c}) - lo_{c}) / (hi_{c} - lo_{c}), 6) AS {c}_scaled" for c in ("market_cap", "total_volume", "github_stars")),
)


@query("feature_matrix", V("items", SCORED + FEATS))
def feature_matrix(spark, sf):
    items = materialise(sc.basic_scores(fx.items(spark, sf)))
    out = en.item_features(
        items, REGULAR, ["market_cap", "total_volume"], ["reddit_subscribers", "twitter_followers", "github_stars"],
        ["popularity_score", "trend_score"], {"chain": "chain", "primary_category": "category"})
    return out.select(
        "id", *[r6(c) for c in REGULAR], *[r6(f"{c}_scaled") for c in ("market_cap", "total_volume", "github_stars")],
        r6("popularity_score"), "chain_other", "category_economy")


def first_hit(value: str, names: list) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({value}), '{n}') THEN '{n}'" for n in names) + " ELSE '' END"


def flags(list_sql: str, names: list, prefix: str) -> str:
    hits = f"list_transform({list_sql}, lambda x: {first_hit('x', names)})"
    return ", ".join(f"CAST(list_contains({hits}, '{n}') AS DOUBLE) AS \"{prefix}{n}\"" for n in names)


@query("flag_features", V("tagged_items items", f"""SELECT t.id, round((ln(1+i.market_cap) - min(ln(1+i.market_cap)) OVER ())
    / (max(ln(1+i.market_cap)) OVER () - min(ln(1+i.market_cap)) OVER ()), 6) AS market_cap,
    {flags('t.categories', en.FLAG_CATEGORIES, 'cat_')}, {flags('t.platform_keys', en.FLAG_PLATFORMS, 'plat_')}
  FROM tagged_items t JOIN items i ON i.id = t.id"""))
def flag_features(spark, sf):
    return flag_matrix(spark, sf, ["market_cap"], ["market_cap"]).withColumn("market_cap", r6("market_cap"))


def flag_matrix(spark, sf, numeric, logged):
    tags = js.parse_json_columns(fx.tagged_items(spark, sf), ["categories", "platforms"]).select("id", "categories", "platforms")
    items = tags.join(fx.items(spark, sf).select("id", *numeric), "id")
    return en.flag_features(items, numeric, logged)




def tfidf_sql() -> str:
    return """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
  n AS (SELECT count(*)::DOUBLE AS n FROM documents),
  v AS (SELECT term, ln((1 + n.n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n.n
        HAVING count(*) >= 5 AND count(*) <= 0.9::DOUBLE * n.n ORDER BY sum(tf) DESC, term LIMIT 100),
  x AS (SELECT doc_id, tf.term, tf * idf AS x FROM tf JOIN v ON v.term = tf.term)
  SELECT doc_id, term, round(x / sqrt(sum(x*x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x"""


@query("tf_idf", tfidf_sql())
def tf_idf(spark, sf):
    docs = use_all_cores(fx.table(spark, sf, "documents").select("doc_id", "text"))
    out = en.tf_idf(docs, "doc_id", "text", stop_words=[""])
    return out.withColumn("weight", r6("weight"))


@query("text_features")
def text_features(spark, sf):
    docs = use_all_cores(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return en.text_features(docs, "doc_id", "text").drop("text")


# --- scores -------------------------------------------------------------------------------------------------------


@query("popularity_trend_scores", V("items", SCORED + " SELECT id, round(popularity_score, 6) AS popularity_score, round(trend_score, 6) AS trend_score FROM scored"))
def popularity_trend_scores(spark, sf):
    return sc.basic_scores(fx.items(spark, sf)).select("id", r6("popularity_score"), r6("trend_score"))


@query("social_engagement", V("items", """holes AS (SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE market_cap END AS cap, reddit_subscribers + twitter_followers AS f FROM items),
  r AS (SELECT id, f / nullif(cap / 1000000, 0) AS r FROM holes),
  e AS (SELECT id, ln(1 + coalesce(r, (SELECT quantile_cont(r, 0.5) FROM r))) AS e FROM r)
  SELECT id, round(greatest(0, least(100, 100 * e / (SELECT quantile_cont(e, 0.95) FROM e))), 6) AS social_engagement_score FROM e"""))
def social_engagement(spark, sf):
    items = fx.items(spark, sf).withColumn("market_cap", F.when(F.col("id") % 7 != 0, F.col("market_cap")).otherwise(0.0))
    return sc.social_engagement(materialise(items)).select("id", r6("social_engagement_score"))


@query("maturity_score", V("items", f"""a AS (SELECT id, market_cap, CASE WHEN id % 7 <> 0 THEN CAST(date_diff('day', genesis_date, DATE '{AS_OF}') AS DOUBLE) END AS d FROM items),
  f AS (SELECT id, market_cap, coalesce(d, (SELECT quantile_cont(d, 0.5) FROM a)) AS d FROM a)
  SELECT id, round(greatest(0, least(100, 100 * (0.6::DOUBLE * greatest(0, least(1, d / (SELECT quantile_cont(d, 0.95) FROM f)))
    + 0.4::DOUBLE * ln(1 + market_cap) / 30))), 6) AS maturity_score FROM f"""))
def maturity_score(spark, sf):
    items = fx.items(spark, sf).withColumn("genesis_date", F.when(F.col("id") % 7 != 0, F.col("genesis_date")))
    return sc.maturity(materialise(items), F.lit(AS_OF).cast("date")).select("id", r6("maturity_score"))


@query("developer_activity", V("items", """d AS (SELECT id, ln(1 + github_stars) + ln(1 + github_forks) AS d FROM items)
  SELECT id, round(100 * greatest(0, least(1, d / (SELECT quantile_cont(d, 0.95) FROM d))), 6) AS developer_activity_score FROM d"""))
def developer_activity(spark, sf):
    return sc.developer_activity(materialise(fx.items(spark, sf))).select("id", r6("developer_activity_score"))


@query("stored_scores", V("items", """SELECT id, round(100*(0.4::DOUBLE*ln(1+market_cap)/30 + 0.3::DOUBLE*ln(1+total_volume)/25 + 0.15::DOUBLE*ln(1+reddit_subscribers)/15
    + 0.15::DOUBLE*ln(1+twitter_followers)/15), 6) AS popularity_score,
    round(50*(ln(1+reddit_subscribers)/15 + ln(1+twitter_followers)/15), 6) AS social_score,
    lower(categories[1]) AS primary_category, lower(chain) AS chain FROM items"""))
def stored_scores(spark, sf):
    return sc.stored_scores(fx.items(spark, sf)).select(
        "id", r6("popularity_score"), r6("social_score"), "primary_category", "chain")


@query("trending_boost", V("items", SCORED + """, r AS (SELECT id, row_number() OVER (ORDER BY round(total_volume, 4) DESC, id) - 1 AS place FROM items QUALIFY place < 15)
  SELECT s.id, round(CASE WHEN r.id IS NULL THEN 50 ELSE s.popularity_score + 30 + 5 * (8 - least(8, place)) END, 6) AS trend_score
  FROM scored s LEFT JOIN r ON r.id = s.id"""))
def trending_boost(spark, sf):
    items = sc.basic_scores(fx.items(spark, sf))
    first = items.orderBy(F.round("total_volume", 4).desc(), "id").limit(15).select("id", F.round("total_volume", 4).alias("v"))
    ranked = top_k(first.withColumn("_all", F.lit(0)), ["_all"], [F.col("v").desc(), F.col("id")], 15, "place")
    return sc.trending_boost(items, ranked.select("id", (F.col("place") - 1).alias("place"))).select("id", r6("trend_score"))
