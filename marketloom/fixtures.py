"""Model tables derived from the driver's parquet tables (interactions, ratings, items, prices, users ...)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.scale import distinct_counts


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as an interaction; ``error`` events map to no type and are invalid on purpose."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.when(kind == "view", "view")
        .when(kind == "click", "click")
        .when(kind == "signup", "favorite")
        .when(kind == "purchase", "portfolio_add")
        .alias("interaction_type"),
        F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "signup", 4).when(kind == "purchase", 5)
        .alias("weight"),
        "ts",
    )


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    return raw_interactions(spark, sf).filter(F.col("interaction_type").isNotNull())


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return interactions(spark, sf).groupBy("user_id", "item_id").agg(F.max("weight").cast("double").alias("rating"))


def ratings_large(spark: SparkSession, sf: str, by: str | None = None) -> DataFrame:
    """With ``by`` (``user_id`` or ``item_id``) all ratings of a user or an item lie in one partition, without a further shuffle."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    bought = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.ceil(F.col("l_quantity") / 10).alias("rating"))
    if by is not None:
        bought = bought.repartition(by)
    return bought.groupBy("user_id", "item_id").agg(F.max("rating").cast("double").alias("rating"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "id")
    sums = lines.groupBy("id").agg(
        F.sum("l_extendedprice").alias("market_cap"),
        F.sum("l_quantity").alias("total_volume"),
        F.count(F.lit(1)).alias("twitter_followers"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("github_forks"),
        F.to_date(F.min("l_shipdate")).alias("genesis_date"),
    )
    distinct = distinct_counts(lines, "id", reddit_subscribers="l_orderkey", github_stars="l_suppkey")
    sales = sums.join(distinct, "id", "left").select(
        "id", "market_cap", "total_volume", F.coalesce("reddit_subscribers", F.lit(0)).alias("reddit_subscribers"),
        "twitter_followers", F.coalesce("github_stars", F.lit(0)).alias("github_stars"), "github_forks", "genesis_date")
    key = F.col("p_partkey")
    catalog = part.select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.upper(F.substring("p_name", 1, 3)).alias("symbol"),
        F.col("p_brand").alias("chain"),
        F.lower("p_type").alias("primary_category"),
        F.split("p_name", " ").alias("categories"),
        F.create_map(F.lower("p_brand"), key.cast("string")).alias("platforms"),
        F.col("p_retailprice").alias("current_price"),
        (F.col("p_size") - 25.5).alias("price_change_percentage_24h"),
        ((key % 61) - 30).cast("double").alias("price_change_percentage_7d"),
        ((key % 101) - 50).cast("double").alias("price_change_percentage_30d"),
    )
    return catalog.join(sales, "id", "left")


def prices(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts")
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("project_id"), hour.alias("timestamp"))
        .agg(F.avg("value").alias("price"), F.sum("value").alias("volume"), (F.sum("value") * 100).alias("market_cap"))
    )


def prices_long(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy(F.col("p_brand").alias("project_id"), F.date_trunc("day", "l_shipdate").alias("timestamp"))
        .agg(
            F.avg("l_extendedprice").alias("price"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("market_cap"),
        )
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(seg.isin("AUTOMOBILE", "BUILDING"), "low").when(seg == "FURNITURE", "medium").otherwise("high")
        .alias("risk_tolerance"),
    )


def portfolios(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    held = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("project_id"))
        .agg(F.sum(held).alias("amount"))
    )


def price_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """One alert per rating; kind and target follow from the ids, half of them already beyond the price."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("project_id"), "p_retailprice")
    r = ratings(spark, sf).withColumnRenamed("item_id", "project_id")
    pick = F.pmod(F.col("user_id") + F.col("project_id"), F.lit(2)) == 0
    factor = F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, 0.9).otherwise(1.1)
    return r.join(part, "project_id").select(
        (F.col("user_id") * 100000 + F.col("project_id")).alias("alert_id"),
        "user_id",
        "project_id",
        F.when(pick, "above").otherwise("below").alias("alert_type"),
        (F.col("p_retailprice") * factor).alias("target_price"),
    )


# The same tables as DuckDB text, prepended to the check queries that need them.
SQL = {
    "raw_interactions": """raw_interactions AS (
  SELECT event_id, user_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS item_id,
         CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click'
                         WHEN 'signup' THEN 'favorite' WHEN 'purchase' THEN 'portfolio_add' END AS interaction_type,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 END
           AS weight, ts FROM events)""",
    "interactions": "interactions AS (SELECT * FROM raw_interactions WHERE interaction_type IS NOT NULL)",
    "ratings": """ratings AS (
  SELECT user_id, item_id, CAST(max(weight) AS DOUBLE) AS rating FROM interactions GROUP BY user_id, item_id)""",
    "ratings_large": """ratings_large AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(max(ceil(l_quantity/10)) AS DOUBLE) AS rating
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey)""",
    "items": """items AS (
  SELECT p.p_partkey AS id, p.p_name AS name, upper(substr(p.p_name,1,3)) AS symbol, p.p_brand AS chain,
         lower(p.p_type) AS primary_category, string_split(p.p_name,' ') AS categories, p.p_retailprice AS current_price,
         CAST(p.p_size AS DOUBLE) - 25.5 AS price_change_percentage_24h,
         CAST(p.p_partkey % 61 - 30 AS DOUBLE) AS price_change_percentage_7d,
         CAST(p.p_partkey % 101 - 50 AS DOUBLE) AS price_change_percentage_30d,
         a.market_cap, a.total_volume, a.reddit_subscribers, a.twitter_followers, a.github_stars, a.github_forks,
         a.genesis_date
  FROM part p LEFT JOIN (
    SELECT l_partkey, sum(l_extendedprice) AS market_cap, sum(l_quantity) AS total_volume,
           count(DISTINCT l_orderkey) AS reddit_subscribers, count(*) AS twitter_followers,
           count(DISTINCT l_suppkey) AS github_stars,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS github_forks,
           CAST(min(l_shipdate) AS DATE) AS genesis_date
    FROM lineitem GROUP BY l_partkey) a ON a.l_partkey = p.p_partkey)""",
    "prices": """prices AS (
  SELECT event_type AS project_id, date_trunc('hour', ts) AS "timestamp", avg(value) AS price,
         sum(value) AS volume, sum(value) * 100 AS market_cap
  FROM events GROUP BY event_type, date_trunc('hour', ts))""",
    "prices_long": """prices_long AS (
  SELECT p_brand AS project_id, date_trunc('day', l_shipdate) AS "timestamp", avg(l_extendedprice) AS price,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS market_cap
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, date_trunc('day', l_shipdate))""",
    "users": """users AS (
  SELECT c_custkey AS user_id, CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'low'
         WHEN c_mktsegment = 'FURNITURE' THEN 'medium' ELSE 'high' END AS risk_tolerance FROM customer)""",
    "portfolios": """portfolios AS (
  SELECT o_custkey AS user_id, l_partkey AS project_id,
         sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS amount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey)""",
    "price_alerts": """price_alerts AS (
  SELECT r.user_id * 100000 + r.item_id AS alert_id, r.user_id, r.item_id AS project_id,
         CASE WHEN (r.user_id + r.item_id) % 2 = 0 THEN 'above' ELSE 'below' END AS alert_type,
         p_retailprice * (CASE WHEN r.user_id % 2 = 0 THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END) AS target_price
  FROM ratings r JOIN part ON r.item_id = p_partkey)""",
}

NEEDS = {
    "interactions": ["raw_interactions"],
    "ratings": ["interactions"],
    "price_alerts": ["ratings"],
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` clause for the named views (and what they need) in front of a query body.

    ``body`` starts with ``SELECT`` or with further comma-led common table expressions.
    """
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    head = "WITH RECURSIVE " if recursive else "WITH "
    ctes = ",\n".join(SQL[n] for n in order)
    body = body.strip()
    sep = ",\n" if not body.upper().startswith("SELECT") else "\n"
    return head + ctes + sep + body


# Category and platform texts dealt out to items by id.
TAG_CATEGORIES = [
    "Decentralized-Finance", "Layer-1", "NFT", "Meme-Token", "Play-to-Earn", "Oracle", "Tokenized-Asset", "Unlisted",
    "defi", "Exchange-Token",
]
TAG_PLATFORMS = ["ethereum", "BSC", "sol", "Polygon", "near", "AVAX", "cosmos-hub"]


def tagged_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with JSON texts of categories and platforms, some null, empty, damaged or broken."""
    k = F.col("p_partkey")
    cats = F.array(*[F.lit(c) for c in TAG_CATEGORIES])
    plats = F.array(*[F.lit(p) for p in TAG_PLATFORMS])
    c1 = cats[(k % 10).cast("int")]
    c2 = cats[F.floor(k / 10 % 10).cast("int")]
    p1 = plats[(k % 7).cast("int")]
    p2 = plats[F.floor(k / 7 % 7).cast("int")]
    q = F.lit('"')
    good_c = F.concat(F.lit('["'), c1, F.lit('", "'), c2, F.lit('"]'))
    good_p = F.when(p1 == p2, F.concat(F.lit('{"'), p1, F.lit('": "0x1"}'))).otherwise(
        F.concat(F.lit('{"'), p1, F.lit('": "0x1", "'), p2, F.lit('": "0x2"}')))
    doubled = lambda t: F.replace(t, q, F.lit('""'))
    odd = k % 23
    spoil = lambda t, broken: (
        F.when(odd == 0, F.lit(None)).when(odd == 1, F.lit("")).when(odd == 2, doubled(t))
        .when(odd == 3, F.lit(broken)).otherwise(t))
    return table(spark, sf, "part").select(
        k.alias("id"),
        F.col("p_name").alias("name"),
        spoil(good_c, "[broken").alias("categories"),
        spoil(good_p, "{broken").alias("platforms"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


SQL["tagged_items"] = f"""tags0 AS (
  SELECT p_partkey AS id, p_name AS name, p_partkey % 23 AS odd,
         {_sql_list(TAG_CATEGORIES)}[p_partkey % 10 + 1] AS c1, {_sql_list(TAG_CATEGORIES)}[p_partkey // 10 % 10 + 1] AS c2,
         {_sql_list(TAG_PLATFORMS)}[p_partkey % 7 + 1] AS p1, {_sql_list(TAG_PLATFORMS)}[p_partkey // 7 % 7 + 1] AS p2
  FROM part),
  tagged_items AS (
  SELECT id, name, odd,
         CASE WHEN odd IN (0, 1, 3) THEN [] ELSE [c1, c2] END AS categories,
         CASE WHEN odd IN (0, 1, 3) THEN [] WHEN p1 = p2 THEN [p1] ELSE [p1, p2] END AS platform_keys
  FROM tags0)"""


def brand_items(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as items: ids match ``prices_long``."""
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_extendedprice")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy(F.col("p_brand").alias("id"))
        .agg(
            F.round(F.sum("l_extendedprice"), 2).alias("market_cap"),
            F.max("p_retailprice").alias("current_price"),
            F.concat(F.lit("The "), F.first("p_brand")).alias("name"),
        )
    )


def brand_portfolios(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("project_id"), "p_brand")
    return (
        portfolios(spark, sf).join(part, "project_id")
        .groupBy("user_id", F.col("p_brand").alias("project_id")).agg(F.sum("amount").alias("amount"))
    )


def stored_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations of stored technical actions per (user, brand), derived from ids; some users have none."""
    held = brand_portfolios(spark, sf).filter("amount > 10")
    age = held.withColumn("age", F.explode(F.array(F.lit(1), F.lit(2))))
    pick = F.pmod(F.col("user_id") + F.col("age"), F.lit(3))
    return age.select(
        "user_id", "project_id", F.lit("technical").alias("recommendation_type"),
        F.when(pick == 0, "hold").when(pick == 1, "buy").otherwise("sell").alias("action_type"),
        (F.lit("2024-06-10").cast("timestamp") - F.make_interval(days=F.col("age"))).alias("created_at"),
    )


SQL["brand_items"] = """brand_items AS (
  SELECT p_brand AS id, round(sum(l_extendedprice), 2) AS market_cap, max(p_retailprice) AS current_price, 'The ' || p_brand AS name
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand)"""
SQL["brand_portfolios"] = """brand_portfolios AS (
  SELECT user_id, p_brand AS project_id, sum(amount) AS amount FROM portfolios JOIN part ON p_partkey = project_id GROUP BY 1, 2)"""
SQL["stored_signals"] = """stored_signals AS (
  SELECT user_id, project_id, CASE (user_id + age) % 3 WHEN 0 THEN 'hold' WHEN 1 THEN 'buy' ELSE 'sell' END AS action_type,
         TIMESTAMP '2024-06-10' - to_days(age) AS created_at
  FROM brand_portfolios, (SELECT unnest([1, 2]) AS age) WHERE amount > 10)"""
NEEDS["brand_portfolios"] = ["portfolios"]
NEEDS["stored_signals"] = ["brand_portfolios"]
