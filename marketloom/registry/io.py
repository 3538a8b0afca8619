"""Sources, sinks, stores and streams, run through the session's shared folder."""

from pyspark.sql import functions as F

from marketloom import fixtures as fx
from marketloom.functions.jsonops import parse_json_columns
from marketloom.plans import similarity as sm
from marketloom.plans.recommend import item_cf, stored_item_cf
from marketloom.registry.base import query, r6
from marketloom.registry.market import mean, sd
from marketloom.registry.recs import COS_ITEM, TOP, cf_sql, ranked, show
from marketloom.session import materialise, staging_path
from marketloom.sources import files as fi
from marketloom.sources import ranges as ra
from marketloom.sources import stores as st
from marketloom.streaming import jobs as sj
from marketloom.streaming.ratings import RatingsTable

V = fx.with_views


@query("read_csv", """SELECT event_id, date_trunc('second', ts) AS created_at, user_id, event_type, value,
    CAST(NULL AS TIMESTAMP) AS bad_date FROM events""")
def read_csv(spark, sf):
    path = staging_path(spark, "csv")
    fi.write_csv(
        fx.table(spark, sf, "events").select(
            "event_id", F.col("ts").alias("created_at"), "user_id", "event_type", "value", F.lit("soon").alias("bad_date")),
        path, 6, "gzip")
    return fi.read_csv(
        spark, path, "event_id long, created_at string, user_id long, event_type string, value double, bad_date string")


@query("write_csv", "SELECT p_partkey, p_name, format('{:.6f}', p_retailprice) AS p_retailprice FROM part")
def write_csv(spark, sf):
    path = staging_path(spark, "csv")
    fi.write_csv(fx.table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return fi.read_csv(spark, path, "p_partkey long, p_name string, p_retailprice string", parse_dates=False)


@query("read_json", """SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def read_json(spark, sf):
    path = staging_path(spark, "json")
    rows = fx.table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.from_json("props", "k long").alias("props"))
    fi.write_json(rows, path, "gzip")
    back = fi.read_json(spark, path, "event_id long, event_type string, value double, props struct<k: long>")
    return back.select("event_id", "event_type", "value", F.col("props.k").alias("k"))


@query("read_json_array", """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "props.k",
    'say "[' || event_id || ']" \\ {' AS note FROM events""")
def read_json_array(spark, sf):
    path = staging_path(spark, "arrays")
    rows = fx.table(spark, sf, "events").select(
        "event_id", "event_type", F.from_json("props", "k long").alias("props"),
        F.concat(F.lit('say "['), "event_id", F.lit(']" \\ {')).alias("note"))
    ra.write_json_arrays(rows.repartition(2), path)
    return ra.read_json_array(
        spark, path, "event_id long, event_type string, props struct<k: long>, note string", flatten=True, range_bytes=50_000)


@query("read_archived_csv", """SELECT event_id, event_type, value, 'x,"' || event_id || '"' AS note FROM events""")
def read_archived_csv(spark, sf):
    path = staging_path(spark, "archives")
    rows = fx.table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.concat(F.lit('x,"'), "event_id", F.lit('"')).alias("note"))
    ra.write_archived_csv(rows.filter("event_id % 2 = 0").repartition(3), f"{path}/zip", "zip")
    ra.write_archived_csv(rows.filter("event_id % 2 = 1").repartition(2), f"{path}/xz", "xz")
    return ra.read_archived_csv(spark, path, "event_id long, event_type string, value double, note string")


@query("write_json", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events")
def write_json(spark, sf):
    path = staging_path(spark, "json")
    fi.write_json(fx.table(spark, sf, "events").select("event_id", "ts"), path)
    return fi.read_json(spark, path, "event_id long, ts string")


@query("latest_snapshot", """SELECT p_partkey, p_retailprice * 1.2::DOUBLE AS price, '20240103_000000' AS snapshot_ts FROM part""")
def latest_snapshot(spark, sf):
    path = staging_path(spark, "snap")
    part = fx.table(spark, sf, "part")
    for day, factor in (("2024-01-01", 1.0), ("2024-01-03", 1.2), ("2024-01-02", 1.1)):
        rows = part.select("p_partkey", (F.col("p_retailprice") * factor).alias("price"))
        fi.save_snapshot(rows, path, F.lit(day).cast("timestamp"))
    return fi.latest_snapshot(spark, path)


@query("list_files", "SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS name_ts, true AS has_rows FROM events")
def list_files(spark, sf):
    path = staging_path(spark, "daily")
    events = fx.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    events.repartition("day").write.partitionBy("day").parquet(path)
    files = fi.list_files(spark, path, prefix="part-", suffix=".parquet", recursive=True, min_size=1)
    return files.groupBy(fi.file_timestamp(F.col("path")).alias("name_ts")).agg((F.sum("length") > 0).alias("has_rows"))


@query("load_item_details", """SELECT 'p' || p_partkey AS id, CAST(p_size AS BIGINT) AS github_stars, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END AS reddit_subscribers,
    p_name AS categories, CASE WHEN p_partkey % 4 = 0 THEN 50 ELSE p_retailprice END AS sentiment_positive, p_type AS description, CAST(9999 AS BIGINT) AS market_cap_rank FROM part""")
def load_item_details(spark, sf):
    path = staging_path(spark, "details")
    k = F.col("p_partkey")
    docs = fx.table(spark, sf, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"),
        F.split("p_name", " ").alias("categories"),
        F.struct(F.when(k % 3 == 0, "many").otherwise(k.cast("string")).alias("reddit_subscribers")).alias("community_data"),
        F.struct(F.col("p_size").alias("stars")).alias("developer_data"),
        F.struct(F.col("p_type").alias("en")).alias("description"),
        F.when(k % 4 != 0, F.col("p_retailprice")).alias("sentiment_votes_up_percentage"))
    fi.write_json(docs, path)
    return fi.load_item_details(spark, path, multi_line=False).select(
        "id", "github_stars", "reddit_subscribers", F.array_join("categories", " ").alias("categories"),
        "sentiment_positive", "description", "market_cap_rank")


@query("save_processed", V("tagged_items", """SELECT id, array_to_string(categories, ', ') AS categories, array_to_string(platform_keys, ', ') AS platforms FROM tagged_items"""))
def save_processed(spark, sf):
    path = staging_path(spark, "processed")
    items = parse_json_columns(fx.tagged_items(spark, sf), ["categories", "platforms"])
    fi.save_processed(path, F.lit("2024-01-05").cast("timestamp"), items=items, interactions=fx.interactions(spark, sf))
    return fi.flat_view(fi.load_processed(spark, path, "items")["items"]).select("id", "categories", "platforms")


@query("save_matrices", V("ratings", f"{COS_ITEM}, {cf_sql('iscores', 'cos')}, {ranked('top', 'iscores', 10)} {TOP} top"))
def save_matrices(spark, sf):
    path = staging_path(spark, "matrices")
    ratings = fx.ratings(spark, sf)
    st.save_matrices(path, ratings, sim_item=sm.item_cosine(ratings))
    back = st.load_matrices(spark, path, "ratings", "sim_item")
    return show(stored_item_cf(back["ratings"], back["sim_item"]))


@query("sim_store", V("ratings_large", f"""ratings AS (SELECT * FROM ratings_large), {COS_ITEM} SELECT i, j, round(sim, 6) AS sim FROM cos WHERE i < j AND sim > 0.1"""))
def sim_store(spark, sf):
    path = staging_path(spark, "sim")
    large = materialise(sm.cosines_above(
        fx.ratings_large(spark, sf, by="item_id"), "item_id", "user_id", st.STORED_SIMILARITY, dealt=True))
    st.save_similarity(sm.item_cosine(fx.ratings(spark, sf)), "events", path)
    st.save_similarity(large.filter("sim > 0.5"), "orders", path)
    st.save_similarity(large, "orders", path)
    return st.load_similarity(spark, path, "orders").select("i", "j", r6("sim"))


@query("upsert_items", """WITH old AS (SELECT p_partkey AS id, p_name AS name, p_size * 1000.0::DOUBLE AS market_cap FROM part WHERE p_size > 20),
  new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE upper(p_name) END AS name, p_size * 2000.0::DOUBLE AS market_cap FROM part WHERE p_size < 35)
  SELECT coalesce(old.id, new.id) AS id, coalesce(new.name, old.name) AS name, round(100 * 0.4::DOUBLE * ln(1 + coalesce(new.market_cap, old.market_cap)) / 30, 6) AS popularity_score
  FROM old FULL OUTER JOIN new ON old.id = new.id""")
def upsert_items(spark, sf):
    k = F.col("p_partkey")
    base = fx.table(spark, sf, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), "p_size", F.lit(0.0).alias("total_volume"),
        F.lit(0).alias("reddit_subscribers"), F.lit(0).alias("twitter_followers"),
        F.array().cast("array<string>").alias("categories"), F.create_map().cast("map<string,string>").alias("platforms"))
    old = base.filter("p_size > 20").withColumn("market_cap", F.col("p_size") * 1000.0)
    new = base.filter("p_size < 35").withColumns(
        {"market_cap": F.col("p_size") * 2000.0, "name": F.when(F.col("id") % 6 != 0, F.upper("name"))})
    return st.upsert_items(old, new).select("id", "name", r6("popularity_score"))


@query("upsert_prices", V("prices", """new AS (SELECT project_id, "timestamp", price * 2 AS price FROM prices WHERE project_id <> 'view')
  SELECT project_id, "timestamp", round(price + 1e-9, 6) AS price FROM prices WHERE "timestamp" < TIMESTAMP '2024-01-24' OR project_id = 'view' UNION ALL
  SELECT project_id, "timestamp", round(price + 1e-9, 6) FROM new WHERE "timestamp" >= TIMESTAMP '2024-01-24'"""))
def upsert_prices(spark, sf):
    prices = fx.prices(spark, sf)
    point = lambda c: F.sort_array(F.collect_list(F.array(F.unix_millis(F.col("timestamp").cast("timestamp")).cast("double"), c)))
    some = prices.filter(F.col("project_id") != "view")
    charts = some.groupBy("project_id", F.to_date("timestamp").alias("day")).agg(  # one document per series and day
        point(F.col("price") * 2).alias("prices"), point(F.col("volume")).alias("total_volumes"),
        point(F.col("market_cap")).alias("market_caps"))
    merged = st.upsert_prices(prices, st.chart_rows(charts), F.lit("2024-01-31").cast("timestamp"), 7)
    return merged.select("project_id", "timestamp", r6(F.col("price") + 1e-9, "price"))


@query("combine_pages", """WITH d AS (SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_retailprice > 950)
  SELECT p.p_partkey AS id, CASE WHEN p.p_size > 25 THEN p.p_name ELSE p.p_type END AS label, CASE WHEN p.p_size > 25 THEN NULL ELSE p.p_size END AS size, d.brand
  FROM part p LEFT JOIN d ON d.id = p.p_partkey""")
def combine_pages(spark, sf):
    k, part = F.col("p_partkey"), fx.table(spark, sf, "part")
    first = part.filter("p_size > 25").select(k.alias("id"), F.col("p_name").alias("label"))
    second = part.select(k.alias("id"), F.col("p_type").alias("label"), F.col("p_size").alias("size"))
    details = part.filter("p_retailprice > 950").select(k.alias("id"), F.col("p_brand").alias("brand"))
    return st.combine_pages([first, second], details)


@query("save_recommendations", V("ratings", f"{COS_ITEM}, {cf_sql('iscores', 'cos')}, {ranked('top', 'iscores', 10)} {TOP} top"))
def save_recommendations(spark, sf):
    path = staging_path(spark, "recs")
    recs = item_cf(fx.ratings(spark, sf)).withColumn("recommendation_type", F.lit("item_based"))
    st.save_recommendations(recs.filter("rank = 1").withColumn("recommendation_type", F.lit("best")), path)
    st.save_recommendations(recs.filter("rank <= 3"), path)
    st.save_recommendations(recs, path)
    return show(spark.read.parquet(path).filter("recommendation_type = 'item_based'"))


@query("map_batches", "SELECT doc_id, length(text) AS n FROM documents")
def map_batches(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return st.map_batches(
        docs, lambda f: f.assign(n=f["text"].str.len())[["doc_id", "n"]], "doc_id long, n long")


# --- streams ------------------------------------------------------------------------------------------------------


FILES = 4  # of a slice; a trigger reads one slice


def slices(spark, df, n=4):
    """A folder with ``n`` slices of ``FILES`` files in time order, as a stream of arriving files would leave it."""
    path = staging_path(spark, "in")
    cuts = df.approxQuantile("_t", [i / n for i in range(1, n)], 0.001) if "_t" in df.columns else []
    for i in range(n):
        lo = F.lit(True) if i == 0 else F.col("_t") > cuts[i - 1]
        hi = F.lit(True) if i == n - 1 else F.col("_t") <= cuts[i]
        df.filter(lo & hi).drop("_t").repartition(FILES).write.mode("append").parquet(path)
    return path


def run(spark, df, state="memory"):
    """Run a stream to its end and read what it wrote; ``state='rocksdb'`` keeps large state on disk."""
    if state == "rocksdb":
        sj.use_rocksdb(spark)
    out = staging_path(spark, "out")
    q = sj.to_files(df, out, staging_path(spark, "cp"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("stream_ratings", V("ratings", "SELECT user_id, item_id, rating FROM ratings"))
def stream_ratings(spark, sf):
    raw = fx.raw_interactions(spark, sf)
    twice = raw.unionByName(raw.filter("interaction_type = 'view'"))
    path = slices(spark, twice.withColumn("_t", F.unix_millis(F.col("ts").cast("timestamp"))))
    stream = sj.file_stream(spark, path, raw.schema, FILES)
    return sj.merged_ratings(run(spark, sj.valid_interactions(stream)))


@query("stream_merge_ratings", V("ratings", "SELECT user_id, item_id, rating FROM ratings"))
def stream_merge_ratings(spark, sf):
    raw = fx.raw_interactions(spark, sf)
    path = slices(spark, raw.withColumn("_t", F.unix_millis(F.col("ts").cast("timestamp"))))
    table = RatingsTable(spark, staging_path(spark, "ratings"), buckets=8)
    valid = sj.valid_interactions(sj.file_stream(spark, path, raw.schema, FILES))
    table.follow(valid, staging_path(spark, "cp")).awaitTermination()
    return table.read()


@query("stream_dead_letters", V("raw_interactions", "SELECT event_id, user_id, item_id, ts FROM raw_interactions WHERE interaction_type IS NULL"))
def stream_dead_letters(spark, sf):
    raw = fx.raw_interactions(spark, sf)
    path = slices(spark, raw.withColumn("_t", F.unix_millis(F.col("ts").cast("timestamp"))))
    return run(spark, sj.invalid_interactions(sj.file_stream(spark, path, raw.schema, FILES))).select(
        "event_id", "user_id", "item_id", "ts")


@query("stream_price_buckets", """SELECT event_type AS project_id, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
    round(avg(value) + 1e-9, 6) AS price, round(sum(value), 6) AS volume, count(*) AS n FROM events GROUP BY 1, 2, 3
  HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_price_buckets(spark, sf):
    ticks = fx.table(spark, sf, "events").select(F.col("event_type").alias("project_id"), "ts", "value")
    path = slices(spark, ticks.withColumn("_t", F.unix_millis(F.col("ts").cast("timestamp"))))
    out = run(spark, sj.price_buckets(sj.file_stream(spark, path, ticks.schema, FILES)))
    return out.select(
        "project_id", "window_start", "window_end", r6(F.col("price") + 1e-9, "price"), r6("volume"), "n")


ALERTS = """al AS (SELECT p_partkey AS alert_id, p_brand AS project_id, CASE WHEN p_partkey % 2 = 0 THEN 'above' ELSE 'below' END AS alert_type,
    p_retailprice * (CASE WHEN p_partkey % 2 = 0 THEN 45 ELSE 12 END) AS target_price FROM part)"""


@query("stream_price_alerts", V("prices_long", f"""{ALERTS} SELECT alert_id, al.project_id, min("timestamp") AS "timestamp" FROM prices_long p JOIN al ON al.project_id = p.project_id
  WHERE (alert_type = 'above' AND price >= target_price) OR (alert_type = 'below' AND price <= target_price) GROUP BY 1, 2"""))
def stream_price_alerts(spark, sf):
    k = F.col("p_partkey")
    alerts = fx.table(spark, sf, "part").select(
        k.alias("alert_id"), F.col("p_brand").alias("project_id"), F.when(k % 2 == 0, "above").otherwise("below").alias("alert_type"),
        (F.col("p_retailprice") * F.when(k % 2 == 0, 45).otherwise(12)).alias("target_price"))
    bars = fx.prices_long(spark, sf).select("project_id", "timestamp", "price")
    path = slices(spark, bars.withColumn("_t", F.unix_millis(F.col("timestamp").cast("timestamp"))))
    hits = sj.first_hits(sj.file_stream(spark, path, bars.schema, FILES), alerts)
    return run(spark, sj.fire_once(hits, None, keep_days=4000), "rocksdb").select("alert_id", "project_id", "timestamp")


@query("stream_events", V("prices_long", f"""p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp") AS pos FROM prices_long),
  flags AS (SELECT project_id, "timestamp", coalesce(CAST(price > {mean('price', 7)} + 2 * ({sd('price', 7)}) AS INT), 0) AS pump,
    coalesce(CAST(price < {mean('price', 7)} - 2 * ({sd('price', 7)}) AS INT), 0) AS dump FROM p)
  SELECT * FROM flags WHERE (epoch_ms("timestamp"::TIMESTAMP) // 5529600000 + 1) * 5529600000
    <= epoch_ms((SELECT max("timestamp") FROM prices_long)::TIMESTAMP) - 172800000"""))
def stream_events(spark, sf):
    bars = fx.prices_long(spark, sf).select("project_id", "timestamp", "price")
    path = slices(spark, bars.withColumn("_t", F.unix_millis(F.col("timestamp").cast("timestamp"))))
    return run(spark, sj.pump_dump(sj.file_stream(spark, path, bars.schema, FILES), "2 days", chunk_ms=64 * sj.DAY_MS), "rocksdb").select(
        "project_id", "timestamp", "pump", "dump")
