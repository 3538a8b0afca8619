"""Lists built on the recommenders: combined similarity, filters, cold start, jobs, sampling, latent factors."""

from pyspark.sql import functions as F

from marketloom import fixtures as fx
from marketloom.operators import aggregates as ag
from marketloom.operators import joins as jn
from marketloom.operators.grid import VectorTable, unit_rows
from marketloom.operators.scores import basic_scores
from marketloom.plans import latent as la
from marketloom.plans import recommend as rc
from marketloom.plans import sampling as sa
from marketloom.plans import similarity as sm
from marketloom.registry.base import query, r6
from marketloom.registry.recs import (
    COS_ITEM, COS_USER, ENHANCED, NUMERIC, SCORED, TOP, USER_SCORES, cf_sql, hybrid_recs, hybrid_sql, hybrid_tables,
    neighbours_sql, ranked, show, show_pairs,
)
from marketloom.registry.toolbox import en, first_hit, flag_matrix
from marketloom.session import materialise

V = fx.with_views

# --- combined similarity from the flag matrix ----------------------------------------------------------------------

FLAG_NUM = ["market_cap", "total_volume", "price_change_percentage_24h", "github_stars"]
FLAG_LOG = ["market_cap", "total_volume"]


def flag_table(spark, sf):
    wide = materialise(flag_matrix(spark, sf, FLAG_NUM, FLAG_LOG))
    cols = [c for c in wide.columns if c != "id"]
    safe = wide.toDF("id", *[f"x{n}" for n in range(len(cols))])
    names = safe.columns[1:]
    return VectorTable(unit_rows(safe, names), "id", names)


def _flag_exprs() -> list[str]:
    cats = f"list_transform(t.categories, lambda x: {first_hit('x', en.FLAG_CATEGORIES)})"
    plats = f"list_transform(t.platform_keys, lambda x: {first_hit('x', en.FLAG_PLATFORMS)})"
    return [f"CAST(list_contains({cats}, '{n}') AS DOUBLE)" for n in en.FLAG_CATEGORIES] + [
        f"CAST(list_contains({plats}, '{n}') AS DOUBLE)" for n in en.FLAG_PLATFORMS]


def _scaled(x: str) -> str:
    return f"({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())"


FLAG_VEC = "fv AS (SELECT t.id, [{}]::DOUBLE[] AS f FROM tagged_items t JOIN items i ON i.id = t.id)".format(", ".join(
    [_scaled(f"ln(1+i.{c})" if c in FLAG_LOG else f"CAST(i.{c} AS DOUBLE)") for c in FLAG_NUM] + _flag_exprs()))
COMBINED = f"""{FLAG_VEC}, comb AS (
  SELECT a.id AS i, b.id AS j, 0.5::DOUBLE * coalesce(c.sim, 0) + 0.5::DOUBLE * coalesce(list_dot_product(a.f, b.f)
      / nullif(sqrt(list_dot_product(a.f, a.f) * list_dot_product(b.f, b.f)), 0), 0) AS sim
  FROM fv a JOIN fv b ON a.id <> b.id LEFT JOIN cos c ON c.i = a.id AND c.j = b.id
  WHERE a.id IN (SELECT item_id FROM ratings) AND b.id IN (SELECT item_id FROM ratings))"""


@query("combined_sim", V("ratings tagged_items items", f"{COS_ITEM}, {COMBINED}, " + neighbours_sql("comb", 10)))
def combined_sim(spark, sf):
    ratings = fx.ratings(spark, sf)
    return show_pairs(sm.blended_neighbours(sm.item_cosine(ratings), sm.common(flag_table(spark, sf), ratings), 0.5, 10))


@query("combined_cf", V("ratings tagged_items items", f"{COS_ITEM}, {COMBINED}, {cf_sql('cscores', 'comb')}, {ranked('top', 'cscores', 10)} {TOP} top"))
def combined_cf(spark, sf):
    ratings = materialise(fx.ratings(spark, sf))
    return show(rc.blended_cf(ratings, sm.item_cosine(ratings), flag_table(spark, sf), 0.5, 10))


@query("common_index_join", V("ratings ratings_large", f"""{COS_ITEM}, c1 AS (SELECT i, j, sim FROM cos WHERE i < j),
  c2 AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.rating * b.rating) / (max(na.n) * max(nb.n)) AS sim FROM ratings_large a
    JOIN ratings_large b ON a.user_id = b.user_id AND a.item_id < b.item_id
    JOIN (SELECT item_id, sqrt(sum(rating*rating)) AS n FROM ratings_large GROUP BY 1) na ON na.item_id = a.item_id
    JOIN (SELECT item_id, sqrt(sum(rating*rating)) AS n FROM ratings_large GROUP BY 1) nb ON nb.item_id = b.item_id GROUP BY 1, 2),
  ids AS (SELECT item_id FROM ratings INTERSECT SELECT item_id FROM ratings_large)
  SELECT coalesce(c1.i, c2.i) AS i, coalesce(c1.j, c2.j) AS j, round(0.6::DOUBLE * coalesce(c1.sim, 0) + 0.4::DOUBLE * coalesce(c2.sim, 0), 6) AS sim
  FROM c1 FULL OUTER JOIN c2 ON c1.i = c2.i AND c1.j = c2.j
  WHERE coalesce(c1.i, c2.i) IN (SELECT item_id FROM ids) AND coalesce(c1.j, c2.j) IN (SELECT item_id FROM ids)"""))
def common_index_join(spark, sf):
    few, many = materialise(fx.ratings(spark, sf)), materialise(fx.ratings_large(spark, sf))
    shared = materialise(few.select(F.col("item_id").alias("id")).intersect(many.select(F.col("item_id").alias("id"))))
    a, b = sm.item_cosine(few, shared), sm.item_cosine(many, shared)
    return show_pairs(sm.common_index_join(a, b, 0.6, shared), rank=False)


# --- filters on the hybrid list, cold start, jobs -----------------------------------------------------------------


@query("by_category", V("ratings items", f"""{hybrid_sql(30)}, keep AS (SELECT h.user_id, h.item_id, h.score FROM hybrid h JOIN items i ON i.id = h.item_id
    WHERE i.primary_category = 'red' OR list_contains(i.categories, 'red')), {ranked('top', 'keep', 10)} {TOP} top"""))
def by_category(spark, sf):
    ratings, items = tables = hybrid_tables(spark, sf)
    among = rc.hybrid_items(ratings, items, 30)
    return show(rc.by_category(hybrid_recs(spark, sf, 30, tables), items, "red", 10, among))


@query("by_chain", V("ratings items", f"""{hybrid_sql(30)}, keep AS (SELECT h.user_id, h.item_id, h.score FROM hybrid h JOIN items i ON i.id = h.item_id
    WHERE i.chain = 'Brand#3'), {ranked('top', 'keep', 10)} {TOP} top"""))
def by_chain(spark, sf):
    ratings, items = tables = hybrid_tables(spark, sf)
    among = rc.hybrid_items(ratings, items, 30)
    return show(rc.by_chain(hybrid_recs(spark, sf, 30, tables), items, "Brand#3", 10, among))


INTEREST_LIST = ["red", "economy", "gear", "small", "blue"]


def interests(spark, sf):
    words = F.array(*[F.lit(w) for w in INTEREST_LIST])
    k = F.col("user_id")
    first, second = words[(k % 5).cast("int")], words[((k + 1 + k % 3) % 5).cast("int")]
    wanted = F.when(k % 4 == 0, F.array(first)).otherwise(F.array_distinct(F.array(first, second)))
    return fx.users(spark, sf).select("user_id", wanted.alias("interests"))


@query("cold_start_interests", V("items users", SCORED + f""", w AS (SELECT user_id, ['{"','".join(INTEREST_LIST)}'] AS l FROM users),
  i0 AS (SELECT user_id, l[user_id % 5 + 1] AS a, l[(user_id + 1 + user_id % 3) % 5 + 1] AS b FROM w),
  i1 AS (SELECT user_id, CASE WHEN user_id % 4 = 0 OR a = b THEN [a] ELSE [a, b] END AS xs FROM i0),
  i2 AS (SELECT user_id, len(xs) AS k, unnest(range(len(xs))) AS place, unnest(xs) AS x FROM i1),
  tags AS (SELECT DISTINCT id, popularity_score, unnest(list_append(categories, primary_category)) AS x FROM scored),
  r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(popularity_score, 8) DESC, id) AS r FROM tags),
  m AS (SELECT user_id, r.id AS item_id, place, r.r, popularity_score FROM i2 JOIN r ON r.x = i2.x AND r.r <= greatest(3, 10 // k)),
  f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY place, r) = 1)
  SELECT user_id, item_id, round(popularity_score / 100, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY place, r) AS rank
  FROM f QUALIFY rank <= 10"""))
def cold_start_interests(spark, sf):
    return show(rc.interest_recs(interests(spark, sf), basic_scores(fx.items(spark, sf)), 10))


@query("cold_start")
def cold_start(spark, sf):
    items = materialise(basic_scores(fx.items(spark, sf)))
    ratings = materialise(fx.ratings(spark, sf))
    cold = materialise(rc.cold_users(fx.users(spark, sf), fx.interactions(spark, sf)))
    low_risk = fx.users(spark, sf).filter("risk_tolerance = 'low'")
    some = interests(spark, sf).join(low_risk.select("user_id"), "user_id", "left_semi")
    return show(rc.cold_start(cold, ratings, items, sm.feature_vectors(items), sm.CF_WEIGHT, 10, some))


def listed(spark, sf):
    ratings, items = hybrid_tables(spark, sf)
    sim = materialise(sm.item_cosine(ratings))
    user_recs = materialise(rc.user_cf(ratings, 20))
    item_recs = materialise(rc.item_cf(ratings, 20, sim=sim))
    feature_recs = materialise(rc.blended_cf(ratings, sim, sm.feature_vectors(items), sm.CF_WEIGHT, 20))
    users = fx.users(spark, sf)
    lists = {
        "hybrid": rc.hybrid(user_recs, item_recs, feature_recs, items, users, 10),
        "user_based": user_recs.filter("rank <= 10"), "item_based": item_recs.filter("rank <= 10"),
        "feature_enhanced": feature_recs.filter("rank <= 10"),
    }
    return rc.all_users(lists, items, users, 20), items


def all_lists(spark, sf):
    """The lists of all users for queries that read them more than once, and the items."""
    recs, items = listed(spark, sf)
    return materialise(recs), items


ALL = f"""{hybrid_sql(10)}, trend AS (SELECT id AS item_id, trend_score/100 AS score, row_number() OVER (ORDER BY round(trend_score, 8) DESC, id) AS rank FROM scored),
  stored AS (
    SELECT user_id, item_id, score, rank, 'hybrid' AS recommendation_type FROM hybrid UNION ALL
    SELECT user_id, item_id, score, rank, 'user_based' FROM utop WHERE rank <= 10 UNION ALL
    SELECT user_id, item_id, score, rank, 'item_based' FROM itop WHERE rank <= 10 UNION ALL
    SELECT user_id, item_id, score, rank, 'feature_enhanced' FROM ftop WHERE rank <= 10 UNION ALL
    SELECT c_custkey, item_id, score, rank, 'popular' FROM customer, pop WHERE rank <= 20 UNION ALL
    SELECT c_custkey, item_id, score, rank, 'trending' FROM customer, trend WHERE rank <= 20)"""


@query("all_users_job", V("ratings items", f"{ALL} SELECT user_id, item_id, round(score, 6) AS score, rank, recommendation_type FROM stored"))
def all_users_job(spark, sf):
    recs, _ = listed(spark, sf)  # read once, so the lists are not stored in between
    return recs.select("user_id", "item_id", r6("score"), F.col("rank").cast("long").alias("rank"), "recommendation_type")


def dated(recs):
    """Stored lists with ages that follow from user and rank, some of them stale."""
    minutes = F.pmod(F.col("user_id") * 37 + F.col("rank") * 11, F.lit(1440))
    return recs.withColumn("created_at", F.lit("2024-06-10").cast("timestamp") - F.make_interval(mins=minutes.cast("int")))


@query("fresh_recs", V("ratings items", f"""{COS_ITEM}, {cf_sql('iscores', 'cos')}, {ranked('top', 'iscores', 10)},
  d AS (SELECT *, TIMESTAMP '2024-06-10' - to_minutes(CAST((user_id * 37 + rank * 11) % 1440 AS INT)) AS created_at FROM top)
  SELECT d.user_id, d.item_id, round(d.score, 6) AS score, d.rank, d.created_at, i.name, i.chain FROM d JOIN items i ON i.id = d.item_id
  WHERE d.created_at > TIMESTAMP '2024-06-09 12:00:00' AND (i.primary_category = 'small' OR list_contains(i.categories, 'small'))"""))
def fresh_recs(spark, sf):
    stored = dated(rc.item_cf(materialise(fx.ratings(spark, sf))))
    out = rc.fresh_recs(stored, fx.items(spark, sf), F.lit("2024-06-10").cast("timestamp"), category="small")
    return out.select(
        "user_id", "item_id", r6("score"), F.col("rank").cast("long").alias("rank"), "created_at", "name", "chain")


@query("replace_recs", V("ratings users", f"""{COS_ITEM}, {cf_sql('iscores', 'cos')}, {ranked('top', 'iscores', 10)},
  low AS (SELECT user_id FROM users WHERE risk_tolerance = 'low')
  SELECT user_id, item_id, 6 - rank AS rank, 'item_based' AS recommendation_type FROM top WHERE user_id IN (SELECT user_id FROM low) AND rank <= 5 UNION ALL
  SELECT user_id, item_id, rank, 'item_based' FROM top WHERE user_id NOT IN (SELECT user_id FROM low) UNION ALL
  SELECT user_id, item_id, rank, 'user_based' FROM top"""))
def replace_recs(spark, sf):
    top = materialise(rc.item_cf(fx.ratings(spark, sf)).select("user_id", "item_id", F.col("rank").cast("long").alias("rank")))
    item_lists = top.withColumn("recommendation_type", F.lit("item_based"))
    stored = item_lists.unionByName(top.withColumn("recommendation_type", F.lit("user_based")))
    low_risk = fx.users(spark, sf).filter("risk_tolerance = 'low'").select("user_id")
    new = item_lists.join(low_risk, "user_id", "left_semi").filter("rank <= 5").withColumn("rank", 6 - F.col("rank"))
    return rc.replace_recs(stored, new.select(*stored.columns))


@query("rec_overlap", V("ratings items", f"""{COS_ITEM}, {COS_USER}, {NUMERIC}, {ENHANCED}, {cf_sql('iscores', 'cos')}, {USER_SCORES}, {cf_sql('fscores', 'esim')},
  {ranked('itop', 'iscores', 10)}, {ranked('utop', 'uscores', 10)}, {ranked('ftop', 'fscores', 10)},
  m AS (SELECT 'item' AS m, user_id, item_id FROM itop UNION ALL SELECT 'user', user_id, item_id FROM utop UNION ALL SELECT 'feature', user_id, item_id FROM ftop)
  SELECT a.user_id, a.m AS method_a, b.m AS method_b, count(*) AS shared FROM m a JOIN m b ON a.user_id = b.user_id AND a.item_id = b.item_id AND a.m < b.m GROUP BY 1, 2, 3"""))
def rec_overlap(spark, sf):
    recs, _ = all_lists(spark, sf)
    names = {"item_based": "item", "user_based": "user", "feature_enhanced": "feature"}
    some = recs.filter(F.col("recommendation_type").isin(list(names))).withColumn(
        "method", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("recommendation_type")))
    return jn.rec_overlap(some)


@query("rec_report", V("ratings items", f"""{ALL}, l AS (SELECT DISTINCT user_id, recommendation_type AS t FROM stored),
  u AS (SELECT 'user' AS section, CAST(user_id AS VARCHAR) AS name, count(*) AS n FROM l GROUP BY user_id ORDER BY n DESC, name LIMIT 10),
  c AS (SELECT item_id, count(*) AS n FROM stored GROUP BY 1),
  i AS (SELECT 'item' AS section, CAST(item_id AS VARCHAR) AS name, n FROM c ORDER BY n DESC, name LIMIT 20)
  SELECT * FROM u UNION ALL SELECT * FROM i UNION ALL
  SELECT 'category', primary_category, CAST(sum(n) AS BIGINT) FROM c JOIN items ON id = item_id GROUP BY 2 UNION ALL
  SELECT 'type', t, count(*) FROM l GROUP BY 2"""))
def rec_report(spark, sf):
    recs, items = all_lists(spark, sf)
    return ag.rec_report(recs, items)


# --- sampling and latent factors ----------------------------------------------------------------------------------


@query("weighted_sample", V("ratings_large items", SCORED + """, k AS (SELECT user_id, item_id,
    ln((CAST('0x' || substr(md5(user_id || ':' || item_id || ':42'), 1, 12) AS BIGINT) + 1)::DOUBLE / (16::DOUBLE ** 12)) / greatest(popularity_score, 0.001) AS key
  FROM ratings_large JOIN scored ON id = item_id)
  SELECT user_id, item_id, round(key, 9) AS key, row_number() OVER (PARTITION BY user_id ORDER BY key DESC, item_id) AS rank FROM k QUALIFY rank <= 5"""))
def weighted_sample(spark, sf):
    items = basic_scores(fx.items(spark, sf)).select(F.col("id").alias("item_id"), F.col("popularity_score").alias("weight"))
    pairs = fx.ratings_large(spark, sf).select("user_id", "item_id").join(items, "item_id")
    return sa.weighted_sample(pairs, 5).select(
        "user_id", "item_id", F.round("key", 9).alias("key"), F.col("rank").cast("long").alias("rank"))


@query("negative_sampling", V("ratings_large", """n AS (SELECT p_partkey AS item_id,
    row_number() OVER (ORDER BY md5(p_partkey || ':42')) - 1 AS no, count(*) OVER () AS size FROM part),
  u AS (SELECT user_id, count(*) AS pos, CAST('0x' || substr(md5(user_id || ':42'), 1, 12) AS BIGINT) AS h FROM ratings_large GROUP BY 1),
  w AS (SELECT user_id, item_id, pos, (no - h % size + size) % size AS t FROM u, n WHERE (no - h % size + size) % size < least(pos * 5, size)),
  left_over AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS k FROM w ANTI JOIN ratings_large USING (user_id, item_id))
  SELECT user_id, item_id, 0.0::DOUBLE AS label FROM left_over WHERE k < 4 * pos
  UNION ALL SELECT user_id, item_id, rating / 5 FROM ratings_large"""))
def negative_sampling(spark, sf):
    ratings = materialise(fx.ratings_large(spark, sf))
    return sa.training_samples(ratings, fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id")))


@query("latent_topn")
def latent_topn(spark, sf):
    ratings = materialise(fx.ratings_large(spark, sf))
    return show(la.recommend(la.fit_factors(ratings), ratings, 10))


@query("latent_rerank")
def latent_rerank(spark, sf):
    ratings = materialise(fx.ratings(spark, sf))
    catalog = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    model = la.fit_factors(ratings)
    classifier = la.fit_reranker(ratings, catalog, model)
    return show(la.rerank_all(ratings, catalog, model, classifier, 10))
