"""Hold-out evaluation."""

from pyspark.sql import functions as F

from marketloom import fixtures as fx
from marketloom.operators.scores import basic_scores
from marketloom.plans import evaluation as ev
from marketloom.plans import recommend as rc
from marketloom.plans import similarity as sm
from marketloom.registry.base import query, r6
from marketloom.registry.recs import COS_ITEM, ENHANCED, NUMERIC, cf_sql, hybrid_sql, ranked
from marketloom.session import materialise

V = fx.with_views

SHARE = 0.5
BOUND = f"{int(SHARE * 16**8):08x}"
SPLIT = f"""all_ratings AS (SELECT user_id, item_id, CAST(max(weight) AS DOUBLE) AS rating FROM interactions GROUP BY 1, 2),
  marked AS (SELECT user_id, item_id, rating,
      substr(md5(user_id || ':42'), 1, 8) < '{BOUND}' AND count(*) OVER (PARTITION BY user_id) >= 5
      AND row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || ':' || item_id || ':42'), item_id)
          <= greatest(1, floor(0.2::DOUBLE * count(*) OVER (PARTITION BY user_id) + 1e-9)) AS is_test FROM all_ratings),
  ratings AS (SELECT user_id, item_id, rating FROM marked WHERE NOT is_test),
  truth AS (SELECT user_id, item_id FROM marked WHERE is_test)"""


def metrics_sql(pred: str, k: int = 10, name: str = "um") -> str:
    """Per-user metrics of ``pred(method, user_id, item_id, rank)``."""
    return f"""nt AS (SELECT user_id, count(*) AS nt FROM truth GROUP BY 1),
  pk AS (SELECT p.method, p.user_id, p.rank, t.item_id IS NOT NULL AS hit FROM {pred} p LEFT JOIN truth t ON t.user_id = p.user_id AND t.item_id = p.item_id WHERE p.rank <= {k}),
  ag AS (SELECT method, user_id, count(*) AS np, sum(CAST(hit AS INT)) AS h, min(CASE WHEN hit THEN rank END) AS f,
      sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM pk GROUP BY 1, 2),
  {name} AS (SELECT method, ag.user_id, h / least({k}, np)::DOUBLE AS "precision", h / nt::DOUBLE AS recall,
      CASE WHEN h > 0 THEN 2 * (h / least({k}, np)::DOUBLE) * (h / nt::DOUBLE) / (h / least({k}, np)::DOUBLE + h / nt::DOUBLE) ELSE 0 END AS f1,
      coalesce(1.0::DOUBLE / f, 0) AS mrr, dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {k} + 1) r(i) WHERE i <= least(nt, {k})) AS ndcg,
      CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_ratio FROM ag JOIN nt ON nt.user_id = ag.user_id)"""


ROUNDED = ", ".join(f'round("{m}", 6) AS "{m}"' for m in ev.METRICS)
AVERAGED = ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in ev.METRICS) + ", count(*) AS num_users"


def halves(spark, sf):
    return ev.split(materialise(rc.by_user(fx.ratings(spark, sf))), share=SHARE)


@query("holdout_split", V("interactions", f"{SPLIT} SELECT user_id, item_id, rating, is_test FROM marked"))
def holdout_split(spark, sf):
    return ev.holdout_split(fx.ratings(spark, sf), share=SHARE)


ITEM_PRED = f"{SPLIT}, {COS_ITEM}, {cf_sql('iscores', 'cos')}, {ranked('top', 'iscores', 10)}, pred AS (SELECT 'item' AS method, * FROM top)"


@query("user_metrics", V("interactions", f"{ITEM_PRED}, {metrics_sql('pred')} SELECT user_id, {ROUNDED} FROM um"))
def user_metrics(spark, sf):
    train, truth = halves(spark, sf)
    return ev.user_metrics(truth, rc.item_cf(train)).select("user_id", *[r6(m) for m in ev.METRICS])


@query("evaluate", V("interactions", f"{ITEM_PRED}, {metrics_sql('pred')} SELECT {AVERAGED} FROM um"))
def evaluate(spark, sf):
    train, truth = halves(spark, sf)
    return ev.evaluate(truth, rc.item_cf(train)).select(*[r6(m) for m in ev.METRICS], "num_users")


@query("model_comparison", V("interactions items", f"""{SPLIT}, {hybrid_sql(10)},
  pred AS (SELECT 'user_based_cf' AS method, user_id, item_id, rank FROM utop UNION ALL SELECT 'item_based_cf', user_id, item_id, rank FROM itop
    UNION ALL SELECT 'feature_enhanced_cf', user_id, item_id, rank FROM ftop UNION ALL SELECT 'hybrid', user_id, item_id, rank FROM hybrid),
  {metrics_sql('pred')} SELECT method, {AVERAGED} FROM um GROUP BY method"""))
def model_comparison(spark, sf):
    train, truth = halves(spark, sf)
    items = materialise(basic_scores(fx.items(spark, sf)))
    methods = ev.standard_methods(train, items, fx.users(spark, sf))
    return ev.compare_models(truth, methods).select("method", *[r6(m) for m in ev.METRICS], "num_users")


@query("feature_cf_eval", V("interactions items", f"""{SPLIT}, five AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM truth) ORDER BY md5(user_id || ':7') LIMIT 5),
  {COS_ITEM}, {NUMERIC}, {ENHANCED}, {cf_sql('fscores', 'esim')}, {ranked('top', 'fscores', 10)},
  pred AS (SELECT 'f' AS method, * FROM top WHERE user_id IN (SELECT user_id FROM five)), {metrics_sql('pred')}
  SELECT round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM um"""))
def feature_cf_eval(spark, sf):
    train, truth = halves(spark, sf)
    items = materialise(fx.items(spark, sf))
    five = materialise(truth.select("user_id").distinct().orderBy(ev.digest("user_id", seed=7)).limit(5))
    recs = rc.blended_cf(train, sm.item_cosine(train), sm.feature_vectors(items), sm.CF_WEIGHT, 10, only=five)
    return ev.evaluate(truth, recs).select(*[r6(m) for m in ("precision", "recall", "f1")])


ITEM_TOP = f"{COS_ITEM}, {cf_sql('iscores', 'cos')}, {ranked('top', 'iscores', 10)}"
POP = "pop AS (SELECT id AS item_id, ln(1 + market_cap) AS popularity FROM items)"


def popularity(spark, sf):
    return fx.items(spark, sf).select(
        F.col("id").alias("item_id"), F.log1p("market_cap").alias("popularity"))


@query("diversity", V("ratings items", f"""{ITEM_TOP} SELECT user_id, round(CASE WHEN count(i.id) > 1 THEN count(DISTINCT i.chain)::DOUBLE / count(i.id) ELSE 0 END, 6) AS diversity
  FROM top LEFT JOIN items i ON i.id = item_id GROUP BY 1"""))
def diversity(spark, sf):
    items = fx.items(spark, sf)
    return ev.diversity(rc.item_cf(materialise(fx.ratings(spark, sf))), items, "chain").withColumn("diversity", r6("diversity"))


@query("novelty", V("ratings items", f"""{ITEM_TOP}, {POP} SELECT user_id, round(coalesce(avg(1 / greatest(popularity, 1e-6)), 0), 6) AS novelty
  FROM top LEFT JOIN pop ON pop.item_id = top.item_id GROUP BY 1"""))
def novelty(spark, sf):
    return ev.novelty(rc.item_cf(materialise(fx.ratings(spark, sf))), popularity(spark, sf)).withColumn("novelty", r6("novelty"))


@query("coverage", V("ratings items", f"{ITEM_TOP} SELECT round(count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM items), 6) AS coverage FROM top"))
def coverage(spark, sf):
    return ev.coverage(rc.item_cf(materialise(fx.ratings(spark, sf))), fx.items(spark, sf)).select(r6("coverage"))


@query("serendipity", V("ratings items", f"""{ITEM_TOP}, {POP}, s AS (SELECT user_id, avg(1 - popularity / (SELECT max(popularity) FROM pop)) AS s
  FROM top JOIN pop ON pop.item_id = top.item_id GROUP BY 1) SELECT round(avg(s), 6) AS serendipity FROM s"""))
def serendipity(spark, sf):
    ratings = fx.ratings(spark, sf)
    return ev.serendipity(rc.item_cf(ratings), ratings, popularity(spark, sf)).select(r6("serendipity"))


@query("user_cold_start")
def user_cold_start(spark, sf):
    items = materialise(basic_scores(fx.items(spark, sf)))
    return ev.user_cold_start(materialise(fx.ratings(spark, sf)), items).select(
        *[r6(m) for m in ev.METRICS], "num_users")


@query("item_cold_start")
def item_cold_start(spark, sf):
    items = materialise(fx.items(spark, sf))
    return ev.item_cold_start(
        materialise(fx.ratings(spark, sf)), items, numeric=["market_cap", "total_volume", "current_price"])
