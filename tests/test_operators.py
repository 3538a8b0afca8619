"""Operators on literal frames with hand-computed answers, and the documented deviations."""

import datetime as dt
import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

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
from marketloom.operators import series as se
from marketloom.plans import evaluation as ev
from marketloom.plans import recommend as rc
from marketloom.plans import signals as sg
from marketloom.sources import files as fi
from marketloom.sources import stores as st


def column(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def test_ranking_metrics_of_one_list(spark):
    truth = spark.createDataFrame([(1, f"item{i}") for i in (1, 2, 3)], "user_id int, item_id string")
    pred = spark.createDataFrame(
        [(1, f"item{i}", n) for n, i in enumerate((1, 4, 2, 5, 6), 1)], "user_id int, item_id string, rank int")
    row = ev.user_metrics(truth, pred, 5).first()
    assert row["precision"] == pytest.approx(0.4)
    assert row["recall"] == pytest.approx(2 / 3)
    assert row["f1"] == pytest.approx(0.5)
    assert row["mrr"] == 1 and row["hit_ratio"] == 1
    assert row["ndcg"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2))


def test_users_without_predictions_are_left_out(spark):
    truth = spark.createDataFrame([(1, 1), (2, 1)], "user_id int, item_id int")
    pred = spark.createDataFrame([(1, 1, 1), (3, 1, 1)], "user_id int, item_id int, rank int")
    assert ev.evaluate(truth, pred).first()["num_users"] == 1


def test_fill_missing_strategies(spark):
    rows = [(1, 1.0, "A", dt.datetime(2024, 1, 1)), (2, 2.0, "B", dt.datetime(2024, 1, 2)), (3, None, None, None),
            (4, 4.0, "B", dt.datetime(2024, 1, 4)), (5, 5.0, "C", dt.datetime(2024, 1, 5))]
    df = spark.createDataFrame(rows, "n int, numeric double, categorical string, date timestamp")
    auto = cl.fill_missing(df, order=["n"], bucket=F.col("n"))
    got = auto.filter("n = 3").first()
    assert (got["numeric"], got["categorical"], got["date"]) == (3.0, "B", dt.datetime(2024, 1, 2))
    for strategy, want in (("mean", 3.0), ("min", 1.0), ("max", 5.0), ("zero", 0.0), ("interpolate", 3.0), ("bfill", 4.0)):
        out = cl.fill_missing(df.select("n", "numeric"), {"numeric": strategy}, order=["n"], bucket=F.col("n"))
        assert out.filter("n = 3").first()["numeric"] == want
    assert cl.fill_missing(df.select("n", "numeric"), {"numeric": "drop"}).count() == 4
    custom = cl.fill_missing(df.select("n", "categorical"), {"categorical": "custom"}, {"categorical": "Z"})
    assert custom.filter("n = 3").first()["categorical"] == "Z"


def test_normalize_values(spark):
    df = spark.createDataFrame([(v, o) for v, o in zip((100., 200., 300., 400., 500.), (10., 20., 1000., 30., 40.))],
                               "value double, outlier double")
    assert column(cl.normalize(df, "value"), "value") == pytest.approx([0, .25, .5, .75, 1])
    assert column(cl.normalize(df, "value", "robust"), "value") == pytest.approx([-1, -.5, 0, .5, 1])
    assert column(cl.normalize(df, "value", "quantile"), "value", "outlier") is not None
    clipped = cl.normalize(df, "outlier", "minmax", handle_outliers=True)
    assert max(column(clipped, "outlier")) == 1 and sorted(column(clipped, "outlier"))[3] == pytest.approx(30 / 60)
    flat = spark.createDataFrame([(7.0,), (7.0,)], "v double")
    for method, want in (("minmax", 0), ("zscore", 0), ("robust", 0)):
        assert column(cl.normalize(flat, "v", method), "v") == [want, want]


def test_outliers_fall_back_to_zscore_when_mad_is_zero(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(50.0,)], "v double")
    assert column(cl.outliers(df, "v", "modified_zscore", 3.0), "v") == [50.0]
    assert column(cl.outliers(df, "v", "iqr"), "v") == [50.0]


def test_filters_treat_nulls_like_data_frames(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b.c")], "n int, s string")
    assert column(fl.filter_dataframe(df, {"s": "a"}, {"s": "!="}), "n") == [2, 3]
    assert column(fl.filter_dataframe(df, {"s": ["a"]}, {"s": "not in"}), "n") == [2, 3]
    assert column(fl.filter_dataframe(df, {"s": [".c"]}, {"s": "contains"}), "n") == [3]
    assert column(fl.filter_dataframe(df, {"s": "^a"}, {"s": "contains"}), "n") == [1]
    assert fl.filter_dataframe(df, {"n": 1}, {"n": "startswith"}).count() == 3
    with pytest.raises(ValueError):
        fl.catalog_query(df, sort_by="n")


def test_merge_checks_cardinality(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
    b = spark.createDataFrame([(1.0, "z")], "id double, v string")
    with pytest.raises(ValueError):
        jn.merge_dataframes(a, b, ["id"], validate="1:1")
    out = jn.merge_dataframes(a, b, ["id"], validate="m:1", indicator=True)
    assert out.columns == ["id", "v_x", "v_y", "_merge"] and out.count() == 2
    text = jn.merge_dataframes(a, spark.createDataFrame([("1", 5)], "id string, w int"), ["id"])
    assert text.schema["id"].dataType.simpleString() == "string" and text.count() == 2


CHAINS = [({"solana": "x", "ethereum": "y"}, "ethereum"), ({"BSC": "x"}, "binance-smart-chain"),
          ({"Matic": "x"}, "polygon-pos"), ({"near": "x", "other": "y"}, "near"), ({}, "unknown"), (None, "unknown"),
          ({"ada": "1", "erc20": "2"}, "ethereum")]


def test_primary_chain(spark):
    texts = spark.createDataFrame([(n, None if p is None else json.dumps(p)) for n, (p, _) in enumerate(CHAINS)], "n int, t string")
    df = texts.select("n", F.from_json("t", "map<string,string>").alias("p"))  # keeps the key order
    assert column(df.select("n", ca.primary_chain(F.col("p")).alias("c")), "c", "n") == [c for _, c in CHAINS]


CATEGORIES = [(["Gaming", "DeFi"], "defi"), (["Decentralized-Finance"], "defi"), (["Dog Money"], "meme"),
              (["Something Odd"], "something odd"), ([], "unknown"), (None, "unknown"), ([""], "unknown")]


def test_primary_category(spark):
    df = spark.createDataFrame([(n, p) for n, (p, _) in enumerate(CATEGORIES)], "n int, p array<string>")
    assert column(df.select("n", ca.primary_category(F.col("p")).alias("c")), "c", "n") == [c for _, c in CATEGORIES]


def test_json_error_modes(spark):
    df = spark.createDataFrame([(1, '["a"]'), (2, '[""b""]'), (3, "[oops"), (4, None), (5, '{"a":1}')], "n int, categories string")
    assert column(js.parse_json_columns(df, ["categories"]), "categories", "n") == [["a"], ["b"], [], [], []]
    kept = column(js.parse_json_columns(df, ["categories"], "null"), "categories", "n")
    assert kept[2] is None and kept[3] == []
    with pytest.raises(Exception, match="unreadable JSON"):
        js.parse_json_columns(df, ["categories"], "raise").collect()


def test_flatten_struct(spark):
    df = spark.createDataFrame([(1, ((2, "x"), 3))], "id int, s struct<a: struct<b: int, c: string>, d: int>")
    assert js.flatten_struct(df, "s").columns == ["id", "a.b", "a.c", "d"]


def test_time_features_of_month_ends(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 12, 31, 5),), (dt.datetime(2024, 2, 29),), (dt.datetime(2024, 4, 1),)], "t timestamp")
    out = tf.time_features(df, "t", ["is_year_end", "is_month_end", "is_quarter_start", "day_of_week", "week_of_year"]).orderBy("t").toPandas()
    assert out.t_is_year_end.tolist() == [1, 0, 0] and out.t_is_month_end.tolist() == [1, 1, 0]
    assert out.t_is_quarter_start.tolist() == [0, 0, 1] and out.t_day_of_week.tolist() == [6, 3, 0]


def test_anonymised_column_is_kept(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "s string")
    assert column(pv.anonymize(df, "s", "mask"), "s") == ["ab**ef", "***", None]
    assert column(pv.anonymize(df, "s", "obfuscate"), "s") == ["a_5", "a_2", None]
    assert pv.anonymize(df, "s", "hash", keep_original=True).columns == ["s", "s_anon"]


def test_binary_codes_do_not_collide(spark):
    df = spark.createDataFrame([(v,) for v in "abcde"], "c string")
    out = en.encode_categorical(df, ["c"], "binary", drop_original=False)
    assert [c for c in out.columns if "bin" in c] == ["c_bin_0", "c_bin_1", "c_bin_2"]
    assert len({tuple(r)[1:] for r in out.collect()}) == 5


def test_svd_reconstructs_a_rank_one_matrix(spark):
    w = spark.createDataFrame([(d, t, d * (n + 1.0)) for d in (1, 2, 3) for n, t in enumerate("xyz")], "d int, term string, weight double")
    out = en.text_components(w, "d", 2).orderBy("d").toPandas()
    assert (out.text_feature_1 / out.d).round(9).nunique() == 1 and out.text_feature_2.abs().max() < 1e-6


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 70000, 1.5)], "a long, b long, c long, d double")
    out, chosen = cv.narrow_types(df)
    assert chosen == {"a": "tinyint", "b": "smallint", "c": "int", "d": "float"}
    assert dict(out.dtypes)["b"] == "smallint"


def test_correlation_needs_enough_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0)], "a double, b double")
    assert ag.correlation(df).first()["corr"] == pytest.approx(1)
    assert ag.correlation(df, min_periods=3).first()["corr"] is None


def test_custom_time_window(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), float(h)) for h in range(8)], "t timestamp, v double")
    out = ag.time_windows(df, "t", "4H", agg={"v": ["sum"]}).orderBy("time_window")
    assert column(out, "v_sum") == [6.0, 22.0]


def test_scores_without_dates_and_with_zero_percentile(spark):
    items = spark.createDataFrame([(1, 0.0, 0, 0, 0, 0, None)], "id int, market_cap double, reddit_subscribers int, "
                                  "twitter_followers int, github_stars int, github_forks int, genesis_date date")
    assert sc.developer_activity(items).first()["developer_activity_score"] == 0
    assert sc.social_engagement(items).first()["social_engagement_score"] == 50
    assert sc.maturity(items, F.lit("2024-01-01").cast("date")).first()["maturity_score"] == 50


def series(spark, prices, volume=None):
    n = len(prices)
    pdf = pd.DataFrame({"project_id": "a", "timestamp": pd.date_range("2024-01-01", periods=n, freq="h"), "price": prices,
                        "volume": volume or [1.0] * n, "market_cap": [1.0] * n})
    return spark.createDataFrame(pdf)


def test_one_hour_change_uses_the_row_before(spark):
    df = series(spark, [100.0, 110.0, 99.0])
    assert column(se.price_change(df, [1, 5]).orderBy("timestamp"), "change_1") == pytest.approx([0, 10, -10])


def test_signal_on_a_falling_series(spark):
    prices = [200.0 - i for i in range(80)]
    row = sg.trading_signals(series(spark, prices, [1.0] * 79 + [100.0])).first()
    assert row["rsi_label"] == "oversold" and row["action"] == "buy" and row["reason"].startswith("RSI indicates oversold")
    assert row["stop_loss"] == pytest.approx(121 * 0.95)
    held = {r["risk_tolerance"]: r["action"] for r in sg.by_risk(sg.trading_signals(series(spark, prices, [1.0] * 79 + [100.0]))).collect()}
    assert held["low"] == "hold" and held["medium"] == "buy"
    few = sg.trading_signals(series(spark, prices[:30])).first()
    assert few["action"] == "hold" and few["confidence"] == 0.5


def test_high_risk_users_follow_momentum(spark):
    flat = [100.0 + 0.01 * (i % 2) for i in range(60)]
    rows = {r["risk_tolerance"]: r["action"] for r in sg.by_risk(sg.trading_signals(series(spark, flat))).collect()}
    assert rows["medium"] == "hold" and rows["high"] in ("buy", "sell")


def test_market_events_of_a_jump(spark):
    out = se.market_events(series(spark, [100.0, 101, 100, 101, 100, 101, 100, 101, 150, 100, 101, 100]), k=1.5).orderBy("timestamp").toPandas()
    assert out.pump.iloc[8] == 1 and out.local_peak.iloc[8] == 1 and out.event_start.iloc[0] == 0
    assert (out.event_duration[out.event_type == 0] == 0).all()


def test_item_documents(spark, tmp_path):
    (tmp_path / "alpha.json").write_text(json.dumps(
        {"community_data": {"reddit_subscribers": 5, "twitter_followers": "x"}, "categories": ["A"], "description": {"en": "hi"}}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "beta", "market_cap_rank": 3, "platforms": {"sol": "1"}}))
    rows = {r["id"]: r for r in fi.load_item_details(spark, str(tmp_path)).collect()}
    assert set(rows) == {"alpha", "beta"}
    assert rows["alpha"]["reddit_subscribers"] == 5 and rows["alpha"]["twitter_followers"] == 0
    assert rows["alpha"]["market_cap_rank"] == 9999 and rows["beta"]["sentiment_positive"] == 50.0


def test_file_names_and_csv_rules(spark, tmp_path):
    names = spark.createDataFrame([("a_20240131_235959.csv",), ("b_2024-01-31.json",), ("none.txt",)], "f string")
    got = column(names.select(fi.file_timestamp(F.col("f")).alias("t")), "t")
    assert got == [dt.datetime(2024, 1, 31, 23, 59, 59), dt.datetime(2024, 1, 31), None]
    with pytest.raises(ValueError):
        fi.read_csv(spark, "x.zip")
    (tmp_path / "t.csv").write_text("id,created_at,n\n1,2024-01-02 03:04:05,7\n2,bad,8\n")
    df = fi.read_csv(spark, str(tmp_path / "t.csv"), "id int, created_at string, n int")
    assert column(df, "created_at", "id") == [dt.datetime(2024, 1, 2, 3, 4, 5), None]
    assert fi.latest_file(fi.list_files(spark, str(tmp_path), suffix=".csv")).first()["name"] == "t.csv"


def test_chart_rows_align_on_price_times(spark):
    df = spark.createDataFrame(
        [("a", [[1000.0, 1.0], [2000.0, 2.0], [2000.0, 9.0]], [[2000.0, 20.0]], [[1000.0, 10.0], [3000.0, 30.0]])],
        "project_id string, prices array<array<double>>, total_volumes array<array<double>>, market_caps array<array<double>>")
    got = [tuple(r)[2:] for r in st.chart_rows(df).orderBy("timestamp").collect()]
    assert got == [(1.0, None, 10.0), (2.0, 20.0, None)]


def test_hybrid_gives_popular_items_to_idle_users(spark):
    items = spark.createDataFrame([(i, float(i), 50.0) for i in range(1, 6)], "id long, popularity_score double, trend_score double")
    recs = spark.createDataFrame([(1, 2, 4.0, 1)], "user_id long, item_id long, score double, rank int")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    out = rc.hybrid(recs, recs, None, items, users, 2).collect()
    assert [r.item_id for r in out if r.user_id == 2] == [5, 4]
    mine = [r for r in out if r.user_id == 1]
    assert len(mine) == 1 and mine[0].score == pytest.approx(0.2 * 4 / 5 + 0.3 * 2 / 5 + 0.3)


def test_hybrid_feature_scale_option(spark):
    items = spark.createDataFrame([(2, 2.0, 50.0)], "id long, popularity_score double, trend_score double")
    recs = spark.createDataFrame([(1, 2, 5.0, 1)], "user_id long, item_id long, score double, rank int")
    users = spark.createDataFrame([(1,)], "user_id long")
    raw = rc.hybrid(recs, recs, recs, items, users, 1).first().score
    scaled = rc.hybrid(recs, recs, recs, items, users, 1, feature_scale=5.0).first().score
    assert raw - scaled == pytest.approx(0.8 * 4)


def test_item_details_of_unknown_items(spark):
    recs = spark.createDataFrame([(1, 9, 0.5)], "user_id int, item_id int, score double")
    items = spark.createDataFrame([(1, "n", "s", "c", "p")], "id int, name string, symbol string, chain string, primary_category string")
    row = rc.attach_items(recs, items, ["name", "symbol", "chain", "primary_category"]).first()
    assert (row["name"], row["symbol"], row["chain"], row["primary_category"]) == ("9", "", "unknown", "unknown")


def test_term_weights_shuffle_no_words_outside_the_vocabulary(spark, monkeypatch):
    texts = [(i, " ".join(f"word{(i * 7 + j * j) % 23} the" for j in range(i % 9 + 1))) for i in range(40)]
    stored = []
    monkeypatch.setattr(en, "materialise", lambda df: stored.append(df.cache()) or stored[-1])
    docs = spark.createDataFrame(texts, "k long, t string")
    whole = {(r.k, r.term): round(r.weight, 9) for r in en.tf_idf(docs, "k", "t", max_terms=9).collect()}
    assert len(stored) == 2 and stored[0].count() == 9 and stored[1].count() == len(whole)
    lines = [(k, w) for k, t in texts for w in t.split()]  # the same documents, a row for each word
    split = en.tf_idf(spark.createDataFrame(lines, "k long, t string"), "k", "t", max_terms=9, max_df=1.0)
    assert {(r.k, r.term) for r in split.collect()} == set(whole)
