"""Trading signals for all series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.joins import portfolio_items, top_by_market_cap
from marketloom.operators.scale import salted_join, top_k
from marketloom.operators.series import latest_rows, technical_indicators

# Reason texts of the signals.
OVERSOLD = "RSI indicates oversold condition ("
CROSS_UP = "MACD shows bullish crossover from negative territory"
DIP = "Price dip with recovery"
MANY_BUY = "Multiple technical indicators suggest buying opportunity"
OVERBOUGHT = "RSI indicates overbought condition ("
CROSS_DOWN = "MACD shows bearish crossover from positive territory"
REVERSAL = "Sharp price increase followed by reversal"
MANY_SELL = "Multiple technical indicators suggest selling opportunity"
NO_SIGNAL = "No clear signals detected"
TONED_DOWN = ") adjusted to HOLD due to your conservative risk profile"
ORIGINAL = "Original signal ("
MOMENTUM_BUY = "Momentum trending positive - opportunistic buy for aggressive risk profile"
MOMENTUM_SELL = "Momentum trending negative - opportunistic sell for aggressive risk profile"

HISTORY_ROWS = 168
WEEK_ROWS = 168
MIN_ROWS = 50
REC_ROWS = 24


def _fixed(c: Column) -> Column:
    return F.format_string("%.2f", c)


def latest_state(prices: DataFrame, keys: Sequence[str] = ("project_id",), history: int = HISTORY_ROWS) -> DataFrame:
    """One row per series: last price, indicators, changes over 1, 24 and 168 rows, volume spike.

    Only the newest ``history`` rows per key enter the indicators, and one more row the change over 168 rows, so a key is
    bounded before any window runs.
    """
    keys = list(keys)
    newest = latest_rows(prices, keys, "timestamp", max(history, WEEK_ROWS + 1))
    week_ago = F.max(F.when(F.col("recency") == WEEK_ROWS + 1, F.col("price"))).over(Window.partitionBy(*keys))
    recent = newest.withColumn("_week_ago", week_ago).filter(F.col("recency") <= history).drop("recency")
    ind = technical_indicators(recent, keys)
    last = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    base = Window.partitionBy(*keys).orderBy("pos")
    p, v = F.col("price"), F.col("volume")

    def change(h: int) -> Column:
        old = F.col("_week_ago") if h == WEEK_ROWS else F.lag(p, h).over(base)
        return F.coalesce((p - old) / F.nullif(old, F.lit(0.0)) * 100, F.lit(0.0))

    before = base.rowsBetween(-23, -1)
    mean = F.when(F.count(v).over(before) >= 23, F.nullif(F.avg(v).over(before), F.lit(0.0)))
    rows = ind.withColumns(
        {
            "change_1h": change(1), "change_24h": change(24), "change_7d": change(WEEK_ROWS),
            "volume_change": F.coalesce((v - mean) / mean * 100, F.lit(0.0)),
            "n_rows": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            "_r": F.row_number().over(last),
        }
    )
    return rows.filter("_r = 1").drop("_r", "pos", "_week_ago").withColumn("spike", F.col("volume_change") > 50)


def determine_signal(state: DataFrame) -> DataFrame:
    """Labels, action, reason, target and stop (G1). The MACD signal line and its label are kept apart."""
    rsi, macd, line = F.col("rsi_14"), F.col("macd"), F.col("macd_signal")
    d1, d24, d7, price = F.col("change_1h"), F.col("change_24h"), F.col("change_7d"), F.col("price")
    enough = F.col("n_rows") >= MIN_ROWS
    yes = lambda c: F.coalesce(c, F.lit(False))
    label = lambda c, a, b: F.when(enough, F.when(yes(c), a).otherwise(b))
    labelled = state.withColumns(
        {
            "ma_label": label(F.col("sma_20") > F.col("sma_50"), "bullish", "bearish"),
            "rsi_label": F.when(enough, F.when(rsi < 30, "oversold").when(rsi > 70, "overbought").otherwise("neutral")),
            "macd_label": label(macd > line, "bullish", "bearish"),
            "volume_label": label(F.col("spike"), "high", "normal"),
            "momentum_label": label(d24 > 0, "positive", "negative"),
        }
    )
    buy = yes(enough & (
        yes((rsi < 40) & (macd > line)) | yes((d24 < -10) & (d1 > 2)) | yes((rsi < 30) & F.col("spike"))))
    sell = yes(enough & (
        yes((rsi > 70) & (macd < line)) | yes((d24 > 15) & (d1 < -1)) | yes((rsi > 70) & (d7 > 30))))
    moves = F.concat(F.lit(" (24h: "), _fixed(d24), F.lit("%, 1h: "), _fixed(d1), F.lit("%)"))
    buy_reason = (
        F.when(rsi < 30, F.concat(F.lit(OVERSOLD), _fixed(rsi), F.lit(")")))
        .when((macd > line) & (line < 0), CROSS_UP)
        .when(d24 < -10, F.concat(F.lit(DIP), moves))
        .otherwise(MANY_BUY)
    )
    sell_reason = (
        F.when(rsi > 70, F.concat(F.lit(OVERBOUGHT), _fixed(rsi), F.lit(")")))
        .when((macd < line) & (line > 0), CROSS_DOWN)
        .when(d24 > 15, F.concat(F.lit(REVERSAL), moves))
        .otherwise(MANY_SELL)
    )
    return labelled.withColumn("action", F.when(buy, "buy").when(sell, "sell").otherwise("hold")).withColumns(
        {
            "reason": F.when(F.col("action") == "buy", buy_reason).when(F.col("action") == "sell", sell_reason)
            .otherwise(NO_SIGNAL),
            "target_price": F.when(F.col("action") == "buy", price * (1 + F.abs(d24) / 200))
            .when(F.col("action") == "sell", price),
            "stop_loss": F.when(F.col("action") == "buy", price * 0.95),
        }
    )


def with_confidence(signals: DataFrame) -> DataFrame:
    """Confidence from confirming labels, maturity and daily volatility.

    Uses ``maturity_score`` and ``price_change_percentage_24h`` when the frame has them.
    """
    buy = F.col("action") == "buy"
    pairs = [("ma_label", "bullish", "bearish"), ("rsi_label", "oversold", "overbought"),
             ("macd_label", "bullish", "bearish"), ("volume_label", "high", "high"),
             ("momentum_label", "positive", "negative")]
    hits = F.lit(0)
    for c, b, s in pairs:
        hits = hits + F.when(F.col(c) == F.when(buy, b).otherwise(s), 1).otherwise(0)
    value = 0.3 + 0.4 * (hits / 5)
    if "maturity_score" in signals.columns:
        m = F.col("maturity_score")
        value = F.when(m.isNotNull(), F.least(F.lit(0.95), value + m / 200)).otherwise(value)
    if "price_change_percentage_24h" in signals.columns:
        wild = F.abs(F.col("price_change_percentage_24h")) > 20
        value = F.when(wild, F.greatest(F.lit(0.05), value - 0.1)).otherwise(value)
    return signals.withColumn(
        "confidence", F.when(F.col("action") == "hold", 0.5).otherwise(F.round(value, 2)))


def trading_signals(
    prices: DataFrame, info: DataFrame | None = None, keys: Sequence[str] = ("project_id",), min_rows: int = 1
) -> DataFrame:
    """Signal report per series: action, confidence, metrics and labels."""
    state = latest_state(prices, keys).filter(F.col("n_rows") >= min_rows)
    if info is not None:
        state = state.join(info, list(keys), "left")
    return with_confidence(determine_signal(state))


def by_risk(signals: DataFrame) -> DataFrame:
    """Each signal in three variants, one per risk tolerance."""
    risk, action, conf = F.col("risk_tolerance"), F.col("action"), F.col("confidence")
    wide = signals.withColumn("risk_tolerance", F.explode(F.array(F.lit("low"), F.lit("medium"), F.lit("high"))))
    cautious = (risk == "low") & (action == "buy") & (conf < 0.7)
    eager = (risk == "high") & (action == "hold") & (conf > 0.4) & F.col("momentum_label").isNotNull()
    up = F.col("momentum_label") == "positive"
    new_action = F.when(cautious, "hold").when(eager, F.when(up, "buy").otherwise("sell")).otherwise(action)
    new_reason = (
        F.when(cautious, F.concat(
            F.lit(ORIGINAL), action, F.lit(TONED_DOWN)))
        .when(eager & up, MOMENTUM_BUY)
        .when(eager, MOMENTUM_SELL)
        .otherwise(F.col("reason"))
    )
    new_conf = (
        F.when((risk == "low") & (action == "sell") & (conf < 0.6), F.least(F.lit(0.95), conf + 0.1))
        .when(eager, 0.5).otherwise(conf)
    )
    return wide.withColumns({"_a": new_action, "_r": new_reason, "_c": new_conf}).drop(
        "action", "reason", "confidence").withColumnsRenamed({"_a": "action", "_r": "reason", "_c": "confidence"})


def personalised(signals: DataFrame, users: DataFrame) -> DataFrame:
    """Signals per user: users pick the variant of their risk tolerance, medium when it is missing.

    Every user gets every signal, so the result has users x signals rows; limit the signals before. The three levels are
    hot keys: their users are spread over salts, and neither side is gathered.
    """
    own = users.select("user_id", F.coalesce("risk_tolerance", F.lit("medium")).alias("risk_tolerance"))
    variants = by_risk(signals).select("risk_tolerance", "project_id", "action", "confidence", "reason", "target_price")
    return salted_join(own, variants, ["risk_tolerance"]).select(
        "user_id", "risk_tolerance", "project_id", "action", "confidence", "reason", "target_price")


def technical_recs(
    prices: DataFrame, items: DataFrame, users: DataFrame, as_of: Column, top: int = 50, info: DataFrame | None = None
) -> DataFrame:
    """Technical recommendations of the ``top`` items by market value for every user."""
    leading = top_by_market_cap(items, top).select(F.col("id").alias("project_id"))
    known = prices.join(F.broadcast(leading), "project_id", "left_semi")  # at most ``top`` ids
    signals = trading_signals(known, info, min_rows=REC_ROWS)
    return personalised(signals, users).select(
        "user_id", "project_id", (F.col("confidence") * 100).alias("score"), F.lit(1).alias("rank"),
        F.lit("technical").alias("recommendation_type"), F.col("action").alias("action_type"),
        F.col("confidence").alias("confidence_score"), "target_price", F.col("reason").alias("explanation"),
        as_of.alias("created_at"), (as_of + F.make_interval(hours=F.lit(24))).alias("expires_at"),
    )


def signal_changes(
    portfolios: DataFrame, items: DataFrame, users: DataFrame, prices: DataFrame, stored: DataFrame
) -> DataFrame:
    """Holdings whose personal signal differs from the last stored action, with a notification flag.

    A first signal is a change without a notification.
    """
    held = portfolio_items(portfolios, items)
    mine = held.join(users.select("user_id", "risk_tolerance"), "user_id", "left").withColumn(
        "risk_tolerance", F.coalesce("risk_tolerance", F.lit("medium")))
    signals = by_risk(trading_signals(prices, min_rows=REC_ROWS)).select(
        "project_id", "risk_tolerance", "action", "confidence", "reason", "target_price")
    now = salted_join(mine, signals, ["project_id", "risk_tolerance"])
    previous = top_k(
        stored.filter(F.col("recommendation_type") == "technical"), ["user_id", "project_id"],
        [F.col("created_at").desc()], 1, "_r"
    ).select("user_id", "project_id", F.col("action_type").alias("previous_action"))
    both = now.join(previous, ["user_id", "project_id"], "left")
    changed = ~F.col("action").eqNullSafe(F.col("previous_action"))
    name = items.select(F.col("id").alias("project_id"), "name")
    title = F.concat(F.lit("New "), F.upper("action"), F.lit(" signal for "), F.col("name"))
    return salted_join(both.filter(changed), name, ["project_id"]).select(
        "user_id", "project_id", "previous_action", F.col("action").alias("action_type"),
        F.col("confidence").alias("confidence_score"), "target_price", F.col("reason").alias("explanation"),
        F.col("previous_action").isNotNull().alias("notify"),
        F.when(F.col("previous_action").isNotNull(), title).alias("title"),
    )
