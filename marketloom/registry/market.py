"""Price series and trading signals."""

from pyspark.sql import functions as F

from marketloom import fixtures as fx
from marketloom.operators import series as se
from marketloom.plans import signals as sg
from marketloom.registry.base import four_digits, query, r4, r6

V = fx.with_views
KEY = 'project_id, "timestamp"'


def frame(n: int) -> str:
    return f'OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'


def mean(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {frame(n)} = {n} THEN avg({c}) {frame(n)} END"


def sd(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {frame(n)} = {n} THEN stddev_samp({c}) {frame(n)} END"


LAG = "OVER (PARTITION BY project_id ORDER BY pos)"


def ema(source: str) -> str:
    """Positions, recursive means and price steps of a price view."""
    return f"""p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp") AS pos FROM {source}),
  e AS (SELECT project_id, pos, price AS e12, price AS e26, 0.0::DOUBLE AS sig FROM p WHERE pos = 1 UNION ALL
    SELECT p.project_id, p.pos, e.e12 + (p.price - e.e12) * 2.0::DOUBLE / 13, e.e26 + (p.price - e.e26) * 2.0::DOUBLE / 27,
      e.sig + (((e.e12 + (p.price - e.e12) * 2.0::DOUBLE / 13) - (e.e26 + (p.price - e.e26) * 2.0::DOUBLE / 27)) - e.sig) * 0.2::DOUBLE
    FROM e JOIN p ON p.project_id = e.project_id AND p.pos = e.pos + 1),
  d AS (SELECT p.*, e.e12, e.e26, e.e12 - e.e26 AS macd, e.sig, p.price - lag(p.price) OVER (PARTITION BY p.project_id ORDER BY p.pos) AS delta
    FROM p JOIN e ON e.project_id = p.project_id AND e.pos = p.pos),
  g AS (SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss FROM d)"""


W1 = f"""i AS (SELECT *, {mean('price', 20)} AS sma_20, {mean('price', 50)} AS sma_50, {mean('price', 200)} AS sma_200,
    {sd('price', 20)} AS bb_std, 100 - 100 / (1 + ({mean('gain', 14)}) / nullif({mean('loss', 14)}, 0)) AS rsi_14 FROM g)"""


def bfill(c: str) -> str:
    return (f"first_value({c} IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND "
            "UNBOUNDED FOLLOWING)")


@query("technical_indicators", four_digits(V("prices", f"""{ema('prices')}, {W1}, f AS (SELECT *, {bfill('sma_20')} AS s20, {bfill('sma_50')} AS s50,
    {bfill('sma_200')} AS s200, {bfill('bb_std')} AS bs, {bfill('rsi_14')} AS rsi FROM i)
  SELECT project_id, "timestamp", round(s20, 6) AS sma_20, round(s50, 6) AS sma_50, round(s200, 6) AS sma_200, round(e12, 6) AS ema_12,
    round(e26, 6) AS ema_26, round(macd, 6) AS macd, round(sig, 6) AS macd_signal, round(macd - sig, 6) AS macd_hist,
    round(rsi, 6) AS rsi_14, round(s20, 6) AS bb_middle, round(bs, 6) AS bb_std, round(s20 + 2*bs, 6) AS bb_upper,
    round(s20 - 2*bs, 6) AS bb_lower FROM f""", recursive=True)))
def technical_indicators(spark, sf):
    return se.technical_indicators(fx.prices(spark, sf)).select(
        "project_id", "timestamp", *[r4(c) for c in se.INDICATORS])


EWM_SPANS = [1, 2, 3, 5, 12]


@query("ewm_mean", four_digits(V("prices_long", f"""p AS (SELECT *, row_number() OVER (PARTITION BY project_id
    ORDER BY "timestamp") AS pos FROM prices_long),
  e AS (SELECT project_id, "timestamp", pos, {', '.join(f'price AS e{n}' for n in EWM_SPANS)} FROM p WHERE pos = 1 UNION ALL
    SELECT p.project_id, p."timestamp", p.pos, {', '.join(f'e.e{n} + (p.price - e.e{n}) * 2.0::DOUBLE / {n + 1}' for n in EWM_SPANS)}
    FROM e JOIN p ON p.project_id = e.project_id AND p.pos = e.pos + 1)
  SELECT project_id, "timestamp", {', '.join(f'round(e{n}, 6) AS ema_{n}' for n in EWM_SPANS)} FROM e""", recursive=True)))
def ewm_mean(spark, sf):
    out = fx.prices_long(spark, sf)
    for n in EWM_SPANS:
        out = se.ewm_mean(out, ["project_id"], "timestamp", "price", n, f"ema_{n}")
    return out.select("project_id", "timestamp", *[r4(f"ema_{n}") for n in EWM_SPANS])


def metric_cols(d: int) -> list[str]:
    rsi = (f"CASE WHEN {mean('loss', d)} = 0 AND {mean('gain', d)} > 0 THEN 100 ELSE 100 - 100 / (1 + ({mean('gain', d)}) "
           f"/ nullif({mean('loss', d)}, 0)) END")
    vol = sd("ret", d) if d > 1 else "NULL::DOUBLE"
    dev = sd("price", d) if d > 1 else "NULL::DOUBLE"
    ma = mean("price", d)
    return [
        f"round(({vol}) * sqrt({d}), 6) AS market_volatility_{d}d", f"round({ma}, 6) AS market_ma_{d}d",
        f"round({rsi}, 6) AS market_rsi_{d}d", f"round(price / lag(price, {d}) {LAG} - 1, 6) AS market_momentum_{d}d",
        f"round(({ma}) + 2 * ({dev}), 6) AS market_bb_upper_{d}d", f"round(({ma}) - 2 * ({dev}), 6) AS market_bb_lower_{d}d",
        f"round((price - ({ma}) + 2 * ({dev})) / nullif(4 * ({dev}), 0), 6) AS market_bb_pct_{d}d",
    ]


METRICS = [c for d in (1, 7, 30) for c in metric_cols(d)]
METRIC_NAMES = [c.rsplit(" AS ", 1)[1] for c in METRICS]


@query("market_metrics", four_digits(V("prices_long", f"""{ema('prices_long')}, r AS (SELECT *, delta / lag(price) {LAG} AS ret FROM g)
  SELECT project_id, "timestamp", round(ret, 6) AS market_returns, round(volume / market_cap, 9) AS market_volume_to_mcap,
    round(macd, 6) AS market_macd, round(sig, 6) AS market_macd_signal, round(macd - sig, 6) AS market_macd_hist,
    {', '.join(METRICS)} FROM r""", recursive=True)))
def market_metrics(spark, sf):
    out = se.market_metrics(fx.prices_long(spark, sf))
    names = ["market_returns", "market_macd", "market_macd_signal", "market_macd_hist", *METRIC_NAMES]
    return out.select(
        "project_id", "timestamp", F.round("market_volume_to_mcap", 9).alias("market_volume_to_mcap"),
        *[r4(n) for n in names])


FLAGS = ["pump", "dump", "high_volatility", "price_streak_up", "price_streak_down", "local_peak", "local_trough",
         "breakout", "breakdown", "price_acceleration", "volume_spike"]
EVENT_SQL = f"""p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp") AS pos FROM prices_long),
  a AS (SELECT *, price / lag(price) {LAG} - 1 AS ret, {mean('price', 7)} AS ma, {sd('price', 7)} AS sd,
      coalesce(CAST(price > lag(price) {LAG} AS INT), 0) AS up, coalesce(CAST(price < lag(price) {LAG} AS INT), 0) AS down,
      coalesce(CAST(price > lag(price) {LAG} AND price > lead(price) {LAG} AS INT), 0) AS local_peak,
      coalesce(CAST(price < lag(price) {LAG} AND price < lead(price) {LAG} AS INT), 0) AS local_trough,
      coalesce(CAST(volume > {mean('volume', 7)} + 2 * ({sd('volume', 7)}) AS INT), 0) AS volume_spike FROM p),
  b AS (SELECT *, {sd('ret', 7)} AS vola, coalesce(CAST(price > ma + 2*sd AS INT), 0) AS pump,
      coalesce(CAST(price < ma - 2*sd AS INT), 0) AS dump, coalesce(CAST(price > ma AS INT), 0) AS above,
      coalesce(CAST(price < ma AS INT), 0) AS below,
      coalesce(CAST(({mean('up', 3)}) = 1 AS INT), 0) AS price_streak_up, coalesce(CAST(({mean('down', 3)}) = 1 AS INT), 0) AS price_streak_down,
      ret - lag(ret) {LAG} AS rc FROM a),
  c AS (SELECT *, {mean('rc', 3)} AS acc, coalesce(CAST(above = 1 AND lag(above) {LAG} = 0 AS INT), 0) AS breakout,
      coalesce(CAST(below = 1 AND lag(below) {LAG} = 0 AS INT), 0) AS breakdown FROM b),
  d AS (SELECT *, coalesce(CAST(vola > avg(vola) OVER k + 2 * stddev_samp(vola) OVER k AS INT), 0) AS high_volatility,
      coalesce(CAST(abs(acc) > avg(abs(acc)) OVER k + 2 * stddev_samp(abs(acc)) OVER k AS INT), 0) AS price_acceleration
    FROM c WINDOW k AS (PARTITION BY project_id)),
  t AS (SELECT *, CASE WHEN volume_spike = 1 THEN 8 WHEN breakdown = 1 THEN 7 WHEN breakout = 1 THEN 6 WHEN price_streak_down = 1 THEN 5
      WHEN price_streak_up = 1 THEN 4 WHEN high_volatility = 1 THEN 3 WHEN dump = 1 THEN 2 WHEN pump = 1 THEN 1 ELSE 0 END AS event_type,
      coalesce(CAST((pump = 1 AND lag(pump) {LAG} = 0) OR (dump = 1 AND lag(dump) {LAG} = 0)
        OR (high_volatility = 1 AND lag(high_volatility) {LAG} = 0) AS INT), 0) AS event_start FROM d),
  g AS (SELECT *, CAST(sum(event_start) OVER (PARTITION BY project_id ORDER BY pos) AS BIGINT) AS event_group FROM t)
  SELECT project_id, "timestamp", {', '.join(FLAGS)}, event_type,
    ['normal','pump','dump','high_volatility','streak_up','streak_down','breakout','breakdown','volume_spike'][event_type + 1] AS event_name,
    event_start, event_group, CASE WHEN event_type = 0 THEN 0 ELSE count(*) OVER (PARTITION BY project_id, event_group) END AS event_duration FROM g"""


@query("market_events", V("prices_long", EVENT_SQL))
def market_events(spark, sf):
    return se.market_events(fx.prices_long(spark, sf)).select(
        "project_id", "timestamp", *FLAGS, "event_type", "event_name", "event_start", "event_group", "event_duration")


@query("price_change", V("prices", f"""p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp") AS pos FROM prices)
  SELECT project_id, "timestamp", """ + ", ".join(
    f"round(coalesce((price - lag(price, {h}) {LAG}) / nullif(lag(price, {h}) {LAG}, 0) * 100, 0), 6) AS change_{h}" for h in (1, 24, 168))
    + " FROM p"))
def price_change(spark, sf):
    out = se.price_change(fx.prices(spark, sf), [1, 24, 168])
    return out.select("project_id", "timestamp", *[r6(f"change_{h}") for h in (1, 24, 168)])


PREV = "OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING)"


@query("volume_spike", V("prices", f"""p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "timestamp") AS pos FROM prices),
  m AS (SELECT *, CASE WHEN count(volume) {PREV} >= 23 THEN nullif(avg(volume) {PREV}, 0) END AS m FROM p)
  SELECT project_id, "timestamp", round(coalesce((volume - m) / m * 100, 0), 6) AS volume_change,
    coalesce((volume - m) / m * 100, 0) > 50 AS volume_spike FROM m"""))
def volume_spike(spark, sf):
    return se.volume_spike(fx.prices(spark, sf)).select("project_id", "timestamp", r6("volume_change"), "volume_spike")


@query("latest_per_key", V("prices", f"""SELECT project_id, "timestamp", round(price + 1e-9, 6) AS price,
    row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC) AS recency FROM prices QUALIFY recency <= 168"""))
def latest_per_key(spark, sf):
    out = se.latest_rows(fx.prices(spark, sf), ["project_id"], "timestamp", 168)
    return out.select("project_id", "timestamp", r6(F.col("price") + 1e-9, "price"), F.col("recency").cast("long").alias("recency"))


# --- signals ------------------------------------------------------------------------------------------------------

STATE = f"""ago AS (SELECT project_id, price AS week_ago FROM prices_long
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY "timestamp" DESC) = 169),
  recent AS (SELECT l.*, week_ago FROM prices_long l LEFT JOIN ago USING (project_id)
    QUALIFY row_number() OVER (PARTITION BY l.project_id ORDER BY "timestamp" DESC) <= 168),
  {ema('recent')}, {W1},
  c AS (SELECT *, count(*) OVER (PARTITION BY project_id) AS n,
      coalesce((price - lag(price, 1) {LAG}) / nullif(lag(price, 1) {LAG}, 0) * 100, 0) AS d1,
      coalesce((price - lag(price, 24) {LAG}) / nullif(lag(price, 24) {LAG}, 0) * 100, 0) AS d24,
      coalesce((price - week_ago) / nullif(week_ago, 0) * 100, 0) AS d7,
      CASE WHEN count(volume) {PREV} >= 23 THEN nullif(avg(volume) {PREV}, 0) END AS vm FROM i),
  st AS (SELECT *, coalesce((volume - vm) / vm * 100, 0) AS vc, coalesce((volume - vm) / vm * 100, 0) > 50 AS spike FROM c WHERE pos = n),
  lb AS (SELECT *, CASE WHEN sma_20 > sma_50 THEN 'bullish' ELSE 'bearish' END AS ma_label,
      CASE WHEN rsi_14 < 30 THEN 'oversold' WHEN rsi_14 > 70 THEN 'overbought' ELSE 'neutral' END AS rsi_label,
      CASE WHEN macd > sig THEN 'bullish' ELSE 'bearish' END AS macd_label, CASE WHEN spike THEN 'high' ELSE 'normal' END AS volume_label,
      CASE WHEN d24 > 0 THEN 'positive' ELSE 'negative' END AS momentum_label,
      CASE WHEN n >= 50 AND ((rsi_14 < 40 AND macd > sig) OR (d24 < -10 AND d1 > 2) OR (rsi_14 < 30 AND spike)) THEN 'buy'
           WHEN n >= 50 AND ((rsi_14 > 70 AND macd < sig) OR (d24 > 15 AND d1 < -1) OR (rsi_14 > 70 AND d7 > 30)) THEN 'sell' ELSE 'hold' END AS action
    FROM st),
  signals AS (SELECT *, CASE action WHEN 'buy' THEN CASE
        WHEN rsi_14 < 30 THEN 'RSI indicates oversold condition (' || format('{{:.2f}}', rsi_14) || ')'
        WHEN macd > sig AND sig < 0 THEN 'MACD shows bullish crossover from negative territory'
        WHEN d24 < -10 THEN 'Price dip with recovery (24h: ' || format('{{:.2f}}', d24) || '%, 1h: ' || format('{{:.2f}}', d1) || '%)'
        ELSE 'Multiple technical indicators suggest buying opportunity' END
      WHEN 'sell' THEN CASE WHEN rsi_14 > 70 THEN 'RSI indicates overbought condition (' || format('{{:.2f}}', rsi_14) || ')'
        WHEN macd < sig AND sig > 0 THEN 'MACD shows bearish crossover from positive territory'
        WHEN d24 > 15 THEN 'Sharp price increase followed by reversal (24h: ' || format('{{:.2f}}', d24) || '%, 1h: ' || format('{{:.2f}}', d1) || '%)'
        ELSE 'Multiple technical indicators suggest selling opportunity' END ELSE 'No clear signals detected' END AS reason,
      CASE action WHEN 'buy' THEN price * (1 + abs(d24) / 200) WHEN 'sell' THEN price END AS target_price,
      CASE action WHEN 'buy' THEN price * 0.95::DOUBLE END AS stop_loss,
      CASE WHEN action = 'hold' THEN 0.5::DOUBLE ELSE round(0.3::DOUBLE + 0.4::DOUBLE * ((CASE WHEN action = 'buy' THEN
          CAST(ma_label = 'bullish' AS INT) + CAST(rsi_label = 'oversold' AS INT) + CAST(macd_label = 'bullish' AS INT)
          + CAST(spike AS INT) + CAST(momentum_label = 'positive' AS INT)
        ELSE CAST(ma_label = 'bearish' AS INT) + CAST(rsi_label = 'overbought' AS INT) + CAST(macd_label = 'bearish' AS INT)
          + CAST(spike AS INT) + CAST(momentum_label = 'negative' AS INT) END) / 5::DOUBLE), 2) END AS confidence FROM lb)"""


@query("trading_signals", V("prices_long", f"""{STATE} SELECT project_id, "timestamp" AS updated_at, action, confidence, reason,
    round(target_price, 6) AS target_price, round(stop_loss, 6) AS stop_loss, round(d1, 6) AS change_1h, round(d24, 6) AS change_24h,
    round(d7, 6) AS change_7d, round(vc, 6) AS volume_change, round(rsi_14, 6) AS rsi_14, round(macd, 6) AS macd,
    ma_label, rsi_label, macd_label, volume_label, momentum_label FROM signals""", recursive=True))
def trading_signals(spark, sf):
    s = sg.trading_signals(fx.prices_long(spark, sf))
    return s.select(
        "project_id", F.col("timestamp").alias("updated_at"), "action", "confidence", "reason",
        *[r6(c) for c in ("target_price", "stop_loss", "change_1h", "change_24h", "change_7d", "volume_change", "rsi_14", "macd")],
        "ma_label", "rsi_label", "macd_label", "volume_label", "momentum_label")


# Item facts of a brand from its number: no maturity for every fifth one, a wild day above 20 %.
INFO = """info AS (SELECT id AS project_id, CASE WHEN n % 5 <> 0 THEN n * 3 END AS maturity_score, n - 3 AS price_change_percentage_24h
  FROM (SELECT id, CAST(regexp_replace(id, '[^0-9]', '', 'g') AS DOUBLE) AS n FROM brand_items))"""


@query("signal_confidence", V("prices_long brand_items", f"""{STATE}, {INFO}, v AS (
    SELECT s.*, i.price_change_percentage_24h AS pct, CASE WHEN maturity_score IS NULL THEN base ELSE least(0.95::DOUBLE, base + maturity_score / 200) END AS c
    FROM (SELECT *, 0.3::DOUBLE + 0.4::DOUBLE * ((CASE WHEN action = 'buy' THEN
          CAST(ma_label = 'bullish' AS INT) + CAST(rsi_label = 'oversold' AS INT) + CAST(macd_label = 'bullish' AS INT)
          + CAST(spike AS INT) + CAST(momentum_label = 'positive' AS INT)
        ELSE CAST(ma_label = 'bearish' AS INT) + CAST(rsi_label = 'overbought' AS INT) + CAST(macd_label = 'bearish' AS INT)
          + CAST(spike AS INT) + CAST(momentum_label = 'negative' AS INT) END) / 5::DOUBLE) AS base FROM lb) s LEFT JOIN info i USING (project_id))
  SELECT project_id, action, CASE WHEN action = 'hold' THEN 0.5::DOUBLE
    ELSE round(CASE WHEN abs(pct) > 20 THEN greatest(0.05::DOUBLE, c - 0.1::DOUBLE) ELSE c END, 2) END AS confidence FROM v""", recursive=True))
def signal_confidence(spark, sf):
    number = F.regexp_replace("id", "[^0-9]", "").cast("double")
    info = fx.brand_items(spark, sf).select(
        F.col("id").alias("project_id"), F.when(number % 5 != 0, number * 3).alias("maturity_score"),
        (number - 3).alias("price_change_percentage_24h"))
    return sg.trading_signals(fx.prices_long(spark, sf), info).select("project_id", "action", r6("confidence"))


BY_RISK = """risks AS (SELECT s.*, r AS risk FROM signals s, (SELECT unnest(['low', 'medium', 'high']) AS r)),
  personal AS (SELECT project_id, risk, target_price,
    CASE WHEN risk = 'low' AND action = 'buy' AND confidence < 0.7 THEN 'hold'
         WHEN risk = 'high' AND action = 'hold' AND confidence > 0.4 THEN CASE WHEN momentum_label = 'positive' THEN 'buy' ELSE 'sell' END
         ELSE action END AS action,
    CASE WHEN risk = 'low' AND action = 'buy' AND confidence < 0.7 THEN 'Original signal (' || action || ') adjusted to HOLD due to your conservative risk profile'
         WHEN risk = 'high' AND action = 'hold' AND confidence > 0.4 THEN 'Momentum trending ' || momentum_label || ' - opportunistic '
              || CASE WHEN momentum_label = 'positive' THEN 'buy' ELSE 'sell' END || ' for aggressive risk profile' ELSE reason END AS reason,
    CASE WHEN risk = 'low' AND action = 'sell' AND confidence < 0.6 THEN least(0.95::DOUBLE, confidence + 0.1::DOUBLE)
         WHEN risk = 'high' AND action = 'hold' AND confidence > 0.4 THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM risks)"""


@query("personalize_signals", V("prices_long", f"{STATE}, {BY_RISK} SELECT project_id, risk AS risk_tolerance, action, reason, round(confidence, 6) AS confidence FROM personal", recursive=True))
def personalize_signals(spark, sf):
    return sg.by_risk(sg.trading_signals(fx.prices_long(spark, sf))).select(
        "project_id", "risk_tolerance", "action", "reason", r6("confidence"))


@query("technical_recs", V("prices_long brand_items users", f"""{STATE}, {BY_RISK}, lead AS (SELECT id FROM brand_items WHERE current_price > 0 ORDER BY market_cap DESC, id LIMIT 50)
  SELECT u.user_id, p.project_id, round(p.confidence * 100, 6) AS score, 'technical' AS recommendation_type, p.action AS action_type,
    round(p.confidence, 6) AS confidence_score, round(p.target_price, 6) AS target_price, p.reason AS explanation,
    TIMESTAMP '2024-06-11 00:00:00' AS expires_at
  FROM users u JOIN personal p ON p.risk = u.risk_tolerance WHERE p.project_id IN (SELECT id FROM lead)""", recursive=True))
def technical_recs(spark, sf):
    recs = sg.technical_recs(
        fx.prices_long(spark, sf), fx.brand_items(spark, sf), fx.users(spark, sf),
        F.lit("2024-06-10").cast("timestamp"))
    return recs.select(
        "user_id", "project_id", r6("score"), "recommendation_type", "action_type", r6("confidence_score"),
        r6("target_price"), "explanation", "expires_at")


@query("signal_changes", V("prices_long brand_portfolios stored_signals users", f"""{STATE}, {BY_RISK},
  held AS (SELECT b.user_id, b.project_id, u.risk_tolerance FROM brand_portfolios b JOIN users u ON u.user_id = b.user_id WHERE b.amount > 0),
  prev AS (SELECT user_id, project_id, action_type FROM stored_signals QUALIFY row_number() OVER (PARTITION BY user_id, project_id ORDER BY created_at DESC) = 1)
  SELECT h.user_id, h.project_id, prev.action_type AS previous_action, p.action AS action_type, round(p.confidence, 6) AS confidence_score,
    prev.action_type IS NOT NULL AS notify,
    CASE WHEN prev.action_type IS NOT NULL THEN 'New ' || upper(p.action) || ' signal for The ' || h.project_id END AS title
  FROM held h JOIN personal p ON p.project_id = h.project_id AND p.risk = h.risk_tolerance
  LEFT JOIN prev ON prev.user_id = h.user_id AND prev.project_id = h.project_id
  WHERE p.action IS DISTINCT FROM prev.action_type""", recursive=True))
def signal_changes(spark, sf):
    out = sg.signal_changes(
        fx.brand_portfolios(spark, sf), fx.brand_items(spark, sf), fx.users(spark, sf), fx.prices_long(spark, sf),
        fx.stored_signals(spark, sf))
    return out.select(
        "user_id", "project_id", "previous_action", "action_type", r6("confidence_score"), "notify", "title")
