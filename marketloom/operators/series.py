"""Indicators, metrics and events of price series.

Every function takes ``keys`` (one series per key) and a timestamp column. Rows get an exact position, the series is
cut into blocks with enough neighbouring rows for the longest frame, and all frames run inside a block, so one long
series is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.scale import drop_halo, neighbour_values, null_safe_join, top_k, with_halo, with_position

BLOCK = 2048


def ewm_reach(span: int) -> int:
    """Rows after which a term's weight in the recursive mean is below double precision."""
    return math.ceil(37 / _decay(span)) if span > 1 else 0


def ewm_block(span: int) -> int:
    """Rows of a block whose weights, halo included, stay far inside the range of a double."""
    return min(BLOCK, max(1, int(560 / _decay(span)))) if span > 1 else BLOCK


def _decay(span: int) -> float:
    return -math.log1p(-2 / (span + 1))


def positioned(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), span: str = "day"
) -> DataFrame:
    """Exact row number ``pos`` per series; ``span`` is the calendar bucket numbered in one task."""
    order = [F.col(ts).asc(), *[F.col(t).asc() for t in tie]]
    return with_position(df, keys, order, F.date_trunc(span, ts))


class Frames:
    """Window frames inside the blocks of one positioned series."""

    def __init__(self, keys: Sequence[str]):
        self.base = Window.partitionBy(*keys, "_block").orderBy("pos")

    def last(self, n: int) -> Column:
        return self.base.rowsBetween(-(n - 1), 0)

    def mean(self, c: Column, n: int) -> Column:
        w = self.last(n)
        return F.when(F.count(c).over(w) == n, F.avg(c).over(w))

    def std(self, c: Column, n: int) -> Column:
        w = self.last(n)
        return F.when((F.count(c).over(w) == n) & F.lit(n > 1), F.stddev_samp(c).over(w))

    def total(self, c: Column, n: int) -> Column:
        w = self.last(n)
        return F.when(F.count(c).over(w) == n, F.sum(c).over(w))

    def lag(self, c: Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.base)

    def lead(self, c: Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.base)

    def ewm(self, c: Column, span: int) -> Column:
        """Recursive mean ``y = a x + (1 - a) y'`` with ``y0 = x0`` as a weighted running sum.

        The first row of the series has weight one. Offsets restart in every block, which keeps the powers in range;
        the block's leading rows reach back far enough that the missing past is below rounding.
        """
        if span < 1:
            raise ValueError("span must be at least 1")
        if span == 1:
            return c
        a = 2.0 / (span + 1)
        q = 1 - a
        offset = F.col("pos") - F.min("pos").over(self.base)
        weight = F.when(F.col("pos") == 0, 1.0).otherwise(a)
        run = F.sum(weight * c * F.pow(F.lit(q), -offset)).over(self.base)
        return run * F.pow(F.lit(q), offset)


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _rsi(f: Frames, delta: Column, n: int, saturate: bool = False) -> Column:
    """Simple-mean RSI; null while the window is short. Without any loss it is null, or 100 with ``saturate``."""
    gain = f.mean(F.when(delta > 0, delta).otherwise(0.0), n)
    loss = f.mean(F.when(delta < 0, -delta).otherwise(0.0), n)
    value = 100 - 100 / (1 + _ratio(gain, loss))
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(value) if saturate else value


def ewm_mean(df: DataFrame, keys: Sequence[str], ts: str, column: str, span: int, out: str) -> DataFrame:
    """Exponential mean of a column without nulls."""
    f = Frames(keys)
    blocks = with_halo(positioned(df, keys, ts), ewm_block(span), before=ewm_reach(span))
    return drop_halo(blocks.withColumn(out, f.ewm(F.col(column), span))).drop("pos")


INDICATORS = [
    "sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi_14",
    "bb_middle", "bb_std", "bb_upper", "bb_lower",
]


def technical_indicators(
    prices: DataFrame, keys: Sequence[str] = ("project_id",), ts: str = "timestamp", price: str = "price",
    backfill: bool = True,
) -> DataFrame:
    """SMA 20/50/200, EMA 12/26, MACD with signal 9, RSI 14, Bollinger 20 (W1); gaps take the next value."""
    f = Frames(keys)
    p = F.col(price)
    reach = ewm_reach(26) + ewm_reach(9)
    blocks = with_halo(positioned(prices, keys, ts), BLOCK, before=max(reach, 200))
    a = blocks.withColumns(
        {
            "sma_20": f.mean(p, 20), "sma_50": f.mean(p, 50), "sma_200": f.mean(p, 200),
            "ema_12": f.ewm(p, 12), "ema_26": f.ewm(p, 26), "_delta": p - f.lag(p), "bb_std": f.std(p, 20),
        }
    )
    b = a.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    c = b.withColumns({"macd_signal": f.ewm(F.col("macd"), 9), "rsi_14": _rsi(f, F.col("_delta"), 14)})
    done = drop_halo(
        c.withColumns(
            {
                "macd_hist": F.col("macd") - F.col("macd_signal"),
                "bb_middle": F.col("sma_20"),
                "bb_upper": F.col("sma_20") + 2 * F.col("bb_std"),
                "bb_lower": F.col("sma_20") - 2 * F.col("bb_std"),
            }
        ).drop("_delta")
    )
    if not backfill:
        return done.select(*prices.columns, "pos", *INDICATORS)
    gaps = ["sma_20", "sma_50", "sma_200", "rsi_14", "bb_std", "bb_upper", "bb_lower"]
    near = neighbour_values(done, keys, gaps)
    filled = near.withColumns({c: F.col(f"next_{c}")["v"] for c in gaps}).withColumn("bb_middle", F.col("sma_20"))
    return filled.select(*prices.columns, "pos", *INDICATORS)


def market_metrics(
    df: DataFrame, keys: Sequence[str] = ("project_id",), ts: str = "timestamp", price: str = "price",
    market_cap: str = "market_cap", volume: str = "volume", prefix: str = "market_",
    periods: Sequence[int] = (1, 7, 30),
) -> DataFrame:
    """Returns, volatility, means, RSI, MACD, momentum and Bollinger position per period.

    MACD needs at least 26 rows in the series, the other columns their own window.
    """
    f = Frames(keys)
    p = F.col(price)
    reach = max(max(periods) + 1, ewm_reach(26) + ewm_reach(9))
    blocks = with_halo(positioned(df, keys, ts), BLOCK, before=reach)
    a = blocks.withColumns(
        {
            f"{prefix}returns": _ratio(p - f.lag(p), f.lag(p)), "_delta": p - f.lag(p),
            "_e12": f.ewm(p, 12), "_e26": f.ewm(p, 26),
        }
    ).withColumn(f"{prefix}macd", F.col("_e12") - F.col("_e26"))
    # a block holds more than 26 rows, so only the first block of a series can be too short
    longest = F.max("pos").over(Window.partitionBy(*keys, "_block"))
    cols: dict[str, Column] = {
        "_enough": longest >= 25,
        f"{prefix}volume_to_mcap": _ratio(F.col(volume), F.col(market_cap)),
        f"{prefix}macd_signal": f.ewm(F.col(f"{prefix}macd"), 9),
    }
    r = F.col(f"{prefix}returns")
    for d in periods:
        cols[f"{prefix}volatility_{d}d"] = f.std(r, d) * math.sqrt(d)
        cols[f"{prefix}ma_{d}d"] = f.mean(p, d)
        cols[f"{prefix}rsi_{d}d"] = _rsi(f, F.col("_delta"), d, saturate=True)
        cols[f"{prefix}momentum_{d}d"] = _ratio(p, f.lag(p, d)) - 1
        cols[f"_sd_{d}"] = f.std(p, d)
    b = drop_halo(a.withColumns(cols))
    bands: dict[str, Column] = {}
    for d in periods:
        ma, sd = F.col(f"{prefix}ma_{d}d"), F.col(f"_sd_{d}")
        bands[f"{prefix}bb_upper_{d}d"] = ma + 2 * sd
        bands[f"{prefix}bb_lower_{d}d"] = ma - 2 * sd
        bands[f"{prefix}bb_pct_{d}d"] = _ratio(p - (ma - 2 * sd), 4 * sd)
    enough = F.col("_enough")
    out = b.withColumns(bands).withColumns(
        {
            f"{prefix}macd": F.when(enough, F.col(f"{prefix}macd")),
            f"{prefix}macd_signal": F.when(enough, F.col(f"{prefix}macd_signal")),
            f"{prefix}macd_hist": F.when(enough, F.col(f"{prefix}macd") - F.col(f"{prefix}macd_signal")),
        }
    )
    return out.drop("_enough", "_delta", "_e12", "_e26", "pos", *[f"_sd_{d}" for d in periods])


# Event names; later entries win over earlier ones.
EVENTS = [
    ("pump", "pump"), ("dump", "dump"), ("high_volatility", "high_volatility"), ("price_streak_up", "streak_up"),
    ("price_streak_down", "streak_down"), ("breakout", "breakout"), ("breakdown", "breakdown"),
    ("volume_spike", "volume_spike"),
]


def market_events(
    df: DataFrame, keys: Sequence[str] = ("project_id",), ts: str = "timestamp", price: str = "price",
    volume: str | None = "volume", window: int = 7, k: float = 2.0,
) -> DataFrame:
    """Pump, dump, volatility, streak, turn, breakout, acceleration and volume flags, event type and duration.

    Tests against missing values are 0. Group numbers are running counts of starts, taken per block and carried over
    block totals; durations are the group sizes.
    """
    keys = list(keys)
    f = Frames(keys)
    p = F.col(price)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    blocks = with_halo(positioned(df, keys, ts), BLOCK, before=window + 6, after=1)
    a = blocks.withColumns(
        {
            "return": _ratio(p - f.lag(p), f.lag(p)),
            "price_ma": f.mean(p, window), "price_std": f.std(p, window),
            "price_up": flag(p > f.lag(p)), "price_down": flag(p < f.lag(p)),
            "local_peak": flag((p > f.lag(p)) & (p > f.lead(p))),
            "local_trough": flag((p < f.lag(p)) & (p < f.lead(p))),
        }
    )
    b = a.withColumns(
        {
            "volatility": f.std(F.col("return"), window),
            "pump": flag(p > F.col("price_ma") + k * F.col("price_std")),
            "dump": flag(p < F.col("price_ma") - k * F.col("price_std")),
            "above_ma": flag(p > F.col("price_ma")), "below_ma": flag(p < F.col("price_ma")),
            "price_streak_up": flag(f.total(F.col("price_up"), 3) >= 3),
            "price_streak_down": flag(f.total(F.col("price_down"), 3) >= 3),
            "return_change": F.col("return") - f.lag(F.col("return")),
        }
    )
    c = b.withColumns(
        {
            "breakout": flag((F.col("above_ma") == 1) & (f.lag(F.col("above_ma")) == 0)),
            "breakdown": flag((F.col("below_ma") == 1) & (f.lag(F.col("below_ma")) == 0)),
            "acceleration": f.mean(F.col("return_change"), 3),
        }
    )
    if volume is not None:
        v = F.col(volume)
        c = c.withColumn("volume_spike", flag(v > f.mean(v, window) + k * f.std(v, window)))
    home = drop_halo(c)
    levels = home.groupBy(*keys).agg(
        (F.avg("volatility") + k * F.stddev_samp("volatility")).alias("_vol"),
        (F.avg(F.abs("acceleration")) + k * F.stddev_samp(F.abs(F.col("acceleration")))).alias("_acc"),
    )
    d = null_safe_join(home, levels, keys).withColumns(
        {
            "high_volatility": flag(F.col("volatility") > F.col("_vol")),
            "price_acceleration": flag(F.abs("acceleration") > F.col("_acc")),
        }
    ).drop("_vol", "_acc")
    present = [(n, name, col) for n, (col, name) in enumerate(EVENTS, 1) if col in d.columns]
    kind, label = F.lit(0), F.lit("normal")
    for n, name, col in present:  # later entries overwrite earlier ones
        kind = F.when(F.col(col) == 1, n).otherwise(kind)
        label = F.when(F.col(col) == 1, name).otherwise(label)
    d = d.withColumns({"event_type": kind, "event_name": label})
    e = with_halo(d, BLOCK, before=1)
    starts = [(F.col(n) == 1) & (f.lag(F.col(n)) == 0) for n in ("pump", "dump", "high_volatility")]
    e = drop_halo(e.withColumn("event_start", flag(starts[0] | starts[1] | starts[2])))
    return event_groups(e, keys)


def event_groups(df: DataFrame, keys: Sequence[str], block: int = 100_000) -> DataFrame:
    """``event_group`` as the running count of starts and ``event_duration`` as its size, 0 for normal rows."""
    keys = list(keys)
    b = df.withColumn("_blk", F.floor(F.col("pos") / block))
    kb = [*keys, "_blk"]
    totals = b.groupBy(*kb).agg(F.sum("event_start").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*kb, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_c"))
    run = Window.partitionBy(*kb).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = null_safe_join(b.withColumn("_s", F.sum("event_start").over(run)), carry, kb).withColumn(
        "event_group", F.col("_s") + F.col("_c"))
    sizes = numbered.groupBy(*keys, "event_group").agg(F.count(F.lit(1)).alias("_size"))
    return (
        null_safe_join(numbered, sizes, [*keys, "event_group"])
        .withColumn("event_duration", F.when(F.col("event_type") == 0, 0).otherwise(F.col("_size")))
        .drop("_blk", "_s", "_c", "_size", "pos")
    )


def price_change(prices: DataFrame, hours: Sequence[int], keys: Sequence[str] = ("project_id",), ts: str = "timestamp"):
    """Percent change against the row ``h`` rows back, 0 without such a row or with a zero base."""
    f = Frames(keys)
    p = F.col("price")
    blocks = with_halo(positioned(prices, keys, ts), BLOCK, before=max(hours))
    cols = {f"change_{h}": F.coalesce(_ratio(p - f.lag(p, h), f.lag(p, h)) * 100, F.lit(0.0)) for h in hours}
    return drop_halo(blocks.withColumns(cols)).drop("pos")


def volume_spike(prices: DataFrame, keys: Sequence[str] = ("project_id",), ts: str = "timestamp") -> DataFrame:
    """Volume against the mean of the 23 rows before; a spike is more than 50 % above, with 24 rows at hand."""
    f = Frames(keys)
    v = F.col("volume")
    w = f.base.rowsBetween(-23, -1)
    blocks = with_halo(positioned(prices, keys, ts), BLOCK, before=24)
    mean = F.when(F.count(v).over(w) >= 23, F.avg(v).over(w))
    change = F.coalesce(_ratio(v - F.col("_mean"), F.col("_mean")) * 100, F.lit(0.0))
    out = drop_halo(blocks.withColumn("_mean", mean)).withColumn("volume_change", change)
    return out.withColumn("volume_spike", F.col("volume_change") > 50).drop("_mean", "pos")


def latest_rows(df: DataFrame, keys: Sequence[str], ts: str, n: int) -> DataFrame:
    """Newest ``n`` rows per key; map tasks send at most n rows per key."""
    return top_k(df, keys, [F.col(ts).desc()], n, "recency")
