"""Shared building blocks that keep hot keys and whole-table statistics distributed.

The rules they implement:

* whole-table statistics are one fitted row, used as literals, so no cross join is needed;
* positions, rolling frames and quantiles never put one whole key into one task;
* self-joins run on cells of bounded size;
* dense scoring runs on a grid of bounded blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import materialise

SCORE_DIGITS = 8  # ranking ignores noise below this digit, so ties are broken by id
SMALL_ROWS = 200_000  # rows of a lookup table that is broadcast


def scalars(df: DataFrame, **aggs: Column) -> dict[str, Column]:
    """Fit whole-table aggregates: one job, one row back, literals for the plans that follow."""
    frame = df.agg(*[c.alias(n) for n, c in aggs.items()])
    row = frame.first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in frame.schema}


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` that also matches null with null; keeps the left key columns."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = eq if cond is None else cond & eq
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    rows_per_salt: int = 1_000_000,
    how: str = "inner",
) -> DataFrame:
    """Join whose hot left keys are split over several tasks.

    A key with more than ``rows_per_salt`` left rows gets ``ceil(rows / rows_per_salt)`` salts: its left rows are
    spread by hash and its right rows repeated once per salt. Cold keys are untouched; rows with a null key never match
    and are spread freely. ``how`` is inner or left.
    """
    keys = list(keys)
    hashed = [f.name for f in left.schema if "map<" not in f.dataType.simpleString() and "variant" not in
              f.dataType.simpleString()]
    nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_salt)
        .select(*keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts"))
    )
    spread = left.join(hot, keys, "left").withColumn(
        "_salt",
        F.pmod(F.xxhash64(*hashed), F.when(nulls, 1000).otherwise(F.coalesce("_salts", F.lit(1)))).cast("int"),
    )
    copies = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return spread.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark prunes each map task to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_scored(df: DataFrame, keys: Sequence[str], score: str, item: str, k: int, rank: str = "rank") -> DataFrame:
    """Top ``k`` by score, ties by item id; the score is compared at ``SCORE_DIGITS`` digits."""
    return top_k(df, keys, [F.round(score, SCORE_DIGITS).desc(), F.col(item).asc()], k, rank)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "pos"
) -> DataFrame:
    """Exact 0-based position of each row in its key, without sorting a whole key in one task.

    ``bucket`` must be monotone in ``order`` (a truncated timestamp, a hash range). Rows are numbered inside
    (key, bucket); bucket totals give the offset. Only the totals are sorted per key.
    """
    binned, safe = null_free(df.withColumn("_bucket", bucket), [*keys, "_bucket"])
    owner, place = safe[:-2], safe[-2:]
    totals = binned.groupBy(*safe).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*owner).orderBy(place[1].desc(), place[0]).rowsBetween(
        Window.unboundedPreceding, -1)
    starts = totals.select(*safe, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*safe).orderBy(*order)
    numbered = binned.withColumn("_rn", F.row_number().over(inner))
    names = [f"_k{n}" for n in range(len(safe))]
    joined = numbered.join(starts, names)
    return joined.withColumn(name, F.col("_start") + F.col("_rn") - 1).drop("_bucket", "_rn", "_start", *names)


def null_free(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """Two helper columns per key, a value without nulls and a null mark, so that grouping, windows and plain joins on
    them share one partitioning and treat null as a key of its own."""
    added: dict[str, Column] = {}
    for n, k in enumerate(keys):
        t = df.schema[k].dataType
        zero = F.lit("") if isinstance(t, T.StringType) else F.lit(0).cast("timestamp") if isinstance(
            t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.lit(0)
        added[f"_k{2 * n}"] = F.coalesce(F.col(k), zero.cast(t))
        added[f"_k{2 * n + 1}"] = F.col(k).isNull()
    return df.withColumns(added), [F.col(c) for c in added]


def with_halo(df: DataFrame, size: int, before: int = 0, after: int = 0, pos: str = "pos") -> DataFrame:
    """Cut each series into blocks of ``size`` positions, with copies of the neighbouring rows.

    Adds ``_block`` and ``_home``; a frame over (key, _block) that looks at most ``before`` rows back and ``after``
    rows ahead sees the same rows as a frame over the whole key. Keep ``_home`` rows afterwards.
    """
    p = F.col(pos)
    first = F.greatest(F.floor((p - after) / size), F.lit(0))
    last = F.floor((p + before) / size)
    return df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_home", F.col("_block") == F.floor(p / size)
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_home").drop("_home", "_block")


def clean_number(c: Column) -> Column:
    """Double with NaN and infinities turned into null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(math.inf)), None).otherwise(d)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact interpolated quantiles as rows ``(keys, column, prob, n, value)``.

    A sketch brackets each wanted rank within 3/accuracy of the rows; only values inside the bracket are sorted,
    everything below collapses into one counted row map-side. No task holds all values of a column or key.
    """
    keys = list(keys)
    ks = [*keys, "column"]
    probs = [float(p) for p in probs]
    margin = 3.0 / accuracy
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), clean_number(F.col(c)).alias("v")) for c in columns])
        ).alias("_cv"),
    ).select(*keys, "_cv.column", "_cv.v")
    long = long.filter(F.col("v").isNotNull())
    low = [max(0.0, p - margin) for p in probs]
    high = [min(1.0, p + margin) for p in probs]
    brackets = long.groupBy(*ks).agg(
        F.count("v").alias("n"),
        F.percentile_approx("v", low, accuracy).alias("_lo"),
        F.percentile_approx("v", high, accuracy).alias("_hi"),
    )
    if not keys:
        brackets = F.broadcast(brackets)  # one row per requested column
    counts = long.groupBy(*ks, "v").agg(F.count(F.lit(1)).alias("c"))
    wanted = F.array(
        *[
            F.struct(F.lit(p).alias("prob"), F.col("_lo")[i].alias("lo"), F.col("_hi")[i].alias("hi"))
            for i, p in enumerate(probs)
        ]
    )
    zoned = (
        null_safe_join(counts, brackets, ks)
        .select(*ks, "n", "v", "c", F.explode(wanted).alias("w"))
        .select(
            *ks, "n", "v", "c", "w.prob",
            F.when(F.col("v") < F.col("w.lo"), -1).when(F.col("v") > F.col("w.hi"), 1).otherwise(0).alias("zone"),
        )
    )
    kept = zoned.groupBy(*ks, "n", "prob", "zone", F.when(F.col("zone") == 0, F.col("v")).alias("inside")).agg(
        F.sum("c").alias("c"), F.min("v").alias("vmin"), F.max("v").alias("vmax")
    )
    kept = kept.withColumn("v", F.when(F.col("zone") < 0, F.col("vmax")).otherwise(F.col("vmin")))
    w = Window.partitionBy(*ks, "prob").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = F.col("prob") * (F.col("n") - 1)
    picked = (
        kept.withColumn("cum", F.sum("c").over(w))
        .groupBy(*ks, "n", "prob")
        .agg(
            F.min(F.when(F.col("cum") >= F.floor(h) + 1, F.col("v"))).alias("a"),
            F.min(F.when(F.col("cum") >= F.ceil(h) + 1, F.col("v"))).alias("b"),
        )
    )
    return picked.select(*ks, "prob", "n", (F.col("a") + (F.col("b") - F.col("a")) * (h - F.floor(h))).alias("value"))


def quantile_scalars(df: DataFrame, column: str, accuracy: int = 10_000, **probs: float) -> dict[str, Column]:
    """Fitted exact quantiles of one column as literals: ``quantile_scalars(df, "x", q1=.25)``."""
    q = quantiles(df, [column], sorted(set(probs.values())), accuracy=accuracy)
    return scalars(q, **{k: F.max(F.when(F.col("prob") == p, F.col("value"))) for k, p in probs.items()})


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    )


def modes(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per key, ties to the smallest; built on distributed value counts."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(column).alias("v")))
    counted = value_counts(df, column, keys)
    agg = counted.groupBy(*keys).agg(best.alias("b")) if keys else counted.agg(best.alias("b"))
    return agg.select(*keys, F.col("b.v").alias(column))


def spread_rows(df: DataFrame, *cols: str, tasks: int | None = None) -> DataFrame:
    """Hash rows over ``tasks`` (the session's shuffle partitions by default) ahead of a join that multiplies them.

    A fixed count keeps adaptive execution from merging the small input into a few tasks that then expand it.
    """
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def tasks_for(df: DataFrame, produced: int, per_task: int = 4_000_000, most: int = 200_000) -> int:
    """Task count for a join that yields ``produced`` rows: at least one per core, about ``per_task`` rows each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(most, math.ceil(produced / per_task)))


def use_all_cores(df: DataFrame) -> DataFrame:
    """Redistribute a plain file scan with fewer splits than cores; larger scans are already split and stay in place."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a side with one row per key. Small sides are broadcast by size; otherwise adaptive execution splits
    the partitions of hot left keys, which is enough because the right side has nothing to repeat."""
    return left.join(right, list(keys), how)


def stored_side(df: DataFrame, most: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """A lookup table written once, and whether it has at most ``most`` rows; it is then marked for broadcast, so the other
    side of a join stays where it is. Spark measures a side only after both were shuffled."""
    stored = materialise(df)
    small = stored.count() <= most
    return (F.broadcast(stored) if small else stored), small


def co_occurrence(
    rows: DataFrame, group: str, member: str, value_cols: Sequence[str], sums: dict[str, Column], cell: int = 512,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Sum expressions over all unordered member pairs that share a group.

    ``rows`` is unique on (group, member). Groups larger than ``cell`` members are cut into chunks and the self-join
    runs on chunk pairs, so no join key holds more than about ``cell`` rows a side; the chunk columns are left out
    when the largest group fits one cell. In ``sums`` the two sides are columns ``l_<name>`` and ``r_<name>``; the
    result is keyed by ``i < j``, with l belonging to i and r to j. ``sized_by`` may name a cheaper frame with the same
    groups for measuring their sizes.
    """
    sizes = (rows if sized_by is None else sized_by).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    measured = sizes.agg(F.max("_n"), F.sum(F.col("_n").cast("double") * F.col("_n"))).first()
    largest, tasks = measured[0] or 0, tasks_for(rows, measured[1] or 0)
    vals = list(value_cols)
    if largest <= cell:
        left = rows.select(
            F.col(group).alias("_g"), F.col(member).alias("i"), *[F.col(c).alias(f"l_{c}") for c in vals])
        right = rows.select(
            F.col(group).alias("_g"), F.col(member).alias("j"), *[F.col(c).alias(f"r_{c}") for c in vals])
        pairs = spread_rows(left, "_g", tasks=tasks).join(spread_rows(right, "_g", tasks=tasks), "_g").filter(F.col("i") < F.col("j"))
        return pairs.groupBy("i", "j").agg(*[c.alias(n) for n, c in sums.items()])
    big = sizes.filter(F.col("_n") > cell).select(group, F.ceil(F.col("_n") / cell).cast("int").alias("_chunks"))
    cut = rows.join(big, group, "left").select(
        group, member, *vals, F.coalesce("_chunks", F.lit(1)).alias("_chunks"),
    ).withColumn("_chunk", F.pmod(F.xxhash64(member), F.col("_chunks")).cast("int"))
    left = cut.select(
        F.col(group).alias("_g"), F.col("_chunk").alias("_a"),
        F.explode(F.sequence(F.col("_chunk"), F.col("_chunks") - 1)).alias("_b"),
        F.col(member).alias("x"), *[F.col(c).alias(f"x_{c}") for c in vals],
    )
    right = cut.select(
        F.col(group).alias("_g"), F.explode(F.sequence(F.lit(0), F.col("_chunk"))).alias("_a"),
        F.col("_chunk").alias("_b"),
        F.col(member).alias("y"), *[F.col(c).alias(f"y_{c}") for c in vals],
    )
    keys = ["_g", "_a", "_b"]
    pairs = spread_rows(left, *keys, tasks=tasks).join(spread_rows(right, *keys, tasks=tasks), keys).filter(
        (F.col("_a") < F.col("_b")) | (F.col("x") < F.col("y")))
    swap = F.col("x") > F.col("y")
    pairs = pairs.select(
        F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"),
        *[F.when(swap, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(f"l_{c}") for c in vals],
        *[F.when(swap, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"r_{c}") for c in vals],
    )
    return pairs.groupBy("i", "j").agg(*[c.alias(n) for n, c in sums.items()])


def mirrored(pairs: DataFrame, swap: dict[str, str] | None = None) -> DataFrame:
    """Ordered pairs from unordered ones; ``swap`` names columns that trade places with the direction."""
    swap = swap or {}
    other = [c for c in pairs.columns if c not in ("i", "j")]
    both = F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j"), *[F.col(c).alias(c) for c in other]),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *[F.col(swap.get(c, c)).alias(c) for c in other]),
    )
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def distinct_counts(df: DataFrame, key: str, rows_per_task: int = 50_000, **columns: str) -> DataFrame:
    """Distinct non-null values of columns per non-null key: ``(key, *names)``, ``columns`` maps a name to its column.

    A row travels once, to the task of its key, which counts all columns in place; ``count(DISTINCT)`` would move a row for
    each column, twice. Keys with more than ``rows_per_task`` rows take that way: their rows meet by value first.
    """
    rows = df.select(key, *dict.fromkeys(columns.values())).filter(F.col(key).isNotNull())
    hot = F.broadcast(  # at most one row for each rows_per_task rows
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task).select(key))
    cold = rows.join(hot, key, "left_anti").repartition(key).groupBy(key).agg(
        *[F.size(F.collect_set(c)).cast("long").alias(n) for n, c in columns.items()])  # at most rows_per_task values
    many = rows.join(hot, key, "left_semi").groupBy(key).agg(*[F.countDistinct(c).alias(n) for n, c in columns.items()])
    return cold.unionByName(many).groupBy(key).agg(*[F.max(n).alias(n) for n in columns])


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def block_count(df: DataFrame, size: int) -> Column:
    """Number of hash blocks of about ``size`` rows."""
    return scalars(df, b=F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int"))["b"]


def range_bucketed(df: DataFrame, *order: str, name: str = "_bucket") -> DataFrame:
    """Rows cut into ordered range partitions of similar size, the partition number in ``name``.

    Works for any sortable columns and splits hot leading values by the later columns. The cut points come from
    sampling, so the result is written once; every consumer then sees the same cut.
    """
    return materialise(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def running_total(bucketed: DataFrame, order: Sequence[str], weight: Column, name: str, bucket: str = "_bucket"):
    """Sum of ``weight`` over all earlier rows in the global order of a ``range_bucketed`` frame."""
    totals = bucketed.groupBy(bucket).agg(F.sum(weight).alias("_t"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = totals.select(bucket, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.withColumn("_before", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(starts, bucket)
        .withColumn(name, F.col("_start") + F.col("_before"))
        .drop("_start", "_before")
    )


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """``(column, n, rank)`` per distinct value: 1-based rank, ties averaged; no global sort in one task."""
    counts = value_counts(df, column)
    placed = running_total(range_bucketed(counts, column), [column], F.col("n"), "_less")
    return placed.select(column, "n", (F.col("_less") + (F.col("n") + 1) / 2).alias("rank"))


def dense_codes(df: DataFrame, column: str, name: str = "_code") -> DataFrame:
    """``(column, code)`` numbering the distinct non-null values 0.. in sorted order."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    placed = running_total(range_bucketed(values, column), [column], F.lit(1), name)
    return placed.select(column, F.col(name).cast("long").alias(name))


def neighbour_values(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], pos: str = "pos", block: int = 100_000
) -> DataFrame:
    """Nearest earlier and later non-null value of each column, as structs ``prev_<c>`` / ``next_<c>`` of (v, p).

    Blocks of positions are scanned on their own; block ends are carried over through a short per-block table. The
    row's own value counts for both directions.
    """
    keys = list(keys)
    blocked = df.withColumn("_blk", F.floor(F.col(pos) / block))
    kb = [*keys, "_blk"]
    back = Window.partitionBy(*kb).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*kb).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)

    def point(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(pos).alias("p")))

    inside = blocked.withColumns(
        {
            **{f"prev_{c}": F.last(point(c), ignorenulls=True).over(back) for c in columns},
            **{f"next_{c}": F.first(point(c), ignorenulls=True).over(ahead) for c in columns},
        }
    )
    ends = blocked.groupBy(*kb).agg(
        *[F.max_by(point(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"l_{c}") for c in columns],
        *[F.min_by(point(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"f_{c}") for c in columns],
    )
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(
        *kb,
        *[F.last(f"l_{c}", ignorenulls=True).over(earlier).alias(f"cl_{c}") for c in columns],
        *[F.first(f"f_{c}", ignorenulls=True).over(later).alias(f"cf_{c}") for c in columns],
    )
    joined = null_safe_join(inside, carry, kb)
    return joined.withColumns(
        {
            **{f"prev_{c}": F.coalesce(f"prev_{c}", f"cl_{c}") for c in columns},
            **{f"next_{c}": F.coalesce(f"next_{c}", f"cf_{c}") for c in columns},
        }
    ).drop("_blk", *[f"cl_{c}" for c in columns], *[f"cf_{c}" for c in columns])
