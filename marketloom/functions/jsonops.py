"""JSON text columns: parse with repair, flatten to paths, extract fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import materialise

LIST_SUFFIXES = ("_list", "_array")


def is_list_column(name: str) -> bool:
    return name == "categories" or name.endswith(LIST_SUFFIXES)


def repaired(text: Column) -> Column:
    """Collapse doubled and escaped quotes, the two kinds of damage seen in exported text."""
    return F.replace(F.replace(text, F.lit('""'), F.lit('"')), F.lit('\\"'), F.lit('"'))


def parsed_json(text: Column, ddl: str) -> Column:
    """Value of JSON text, after one repair attempt; null when it stays unreadable or has another shape."""
    opener = "[" if ddl.startswith("array") else "{"

    def attempt(t: Column) -> Column:
        ok = F.try_parse_json(t).isNotNull() & F.ltrim(t).startswith(opener)
        return F.when(ok, F.from_json(t, ddl))

    return F.coalesce(attempt(text), attempt(repaired(text)))


def parse_json_columns(
    df: DataFrame, columns: list[str], on_error: str = "empty", flatten: bool = False, most_keys: int = 1000
) -> DataFrame:
    """JSON text to ``array<string>`` (list-named columns) or ``map<string,string>``.

    With ``flatten`` every map column gives way to one column ``<column>.<key>`` for each key that occurs; more than
    ``most_keys`` keys raise ``ValueError``.

    Null, empty and unreadable text becomes an empty value; ``on_error='null'`` keeps null for unreadable text and
    ``on_error='raise'`` fails the query on it.
    """
    out = {}
    for c in columns:
        if c not in df.columns:
            continue
        ddl = "array<string>" if is_list_column(c) else "map<string,string>"
        empty = F.array().cast(ddl) if is_list_column(c) else F.create_map().cast(ddl)
        blank = F.col(c).isNull() | (F.trim(c) == "")
        value = parsed_json(F.col(c), ddl)
        if on_error == "null":
            out[c] = F.when(blank, empty).otherwise(value)
        elif on_error == "raise":
            message = F.concat(F.lit(f"unreadable JSON in {c}: "), F.col(c))
            out[c] = F.when(blank, empty).otherwise(F.coalesce(value, F.raise_error(message).cast(ddl)))
        else:
            out[c] = F.coalesce(F.when(~blank, value), empty)
    parsed = df.withColumns(out)
    for c in [c for c in out if flatten and not is_list_column(c)]:
        keys = [r[0] for r in parsed.select(F.explode(F.map_keys(F.col(c))).alias("k")).distinct().limit(most_keys + 1).collect()]
        if len(keys) > most_keys:
            raise ValueError(f"{c} has more than {most_keys} keys")
        parsed = parsed.withColumns({f"{c}.{k}": F.try_element_at(F.col(c), F.lit(k)) for k in sorted(keys)}).drop(c)
    return parsed


def flatten_struct(df: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """Known schema: every leaf below a struct column becomes a column named by its path."""

    def leaves(t: T.DataType, path: list[str]):
        if isinstance(t, T.StructType):
            for f in t.fields:
                yield from leaves(f.dataType, [*path, f.name])
        else:
            yield path

    field = next(f for f in df.schema if f.name == column)
    keep = [F.col(c) for c in df.columns if c != column]
    parts = [
        F.col(".".join(f"`{p}`" for p in [column, *path])).alias(separator.join(path))
        for path in leaves(field.dataType, [])
    ]
    return df.select(*keep, *parts)


def flatten_json(df: DataFrame, key: str, column: str, depth: int, separator: str = ".") -> DataFrame:
    """Unknown schema: ``(key, path, value)`` rows for every leaf, paths like ``a.b`` and ``a[0]``.

    Each level explodes objects and arrays one step; ``depth`` is the deepest nesting to open. A row that is still
    nested after ``depth`` steps is kept with its JSON text as value. A string leaf stays as it is, also one that starts
    with a bracket, unless all of it is one JSON value. Empty objects and arrays have no leaf.
    """
    rows = df.select(key, F.lit("").alias("path"), F.col(column).alias("value"))
    for _ in range(depth):
        as_map = F.from_json("value", "map<string,string>")
        as_list = F.from_json("value", "array<string>")
        wrapped = F.concat(F.lit("["), "value", F.lit("]"))  # readers ignore what follows a value; a list of it doesn't
        single = F.try_parse_json(wrapped).isNotNull() & (F.size(F.from_json(wrapped, "array<string>")) == 1)
        is_map = F.ltrim("value").startswith("{") & single
        is_list = F.ltrim("value").startswith("[") & single
        dotted = lambda k: F.when(F.col("path") == "", k).otherwise(F.concat("path", F.lit(separator), k))
        children = (
            F.when(is_map, F.transform(
                F.map_entries(as_map), lambda e: F.struct(dotted(e["key"]).alias("p"), e["value"].alias("v"))))
            .when(is_list, F.transform(
                as_list,
                lambda v, n: F.struct(
                    F.concat("path", F.lit("["), n.cast("string"), F.lit("]")).alias("p"), v.alias("v"))))
            .otherwise(F.array(F.struct(F.col("path").alias("p"), F.col("value").alias("v"))))
        )
        rows = rows.select(key, F.explode(children).alias("c")).select(
            key, F.col("c.p").alias("path"), F.col("c.v").alias("value"))
    return rows


def walk_json(df: DataFrame, key: str, column: str, separator: str = ".") -> DataFrame:
    """Unknown schema and depth: ``(key, path, value)`` rows for every leaf, paths like ``a.b`` and ``a[0]``.

    The text is parsed once. Each round opens one level of what is still nested, and the walk ends when nothing is, so
    branches of unequal depth cost only their own levels; rounds are as many as the deepest value has levels. Strings
    are leaves whatever they hold; numbers have their shortest form, JSON null is a null value. Empty objects and arrays
    have no leaf. Unreadable text (also an object that repeats a key) and null are one leaf with an empty path.
    """
    parsed = F.try_parse_json(F.col(column))
    rows = df.select(
        F.col(key).alias("_key"), F.lit("").alias("path"), parsed.alias("v"),
        F.when(parsed.isNull(), F.col(column)).alias("text"))
    leaves = []
    while True:
        fields = F.try_variant_get("v", "$", "map<string,variant>")
        elements = F.try_variant_get("v", "$", "array<variant>")
        opened = materialise(rows.withColumns({"m": fields, "l": elements}).withColumn(
            "nested", F.col("m").isNotNull() | F.col("l").isNotNull()))
        leaves.append(opened.filter("NOT nested").select(
            F.col("_key").alias(key), "path", F.coalesce("text", F.try_variant_get("v", "$", "string")).alias("value")))
        nested = opened.filter("nested")
        if nested.isEmpty():
            return reduce(lambda x, y: x.unionByName(y), leaves)
        dotted = lambda k: F.when(F.col("path") == "", k).otherwise(F.concat("path", F.lit(separator), k))
        below = F.when(
            F.col("m").isNotNull(),
            F.transform(F.map_entries("m"), lambda e: F.struct(dotted(e["key"]).alias("p"), e["value"].alias("v")))
        ).otherwise(F.transform("l", lambda v, n: F.struct(
            F.concat("path", F.lit("["), n.cast("string"), F.lit("]")).alias("p"), v.alias("v"))))
        rows = nested.select("_key", F.explode(below).alias("c")).select(
            "_key", F.col("c.p").alias("path"), F.col("c.v").alias("v"), F.lit(None).cast("string").alias("text"))


def extract_nested(
    df: DataFrame, column: str, fields: list[str], prefix: str | None = None, keep_original: bool = False,
    flatten_lists: bool = False, errors: str = "ignore",
) -> DataFrame:
    """Dotted-path fields of JSON text as ``<prefix><field>`` string columns.

    A missing field is null. Unreadable text gives nulls, or with ``errors='raise'`` fails the query.

    With ``flatten_lists`` each field that holds a JSON list is exploded on its own, and the exploded variants are
    unioned and deduplicated, as many rows per input row as there are list elements. Which fields hold lists is read
    from the data in one aggregation.
    """
    if errors not in ("ignore", "raise"):
        raise ValueError(f"unknown error mode {errors!r}")
    if errors == "raise":
        bad = F.col(column).isNotNull() & F.try_parse_json(column).isNull()
        message = F.concat(F.lit(f"unreadable JSON in {column}: "), F.col(column))
        df = df.withColumn(column, F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col(column)))
    prefix = f"{column}_" if prefix is None else prefix
    names = [f"{prefix}{f}" for f in fields]
    out = df.withColumns({n: F.get_json_object(column, f"$.{f}") for n, f in zip(names, fields)})
    if flatten_lists:
        seen = out.agg(*[F.max(F.col(f"`{n}`").startswith("[")).alias(str(p)) for p, n in enumerate(names)]).first()
        listed = [n for p, n in enumerate(names) if seen[p]]
        variants = []
        for n in listed:
            c = F.col(f"`{n}`")
            one = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
            variants.append(out.withColumn(n, F.explode_outer(one)))
        if variants:
            out = reduce(lambda a, b: a.unionByName(b), variants).distinct()
    return out if keep_original else out.drop(column)
