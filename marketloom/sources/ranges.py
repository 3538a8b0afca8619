"""Large JSON arrays and archived CSV files, read in parallel without holding a file in memory (IO1, IO3).

Files are opened on the executors through pyarrow's file systems; the driver only lists their names and sizes.
"""

from __future__ import annotations

import lzma
import math
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.jsonops import repaired
from marketloom.sources.files import list_files

RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
MOST_TASKS = 200_000
ESCAPED = re.compile(rb"\\.", re.DOTALL)
QUOTED = {"escape": '"'}  # a quote inside quotes is doubled


def opened(uri: str) -> pa.NativeFile:
    """A file by the name Spark gives it (``file:/a`` or ``scheme://host/a``)."""
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return system.open_input_file(path)


# --- arrays -------------------------------------------------------------------------------------------------------


def unescaped(data: bytes, before: bytes = b"") -> bytes:
    """Escape sequences blanked out. ``before`` are the bytes in front, whose last backslash may escape the first byte."""
    if (len(before) - len(before.rstrip(b"\\"))) % 2:
        data = b"_" + data[1:]
    return ESCAPED.sub(b"__", data)


def structure(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """For blanked bytes: which lie outside of strings (their quotes included), and the change of depth at each."""
    codes = np.frombuffer(data, np.uint8)
    quotes = codes == 0x22
    open_ = (np.cumsum(quotes) + inside) % 2 == 1
    out = ~open_ & ~quotes
    return out, ((codes == 0x5B) | (codes == 0x7B)).astype(np.int64) * out - ((codes == 0x5D) | (codes == 0x7D)) * out


def _block(file: pa.NativeFile, start: int, size: int) -> tuple[bytes, bytes]:
    """Bytes of a range, and those in front of it that end in all its backslashes."""
    back = 64
    while True:
        first = max(0, start - back)
        file.seek(first)
        before = file.read(start - first)
        if first == 0 or before.strip(b"\\"):
            break
        back *= 16
    return file.read(size), before


def summarised(file: pa.NativeFile, start: int, size: int) -> tuple[bool, int, int]:
    """What a range does to the state: odd quotes, change of depth if it starts outside and if it starts inside a string."""
    data, before = _block(file, start, size)
    data = unescaped(data, before)
    return data.count(b'"') % 2 == 1, *(int(structure(data, inside)[1].sum()) for inside in (False, True))


def records(file: pa.NativeFile, start: int, size: int, inside: bool, depth: int) -> Iterator[tuple[int, bytes]]:
    """Places and bytes of the elements of the top-level array whose separator lies in the range.

    The separator is the opening bracket or the comma in front of the element. The last element may end far behind the
    range; it is read on in blocks.
    """
    raw, before = _block(file, start, size)
    data = unescaped(raw, before)
    at, held, began = start, [], None
    while data:
        out, change = structure(data, inside)
        level = depth + np.cumsum(change)
        codes = np.frombuffer(data, np.uint8)
        opens = out & (codes == 0x5B) & (level == 1)
        commas = out & (codes == 0x2C) & (level == 1)
        ends = out & (codes == 0x5D) & (level == 0)
        last = 0
        for place in np.flatnonzero(opens | commas | ends).tolist():
            if began is not None:
                yield began, b"".join([*held, raw[last:place]])
                held = []
            began, last = None, place + 1
            if not ends[place]:
                if at + place >= start + size:
                    return
                began = at + place
        if began is None and at + len(data) >= start + size:
            return
        if began is not None:
            held.append(raw[last:])
        inside ^= data.count(b'"') % 2 == 1
        depth = int(level[-1])
        at += len(data)
        raw, before = _block(file, at, READ_BYTES if at >= start + size else start + size - at)
        data = unescaped(raw, before)


def read_json_array(
    spark: SparkSession, path: str, schema: str | T.StructType, flatten: bool = False, range_bytes: int = RANGE_BYTES,
    corrupt: str | None = None,
) -> DataFrame:
    """Files that hold one JSON array each, however large: cut into byte ranges and parsed in parallel (IO3).

    A first pass finds for every range what it does to the state of a scan (inside a string or not, depth); the states at
    the starts of all ranges follow from running sums, and a second pass cuts the elements. An element that can't be read is
    read again with its quotes repaired; then it becomes a row of nulls, its text in the column ``corrupt`` if one is named.
    ``flatten`` gives every leaf of nested objects a column of its own (``a.b``). An unescaped quote inside a text confuses the
    scan from there on. Files without an array give no rows.
    """
    files = list_files(spark, path, recursive=True).filter("length > 0")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(
        range_bytes).cast("long"))).alias("start"))
    ranges, size = cut.agg(F.count(F.lit(1)), F.sum(F.least(F.col("length") - F.col("start"), F.lit(range_bytes)))).first()
    cores = spark.sparkContext.defaultParallelism
    # a fixed number: the rows are tiny, what they stand for is not; small ranges share tasks of about RANGE_BYTES
    tasks = max(1, min(MOST_TASKS, ranges, max(4 * cores, math.ceil((size or 0) / RANGE_BYTES))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri, start in zip(*[c.to_pylist() for c in batch.columns]):
                with opened(uri) as file:
                    found.append((uri, start, *summarised(file, start, range_bytes)))
            columns = list(zip(*found)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["path", "start", "odd", "outside", "within"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, inside, depth in zip(*[c.to_pylist() for c in batch.columns]):
                with opened(uri) as file:
                    held, size = [], 0
                    for place, text in records(file, start, range_bytes, inside, depth):
                        if text.strip():
                            held.append((uri, place, text.decode("utf-8", "replace")))
                            size += len(text)
                        if size >= READ_BYTES:
                            yield rows(held)
                            held, size = [], 0
                    yield rows(held)

    def rows(held: list) -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))],
                                          names=["path", "place", "text"])

    effects = cut.repartition(tasks, "path", "start").select("path", "start").mapInArrow(scan, "path string, start long, odd boolean, outside long, within long")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    inside = effects.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(earlier), F.lit(0)) % 2 == 1)
    states = inside.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("within")).otherwise(
        F.col("outside"))).over(earlier), F.lit(0)))
    texts = states.repartition(tasks, "path", "start").select("path", "start", "inside", "depth").mapInArrow(
        split, "path string, place long, text string")
    whole = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    readable = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, whole))
    value = F.coalesce(readable(F.col("text")), readable(repaired(F.col("text"))))
    parsed = texts.withColumn("_value", value)
    lost = [F.when(F.col("_value").isNull(), F.col("text")).alias(corrupt)] if corrupt else []
    out = parsed.select("_value.*", *lost)
    return out.select(*leaves(whole, []), *([corrupt] if corrupt else [])) if flatten else out


def leaves(t: T.StructType, path: list[str]) -> Iterator[Column]:
    """Every leaf of nested objects, named by its path."""
    for f in t.fields:
        at = [*path, f.name]
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, at)
        else:
            yield F.col(".".join(f"`{p}`" for p in at)).alias(".".join(at))


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One JSON array for each partition, an element a line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = "["
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(sep + text)
                sep = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if sep == "," else "[]"])], names=["value"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(lines, "value string").write.text(path)


# --- archives -----------------------------------------------------------------------------------------------------


def members(uri: str) -> list[str]:
    """Names of the files in an archive; an xz file holds one without a name."""
    if not uri.lower().endswith(".zip"):
        return [""]
    with opened(uri) as file, zipfile.ZipFile(file) as archive:
        return [m.filename for m in archive.infolist() if not m.is_dir()]


def csv_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records of a CSV stream; a line end inside quotes belongs to its record."""
    rest, held = b"", b""
    for chunk in chunks:
        *lines, rest = (rest + chunk).split(b"\n")
        for line in lines:
            held = held + b"\n" + line if held else line
            if held.count(b'"') % 2 == 0:
                yield held.rstrip(b"\r")
                held = b""
    last = (held + b"\n" + rest if held else rest).rstrip(b"\r")
    if last:
        yield last


def _chunks(uri: str, member: str) -> Iterator[bytes]:
    with opened(uri) as file:
        if member:
            with zipfile.ZipFile(file) as archive, archive.open(member) as stream:
                yield from iter(lambda: stream.read(READ_BYTES), b"")
        else:
            with lzma.open(file) as stream:
                yield from iter(lambda: stream.read(READ_BYTES), b"")


def read_archived_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8", header: bool = True, **options,
) -> DataFrame:
    """CSV in ``.zip`` and ``.xz`` files: one task for each archive member, read as a stream (IO1).

    Columns follow ``schema`` in order; a header line is skipped, lines that don't fit and empty lines are dropped.
    """
    listed = list_files(spark, path, recursive=True).filter(F.lower("path").rlike(r"\.(zip|xz)$")).select("path")

    def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(uri, name) for uri in batch.column(0).to_pylist() for name in members(uri)]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.string()) for c in (0, 1)], names=["path", "member"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, member in zip(*[c.to_pylist() for c in batch.columns]):
                held, size = [], 0
                for n, record in enumerate(csv_records(_chunks(uri, member))):
                    if record and not (header and n == 0):
                        held.append(record.decode(encoding, "replace"))
                        size += len(record)
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["line"])
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["line"])

    named = listed.repartition(max(1, min(MOST_TASKS, listed.count()))).mapInArrow(list_members, "path string, member string")
    named = named.repartition(max(1, min(MOST_TASKS, named.count())), "path", "member")
    text = named.mapInArrow(lines, "line string")
    whole = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "_loom_bad"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*whole.fields, T.StructField(bad, T.StringType())])
    parsed = text.select(F.from_csv("line", ddl, {**QUOTED, **options, "columnNameOfCorruptRecord": bad}).alias("v"))
    return parsed.select("v.*").filter(F.col(bad).isNull()).drop(bad)


def write_archived_csv(df: DataFrame, folder: str, kind: str = "zip") -> None:
    """One archive for each partition below ``folder``, a path all executors share; a retried task writes its file anew."""
    names = df.columns
    folder = re.sub(r"^file:/+", "file:///", folder if ":" in folder else f"file://{folder}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/part-{number:05d}.{kind}") as file:
            if kind == "zip":
                with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(f"part-{number:05d}.csv", "w") as out:
                    fill(out, batches)
            else:
                with lzma.open(file, "w") as out:
                    fill(out, batches)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], names=["part"])

    def fill(out, batches: Iterator[pa.RecordBatch]) -> None:
        out.write((",".join(names) + "\n").encode())
        for batch in batches:
            out.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())

    df.select(F.to_csv(F.struct(*names), QUOTED).alias("line")).mapInArrow(write, "part int").count()
