"""Scans of huge JSON arrays and maps that are one document a file, by several tasks.

Spark cuts a file into byte ranges and deals out what stands between two closing braces,
so a range begins anywhere: within a record, or within a string. A first pass says of
each range, for either case (it begins within a string or not), how it ends, how the
depth of braces changes and how low it comes. Put together in the file's order, a row a
range, that gives every range its true start; a second pass cuts the records. What a
record leaves in several ranges is joined by the range in which it begins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPED = re.compile(rb"\\.", re.S)
LOW = 1 << 40


def _outside(piece: bytes, within: bool) -> tuple[int, bool]:
    """(braces opened outside of strings, whether the piece ends within a string)."""
    parts = _ESCAPED.sub(b"", piece).split(b'"')
    return sum(p.count(b"{") for p in parts[within::2]), within ^ (len(parts) % 2 == 0)


def _ranges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    for b in batches:
        yield from (((f, s), p) for p, f, s in zip(b["piece"].to_pylist(), b["file"].to_pylist(), b["start"].to_pylist(), strict=True))


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list[list[int]]] = {}
    for at, piece in _runs(batches):  # a few ranges a task
        both = found.setdefault(at, [[0, 0, LOW], [1, 0, LOW]])
        for case in both:
            opened, within = _outside(piece, bool(case[0]))
            case[0], case[1] = int(within), case[1] + opened
            if not within:
                case[1] -= 1
                case[2] = min(case[2], case[1])
    rows = [(f, s, *a, *b) for (f, s), (a, b) in found.items()]
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["file", "start", "end0", "depth0", "low0", "end1", "depth1", "low1"])


def _starts(rows: list, base: int) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(within a string, depth, the range in which the open record began) of each range's start."""
    files = defaultdict(list)
    for r in rows:
        files[r[0]].append(tuple(r)[1:])
    out = {}
    for file, parts in files.items():
        within, depth, owner = 0, 0, 0
        for start, *cases in sorted(parts):
            end, change, low = cases[3 * within : 3 * within + 3]
            out[file, start] = (bool(within), depth, owner)
            if depth + low <= base:
                owner = start
            within, depth = end, depth + change
    return out


def _cut(starts: dict, base: int) -> Callable:
    """Whole records (owner null) and pieces of records that cross ranges (owner: where the record began)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, within, depth, owner, held, head = None, False, 0, 0, [], True
        out: list[tuple] = []

        def flush() -> None:
            if held and at is not None:
                out.append((at[0], at[1], starts[at][2] if head else at[1], False, b"}".join(held)))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "owner", "closed", "piece"])

        for where, piece in _runs(batches):
            if where != at:
                flush()
                at, held, head = where, [], True
                within, depth, owner = starts[at]
            opened, within = _outside(piece, within)
            depth += opened
            held.append(piece)
            if not within:
                depth -= 1
                if depth == base:
                    out.append((at[0], at[1], owner if head and at[1] else None, True, b"}".join(held)))
                    held, head = [], False
                    if len(out) >= 2000:
                        yield batch()
        flush()
        yield batch()

    return run


def _records(spark: SparkSession, path: str | list[str], base: int) -> DataFrame:
    """(file, text) of every record; text lacks its last brace and may begin with what separates records."""
    ranges = _ranges(spark, path)
    kinds = "file string, start long, end0 long, depth0 long, low0 long, end1 long, depth1 long, low1 long"
    starts = _starts(ranges.mapInArrow(_summarise, kinds).collect(), base)  # a row a range of the files
    cut = ranges.mapInArrow(_cut(starts, base), "file string, start long, owner long, closed boolean, piece binary")
    whole = cut.filter("owner IS NULL").select("file", F.col("piece").cast("string").alias("text"))
    parts = cut.filter("owner IS NOT NULL").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "closed"))).alias("ps"), F.max("closed").alias("closed"))
    joined = F.array_join(F.transform("ps", lambda p: p["piece"].cast("string")), "}")
    # what follows the last record of a file is a closing bracket or brace, and no record
    rest = F.regexp_replace(joined, r"\A[\s\[\]{},]*", "")
    sound = F.when(F.col("closed") | (rest == ""), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("cut JSON in "), F.col("file"))).cast("boolean"))
    return whole.unionByName(parts.filter(sound).filter("closed").select("file", joined.alias("text")))


def json_array(spark: SparkSession, path: str | list[str], schema: str, explode: str | None = None) -> DataFrame:
    """Rows of files that are one JSON array of objects each, read by as many tasks as Spark cuts the files into.

    A file that is cut, elements that are no objects and records that don't parse raise.
    """
    text = F.regexp_replace("text", r"\A\s*[\[,]?\s*", "")
    whole = F.when(text.startswith("{"), F.concat(text, F.lit("}"))).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), text)))
    df = _records(spark, path, 0).select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")
    return df.select(F.inline(explode)) if explode else df


def json_map(spark: SparkSession, path: str | list[str], value: str, key: str = "key") -> DataFrame:
    """A row for each entry of files that are one JSON object of objects each: its key, and the fields of the DDL value."""
    text = F.regexp_replace("text", r"\A\s*[{,]?\s*", "")
    entry = F.from_json(F.concat(F.lit("{"), text, F.lit("}}")), f"map<string, struct<{value}>>", {"mode": "FAILFAST"})
    return _records(spark, path, 1).select(F.explode(entry).alias(key, "v")).select(key, "v.*")
