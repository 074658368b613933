"""Scans: JSON arrays and maps, JSON lines strict and lenient, TSV, path lists, globs, bundles, configurations.

Paths go through Hadoop's file systems, so they may lie anywhere that Spark can read.
Schemas are given, never inferred from the data.
"""

from __future__ import annotations

import ast
import json
import logging
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tessella.functions.text import title_and_body

log = logging.getLogger(__name__)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a glob, sorted; none is an error."""
    p, fs = _path(spark, pattern)
    found = sorted(str(s.getPath()) for s in fs.globStatus(p) or [])
    if not found:
        raise FileNotFoundError(pattern)
    return found


def existing(spark: SparkSession, paths: str) -> list[str]:
    """The paths of a comma-separated list; missing ones are warned of and left out."""
    every = [p.strip() for p in paths.split(",") if p.strip()]
    missing = [p for p in every if not exists(spark, p)]
    for p in missing:
        log.warning("skipped, as it does not exist: %s", p)
    return [p for p in every if p not in missing]


def json_array(spark: SparkSession, path: str | list[str], schema: str, explode: str | None = None) -> DataFrame:
    """Rows of files that are one JSON array each (or one object); explode: an array column whose elements become the rows."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select(F.inline(explode)) if explode else df


def json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """A row for each entry of a JSON object of records: its key, and the fields of the DDL value."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", f"map<string, struct<{value}>>", {"mode": "FAILFAST"}))
    return whole.select(entries.alias(key, "v")).select(key, "v.*")


def union_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON arrays of several files, each row with the place of its file; a bad or missing file is reported and left out."""
    parts = []
    for i, p in enumerate(paths):
        try:
            df = json_array(spark, p, schema)
            df.write.format("noop").mode("overwrite").save()  # read it all: rows of a file that breaks later must not stay
            parts.append(df.withColumn("file_index", F.lit(i)))
        except Exception as e:  # noqa: BLE001
            log.warning("skipped %s: %s", p, str(e).splitlines()[0])
    if not parts:
        return spark.createDataFrame([], f"{schema}, file_index int")
    return reduce(DataFrame.unionByName, parts)


def jsonl(spark: SparkSession, path: str | list[str], schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines. strict: a blank, cut or non-object line is an error; lenient: blanks are skipped; any: whatever can't be read is skipped."""
    if mode not in ("strict", "lenient", "any"):
        raise ValueError(f"unknown mode: {mode}")
    lines = spark.read.text(path)
    blank = F.trim("value") == ""
    if mode != "strict":
        lines = lines.filter(~blank)
    fits = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    if mode == "any":
        return lines.filter(fits).select(F.from_json("value", schema).alias("v")).select("v.*")
    whole = F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("value"))))
    return lines.select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")


def jsonl_slice(spark: SparkSession, path: str, schema: str, start: int = 0, most: int | None = None, id_col: str = "id") -> DataFrame:
    """Non-blank lines from `start` on, `most` at most, in order; a missing id is the line's running number.

    The numbers are counts of the lines before, per file and input partition, so that
    no task holds the whole table.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).filter(F.trim("value") != "")
    part = F.shiftright("at", 33)
    counts = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per input partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    numbered = lines.withColumn("part", part).withColumn("place", place).join(F.broadcast(before), "part").withColumn("index", F.col("place") + F.col("before"))
    wanted = numbered.filter((F.col("index") >= start) & (F.lit(True) if most is None else F.col("index") < start + most))
    rows = wanted.select("index", F.from_json("value", schema).alias("v")).select("index", "v.*")
    return rows.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), F.col("index").cast("string")))


def passages(df: DataFrame, contents: str = "contents") -> DataFrame:
    """df with title and text in place of contents."""
    title, body = title_and_body(F.col(contents))
    return df.withColumns({"title": title, "text": body}).drop(contents)


def tsv(spark: SparkSession, path: str, schema: str = "id string, text string, title string") -> DataFrame:
    """Tab-separated rows under a header line; quoted fields may hold tabs and line breaks."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, JSON lines or a JSON array, by the path's ending."""
    if path.endswith(".jsonl"):
        return jsonl(spark, path, schema, "lenient")
    if path.endswith(".json"):
        return json_array(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def bundles(spark: SparkSession, dirs: list[str], schema: str, keys: list[str]) -> DataFrame:
    """sample_*.json files of run directories, sorted by their keys; a sample that occurs twice is an error."""
    df = json_array(spark, [f for d in dirs for f in expand(spark, f"{d}/sample_*.json")], schema)
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a sample occurs more than once: {twice[0].asDict()}")
    return df.orderBy(*keys)


def _scalar(text: str):
    """A YAML scalar: quoted text, a JSON value, an inline list or map of plain words, or plain text."""
    t = re.sub(r"""\A("(?:[^"\\]|\\.)*"|'(?:[^']|\'\')*'|.*?)(?:\s+\#.*)?\Z""", r"\1", text.strip(), flags=re.S)
    if t[:1] == t[-1:] == "'" and len(t) > 1:
        return t[1:-1].replace("''", "'")
    if t.lower() in ("", "~", "null"):
        return None
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    try:
        return json.loads(t)
    except ValueError:
        if t[0] == "[" and t[-1] == "]":
            return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
        if t[0] == "{" and t[-1] == "}":
            return {k.strip(): _scalar(v) for k, _, v in (x.partition(":") for x in t[1:-1].split(",") if x.strip())}
        return t


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[object, int]:
    """(the map or list whose lines begin at `at` with that indent, the next line)."""
    items, pairs = [], {}
    while at < len(lines) and lines[at][0] == indent:
        line = lines[at][1]
        if line == "-" or line.startswith("- "):
            inner = line[1:].lstrip()
            if re.match(r"[^\s\"'\[{][^:]*:(?:\s|$)", inner):  # a map that begins behind the dash
                lines[at] = (indent + len(line) - len(inner), inner)
                value, at = _block(lines, at, lines[at][0])
            elif inner:
                value, at = _scalar(inner), at + 1
            else:
                value, at = _block(lines, at + 1, lines[at + 1][0]) if at + 1 < len(lines) and lines[at + 1][0] > indent else (None, at + 1)
            items.append(value)
            continue
        if items:  # a list that stands no deeper than its key
            break
        key, colon, rest = line.partition(":")
        if not colon or (rest and not rest[0].isspace()):
            raise ValueError(f"not a YAML key: {line}")
        at += 1
        rest = "" if rest.strip().startswith("#") else rest
        deeper = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-")))
        if rest.strip() or not deeper:
            pairs[_scalar(key)] = _scalar(rest)
        else:
            pairs[_scalar(key)], at = _block(lines, at, lines[at][0])
    if at < len(lines) and lines[at][0] > indent:
        raise ValueError(f"wrong indent: {lines[at][1]}")
    return items or pairs, at


def config(spark: SparkSession, path: str, overlay: dict | None = None) -> dict:
    """A JSON configuration or a YAML one (maps, lists and scalars by indentation; no anchors, tags or block texts), overlaid by the given values."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        base = json.loads(text)
    else:
        lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and x.strip() != "---" and not x.lstrip().startswith("#")]
        base, at = _block(lines, 0, lines[0][0]) if lines else ({}, 0)
        if at < len(lines):
            raise ValueError(f"wrong indent: {lines[at][1]}")
    return {**base, **(overlay or {})}


def gold_rows(payload: Column, row: str) -> Column:
    """Array of records of {rows: [{row}]}, {data: []} or []; anything else, or a row that is missing, raises. payload: JSON text."""
    v = F.try_parse_json(payload)
    wrapped, data, plain = F.try_variant_get(v, "$.rows", "array<variant>"), F.try_variant_get(v, "$.data", f"array<struct<{row}>>"), F.try_variant_get(v, "$", f"array<struct<{row}>>")
    inner = F.transform(wrapped, lambda r: F.coalesce(F.try_variant_get(r, "$.row", f"struct<{row}>"), F.raise_error(F.lit("a row is missing")).cast(f"struct<{row}>")))
    return F.coalesce(inner, data, plain, F.raise_error(F.lit("an unknown gold format")).cast(f"array<struct<{row}>>"))


def context_pairs(context: Column) -> Column:
    """Array of struct(title, sentences) of {title: [], sentences: [[]]} or [[title, [sentence]]]; unequal lengths and other forms raise. context: JSON text."""
    v = F.try_parse_json(context)
    titles, groups = F.try_variant_get(v, "$.title", "array<string>"), F.try_variant_get(v, "$.sentences", "array<array<string>>")
    listed = F.try_variant_get(v, "$", "array<array<variant>>")
    kind = "array<struct<title:string,sentences:array<string>>>"
    zipped = F.when(F.size(titles) == F.size(groups), F.arrays_zip(titles.alias("title"), groups.alias("sentences")).cast(kind)).otherwise(F.raise_error(F.lit("titles and sentences differ in number")).cast(kind))
    pairs = F.transform(listed, lambda p: F.when(F.size(p) == 2, F.struct(F.variant_get(p[0], "$", "string").alias("title"), F.variant_get(p[1], "$", "array<string>").alias("sentences"))).otherwise(F.raise_error(F.lit("a context entry isn't a pair")).cast("struct<title:string,sentences:array<string>>")))
    return F.coalesce(F.when(titles.isNotNull() & groups.isNotNull(), zipped), pairs, F.raise_error(F.lit("no context")).cast(kind))


@pandas_udf(StringType())
def metadata_json(values: pd.Series) -> pd.Series:
    """JSON text of metadata that is JSON or a Python literal; an empty object for anything else."""

    def one(v: str | None) -> str:
        for read in (json.loads, ast.literal_eval):
            try:
                got = read(v)
                if isinstance(got, dict):
                    return json.dumps(got, ensure_ascii=False, sort_keys=True)
            except (ValueError, SyntaxError, TypeError):
                continue
        return "{}"

    return values.map(one)
