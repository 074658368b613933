"""Many needles in many texts in one pass over each text, by Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize

MOST = 1 << 24  # code points of an automaton's needles, about 2 GB at the worst
PARTS = 64


def automaton(pairs: list[tuple[str, int]]) -> ahocorasick.Automaton | None:
    """An automaton whose values are the ids that share a needle; None without needles."""
    out = ahocorasick.Automaton()
    for needle, ident in pairs:
        if out.exists(needle):
            out.get(needle).append(ident)
        else:
            out.add_word(needle, [ident])
    if not len(out):
        return None
    out.make_automaton()
    return out


def _found(machine: ahocorasick.Automaton | None, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    rows, needles = [], []
    for i, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
        if machine is not None and text:
            hit = {n for _, ns in machine.iter(text) for n in ns}
            rows += [i] * len(hit)
            needles += hit
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(needles, pa.int64())], names=["id", "needle_id"])


def find_needles(texts: DataFrame, needles: DataFrame, id_col: str, text_col: str, needle_id: str, needle_col: str, most: int = MOST) -> DataFrame:
    """(id, needle_id) once for each text that contains the needle, case and all; null and empty needles are in no text.

    Needles of up to `most` code points go to every executor as one automaton. Longer
    lists are dealt to automata of about that size, and every text meets each of these,
    in parts of the texts' ids.
    """
    n = needles.select(F.col(needle_id).cast("long").alias("needle_id"), F.col(needle_col).cast("string").alias("needle")).filter("needle <> ''").distinct()
    t = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = n.agg(F.coalesce(F.sum(F.char_length("needle")), F.lit(0))).first()[0]
    if size <= most:
        pairs = [(r.needle, r.needle_id) for r in n.collect()]  # checked: most code points at most

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(pairs)
            for b in batches:
                yield _found(machine, b["id"], b["text"])

        return t.mapInArrow(scan, "id long, needle_id long").distinct()
    shards = -(-size // most)
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part")
    left = t.select("id", "text", part, shard)
    right = n.select("needle", "needle_id", F.pmod(F.xxhash64("needle"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))

    def both(a: Iterator[pa.RecordBatch], b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton([(w, i) for x in b for w, i in zip(x["needle"].to_pylist(), x["needle_id"].to_pylist(), strict=True)])
        for x in a:
            yield _found(machine, x["id"], x["text"])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(both(a.to_batches(), b.to_batches())), schema=pa.schema([("id", pa.int64()), ("needle_id", pa.int64())]))

    keys = ["shard", "part"]
    return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "id long, needle_id long").distinct(), "needles")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # the sentences of a benchmark item are needles of that item
    sentences = read("benchmark").select("item_id", F.explode(F.split("text", r"\. ")).alias("needle"))
    found = find_needles(read("documents"), sentences, "doc_id", "text", "item_id", "needle")
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("items"), F.min("needle_id").alias("first_item"))


CALLS = [
    ("benchmark_needles", _passages, """
     WITH n AS (SELECT DISTINCT item_id, unnest(string_split(text, '. ')) AS needle FROM benchmark)
     SELECT doc_id, count(DISTINCT item_id) AS items, min(item_id) AS first_item FROM documents JOIN n ON needle <> '' AND contains(text, needle) GROUP BY doc_id"""),
]
