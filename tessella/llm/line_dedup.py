"""Line dedup by range-partitioned line hashes and keep bitmaps (operator 13).

1. Texts are cut into lines where they lie; every line whose key is long enough
   becomes a slim row: 128 bits of its key, the document, the line's place.
2. The slim rows are range-partitioned and sorted by (key, document, place). The
   range is over all of these, so a key that a third of all lines share is spread
   over many partitions. Each partition is streamed once: the first document of a
   key keeps its lines, those of all later ones are dropped. Lines under a
   partition's first key are open, because the key may begin further ahead; every
   partition reports the first document it has for its first and its last key, two
   rows a partition, and the least of these settles the open lines.
3. What is dropped goes back to its documents as one compressed bitmap a document.
   Only there texts are read again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import free_name, materialize
from ._text import lean, slices

LEAST = 10  # code points of the shortest key that can be dropped
WHITE = b" \t\n\v\f\r"
NO_ID = -(1 << 63)  # stands for a null id, the smallest
LINE = "h0 long, h1 long, doc long, version long, place int"
FOUND = f"kind byte, {LINE}"
DROPPED, OPEN, FIRST = range(3)


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def _lines(least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            digests, counts, places = [], [], []
            for text in b["text"].cast(pa.binary()).to_pylist():
                before = len(places)
                for at, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(at)
                counts.append(len(places) - before)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ids = [np.repeat(b[c].to_numpy(), counts) for c in ("doc", "version")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, i])) for i in (0, 1)] + [pa.array(v) for v in ids] + [pa.array(places, pa.int32())], names=["h0", "h1", "doc", "version", "place"])

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, document and place in; dropped lines, open lines and the partition's first documents out."""
    head = last = first_doc = None
    names = ["kind", "h0", "h1", "doc", "version", "place"]

    def rows(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, np.int8)), *(b[c] for c in names[1:])], names=names)

    def border(key: tuple, doc: int) -> pa.RecordBatch:
        values = [FIRST, *key, doc, 0, 0]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int8(), *[pa.int64()] * 4, pa.int32()), strict=True)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        h0, h1, doc = (b[c].to_numpy() for c in ("h0", "h1", "doc"))
        new = np.r_[True, (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])]
        starts = np.flatnonzero(new)
        first = doc[starts]
        if last == (h0[0], h1[0]):
            first[0] = first_doc
        if head is None:
            head = (h0[0], h1[0])
            yield border(head, doc[0])
        later = doc != np.repeat(first, np.diff(np.r_[starts, len(doc)]))
        is_open = (h0 == head[0]) & (h1 == head[1])
        yield rows(OPEN, b.filter(pa.array(is_open)))
        yield rows(DROPPED, b.filter(pa.array(later & ~is_open)))
        last, first_doc = (h0[-1], h1[-1]), first[-1]
    if last is not None:
        yield border(last, first_doc)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, version, place) sorted in; a compressed bitmap of dropped places for each document out."""
    open_key, held = None, []

    def row(key: tuple, parts: list) -> pa.RecordBatch:
        at = np.concatenate(parts)
        bits = np.zeros(at[-1] + 1, bool)
        bits[at] = True
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["doc", "version", "dropped"])

    for b in batches:
        if not b.num_rows:
            continue
        doc, version, place = (b[c].to_numpy() for c in ("doc", "version", "place"))
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])])
        out = []
        for x, y in zip(starts, np.r_[starts[1:], len(doc)], strict=True):
            key = (doc[x], version[x])
            if key != open_key:
                if held:
                    out.append(row(open_key, held))
                open_key, held = key, []
            held.append(place[x:y])
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if held:
        yield row(open_key, held)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return d.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("version", F.xxhash64("text"))


def dropped_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, version, dropped) for documents that lose lines: zlib-compressed bits, a set bit for a dropped line.

    doc is the id (null: the smallest number), version the text's hash, so that rows
    that share an id and not the text have bitmaps of their own.
    """
    lines = materialize(_keyed(docs, id_col, text_col).select("doc", "version", "text").mapInArrow(_lines(least), LINE), "line-keys")
    order = ["h0", "h1", "doc", "version", "place"]
    found = materialize(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_stream), FOUND), "line-first")
    # two rows a partition: bounded by the number of partitions, whatever the table holds
    first = found.filter(F.col("kind") == FIRST).groupBy("h0", "h1").agg(F.min("doc").alias("owner"))
    settled = found.filter(F.col("kind") == OPEN).join(F.broadcast(first), ["h0", "h1"]).filter("doc <> owner")
    columns = ["doc", "version", "place"]
    gone = found.filter(F.col("kind") == DROPPED).select(*columns).unionByName(settled.select(*columns))
    return gone.repartition("doc", "version").sortWithinPartitions(*columns).mapInArrow(lean(_bitmaps), "doc long, version long, dropped binary")


def kept_lines(lines: list, dropped: bytes | None) -> list:
    if dropped is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8))
    return [line for i, line in enumerate(lines) if i >= len(bits) or not bits[i]]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in slices(batches, 500):
        n, gone, sha = [], [], []
        for text, dropped in zip(b["text"].cast(pa.binary()).to_pylist(), b["dropped"].to_pylist(), strict=True):
            lines = text.split(b"\n")
            kept = kept_lines(lines, dropped)
            n.append(len(lines))
            gone.append(len(lines) - len(kept))
            sha.append(hashlib.sha256(text if dropped is None else b"\n".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), b["dropped"]], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "dropped"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256, dropped (its bitmap, null where nothing goes).

    A line's key is the line without white space at its ends, A-Z lower-cased; keys
    of `least` code points or more that several documents hold keep their lines in
    the smallest doc_id alone. A null or empty text is one empty line. A null id
    counts as the smallest. Rows of the same id are one document as to who holds
    a key, so repeated rows don't lose lines to each other. An empty table gives no
    rows; further columns are not read.
    """
    marks = dropped_bitmaps(docs, id_col, text_col, least)
    rows = _keyed(docs, id_col, text_col).join(marks, ["doc", "version"], "left").select("doc_id", "text", "dropped")
    return rows.mapInArrow(lean(_digests), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, dropped binary")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with its other lines alone in text_col; all columns stay as they are, a null text stays null."""

    @F.pandas_udf("string")
    def kept(text, dropped):
        return text.combine(dropped, lambda t, d: t if t is None or d is None else "\n".join(kept_lines(t.split("\n"), d)))

    row, doc, version = (free_name(docs, c) for c in ("row", "doc", "version"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.select(F.struct("*").alias(row), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias(doc), F.xxhash64(text).alias(version))
    marks = dropped_bitmaps(docs, id_col, text_col, least).withColumnsRenamed({"doc": "m_doc", "version": "m_version"})
    out = held.join(marks, (held[doc] == marks.m_doc) & (held[version] == marks.m_version), "left")
    return out.select(*(kept(F.col(row)[c].cast("string"), F.col("dropped")).alias(c) if c == text_col else F.col(row)[c].alias(c) for c in docs.columns))
