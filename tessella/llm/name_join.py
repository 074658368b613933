"""Edit-distance name join by trie descent with dynamic-programming rows (operator 11).

Names are made distinct first, so a name that a third of all rows share is one row.

1. Shards. A name of n code points is cut into max + 1 segments with one code point
   between any two. An edit (a substitution, insertion, deletion or exchange) touches
   at most one segment, so of two names within max edits one holds some segment of the
   other unchanged, moved by what was inserted or deleted before it. A shard is a
   length, a segment's number and its content. Names of the left side go to their own
   max + 1 shards; those of the right side to all shards of lengths within max where
   they hold the segment.
2. Shards with more than `limit` names of a side are cut further: the segment that all
   of them share becomes a hole, and what is left is cut into segments again. Within
   max edits around an exact segment the rest is within max edits too, so nothing is
   lost. This ends when nothing but max code points is left to differ in.
3. In each shard the left names form a trie, reversed where the shared segment is the
   last, and every right name descends it: a node's row of distances is computed from
   its parent's, so names with a common prefix share rows. Earlier rows of the path are
   kept for exchanges, and a node is left when its whole row exceeds max.
4. A pair met in several shards counts once; sums by right name go back to its rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import ascii_lower, materialize
from ._text import lean, slices

HOLE = "\n"  # no name holds it
LIMIT = 4096  # names of a side in one shard
SALTS = 16
LEFT, RIGHT = range(2)
_SHARD = "key long, side byte, name string, rest string, lo int, size int, other int, back boolean, done boolean, n long, first long, crc long"
_COLUMNS = [c.split()[0] for c in _SHARD.split(", ")]
_TYPES = [{"long": pa.int64(), "byte": pa.int8(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in _SHARD.split(", ")]


def name_form(c: Column) -> Column:
    """A-Z lower-cased, white space removed; null where nothing is left."""
    form = F.regexp_replace(ascii_lower(c.cast("string")), r"[\x20\x09-\x0D]", "")
    return F.when(form != "", form)


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of k + 1 segments of n code points with one code point between two; empty ones where n is too small."""
    each, more = divmod(max(0, n - k), k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = each + (i > k - more)
        out.append((min(at, n), size))
        at += size + 1
    return out


def held_segments(length: int, n: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, size) where a name of `length` may hold a segment of one of n within k edits.

    Edits before the first segment touch it, and those behind the last one too, so
    these two lie at the ends; others move by s if s edits before and the
    difference's rest behind them are affordable.
    """
    for i, (at, size) in enumerate(segments(n, k)):
        if i == 0:
            moves = [0]
        elif i == k:
            moves = [length - n]
        else:
            moves = [s for s in range(-k, k + 1) if abs(s) + abs(length - n - s) <= k]
        for s in moves:
            if 0 <= at + s <= length - size:
                yield i, at + s, size


def _deal(k: int):
    """Names to their shards: of the whole name where rest is null, else of the rest after a hole is put into it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in _COLUMNS]
            for row in b.to_pylist():
                side, rest = row["side"], row["name"]
                if row["rest"] is None:
                    lengths = [len(rest)] if side == LEFT else range(max(1, len(rest) - k), len(rest) + k + 1)
                else:
                    rest = row["rest"][: row["lo"]] + HOLE + row["rest"][row["lo"] + row["size"] :]
                    lengths = [row["other"] - row["size"] + 1]
                for n in lengths:
                    places = held_segments(len(rest), n, k) if side == RIGHT else ((i, at, size) for i, (at, size) in enumerate(segments(n, k)))
                    for i, at, size in places:
                        part = rest[at : at + size]
                        key = xxhash.xxh64_intdigest(struct.pack("<qii", row["key"], n, i) + part.encode("utf-8", "surrogatepass")) - (1 << 63)
                        back = i * 2 > k if row["rest"] is None else row["back"]
                        for column, v in zip(out, (key, side, row["name"], rest, at, size, n, back, not part.strip(HOLE), row["n"], row["first"], row["crc"]), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, _TYPES, strict=True)], names=_COLUMNS)

    return run


class Trie:
    """Names as nodes [children, index of the name that ends here or None]."""

    def __init__(self, names: list[str]):
        self.root: list = [{}, None]
        for i, name in enumerate(names):
            node = self.root
            for c in name:
                node = node[0].setdefault(c, [{}, None])
            node[1] = i

    def within(self, q: str, k: int) -> Iterator[tuple[int, int]]:
        """(index, distance) of all names within k edits of q, substrings edited again where that is shorter.

        A row holds the distances between a node's prefix and the prefixes of q whose
        lengths differ from its own by k or less: cell d is of length depth - k + d.
        Cells beyond are k + 1 or more, and only earlier rows and columns at most k
        back can be those an exchange within k edits comes from.
        """
        far, width, length = k + 1, 2 * k + 1, len(q)
        top = [d - k if k <= d <= length + k else far for d in range(width)]
        path, rows = [""], [top]
        stack = [(self.root, "", 0)]
        while stack:
            node, c, depth = stack.pop()
            if depth:
                del path[depth:], rows[depth:]
                above = rows[-1]
                row = [far] * width
                for d in range(max(0, k - depth), min(width, length - depth + k + 1)):
                    j = depth - k + d
                    best = above[d + 1] + 1 if d + 1 < width else far
                    if j:
                        step = above[d] + (q[j - 1] != c)
                        if step < best:
                            best = step
                        if d and row[d - 1] + 1 < best:
                            best = row[d - 1] + 1
                        if best > 1:
                            for i1 in range(depth - 1, max(0, depth - k - 1), -1):
                                if path[i1] != q[j - 1]:
                                    continue
                                for j1 in range(j - 1, max(0, j - k - 1), -1):
                                    if q[j1 - 1] == c:
                                        at = j1 - i1 + k
                                        if 0 <= at < width:
                                            best = min(best, rows[i1 - 1][at] + depth - i1 + j - j1 - 1)
                                        break
                                break
                    row[d] = best if best < far else far
                if min(row) > k:
                    continue
                path.append(c)
                rows.append(row)
            end = length - depth + k
            if node[1] is not None and 0 <= end < width and rows[-1][end] <= k:
                yield node[1], rows[-1][end]
            stack.extend((child, at, depth + 1) for at, child in node[0].items())


def _descend(k: int):
    """Shards sorted by (key, side, name) in, left names before right ones; pairs out."""
    fields = [("form", pa.string()), ("name", pa.string()), ("distance", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("crc", pa.int64())]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, trie, before = None, [], None, None
        for b in batches:
            out: list[list] = [[] for _ in fields]
            keys, sides, names, backs = (b[c].to_pylist() for c in ("key", "side", "name", "back"))
            for i, (at, side, name, back) in enumerate(zip(keys, sides, names, backs, strict=True)):
                if at != key:
                    key, left, trie, before = at, [], None, None
                if side == LEFT:
                    left.append((name, b["n"][i].as_py(), b["first"][i].as_py(), b["crc"][i].as_py()))
                elif left and name != before:
                    before = name
                    trie = trie or Trie([x[0][::-1] if back else x[0] for x in left])
                    for j, distance in trie.within(name[::-1] if back else name, k):
                        for column, v in zip(out, (name, left[j][0], distance, *left[j][1:]), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, fields, strict=True)], names=[f for f, _ in fields])

    return run


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def _copies(df: DataFrame) -> DataFrame:
    """df under every salt, never broadcast: it grows with the input."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).hint("merge")


def shards(names: DataFrame, k: int, limit: int) -> DataFrame:
    """The shards' rows; hot ones are cut until none has more than limit names of a side, or nothing is left to cut."""
    level = materialize(names.mapInArrow(_deal(k), _SHARD), "name-shards")
    leaves = []
    while True:
        counts = level.groupBy("key").agg(F.sum(1 - F.col("side")).alias("n_left"), F.sum(F.col("side")).alias("n_right"), F.min("done").alias("done"))
        hot = materialize(counts.filter((F.greatest("n_left", "n_right") > limit) & (F.least("n_left", "n_right") > 0) & ~F.col("done")).select("key"), "name-hot")
        if hot.isEmpty():
            leaves.append(level)
            break
        rows = _salted(level, "name")
        leaves.append(rows.join(_copies(hot), ["key", "salt"], "left_anti").drop("salt"))
        deeper = rows.join(_copies(hot), ["key", "salt"], "left_semi").drop("salt")
        level = materialize(deeper.mapInArrow(_deal(k), _SHARD), "name-shards")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out.select("key", "side", "name", "back", "n", "first", "crc")


def join_names(left: DataFrame, right: DataFrame, left_id: str = "client_id", left_name: str = "name", right_id: str = "vendor_id", right_name: str = "name", max_distance: int = 1, limit: int = LIMIT) -> DataFrame:
    """(right_id, form, distance, n_left, first_left_id, left_crc) for each right row and exact distance with a qualifying pair.

    Names are compared in name_form(): null and empty ones take no part. The distance is
    the unrestricted Damerau-Levenshtein distance in code points; pairs of max_distance
    or less qualify. Every left row counts, repeated ones too (left_crc sums the unsigned
    crc32 of its decimal id; a null id adds nothing and is never first). Right rows equal
    in id and name are one row; a null right id is an id. Empty tables give no rows;
    further columns are not read. Names of any length are compared whole.
    """
    ids = F.col(left_id).cast("long")
    clients = left.select(name_form(F.col(left_name)).alias("name"), ids.alias("id")).filter("name is not null")
    clients = clients.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.coalesce(F.sum(F.crc32(F.col("id").cast("string"))), F.lit(0)).alias("crc"))
    vendors = right.select(F.col(right_id).cast("long").alias("id"), name_form(F.col(right_name)).alias("form")).filter("form is not null").distinct()
    tagged = clients.select(F.lit(LEFT).cast("byte").alias("side"), "name", "n", "first", "crc").unionByName(vendors.select(F.lit(RIGHT).cast("byte").alias("side"), F.col("form").alias("name")).distinct(), allowMissingColumns=True)
    level = tagged.select(F.lit(0).cast("long").alias("key"), "side", "name", F.lit(None).cast("string").alias("rest"), F.lit(0).alias("lo"), F.lit(0).alias("size"), F.lit(0).alias("other"), F.lit(False).alias("back"), "n", "first", "crc")
    dealt = shards(level, max_distance, limit).repartition("key").sortWithinPartitions("key", "side", "name")
    pairs = dealt.mapInArrow(_descend(max_distance), "form string, name string, distance int, n long, first long, crc long").dropDuplicates(["form", "name"])
    sums = materialize(pairs.groupBy("form", "distance").agg(F.sum("n").alias("n_left"), F.min("first").alias("first_left_id"), F.sum("crc").alias("left_crc")), "name-sums")
    met = _salted(vendors, "id").join(_copies(sums), ["form", "salt"])
    return met.select(F.col("id").alias("right_id"), "form", "distance", "n_left", "first_left_id", "left_crc")
