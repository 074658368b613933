"""Cross-tokenizer alignment (operator 12).

A task tokenises a block of texts under two vocabularies and aligns it in arrays: a
byte offset where tokens of both sides end closes a group, so a token's group is the
number of such offsets before it. From there the task writes a document's digest and
its distinct id pairs, each with how often it is linked there.
This goes to the shared folder once. An id pair's documents are counted from the
pairs, combined before the shuffle. The links then look their counts up: pairs that
more than a 2^16th of all rows hold can't be more than 2^16 and are broadcast, so
their links are summed where they lie; the others go through a shuffle in which no
pair is hot.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ._tables import materialize
from ._text import lean, slices
from .packing import CACHE, Tokens

MARK = "▁"
LARGE = 64  # links of a group from which on repeated ids are weighed, not repeated
BLOCK = 1 << 22  # bytes of texts, and links, that a task holds as arrays at once; a longer text is a block of its own
BITS = 24  # of an id, where document and pair make one number
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
PAIR = StructType([StructField("a", IntegerType(), False), StructField("b", IntegerType(), False), StructField("w", LongType(), False)])
_ARRAYS = {"a_ids": IntegerType(), "a_last": BooleanType(), "b_ids": IntegerType(), "b_last": BooleanType(), "pairs": PAIR}
ALIGNED = StructType([StructField("row", LongType()), StructField("doc_id", LongType()), *(StructField(c, LongType()) for c in NUMBERS), StructField("groups_sha256", StringType()), *(StructField(c, ArrayType(t, False)) for c, t in _ARRAYS.items())])


class ByteTokens(Tokens):
    """Byte-level tokens of texts in which special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        size = max(self.fast.max_token_value, self.exact.get_vocab_size()) + 1
        self.lengths, self.spaced = np.zeros(size, np.int64), np.zeros(size, bool)
        for token in self.fast.token_byte_values():
            i = self.fast.encode_single_token(token)
            self.lengths[i], self.spaced[i] = len(token), token.startswith(b" ")

    def __call__(self, texts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids one text after the other, counts), a space before each. words: none is empty, has a space or ends in white space."""
        if words:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(texts)), np.int32)
            return ids, np.diff(np.r_[np.flatnonzero(self.spaced[ids]), len(ids)])
        return _flat([self.fast.encode_ordinary(" " + t) for t in texts])


class PieceTokens:
    """Pieces of texts, None where they don't spell the text with a space before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.joins = any(MARK in p.lstrip(MARK) for p in names)  # a piece over a word's end: texts can't be cut at spaces
        self.lengths = np.array([len(s) for s in self.spelt])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, which texts are spelt) of the texts one after the other."""
        found = self.model.encode(texts, num_threads=1)
        ids, counts = _flat(found)
        wanted = [b" " + t.encode() for t in texts]
        ends = np.r_[0, np.cumsum(self.lengths[ids])][np.cumsum(counts)]
        if b"".join(map(self.spelt.__getitem__, ids.tolist())) == b"".join(wanted) and (ends == np.cumsum([len(w) for w in wanted])).all():
            return ids, counts, np.ones(len(texts), bool)
        return ids, counts, np.array([b"".join(map(self.spelt.__getitem__, f)) == w for f, w in zip(found, wanted, strict=True)])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(counts.sum())), counts


class Memory:
    """Ids of words under both vocabularies in two flat arrays; a number for each word.

    Neither vocabulary has a token over the end of a word that one space ends, so a text
    with single spaces is its words' ids one after the other. Others, and those with
    other white space before a space, go whole.
    """

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.sides = (a, b)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.count, self.used = 0, [0, 0]
        self.starts, self.sizes = np.zeros((2, 1 << 16), np.int64), np.zeros((2, 1 << 16), np.int64)
        self.flat = [np.zeros(1 << 18, np.int32) for _ in "ab"]
        self.sound, self.blank = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)

    def add(self, texts: list[str], words: bool) -> int:
        """Keep the ids of texts; the number of the first."""
        first, need = self.count, self.count + len(texts)
        if need > len(self.sound):
            more = 2 * need - len(self.sound)
            self.starts, self.sizes = (np.pad(x, ((0, 0), (0, more))) for x in (self.starts, self.sizes))
            self.sound, self.blank = (np.pad(x, (0, more)) for x in (self.sound, self.blank))
        a, b = self.sides
        *pieces, sound = b(texts)
        for k, (ids, sizes) in enumerate((a(texts, words), pieces)):
            end = self.used[k] + len(ids)
            if end > len(self.flat[k]):
                self.flat[k] = np.pad(self.flat[k], (0, end))
            self.flat[k][self.used[k] : end] = ids
            self.sizes[k, first:need] = sizes
            self.starts[k, first:need] = self.used[k] + np.cumsum(sizes) - sizes
            self.used[k] = end
        self.sound[first:need] = sound
        self.count = need
        return first

    def _numbers(self, words: list[str]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            new = list({w for w, n in zip(words, found, strict=True) if n is None})
            ends_blank = [w for w in new if w[-1].isspace()]  # as tokens they depend on what follows
            plain = [w for w in new if not w[-1].isspace()]
            first = self.add(plain, True) if plain else self.count
            self.known.update(zip(plain, range(first, self.count), strict=True))
            if ends_blank:
                first = self.add(ends_blank, False)
                self.blank[first : self.count] = True
                self.known.update(zip(ends_blank, range(first, self.count), strict=True))
            found = [self.known[w] if n is None else n for w, n in zip(words, found, strict=True)]
        return np.array(found, np.int64)

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts by text) of both sides; none where the pieces spell another text."""
        if self.count > CACHE:
            self.clear()
        words, counts, whole = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.sides[1].joins or "  " in text or text[0] == " " or text[-1] == " ":
                whole[i] = True
            else:
                parts = text.split(" ")
                words += parts
                counts[i] = len(parts)
        codes, text_of = self._numbers(words), np.repeat(np.arange(len(texts)), counts)
        last = np.zeros(len(codes), bool)
        last[np.cumsum(counts)[counts > 0] - 1] = True
        whole[text_of[self.blank[codes] & ~last]] = True
        long = np.flatnonzero(whole)
        if len(long):
            keep = ~whole[text_of]
            first = self.add([texts[i] for i in long], False)
            codes, text_of = np.r_[codes[keep], np.arange(first, self.count)], np.r_[text_of[keep], long]
            order = np.argsort(text_of, kind="stable")
            codes, text_of = codes[order], text_of[order]
        bad = np.zeros(len(texts), bool)
        bad[text_of[~self.sound[codes]]] = True
        keep = ~bad[text_of]
        codes, text_of = codes[keep], text_of[keep]
        out = []
        for k in (0, 1):
            sizes = self.sizes[k, codes]
            ends = np.cumsum(sizes)
            at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[k, codes] - ends + sizes, sizes)
            out.append((self.flat[k][at], np.bincount(text_of, sizes, len(texts)).astype(np.int64)))
        return out


class Groups:
    """The groups of a block of texts: ids, byte ends and counts by text of either side.

    Ends rise through the whole block, and both sides' texts end at the same bytes.
    last: the tokens that end a group; group: each token's, numbered through the block.
    """

    def __init__(self, *sides: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.ids, ends, self.counts = zip(*sides, strict=True)
        here = np.zeros((2, max((int(e[-1]) for e in ends if len(e)), default=0) + 1), bool)
        for k in (0, 1):
            here[k, ends[k]] = True
        self.last = [here[1 - k, ends[k]] for k in (0, 1)]
        self.group = [np.cumsum(x) - x for x in self.last]
        self.sizes = [np.diff(np.flatnonzero(x), prepend=-1) for x in self.last]
        self.links = self.sizes[0] * self.sizes[1]
        self.text = np.repeat(np.arange(len(self.counts[0])), self.counts[0])[self.last[0]]  # a group's

    def written(self, names: list[bytes], shift: int) -> list[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3. names: an id and what follows it, for side a, a's last, b and b's last, each by `shift`."""
        places = [np.arange(len(i)) for i in self.ids]
        starts = [np.cumsum(n) - n for n in self.sizes]
        codes = np.empty(sum(map(len, places)), np.int64)
        codes[places[0] + starts[1][self.group[0]]] = self.ids[0] + shift * self.last[0]
        codes[places[1] + (starts[0] + self.sizes[0])[self.group[1]]] = self.ids[1] + shift * (2 + self.last[1])
        stops = np.cumsum(self.counts[0] + self.counts[1]).tolist()
        return [b"".join(map(names.__getitem__, codes[i:j].tolist()))[:-1] for i, j in zip([0, *stops], stops, strict=False)]

    def _items(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, weight) of a side by group; a large group's ids once each, weighed."""
        group, ids, weights = self.group[k], self.ids[k].astype(np.int64), np.ones(len(self.ids[k]), np.int64)
        large = self.links[group] > LARGE
        if large.any():
            found, n = np.unique(group[large] << BITS | ids[large], return_counts=True)
            group, ids, weights = np.r_[group[~large], found >> BITS], np.r_[ids[~large], found & ((1 << BITS) - 1)], np.r_[weights[~large], n]
            order = np.argsort(group, kind="stable")
            group, ids, weights = group[order], ids[order], weights[order]
        return group, ids, weights

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(pairs by text, a, b, times linked in the text) of distinct pairs, in as many parts as keep each near BLOCK links; a pair is in one part."""
        (ga, a, wa), (gb, b, wb) = self._items(0), self._items(1)
        n = np.bincount(gb, minlength=len(self.links))
        first = np.cumsum(n) - n
        parts = max(1, -(-int(n[ga].sum()) // BLOCK))
        for part in range(parts):
            mine = slice(None) if parts == 1 else np.flatnonzero(a % parts == part)
            g, each = ga[mine], n[ga[mine]]
            at = np.arange(int(each.sum())) + np.repeat(first[g] - np.cumsum(each) + each, each)
            key = np.repeat(self.text[g] << 2 * BITS | a[mine] << BITS, each) | b[at]
            weights = np.repeat(wa[mine], each) * wb[at]
            if (weights == 1).all():
                key.sort()
            else:
                order = np.argsort(key, kind="stable")
                key, weights = key[order], weights[order]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            sums = np.add.reduceat(weights, heads) if len(heads) else weights
            key = key[heads]
            yield np.bincount(key >> 2 * BITS, minlength=len(self.counts[0])), key >> BITS & ((1 << BITS) - 1), key & ((1 << BITS) - 1), sums


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 500 rows and about BLOCK bytes of text."""
    for batch in slices(batches, 500):
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > BLOCK:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def _list(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def _aligned(path_a: str, path_b: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(ByteTokens(path_a), PieceTokens(path_b))
        shift = max(len(side.lengths) for side in memory.sides)
        names = [b"%d%s" % (i, after) for after in (b",", b"|", b",", b";") for i in range(shift)]
        for batch in _short(batches):
            tokens = memory(batch["text"].to_pylist())
            g = Groups(*((ids, np.cumsum(side.lengths[ids]), counts) for side, (ids, counts) in zip(memory.sides, tokens, strict=True)))
            n = batch.num_rows
            sums = [np.bincount(g.text, minlength=n), np.bincount(g.text, g.links, n).astype(np.int64)]
            shas = [hashlib.sha256(x).hexdigest() if x else "" for x in g.written(names, shift)]
            columns = [batch["row"], batch["doc_id"], *(pa.array(x) for x in (*g.counts, *sums)), pa.array(shas, pa.string())]
            columns += [_list(g.counts[k], pa.array(v)) for k in (0, 1) for v in (g.ids[k], g.last[k])]
            for part, (counts, a, b, w) in enumerate(g.pairs()):
                if part:  # further pairs: no more than them and the row
                    columns = [batch["row"], *(pa.nulls(n, c.type) for c in columns[1:11])]
                pairs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(w)], PAIR.fieldNames())
                yield pa.RecordBatch.from_arrays([*columns, _list(counts, pairs)], names=ALIGNED.fieldNames())

    return run


def _cut(ids: Column, last: Column) -> Column:
    """The ids in pieces that end where last says."""
    stops = F.filter(F.transform(last, lambda x, i: F.when(x, i + 1).otherwise(0)), lambda i: i > 0)
    starts = F.slice(F.concat(F.array(F.lit(0)), stops), F.lit(1), F.size(stops))
    return F.zip_with(starts, stops, lambda p, q: F.slice(ids, p + 1, q - p))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, as well as groups: its groups a and b.

    a: byte-level tokens of the text with a space before it (a tokenizers file), b: the
    pieces of the text (a sentencepiece file that adds that space). A null or empty
    text, and one whose pieces spell another text, has no tokens: zeros and ''. A pair
    of ids is linked where both stand in one group; its count is the number of rows
    that hold it, so repeated rows count as often as they stand. Links are counted with
    repetition, from distinct ids and their numbers. An empty table gives no rows;
    further columns are not read. Whole texts are aligned, however long.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    g = materialize(rows.mapInArrow(_aligned(path_a, path_b), ALIGNED), "align-groups")

    each = g.select("row", F.inline("pairs")).select("row", (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "w")
    counts = materialize(each.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "align-pairs")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("id")).agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    facts = counts.withColumn("id", first).join(F.broadcast(most), "id").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0

    met = each.join(F.broadcast(facts.filter(F.col("n") > total >> 16)), "pair", "left")
    rare = F.when(F.col("n").isNull(), F.col("pair")).alias("pair")
    met = materialize(met.groupBy("row", rare).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("best")).alias("n_best"), F.sum(F.col("w") * F.col("n")).alias("count_sum")), "align-links")
    cold = met.filter("pair is not null").select("row", "pair", "w").join(facts.filter(F.col("n") <= total >> 16), "pair")
    parts = met.filter("pair is null").select("row", "n_best", "count_sum").unionByName(cold.select("row", (F.col("w") * F.col("best")).alias("n_best"), (F.col("w") * F.col("n")).alias("count_sum")))
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = g.filter("n_a is not null").join(sums, "row", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
    out = out.withColumns({s: _cut(F.col(f"{s}_ids"), F.col(f"{s}_last")) for s in "ab"})
    return out.select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256", F.arrays_zip("a", "b").alias("groups"))
