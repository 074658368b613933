"""LM scoring by a gated recurrent language model (operator 1), in numpy.

Statistics. Every training word is counted over the whole corpus. The FREQUENT
commonest words (a fixed bound) go to every task; the counts of all others are met
by a shuffle, one row per document and word class.

Model. A gated recurrent unit reads one token at a time. The output softmax is
factored: a class first, then a word of the class. The LEXICON commonest words are
dealt to classes by frequency; all other words belong to one of TAILS classes named
by their last two bytes, in which a word has its smoothed share of the class's
training count. Weights are fitted by backpropagation through time, truncated to
windows whose state is carried on: a first fit on a bounded sample, then ROUNDS rounds
that together read every training document once. In each, replicas train on their part
of the round's documents, as it streams in, and their weights are averaged in two levels.

Scoring. Documents run side by side in lanes, window by window with the state carried
across, each to its end.
"""

from __future__ import annotations

import copy
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import materialize
from ._text import blocks, lean, mix, words

FREQUENT, LEXICON, CLASSES, TAILS = 1 << 17, 1024, 16, 32
HIDDEN, WINDOW, LANES = 24, 24, 224
WARM_DOCS, RATE = 1200, 0.006  # documents of the first fit; the replicas' step
ROUNDS, CHUNK = 4, 1 << 18  # averaging rounds in a pass; tokens that a replica holds at once
SHARE, MOST_REPLICAS = 1 << 20, 1 << 14  # tokens that a replica reads in a round; most replicas, each then reads more
SLOTS = 1 << 24
END = np.uint64(1)  # the end token's hash
PER = LEXICON // CLASSES


def tail_class(start: np.ndarray, end: np.ndarray, buf: np.ndarray) -> np.ndarray:
    last, before = buf[end - 1].astype(np.uint64), buf[np.maximum(end - 2, start)].astype(np.uint64)
    return (mix(last * np.uint64(256) + before) % np.uint64(TAILS)).astype(np.int64)


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < LEXICON, ids // PER, ids - LEXICON + CLASSES).astype(np.uint8)


def by_class(cls: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(class, its rows) for the lexicon's classes."""
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        yield k, order[cuts[k] : cuts[k + 1]]


class Model:
    """Weights: e (input tables of both gates), u, v (recurrent), wc, bc (classes), wo, bo (words by class)."""

    NAMES = ("e", "u", "v", "wc", "bc", "wo", "bo")

    def __init__(self, class_counts: np.ndarray, word_counts: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        h, n = HIDDEN, LEXICON + TAILS
        self.e = r.normal(0, 0.3, (n, 2 * h)).astype(np.float32)
        self.u, self.v = (r.normal(0, 0.6 / np.sqrt(h), (h, h)).astype(np.float32) for _ in range(2))
        self.wc, self.bc = np.zeros((h, CLASSES + TAILS), np.float32), np.log((class_counts + 0.5) / (class_counts + 0.5).sum()).astype(np.float32)
        self.wo, self.bo = np.zeros((CLASSES, h, PER), np.float32), np.log(word_counts.reshape(CLASSES, PER) + 0.5).astype(np.float32)

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        x = self.e[ids]
        g = 1 / (1 + np.exp(-(x[:, :HIDDEN] + h @ self.u)))
        c = np.tanh(x[:, HIDDEN:] + (g * h) @ self.v)
        return h + g * (c - h), g, c

    def log_prob(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of class, and of the word within a lexicon class, for states before each token."""
        z = h @ self.wc + self.bc
        top = z.max(1, keepdims=True)
        z -= top
        cls = class_of(ids)
        out = z[np.arange(len(ids)), cls] - np.log(np.exp(z).sum(1))
        for k, rows in by_class(cls):
            if len(rows):
                y = h[rows] @ self.wo[k] + self.bo[k]
                y -= y.max(1, keepdims=True)
                out[rows] += y[np.arange(len(rows)), ids[rows] % PER] - np.log(np.exp(y).sum(1))
        return out

    def gradients(self, x: np.ndarray, new: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the window's mean loss, last state) for ids x [time, lanes]; new: a document starts; h: carried states."""
        t_n, lanes = x.shape
        before, inner, gates, cands = (np.empty((t_n, lanes, HIDDEN), h.dtype) for _ in range(4))
        starts = new.any(1)
        for t in range(t_n):
            if starts[t]:
                h = np.where(new[t][:, None], h.dtype.type(0), h)  # a document starts from nothing
            before[t] = h
            h, gates[t], cands[t] = self.step(x[t], h)
            inner[t] = h
        hs, flat = before.reshape(-1, HIDDEN), x.ravel()
        grads = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        p = hs @ self.wc
        p += self.bc
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        cls = class_of(flat)
        p[np.arange(len(flat)), cls] -= 1
        p /= len(flat)
        grads["wc"], grads["bc"], dh = hs.T @ p, p.sum(0), p @ self.wc.T
        for k, rows in by_class(cls):
            if len(rows):
                states = hs[rows]
                q = states @ self.wo[k]
                q += self.bo[k]
                q -= q.max(1, keepdims=True)
                np.exp(q, out=q)
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(rows)), flat[rows] % PER] -= 1
                q /= len(flat)
                grads["wo"][k], grads["bo"][k] = states.T @ q, q.sum(0)
                dh[rows] += q @ self.wo[k].T
        dh = dh.reshape(t_n, lanes, HIDDEN)
        back = np.zeros((lanes, HIDDEN), h.dtype)
        ge = np.empty((t_n, lanes, 2 * HIDDEN), h.dtype)
        for t in range(t_n - 1, -1, -1):
            back += dh[t]  # by the state before token t, of the losses of t and all later ones
            if t:
                carried = np.where(new[t][:, None], h.dtype.type(0), back) if starts[t] else back
                old, g, c = before[t - 1], gates[t - 1], cands[t - 1]
                dc = carried * g * (1 - c * c)
                dgh = dc @ self.v.T
                da = (carried * (c - old) + dgh * old) * g * (1 - g)
                ge[t - 1, :, :HIDDEN], ge[t - 1, :, HIDDEN:] = da, dc
                back = carried * (1 - g) + dgh * g + da @ self.u.T
        ge[t_n - 1] = 0  # the last state is carried on, and its gradient ends here
        da, dc = ge[:, :, :HIDDEN].reshape(-1, HIDDEN), ge[:, :, HIDDEN:].reshape(-1, HIDDEN)
        grads["v"] = (gates.reshape(-1, HIDDEN) * hs).T @ dc
        grads["u"] = hs.T @ da
        by = np.argsort(flat.astype(np.uint16), kind="stable")
        ordered = flat[by]
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        grads["e"][ordered[first]] = np.add.reduceat(ge.reshape(-1, 2 * HIDDEN)[by], first)
        return grads, h

    def train(self, docs: list[np.ndarray], rate: float = 0.01, lanes: int = 32, seed: int = 0, moments: list | None = None) -> int:
        """One pass over token id arrays by truncated backpropagation; returns the tokens read.

        moments: the optimiser's state, empty at first, for calls that go on with it;
        tokens beyond whole lanes are then read in one lane.
        """
        r = np.random.default_rng(seed)
        size = sum(map(len, docs))
        lanes = max(1, min(lanes, size // WINDOW))
        span = size // lanes
        if not span:
            return 0
        order = r.permutation(len(docs))
        stream = np.concatenate([docs[i] for i in order])
        starts = np.zeros(size, bool)
        starts[np.cumsum([0, *(len(docs[i]) for i in order[:-1])])] = True
        ids, fresh = (np.ascontiguousarray(a[: span * lanes].reshape(lanes, span).T) for a in (stream, starts))
        params = [getattr(self, k) for k in self.NAMES]
        m, v, turn = moments or ([np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for s in range(0, span, WINDOW):
            grads, h = self.gradients(ids[s : s + WINDOW], fresh[s : s + WINDOW], h)
            turn += 1
            for i, k in enumerate(self.NAMES):
                g = np.clip(grads[k], -1, 1)
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                params[i] -= (rate * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
        if moments is None:
            return span * lanes
        moments[:] = m, v, turn
        rest = stream[span * lanes :]
        return span * lanes + (self.train([rest], rate, 1, seed, moments) if len(rest) else 0)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **{k: getattr(self, k) for k in self.NAMES})
        return f.getvalue()

    def load(self, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as z:
            for k in self.NAMES:
                setattr(self, k, z[k].astype(np.float32))
        return self

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of whole documents, lanes of like length at a time."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for s in range(0, len(order), LANES):
            lane = order[s : s + LANES]
            lengths = np.array([len(docs[i]) for i in lane])
            h = np.zeros((len(lane), HIDDEN), np.float32)
            flat, begin = np.concatenate([docs[i] for i in lane]), np.cumsum(lengths) - lengths
            for at in range(0, lengths[0], WINDOW):
                states, tokens, whose = [], [], []
                for t in range(at, min(at + WINDOW, lengths[0])):
                    live = int((lengths > t).sum())
                    ids = flat[begin[:live] + t]
                    h = h[:live]
                    states.append(h)
                    tokens.append(ids)
                    whose.append(np.arange(live))
                    h = self.step(ids, h)[0]
                lp = self.log_prob(np.concatenate(states), np.concatenate(tokens))
                np.add.at(out, np.array(lane)[np.concatenate(whose)], lp.astype(np.float64))
        return out


class Lexicon:
    """Sorted hashes of the commonest words with count and rank; bounded by FREQUENT."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        rank = np.empty(len(hashes), np.int64)
        rank[np.lexsort((hashes.view(np.int64), -counts))] = np.arange(len(hashes))
        self.rank = rank[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def ids(self, h: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(model id, index in the table, found)."""
        at, ok = self.find(h)
        rank = np.where(ok, self.rank[at] if len(self.rank) else 0, LEXICON)
        return np.where(ok & (rank < LEXICON), rank, LEXICON + tails), at, ok


def _tokens(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: hashes and tail classes of all words, end tokens included, and bounds of texts."""
    for _, part in blocks(texts):
        h, bounds, start, end, buf = words(part)
        tails = tail_class(start, end, buf) if len(h) else np.zeros(0, np.int64)
        yield np.insert(h, bounds[1:], END), np.insert(tails, bounds[1:], 0), bounds + np.arange(len(bounds))


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hs, ts = [], []
        for h, t, _ in _tokens(b["text"].cast(pa.binary()).to_pylist()):
            hs.append(h)
            ts.append(t)
        if hs:
            h, first, n = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(ts)[first]), pa.array(n)], names=["h", "tail", "n"])


def _train(start: Model, lexicon: Lexicon):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[int, list[bytes]]]:
            for b in batches:
                who, texts = b["replica"].to_numpy(), b["text"].cast(pa.binary())
                cuts = [0, *(np.flatnonzero(np.diff(who)) + 1), b.num_rows]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    if y > x:
                        yield int(who[x]), texts.slice(x, y - x).to_pylist()

        now, model, docs, held, n, moments = None, None, [], 0, 0, []

        def done() -> pa.RecordBatch:
            more = model.train(docs, rate=RATE, lanes=LANES, moments=moments) if docs else 0
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n + more], pa.int64()), pa.array([model.dump()], pa.binary())], names=["replica", "n", "w"])

        for who, texts in parts():
            if who != now:  # the next replica in this task starts from the round's weights
                if now is not None:
                    yield done()
                now, model, docs, held, n, moments = who, copy.deepcopy(start), [], 0, 0, []
            for h, t, bounds in _tokens(texts):
                ids = lexicon.ids(h, t)[0].astype(np.int32)
                for d in np.split(ids, bounds[1:-1]):  # chunks are cut by documents alone, whatever the batches
                    docs.append(d)
                    held += len(d)
                    if held >= CHUNK:
                        n += model.train(docs, rate=RATE, lanes=LANES, moments=moments)
                        docs, held = [], 0
        if now is not None:
            yield done()

    return run


def _average(shape: Model):
    def run(t: pa.Table) -> pa.Table:
        model, total, sums = copy.deepcopy(shape), 0, {k: 0.0 for k in Model.NAMES}
        rows = sorted(zip(t["replica"].to_pylist(), t["n"].to_pylist(), t["w"].to_pylist(), strict=True))
        for _, n, w in rows:
            m = model.load(w)
            total += n
            for k in sums:
                sums[k] = sums[k] + n * getattr(m, k).astype(np.float64)
        for k in sums:
            setattr(model, k, (sums[k] / max(1, total)).astype(np.float32))
        return pa.table({"replica": pa.array([rows[0][0]], pa.int64()), "n": pa.array([total], pa.int64()), "w": pa.array([model.dump()], pa.binary())})

    return run


def _score(model: Model, lexicon: Lexicon, tail_n: np.ndarray, tail_v: np.ndarray, total: int, distinct: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.log10(total + 0.5 * (distinct + 1))
        share = np.log10(tail_n + 0.5 * (tail_v + 1))
        counted = np.log10(np.r_[lexicon.counts, 0.0][: max(1, len(lexicon.counts))] + 0.5)
        for b in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            texts = b["text"].cast(pa.binary()).to_pylist()
            n, known, base, score = [], [], [], []
            docs: list[np.ndarray] = []
            rare: tuple[list, ...] = ([], [], [])  # words, their counts, how many of each document
            for h, t, bounds in _tokens(texts):
                ids, at, ok = lexicon.ids(h, t)
                logs = np.where(ok, counted[at], 0.0)
                in_tail = ids >= LEXICON
                word = np.where(in_tail, logs - share[np.where(in_tail, ids - LEXICON, 0)], 0.0)
                size, first = np.diff(bounds), bounds[:-1]  # a text has one token at least
                n.append(size)
                known.append(np.add.reduceat(ok.astype(np.int64), first))
                base.append(np.add.reduceat(logs, first) - floor * size)
                score.append(np.add.reduceat(word, first))
                docs += np.split(ids.astype(np.int32), bounds[1:-1])
                new = np.flatnonzero(~ok)
                owner, name = np.searchsorted(bounds, new, "right") - 1, h[new]
                by = np.lexsort((name, owner))
                owner, name = owner[by], name[by]
                start = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(name, prepend=name[:1]) != 0)) if len(new) else new
                for out, v in zip(rare, (name[start].view(np.int64), np.diff(start, append=len(new)), np.bincount(owner[start], minlength=len(size))), strict=True):
                    out.append(v)
            if not docs:
                continue
            n, known, base, score = (np.concatenate(x) for x in (n, known, base, score))
            score = score + model.score(docs) / np.log(10)
            names, times, each = (np.concatenate(x) for x in rare)
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)], pa.int32()), pa.StructArray.from_arrays([pa.array(names), pa.array(times)], ["h", "n"]))
            yield pa.RecordBatch.from_arrays([b["uid"], b["doc_id"], b["held_out"], *map(pa.array, (n, known, base, score)), listed], names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])

    return run


def train_rounds(model: Model, lexicon: Lexicon, train: DataFrame, tokens: int) -> int:
    """Train the model on all documents in ROUNDS averaging rounds; returns the tokens read.

    A document's hash deals it to a round and a replica, which reads its documents in
    the order of their hashes. The number of replicas follows from the tokens alone, so
    the weights don't depend on Spark's settings or on how the table is cut.
    """
    replicas = min(MOST_REPLICAS, max(1, -(-tokens // (ROUNDS * SHARE))))
    side = max(1, int(np.sqrt(replicas)))
    dealt = train.select("text", F.xxhash64("doc_id", "text", F.lit("share")).alias("slot"))
    dealt = dealt.withColumn("replica", F.pmod(F.shiftright("slot", 8), F.lit(replicas)).cast("long"))
    total = 0
    for k in range(ROUNDS):
        mine = dealt.filter(F.pmod("slot", F.lit(ROUNDS)) == k).repartition(replicas, "replica").sortWithinPartitions("replica", "slot", "text")
        trained = mine.select("replica", "text").mapInArrow(_train(model, lexicon), "replica long, n long, w binary")
        level = trained.withColumn("g", F.col("replica") % side).groupBy("g").applyInArrow(_average(model), "replica long, n long, w binary")
        means = sorted((r for r in level.collect() if r["n"]), key=lambda r: r["replica"])  # about the square root of the replicas
        if means:
            merged = _average(model)(pa.table({"replica": [r["replica"] for r in means], "n": [r["n"] for r in means], "w": pa.array([bytes(r["w"]) for r in means], pa.binary())}))
            model.load(merged["w"][0].as_py())
            total += merged["n"][0].as_py()
    return total


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", warm_docs: int = WARM_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: crc32 of the id's text mod 5 is 1; a null id is not held out. A null
    text is empty: one end token. Repeated rows are trained on and scored one by
    one. Without training rows all counts are 0 and the model has its first
    weights. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text.alias("text"))
    train = d.filter(~F.col("held_out"))
    counts = materialize(train.select("text").mapInArrow(_count, "h long, tail long, n long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the commonest words, as many whole steps of frequency (eighths of a power of two) as fit into FREQUENT
    level = F.floor(8 * F.log2("n")).cast("int")
    least, held_words = 1 << 30, 0
    for r in sorted(counts.groupBy(level.alias("l")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["l"]):
        if held_words + r["words"] > FREQUENT:
            break
        least, held_words = r["l"], held_words + r["words"]
    top = counts.filter(level >= least).select("h", "tail", "n").toPandas().sort_values(["n", "h"], ascending=[False, True])
    lexicon = Lexicon(top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))
    own = top["n"].to_numpy(np.float64)[:LEXICON]
    word_counts = np.zeros(LEXICON)
    word_counts[lexicon.rank[lexicon.rank < LEXICON]] = lexicon.counts[lexicon.rank < LEXICON]
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tail_n[r["tail"]], tail_v[r["tail"]] = r["n"], r["v"]
    np.subtract.at(tail_n, top["tail"].to_numpy(np.int64)[:LEXICON], own)
    np.subtract.at(tail_v, top["tail"].to_numpy(np.int64)[:LEXICON], 1.0)
    model = Model(np.concatenate([word_counts.reshape(CLASSES, PER).sum(1), tail_n]), word_counts)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("lm"))
    n_train = max(1, train.count())
    warm = train.filter(F.pmod(order, F.lit(SLOTS)) < min(SLOTS, int(SLOTS * warm_docs / n_train) + 1)).select(order.alias("o"), "text").collect()
    first = []
    for h, t, bounds in _tokens([r["text"].encode() for r in sorted(warm, key=lambda r: (r["o"], r["text"]))[: 2 * warm_docs]]):
        ids = lexicon.ids(h, t)[0]
        first += [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
    model.train(first, seed=0)
    model.train(first, rate=0.005, seed=1)
    train_rounds(model, lexicon, train, int(total))
    rows = d.withColumn("uid", F.monotonically_increasing_id())
    scored = rows.mapInArrow(_score(model, lexicon, tail_n, tail_v, int(total), int(distinct)), "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<h:long,n:long>>")
    scored = materialize(scored, "lm-scored")
    # words beyond the frequent ones: unseen ones have count 0
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.h", F.col("r.n").alias("k"))
    met = rare.join(counts.select("h", "n"), "h", "left")
    c = F.coalesce("n", F.lit(0))
    more = met.groupBy("uid").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known2"), F.sum(F.col("k") * F.log10(c + 0.5)).alias("logs"))
    out = scored.drop("rare").join(more, "uid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
