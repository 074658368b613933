"""Language ID by a byte convolutional network (operator 9), trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; each
filter's maximum over a window feeds a softmax. A filter of width w is the sum of
w table look-ups; for prediction two neighbouring bytes share one look-up. The
probabilities of a text's windows are averaged by length, over the whole text.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks, lean, mix, slices

WINDOW, WIDTHS, FILTERS = 256, (2, 4, 6), 10
SAMPLE = 3000  # labelled documents that the fit reads, about
MOST_WINDOWS = 40_000  # windows of theirs that the driver holds, about
EPOCHS, RATE = 2, 0.01
STEPS = 500  # updates at least, so that a small sample is fitted as well
UNKNOWN = "und"


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text, weight): zero-padded windows that cover each text."""
    data, owner, weight = [], [], []
    for i, t in enumerate(texts):
        for s in range(0, len(t), size):
            w = t[s : s + size]
            data.append(w.ljust(size, b"\0"))
            owner.append(i)
            weight.append(len(w))
    return np.frombuffer(b"".join(data), np.uint8).reshape(-1, size), np.array(owner, np.int64), np.array(weight, np.float64)


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, h, at, w): the windows of sampled texts, each with a hash of its own."""
    for b in batches:
        for y, h, t in zip(b["y"].to_pylist(), b["h"].to_pylist(), b["t"].cast(pa.binary()).to_pylist(), strict=True):
            x = windows([t])[0]
            at = np.arange(len(x), dtype=np.int64)
            own = mix(np.full(len(x), h, np.int64).view(np.uint64) + mix(at.view(np.uint64) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(x), pa.string()), pa.array((own >> np.uint64(40)).astype(np.int64)), pa.array(at), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "own", "at", "w"])


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [r.normal(0, 0.5 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 64, seed: int = 7) -> ByteCNN:
        r = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(max(epochs, -(-STEPS * batch // max(1, len(x))))):
            order = r.permutation(len(x))
            for s in range(0, len(x), batch):
                rows = order[s : s + batch]
                xb, hidden, best = x[rows], [], []
                for w, t in zip(WIDTHS, self.tables, strict=True):
                    span = x.shape[1] - w + 1
                    z = sum(t[k][xb[:, k : k + span]] for k in range(w))
                    at = z.argmax(1)
                    best.append(at)
                    hidden.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
                h = np.concatenate(hidden, 1)
                a = np.tanh(h)
                p = _softmax(a @ self.out + self.bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                grads = [np.zeros_like(t) for t in self.tables] + [a.T @ p, p.sum(0)]
                back = (p @ self.out.T) * (1 - a * a)
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        hit = np.take_along_axis(xb, best[i] + k, 1)
                        np.add.at(grads[i][k], (hit, np.arange(FILTERS)[None, :]), g)
                step += 1
                for j, g in enumerate(grads):
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.001 * (g * g - v[j])
                    params[j] -= (rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, x: np.ndarray, pairs: list) -> np.ndarray:
        """Probabilities of windows; pairs: from pair_tables()."""
        x = x.astype(np.int32)
        two = x[:, :-1] * 256 + x[:, 1:]
        hidden = []
        for w, tables in zip(WIDTHS, pairs, strict=True):
            span = x.shape[1] - w + 1
            z = np.take(tables[0], two[:, :span], axis=0)
            for k, t in enumerate(tables[1:], 1):
                z += np.take(t, two[:, 2 * k : 2 * k + span], axis=0)
            hidden.append(z.max(1))
        return _softmax(np.tanh(np.concatenate(hidden, 1)) @ self.out + self.bias)

    def pair_tables(self) -> list:
        return [[(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(t), 2)] for t in self.tables]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_language_id(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, most_windows: int = MOST_WINDOWS) -> ByteCNN | None:
    """A network from all windows of about `sample` labelled texts; None without any.

    The sample is the bound of a classifier's training data, the one place where
    rows are not all used; it is drawn evenly over labels by a hash of ids. Windows
    are cut where the texts lie. If the sampled texts have more than most_windows,
    those with the least hashes are taken, about as many, so that long texts can't
    fill the driver.
    """
    slots = 1 << 24
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("cnn"))
    rows = labelled.filter(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(label_col).cast("string").alias("y"), h.alias("h"), F.col(text_col).alias("t"))
    sizes = {r["y"]: (r["n"], r["b"]) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.ceil(F.octet_length("t") / WINDOW)).alias("b")).collect()}
    if not sizes:
        return None
    names, quota = sorted(sizes), max(1, sample // len(sizes))
    # hash thresholds, so that what comes to the driver doesn't grow with the table
    share = {k: min(1.0, quota / n) for k, (n, _) in sizes.items()}
    limits = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(int(slots * share[k]) + 1))])
    drawn = rows.filter(F.pmod("h", F.lit(slots)) < limits[F.col("y")]).mapInArrow(_cut, "y string, own long, at long, w binary")
    expected = sum(share[k] * b for k, (_, b) in sizes.items())
    if expected > most_windows:
        drawn = drawn.filter(F.col("own") < int(slots * most_windows / expected))
    got = sorted((r["own"], r["at"], r["y"], bytes(r["w"])) for r in drawn.collect())
    if not got:
        return None
    x = np.frombuffer(b"".join(r[3] for r in got), np.uint8).reshape(-1, WINDOW)
    return ByteCNN(names).fit(x, np.searchsorted(names, [r[2] for r in got]))


def predict_texts(model: ByteCNN | None, pairs: list | None, texts: list[bytes], letters: list[bool]) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    live = [i for i, ok in enumerate(letters) if ok] if model else []
    for at, part in blocks([texts[i] for i in live], 1 << 17):
        x, owner, weight = windows(part)
        total = np.zeros((len(part), len(model.labels)))
        for s in range(0, len(x), 512):  # one very long text is many windows
            np.add.at(total, owner[s : s + 512], model.predict(x[s : s + 512], pairs) * weight[s : s + 512, None])
        total /= total.sum(1, keepdims=True)
        for j, best in enumerate(total.argmax(1)):
            names[live[at + j]], scores[live[at + j]] = model.labels[best], min(1.0, total[j, best])
    return names, scores


def _apply(model: ByteCNN | None):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model.pair_tables() if model else None
        for b in slices(batches):
            names, scores = predict_texts(model, pairs, b["text"].cast(pa.binary()).to_pylist(), b["letters"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def keep_known_language(docs: DataFrame, model: ByteCNN | None, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a letter and a language of score `least` or more.

    Without a model every text with a letter stays; null and empty texts go.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model.pair_tables() if model else None
        for b in slices(batches):
            _, scores = predict_texts(model, pairs, b[text_col].cast(pa.binary()).to_pylist(), [True] * b.num_rows)
            yield b.filter(pa.array(scores >= least)) if model else b

    return docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, docs.schema)


def identify_language(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    held_out: crc32 of the id's text mod 5 is 0; a null id is not held out. The
    prediction reads the text alone; a null text or one without a letter, or any
    text when there is no model, is `und` with score 0. Repeated rows give equal
    rows. An empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.coalesce(text, F.lit("")).alias("text"))
    return d.mapInArrow(_apply(model), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(id_col, remainder: int = 0):
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == remainder, F.lit(False))
