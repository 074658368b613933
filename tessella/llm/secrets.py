"""Secret scans with corpus-wide ownership frequency (operator 6).

Texts are scanned where they lie. Candidates go on as hashes: for each hash the
distinct repositories and owners that hold it are counted over the corpus. A hash
held by many owners, or in many repositories of few, is a copied example; one held
by few, varied enough to be random, looks live. Strings of no known form that mix
letters and digits at random are candidates too: they become spans, of the kind own,
where the corpus shows a single owner.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import column_or_null, join_counted, materialize
from ._text import lean

# The base kinds in their order, then the kinds the method adds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ADDED = (
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), "eyJ"),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), "PRIVATE KEY-----"),
    ("hub", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in ADDED), "own")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
LOOSE_BITS = 3.5
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
EXAMPLE_OWNERS, EXAMPLE_REPOS, LIVE_BITS = 3, 6, 2.5


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(kind's index, start, end, secret) by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for i, (_, pattern, hint) in enumerate(ADDED, 3):
        if hint in text:
            found += [(i, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def loose(text: str, found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Strings of 20 characters or more, digits and letters among them and LOOSE_BITS each, that meet no span found."""
    out, at = [], 0
    for m in LOOSE.finditer(text):
        s, a, b = m[0], m.start(), m.end()
        while at < len(found) and found[at][2] <= a and found[at][1] <= a:
            at += 1
        if any(x < b and y > a for _, x, y, _ in found[at : at + 8]) or any(x < b and y > a for _, x, y, _ in found[max(0, at - 8) : at]):
            continue
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and bits_per_char(s) >= LOOSE_BITS:
            out.append((len(KINDS) - 1, a, b, s))
    return out


def bits_per_char(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _text(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in found)


_DDL = "doc_id long, owner string, repo string, part long, idx long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start:int,kind:int,stop:int>>, secrets array<struct<h:string,bits:double,start:int,kind:int,stop:int>>"


@lean
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, done = TaskContext.get().partitionId(), 0
    place = [("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]
    kind = pa.list_(pa.struct([("h", pa.string()), ("bits", pa.float64()), *place]))
    for b in batches:
        counts, shas, spans, secrets = ([], [], []), [], [], []
        for text in b["text"].to_pylist():
            found = scan(text)
            base = [x for x in found if x[0] < 3]
            for k in range(3):
                counts[k].append(sum(x[0] == k for x in base))
            shas.append(hashlib.sha256(_text(base).encode()).hexdigest())
            spans.append([{"start": a, "kind": k, "stop": z} for k, a, z, _ in found])
            secrets.append([{"h": hashlib.sha256(s.encode()).hexdigest()[:32], "bits": bits_per_char(s), "start": a, "kind": k, "stop": z} for k, a, z, s in [*found, *loose(text, found)]])
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["owner"], b["repo"], pa.array([part] * n, pa.int64()), pa.array(range(done, done + n), pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(spans, pa.list_(pa.struct(place))), pa.array(secrets, kind)],
            names=["doc_id", "owner", "repo", "part", "idx", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets"],
        )
        done += n


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, live_bits: float = LIVE_BITS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    A null text counts as empty. Rows with a null owner belong to one owner of
    their own, likewise null repositories; without repo_col the owner is the
    repository. Repeated rows are scanned one by one, and their secrets counted
    once per owner. A missing owner column counts as null. An empty table gives no
    rows. n_live counts secrets whose characters hold live_bits bits each and that
    fewer than example_owners owners hold in fewer than example_repos repositories
    in all; n_example those that reach either number. Of strings of no known form those
    of a single owner, in fewer than example_repos repositories, are spans of the kind
    own; others are none, however random.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.coalesce(column_or_null(docs, owner_col, "string"), F.lit("\0"))
    repo = F.coalesce(column_or_null(docs, repo_col, "string"), F.lit("\0")) if repo_col else owner
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), repo.alias("repo"), text.alias("text"))
    d = materialize(d.mapInArrow(_run, _DDL), "secrets")
    each = d.select("part", "idx", "owner", "repo", F.explode("secrets").alias("s")).select("part", "idx", "owner", "repo", "s.*")
    # distinct owners and repositories first, so that a hash copied everywhere combines before the shuffle
    held = each.groupBy("h", "owner", "repo").agg(F.count("*").alias("n")).groupBy("h", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    wide = materialize(held.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("held")), "secret-owners")
    total = wide.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    known = join_counted(each, wide, ["h"], "held", int(total))
    example = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    verdicts = known.groupBy("part", "idx").agg(
        F.sum(F.when(~example & (F.col("bits") >= live_bits), 1).otherwise(0)).alias("n_live"),
        F.sum(F.when(example, 1).otherwise(0)).alias("n_example"),
        F.collect_list(F.when((F.col("kind") == len(KINDS) - 1) & (F.col("owners") == 1) & ~example, F.struct("start", "kind", "stop"))).alias("own"),
    )
    out = d.drop("secrets", "owner", "repo").join(verdicts, ["part", "idx"], "left")
    every = F.array_sort(F.concat("spans", F.coalesce("own", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))
