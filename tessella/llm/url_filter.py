"""URL filter by a path-template tree (operator 10), in DataFrame functions.

Per host, the segments of paths form a tree. A segment that is a number, a hex
string or one of very many siblings becomes a wildcard; sibling branches of like
shape merge where labels of both say that they are alike, and those without labels only
among themselves. Templates are judged by the smoothed share of blocked URLs among the
labelled ones, labels being the verdicts of the given rules. A template that has none is
judged by its host's labelled branches, each of which is one piece of evidence however
many URLs it has: by their mean share, less two standard errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import ascii_lower, join_counted, materialize

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
SINGLE = 8  # levels of one segment each
FAN_OUT = 32  # siblings from which a level counts as variable
STRENGTH = 4.0  # weight of the host's share in the smoothing
REJECT = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _kind(seg: Column) -> Column:
    """A variable segment's wildcard, else the segment."""
    stem = F.regexp_replace(seg, r"\.(html?|php|aspx?)$", "")
    return F.when(stem.rlike("^[0-9]+$"), F.lit("{n}")).when(stem.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("{x}")).otherwise(seg)


def _units(segs: Column) -> Column:
    """The first SINGLE segments, and all others joined in units of 2, 4, 8, ...: a level each, so that very deep paths have few."""
    spans = [(k, 1) for k in range(SINGLE)] + [(SINGLE + (1 << k) - 2, 1 << k) for k in range(1, 30)]
    units = F.array(*[F.array_join(F.slice(segs, at + 1, n), "/") for at, n in spans])
    return F.when(F.size(segs) > SINGLE, F.filter(units, lambda u: u != "")).otherwise(segs)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, fan_out: int = FAN_OUT, strength: float = STRENGTH, reject: float = REJECT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    A null url or one without :// has an empty host and path and is judged as any
    other: no rule fits, its template has no labels, it is allowed. Repeated rows
    count once each. An empty table gives no rows; other columns are not read.
    Templates come from counts over all pages, combined before the shuffle. Every
    level of a path has branches of its own, deep ones several segments a level; a level
    is worked on for the paths alone that reach it in company. Branches, templates and paths of hot hosts go to all tasks (they
    can't be many), the others are met by a shuffle.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", rule).withColumn("ruled", verdict)
    d = d.withColumn("segs", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _kind)).withColumn("segs", _units(F.col("segs")))
    d = materialize(d, "url-pages")
    keys = d.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("ruled").alias("m"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("b"))
    keys = materialize(keys.withColumn("tpl", F.array().cast("array<string>")), "url-keys")
    total, deepest = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.size("segs")), F.lit(0))).first()
    leaf, active = keys.filter(F.size("segs") == 0), keys.filter(F.size("segs") > 0)
    for level in range(deepest):
        here = active.withColumn("seg", F.get("segs", F.lit(level)))
        # 1. a level with very many siblings is variable
        shape = F.concat_ws("/", F.transform(F.slice("segs", level + 2, deepest), lambda s: F.when(s.rlike(r"^\{.\}$"), s).otherwise(F.lit("*"))))
        sib = here.groupBy("host", "tpl", "seg").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.max(shape).alias("shape"), F.count("*").alias("held"))
        sib = materialize(sib, "url-siblings")  # each step is a table of its own, so that no plan holds another twice
        wide = sib.groupBy("host", "tpl").agg(F.count("*").alias("siblings"), F.sum("m").alias("pm"), F.sum("b").alias("pb"), F.sum("held").alias("branch"))
        # 2. branches of one shape merge when their shares of blocked labels lie within two standard errors of the parent's
        j = materialize(join_counted(sib, materialize(wide, "url-wide"), ["host", "tpl"], "siblings", total), "url-branches")
        p = (F.col("pb") + 1) / (F.col("pm") + 2)
        far = F.abs(F.col("b") - F.col("m") * p) > 2 * F.sqrt(F.col("m") * p * (1 - p) + 0.25)
        like = (F.col("m") > 0) & ~far
        # a branch without labels has nothing to be compared by: it isn't like a labelled one
        name = F.when(F.col("siblings") >= fan_out, F.lit("*")).when(F.col("seg").rlike(r"^\{.\}$"), F.col("seg")).when(like, F.concat(F.lit("*:"), F.col("shape"))).when(F.col("m") == 0, F.concat(F.lit("?:"), F.col("shape"))).otherwise(F.col("seg"))
        names = materialize(j.select("host", "tpl", "seg", "held", "branch", name.alias("name")), "url-names")
        named = join_counted(here, names, ["host", "tpl", "seg"], "held", total)
        # a path that is alone in its branch can't merge any further down: the rest of it names its template
        done = (F.size("segs") == level + 1) | (F.col("branch") == 1)
        rest = F.when(F.col("branch") == 1, F.slice("segs", level + 2, deepest)).otherwise(F.array().cast("array<string>"))
        keys = materialize(named.select("host", "segs", "n", "m", "b", F.concat("tpl", F.array("name"), rest).alias("tpl"), done.alias("done")), "url-keys")
        leaf, active = leaf.unionByName(keys.filter("done").drop("done")), keys.filter("not done").drop("done")
        if active.isEmpty():
            break
    leaf = leaf.withColumn("template", F.concat(F.lit("/"), F.array_join("tpl", "/")))
    tpl = leaf.groupBy("host", "template").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.count("*").alias("paths"))
    tpl = materialize(tpl, "url-templates")
    hosts = tpl.groupBy("host").agg(((F.sum("b") + 1) / (F.sum("m") + 2)).alias("prior"), F.sum("m").alias("hm"), F.count("*").alias("templates"))
    branches = leaf.groupBy("host", F.get("segs", F.lit(0)).alias("branch")).agg(F.sum("m").alias("m"), F.sum("b").alias("b")).filter("m > 0")
    known = branches.groupBy("host").agg(F.count("*").alias("labelled"), F.sum(F.col("b") / F.col("m")).alias("shares"))
    hosts = hosts.join(known, "host", "left").fillna(0, ["labelled", "shares"])
    tpl = join_counted(tpl, materialize(hosts, "url-hosts"), ["host"], "templates", total)
    # a host without labels has no evidence: its share is nought
    purity = F.when(F.col("hm") == 0, F.lit(0.0)).otherwise((F.col("b") + strength * F.col("prior")) / (F.col("m") + strength))
    # without labels of its own a template has the share of its host's branches, as far as they are sure of it
    share = (F.col("shares") + 1) / (F.col("labelled") + 2)
    bound = F.when(F.col("hm") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), share - 2 * F.sqrt(share * (1 - share) / (F.col("labelled") + 3))))
    judged = materialize(tpl.select("host", "template", "paths", F.when(F.col("m") > 0, purity).otherwise(bound).alias("purity")), "url-purity")
    per_key = materialize(join_counted(leaf.select("host", "segs", "n", "template"), judged, ["host", "template"], "paths", total).select("host", "segs", "n", "template", "purity"), "url-judged")
    out = join_counted(d, per_key, ["host", "segs"], "n", total)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") > reject, F.lit("block")).otherwise("allow")).alias("verdict"), "template", "purity")
