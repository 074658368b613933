"""Ordered token sequences: differences of entropy over content words, smoothing, triggers, checkpoints."""

from ._dialect import pair

_TREND = """
WITH e AS (SELECT user_id, event_id, ts, value AS h, event_type IN ('click', 'view', 'purchase') AS content FROM events),
     p AS (SELECT user_id, event_id, ts, h, content, {last_h} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
     a AS (SELECT user_id, event_id, ts, CASE WHEN content AND prev IS NOT NULL THEN h - prev ELSE cast(0 AS double) END AS s1 FROM p),
     b AS (SELECT user_id, event_id, ts, s1, {last_s} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM a),
     t AS (SELECT user_id, event_id, ts, s1, CASE WHEN s1 <> 0 AND ps IS NOT NULL THEN s1 - ps ELSE cast(0 AS double) END AS s2 FROM b)"""
_S = {"last_h": "last_value(CASE WHEN content THEN h END, true)", "last_s": "last_value(nullif(s1, 0), true)"}
_D = {"last_h": "last_value(CASE WHEN content THEN h END IGNORE NULLS)", "last_s": "last_value(nullif(s1, 0) IGNORE NULLS)"}
_END = " SELECT user_id, event_id, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM t"
_SMOOTH = """,
     z AS (SELECT user_id, event_id, ts, s2, sum(s2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, lag(s2, 1, cast(0 AS double)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM t WHERE s2 <> 0),
     w AS (SELECT user_id, event_id, ts, s2, p, cast(0.9 AS double) + cast(0.1 AS double) * coalesce(abs(p - m) / nullif(abs(s2 - m) + abs(p - m), 0), 0) AS a FROM z),
     y AS (SELECT user_id, event_id, ts, a * s2 + (1 - a) * p AS trend FROM w)"""
_SMOOTH_END = " SELECT user_id, event_id, cast(round(cast(trend AS decimal(28, 10)), 6) AS double) AS trend FROM y"
_TRIGGER = " SELECT user_id, event_id, cast(round(cast(trend AS decimal(28, 10)), 6) AS double) AS trend FROM (SELECT user_id, event_id, trend, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM y WHERE trend > 100) q WHERE rn = 1"
# a user's first signup and first error stay, and five others at evenly spaced ranks, halves to even
_BUDGET = """
WITH e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
     a AS (SELECT user_id, event_id, ts, event_type IN ('signup', 'error') AND k = 1 AS anchor FROM e),
     r AS (SELECT user_id, event_id, anchor, row_number() OVER (PARTITION BY user_id, anchor ORDER BY ts, event_id) - 1 AS rank, count(*) OVER (PARTITION BY user_id, anchor) - 1 AS top FROM a)
SELECT user_id, event_id, anchor FROM r WHERE anchor OR rank IN (0, {even}(top / 4e0{to}), {even}(top / 2e0{to}), {even}(3 * top / 4e0{to}), top)"""
# letters of step, query, retrieve, answer and final tags in order
_TAGS = "CASE event_type WHEN 'signup' THEN 'S' WHEN 'view' THEN 'Q' WHEN 'click' THEN 'R' WHEN 'purchase' THEN 'A' ELSE 'F' END"
_FORMAT = """
SELECT user_id, trace, tags, CASE WHEN {like}(tags, '^(SQRSA)*SF$') THEN 1 ELSE -1 END AS reward FROM (
  SELECT user_id, cast(floor(event_id / 200e0) AS bigint) AS trace, {join} AS tags FROM events GROUP BY user_id, cast(floor(event_id / 200e0) AS bigint)) q"""

QUERIES = [
    ("entropy_trend", _TREND.format(**_S) + _END, _TREND.format(**_D) + _END),
    ("smooth_trend", _TREND.format(**_S) + _SMOOTH + _SMOOTH_END, _TREND.format(**_D) + _SMOOTH + _SMOOTH_END),
    ("trigger_first", _TREND.format(**_S) + _SMOOTH + _TRIGGER, _TREND.format(**_D) + _SMOOTH + _TRIGGER),
    ("asof_prior_sentence", *pair("""
        SELECT event_id, user_id, coalesce(prior, -1) AS prior FROM (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events) q WHERE event_type = 'error'""")),
    ("word_islands", *pair("""
        SELECT user_id, cast(island AS bigint) AS island, count(*) AS n, max(value) AS top FROM (SELECT user_id, value, sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM events) q GROUP BY user_id, island""")),
    ("checkpoint_first", *pair("""
        SELECT user_id, event_type, event_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) - 1 AS checkpoint FROM (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) q WHERE rn = 1""")),
    ("counter_deltas", *pair("""
        SELECT user_id, event_id, round(value - lag(value, 1, cast(0 AS double)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events""")),
    ("checkpoint_budget", _BUDGET.format(even="bround", to=""), _BUDGET.format(even="round_even", to=", 0")),
    ("format_reward",
     _FORMAT.format(like="regexp_like", join=f"array_join(transform(sort_array(collect_list(struct(ts, event_id, {_TAGS} AS tag))), x -> x.tag), '')"),
     _FORMAT.format(like="regexp_matches", join=f"string_agg({_TAGS}, '' ORDER BY ts, event_id)")),
]
