"""Percentiles, group advantages, masked normalisation."""

from ._dialect import pair

QUERIES = [
    ("percentiles_over_threshold",
     "SELECT lang, count(*) AS n, cast(min(n_chars) AS bigint) AS least, round(avg(n_chars), 6) AS mean, round(percentile(n_chars, 0.5), 6) AS p50, round(percentile(n_chars, 0.9), 6) AS p90, round(percentile(n_chars, 0.99), 6) AS p99, cast(max(n_chars) AS bigint) AS most, cast(sum(CASE WHEN n_chars > 4096 THEN 1 ELSE 0 END) AS bigint) AS n_over FROM documents GROUP BY lang",
     "SELECT lang, count(*) AS n, min(n_chars) AS least, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99, max(n_chars) AS most, cast(sum(CASE WHEN n_chars > 4096 THEN 1 ELSE 0 END) AS bigint) AS n_over FROM documents GROUP BY lang"),
    ("group_advantage", *pair("""
        SELECT event_id, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-4), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)""")),
    ("masked_group_norm", *pair("""
        SELECT event_id, round((value - m) / CASE WHEN n <= 1 THEN cast(1 AS double) ELSE sqrt(v + 1e-8) END, 6) AS z FROM (SELECT event_id, event_type, value, avg(CASE WHEN event_type <> 'error' THEN value END) OVER w AS m, var_pop(CASE WHEN event_type <> 'error' THEN value END) OVER w AS v, count(CASE WHEN event_type <> 'error' THEN 1 END) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id)) q WHERE event_type <> 'error'""")),
    ("masked_mean", *pair("""
        SELECT user_id, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) / greatest(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 1), 5) AS mean, round(avg(CASE WHEN event_type = 'click' THEN cast(1 AS double) ELSE 0 END), 9) AS clip_ratio FROM events GROUP BY user_id""")),
    ("trace_feature_summary",
     "SELECT user_id, round(avg(value), 5) AS mean_value, max_by(value, struct(ts, event_id)) AS last_value FROM events GROUP BY user_id",
     "SELECT user_id, round(avg(value), 5) AS mean_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id"),
    ("cube_returns", *pair("""
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")),
]
