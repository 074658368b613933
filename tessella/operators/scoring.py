"""Token F1 of neighbouring turns, action classes and buckets."""

from ._dialect import pair

_F1 = """
WITH t AS (SELECT conv_id, turn, lower(text) AS text, lead(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM conversations),
     n AS (SELECT conv_id, turn, text, nxt FROM t WHERE nxt IS NOT NULL),
     a AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, @explode(@words(text, @ws)) AS w FROM n) x WHERE w <> '' GROUP BY conv_id, turn, w),
     b AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, @explode(@words(nxt, @ws)) AS w FROM n) x WHERE w <> '' GROUP BY conv_id, turn, w),
     sa AS (SELECT conv_id, turn, sum(c) AS s FROM a GROUP BY conv_id, turn), sb AS (SELECT conv_id, turn, sum(c) AS s FROM b GROUP BY conv_id, turn),
     k AS (SELECT a.conv_id, a.turn, sum(least(a.c, b.c)) AS k FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.w = b.w GROUP BY a.conv_id, a.turn)
SELECT sa.conv_id, sa.turn, round(coalesce(cast(2 * k.k AS double) / cast(sa.s + sb.s AS double), cast(0 AS double)), 6) AS f1 FROM sa JOIN sb ON sa.conv_id = sb.conv_id AND sa.turn = sb.turn LEFT JOIN k ON sa.conv_id = k.conv_id AND sa.turn = k.turn"""

QUERIES = [
    ("token_f1_turns", *pair(_F1)),
    ("action_class", *pair("""
        SELECT conv_id, turn, CASE WHEN x LIKE '%<query>%' THEN 'Query' WHEN x LIKE '%<evidence>%' THEN 'Evidence' WHEN x LIKE '%<answer>%' THEN 'Answer' ELSE 'Other' END AS action
        FROM (SELECT conv_id, turn, concat(text, CASE turn % 4 WHEN 0 THEN '<query>q</query>' WHEN 1 THEN '<answer>a</answer>' WHEN 2 THEN '<evidence>e</evidence>' ELSE '' END) AS x FROM conversations) c""")),
    ("normalize_query", *(x for x in (r"SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' '))) AS norm FROM benchmark", r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm FROM benchmark"))),
    ("score_bucket", *pair("""
        SELECT quality, toxic, CASE WHEN quality - toxic > 1e-12 THEN 'positive' WHEN quality - toxic < -1e-12 THEN 'negative' ELSE 'zero' END AS bucket, count(*) AS n FROM labels GROUP BY quality, toxic""")),
]
