"""Counterfactual benefit, oracle gain, flips and audits of rollout bundles (orders stand for actions, customers for samples)."""

from ._dialect import pair

_ACT = """
WITH s AS (SELECT o_custkey AS state, o_orderkey AS action, o_orderpriority AS source, o_orderstatus AS checkpoint, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
     k AS (SELECT state, score AS skip FROM s WHERE rn = 1),
     b AS (SELECT s.state, s.action, s.source, s.checkpoint, s.score, k.skip, s.score - k.skip AS benefit FROM s JOIN k ON s.state = k.state WHERE s.rn > 1)"""

QUERIES = [
    ("benefit_by_source", *pair(_ACT + """
        SELECT source, count(*) AS n, round(avg(benefit), 4) AS mean_benefit, round(avg(CASE WHEN benefit > 1e-12 THEN cast(1 AS double) ELSE 0 END), 9) AS positive_rate, round(avg(CASE WHEN benefit < -1e-12 THEN cast(1 AS double) ELSE 0 END), 9) AS negative_rate FROM b GROUP BY source""")),
    ("benefit_grouping_sets", *pair(_ACT + """
        SELECT source, checkpoint, count(*) AS n, round(avg(benefit), 4) AS mean_benefit FROM b GROUP BY GROUPING SETS ((source), (checkpoint), ())""")),
    ("oracle_gain", *pair(_ACT + """
        SELECT state, round(max(score) - max(skip), 4) AS state_gain, round(greatest(max(score) - max(skip), 0), 4) AS sample_gain FROM b GROUP BY state""")),
    ("accuracy_flips", *pair(_ACT + """
        SELECT CASE WHEN skip < 150000 AND score >= 150000 THEN 'wrong_to_correct' WHEN skip >= 150000 AND score < 150000 THEN 'correct_to_wrong' ELSE 'same' END AS flip, count(*) AS n FROM b GROUP BY 1""")),
    ("rollout_audit", *pair("""
        SELECT c.c_custkey, CASE WHEN o.n IS NULL THEN 'missing' WHEN o.n < 5 THEN 'short' ELSE 'complete' END AS status, cast(coalesce(o.n, 0) AS bigint) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""")),
    ("intervention_best_ties", *pair("""
        SELECT operator, count(*) AS best FROM (SELECT l_orderkey, operator, score, max(score) OVER (PARTITION BY l_orderkey) AS top FROM (SELECT l_orderkey, l_returnflag AS operator, max(l_quantity) AS score FROM lineitem GROUP BY l_orderkey, l_returnflag) q) r WHERE score = top GROUP BY operator""")),
]
