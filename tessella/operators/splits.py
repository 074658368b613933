"""Deterministic splits, shards, merges, resumption and set operations."""

from ._dialect import pair

_HEX_S, _HEX_D = "cast(conv(substr(sha2(concat('salt', chr(0), cast(doc_id AS string)), 256), 1, 13), 16, 10) AS bigint)", "cast(concat('0x', substr(sha256(concat('salt', chr(0), cast(doc_id AS varchar))), 1, 13)) AS bigint)"
_SPLIT = "SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, {hex} / cast(4503599627370496 AS double) AS u FROM documents) q"

QUERIES = [
    ("hash_split", _SPLIT.format(hex=_HEX_S), _SPLIT.format(hex=_HEX_D)),
    ("modulo_shard_merge", *pair("""
        SELECT o_orderkey, cast(o_orderkey % 8 AS bigint) AS shard FROM orders WHERE o_orderkey % 8 < 4 UNION ALL SELECT o_orderkey, cast(o_orderkey % 8 AS bigint) AS shard FROM orders WHERE o_orderkey % 8 >= 4""")),
    ("shard_rollup", *pair("SELECT coalesce(o_orderkey % 8, -1) AS shard, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderkey % 8, o_orderstatus)")),
    ("resume_anti_join", *pair("SELECT c.c_custkey FROM customer c ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000) o ON c.c_custkey = o.o_custkey")),
    ("duplicate_guard", *pair("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")),
    ("key_difference", *pair("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'")),
    ("key_intersection", *pair("SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey AS k FROM lineitem")),
    ("support_semi_join", *pair("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")),
    ("alias_left_join", *pair("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")),
]
