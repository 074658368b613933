"""Corpus preparation: title split, fixed-width chunks, content hashes, deltas."""

from ._dialect import pair

_CHUNKS_SPARK = r"""
WITH w AS (SELECT doc_id, split(trim(text), '\\s+') AS ws FROM documents),
     c AS (SELECT doc_id, ws, explode(sequence(0, cast((size(ws) - 1) div 100 AS int))) AS chunk FROM w)
SELECT doc_id, cast(chunk AS bigint) AS chunk, array_join(slice(ws, chunk * 100 + 1, 100), ' ') AS body FROM c"""
_CHUNKS_DUCK = r"""
WITH w AS (SELECT doc_id, regexp_split_to_array(trim(text), '\s+') AS ws FROM documents),
     c AS (SELECT doc_id, ws, unnest(range(0, (len(ws) - 1) // 100 + 1)) AS chunk FROM w)
SELECT doc_id, cast(chunk AS bigint) AS chunk, array_to_string(ws[chunk * 100 + 1 : chunk * 100 + 100], ' ') AS body FROM c"""
_FIRST = """
SELECT doc_id, chunk, h FROM (SELECT doc_id, chunk, h, row_number() OVER (PARTITION BY h ORDER BY doc_id, chunk) AS rn FROM
  (SELECT doc_id, chunk, md5(body) AS h FROM ({chunks}) q) r) s WHERE rn = 1"""

QUERIES = [
    ("chunk_100_words", _CHUNKS_SPARK, _CHUNKS_DUCK),
    ("chunk_md5_dedup", _FIRST.format(chunks=_CHUNKS_SPARK), _FIRST.format(chunks=_CHUNKS_DUCK)),
    ("title_body_split", *pair(r"""
        SELECT doc_id, trim(CASE WHEN p > 0 THEN substr(text, 1, p - 1) ELSE text END) AS title, CASE WHEN p > 0 THEN substr(text, p + 1) ELSE '' END AS body
        FROM (SELECT doc_id, text, instr(text, chr(10)) AS p FROM documents) d""")),
    ("corpus_delta_anti", *pair("""
        SELECT doc_id, h FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM
          (SELECT doc_id, md5(trim(text)) AS h FROM documents WHERE doc_id % 2 = 1) n
          WHERE NOT EXISTS (SELECT 1 FROM (SELECT md5(trim(text)) AS bh FROM documents WHERE doc_id % 2 = 0) b WHERE b.bh = n.h)) q WHERE rn = 1""")),
    ("running_history", *pair("""
        SELECT conv_id, turn, cast(coalesce(sum(length(text)) OVER w, 0) AS bigint) AS history_chars, cast(count(*) OVER w AS bigint) AS history_turns
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")),
]
