"""The thin queries opN_* over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .language_id import fit_language_id, held_out, identify_language
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .name_join import join_names
from .near_dedup import near_dedup
from .packing import pack
from .rnn_lm import lm_score
from .secrets import scan_secrets
from .token_alignment import align_tokens
from .url_filter import filter_urls
from .vector_dedup import vector_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position", "positions")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables name no repository: a source's documents of one language stand for one."""
    docs = _read(spark, sf_dir, "documents")
    return scan_secrets(docs.withColumn("repo", F.concat_ws("/", "source", "lang")), repo_col="repo")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(_read(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return identify_language(docs, fit_language_id(docs.filter(~held_out(F.col("doc_id")))))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def misspelt(vendors: DataFrame) -> DataFrame:
    """Vendors with two neighbouring code points of the name exchanged where crc32(vendor_id) is even."""
    h, n = F.crc32(F.col("vendor_id").cast("string")), F.char_length("name")
    at = F.pmod(h, F.greatest(n - 1, F.lit(1)).cast("long")).cast("int")
    swapped = F.concat(F.substring("name", F.lit(1), at), F.substring("name", at + 2, F.lit(1)), F.substring("name", at + 1, F.lit(1)), F.substring("name", at + 3, n))
    return vendors.withColumn("name", F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(F.col("name")))


def op11_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = join_names(_read(spark, sf_dir, "clients"), misspelt(_read(spark, sf_dir, "vendors").select("vendor_id", "name")))
    return out.select(F.col("right_id").alias("vendor_id"), "distance", F.col("n_left").alias("n_clients"), F.col("first_left_id").alias("first_client_id"), F.col("left_crc").alias("clients_crc"))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_read(spark, sf_dir, "documents"), tokenizer_path(), piece_path()).drop("groups")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_read(spark, sf_dir, "documents")).drop("dropped")


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_near_dedup, op3_html_extract, op4_mix_sources, op5_pack, op6_secrets, op7_exact_dedup, op8_vector_dedup, op9_language_id, op10_url_filter, op11_name_join, op12_token_alignment, op13_line_dedup)}

ORACLES = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text""",
    "op11_name_join": """
        WITH ids AS (SELECT client_id AS id FROM clients UNION SELECT vendor_id FROM vendors),
             crcs AS (
                SELECT id, xor(list_reduce(
                           list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
                           lambda s, x: CASE WHEN x < 256 THEN xor(s, x) ELSE xor(s >> 1, 3988292384::UBIGINT * (s & 1::UBIGINT)) END), 4294967295::UBIGINT)::BIGINT AS crc
                FROM ids WHERE id IS NOT NULL),
             spelt AS (
                SELECT vendor_id, CASE WHEN crc % 2 = 0 AND length(name) >= 2
                           THEN name[1:crc % (length(name) - 1)] || name[crc % (length(name) - 1) + 2] || name[crc % (length(name) - 1) + 1] || name[crc % (length(name) - 1) + 3:]
                           ELSE name END AS name
                FROM vendors JOIN crcs ON vendor_id = id),
             v AS (SELECT DISTINCT vendor_id, translate(regexp_replace(name, '[\\x20\\x09-\\x0D]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM spelt),
             c AS (SELECT client_id, crc, translate(regexp_replace(name, '[\\x20\\x09-\\x0D]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM clients JOIN crcs ON client_id = id),
             names AS (SELECT DISTINCT f FROM v WHERE f <> '' UNION SELECT f FROM c WHERE f <> ''),
             places AS (SELECT f, unnest(range(1, length(f) + 1)) AS i FROM names),
             holes AS (SELECT f, f[1:i - 1] || chr(10) || f[i + 1:] AS h FROM places),
             cut AS (SELECT f, f[1:i - 1] || f[i + 1:] AS h FROM places),
             swaps AS (SELECT f, f[1:i - 1] || f[i + 1] || f[i] || f[i + 2:] AS h FROM places WHERE i < length(f)),
             near AS (
                SELECT a.f, b.f AS g FROM holes a JOIN holes b USING (h)
                UNION SELECT f, h FROM cut UNION SELECT h, f FROM cut UNION SELECT f, h FROM swaps),
             pairs AS (SELECT f, f AS g, 0 AS distance FROM names UNION SELECT f, g, 1 FROM near WHERE f <> g)
        SELECT v.vendor_id, distance::INTEGER AS distance, count(*) AS n_clients, min(client_id) AS first_client_id, sum(c.crc)::BIGINT AS clients_crc
        FROM v JOIN pairs USING (f) JOIN c ON c.f = pairs.g GROUP BY ALL""",
    "op13_line_dedup": """
        WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
             l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
             k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
             m AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN o USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
