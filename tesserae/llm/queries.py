"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import embed_dedup, langid, license_scan, near_dedup, packing, quality, secret_scan, token_count, trie_bpe, warc
from tesserae.llm.common import read


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes_of(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap in archives just written would be lost pages: it fails the query."""
    lost = F.raise_error(F.concat_ws(" ", F.lit("a gap in"), "archive", "gap_start", "gap_end", "gap_reason")).cast("boolean")
    return warc.roundtrip(read(spark, sf_dir, "pages")).where(F.col("gap_start").isNull() | lost).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_license_scans, op2_secret_scans, op3_embedding_near_dedup, op4_token_counts, op5_minhash_near_dedup, op6_warc, op7_bpe, op8_best_fit_packing, op9_language_id, op10_quality_rules)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in license_scan.TEMPLATES)
_WORDS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^0-9a-z\x{{80}}-\x{{10ffff}}]+'), lambda w: w <> '')"
_COMPONENTS = """, sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM sym UNION SELECT r.a, e.b FROM reach r JOIN sym e ON r.b = e.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

SQL = {
    "op1_license_scans": f"""
WITH t AS (SELECT license_id, {_WORDS.format("text")} AS w FROM (VALUES {_TEMPLATE_ROWS}) v(license_id, text)),
ts AS (SELECT DISTINCT license_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT license_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
n AS (SELECT license_id, count(*) AS n_template FROM ts GROUP BY license_id)
SELECT doc_id, license_id, count(*) AS n_found, n_template FROM dsh JOIN ts USING (s) JOIN n USING (license_id)
GROUP BY doc_id, license_id, n_template HAVING count(*) >= {license_scan.CONTAINMENT} * n_template""",
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.95){_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM sym GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN comp ON id = vec_id LEFT JOIN n ON a = vec_id""",
    "op5_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)){_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON id = d.doc_id""",
    "op6_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= {warc.REVISIT_FROM} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)""",
}
