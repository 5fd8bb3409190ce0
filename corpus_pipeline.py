"""A corpus pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. Missing columns count as null, extra columns are dropped. Null and empty texts are rejected by the first
stage; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import langid, near_dedup, packing, quality, secret_scan
from tesserae.llm.common import Scratch, read

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
#: Texts with a lower language score are rejected; one half in one language and half in another has about 0.5.
MIN_SCORE = 0.3
REDACTED = "[SECRET]"


def _documents(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no known language: und, or a score under MIN_SCORE."""
    docs = _documents(docs)
    judged = docs.withColumn("_r", langid.predicted(docs))
    return judged.where((F.col("_r.lang_pred") != langid.UNKNOWN) & (F.col("_r.score") >= MIN_SCORE)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the rules do not keep."""
    return _documents(docs).withColumn("_r", quality.measured()).where("_r.kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least doc_id; of repeated rows one stays."""
    docs = _documents(docs)
    kept = near_dedup.classes_of(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept._kept), "left_semi").dropDuplicates(["doc_id", "text"])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by REDACTED; n_chars is that of the new text. No document goes."""
    found = _documents(docs).withColumn("_r", secret_scan.found(redact=REDACTED))
    return found.select("doc_id", F.col("_r.redacted").alias("text"), "lang", "source", F.length("_r.redacted").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences."""
    return packing.pack(_documents(docs))


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("secret scans", secret_scans), ("best-fit packing", best_fit_packing)]
#: Language models, compression, near-duplicate classes and tokenizers are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a written table in the shared folder."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.table(out, f"stage{i}")
        scratch.drop(f"stage{i - 1}")  # all of it is in the new table
    return docs
