"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and mixing, one stage after the other.

Each stage reads what its predecessor kept, as a written table, and returns the columns of documents;
the last one adds what it decides: n_tokens, a posterior for each domain, and the rate at which to draw.
SQL can't express the first stage (a trained network) nor the last (a fitted classifier), so the whole
has no oracle; the stages between are held against SQL and brute force by the tests of their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.llm import decontam, langid, linededup, minhash, mixing
from brontide.llm.shared import whole_rows, written

#: Texts whose best language has a smaller share of the letters' mean distribution are of no language.
LEAST_SCORE = 0.45


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters and texts of no one language go."""
    return langid.identify(whole_rows(docs), langid.fit(docs)).where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select("doc_id.*")


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, later copies of whole texts too, and documents that lose some and have no word left."""
    out = linededup.dedup_lines(docs, whole_copies=True)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(linededup.WORD)).select(*docs.columns)


#: Near copies share this part of their shingles of so many words; op5's own figures bind that query alone.
NEAR_SHINGLE, NEAR_OVER, NEAR_UNDER = 5, 80, 100


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    kept = minhash.near_duplicates(docs, NEAR_SHINGLE, NEAR_OVER, NEAR_UNDER).where("kept").select(F.col("doc_id").alias("id_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("id_kept")), "left_semi")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.decontaminate(whole_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select("doc_id.*")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays and gets its rate."""
    out = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("row.*", "n_tokens", *[F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)], "rate")


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
