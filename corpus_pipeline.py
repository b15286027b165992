"""A corpus pipeline over documents: language, near-duplicates, benchmark leaks, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of documents.

Odd rows: any column may be null; a null or empty text has no letters and goes in the first stage, as do texts whose
language is doubtful; texts of any length are read whole; equal rows are copies, of which one stays, that of the least
doc_id (nulls last), then of the least row hash; an empty table passes every stage and stays empty; extra columns, also of
names that operators use inside, are kept to the last stage, which returns the columns that it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleflow.llm import decontam, langid, minhash, pieces, pii
from rippleflow.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts whose language is doubtful go; missing labels are filled in."""
    found = langid.identify(docs, langid.train(langid.training_rows(docs)))
    sure = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= 0.5))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least doc_id."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within a tenth of its bytes in edits, go."""
    found = decontam.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces' ids, and the text that they decode to."""
    back = pieces.encode(docs, pieces.load(), decoded="decoded")
    return back.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").alias("n_pieces"), F.col("decoded").alias("text"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("encoding", encoding)]

#: SQL can't express trained models, sampling and pieces; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
