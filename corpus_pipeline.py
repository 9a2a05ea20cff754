"""The corpus pipeline: ordered stages over ``documents``.

Each stage takes (spark, docs, sf_dir), where ``docs`` has the columns of
``documents``, and returns those columns again; the last one returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, mixing, ngram_join, packing, toxicity
from ledgerloom.session import durable


#: Rows of whole texts that go to a Python worker at once. What a batch takes, the worker's allocator and the buffers
#: of the executor keep for all later stages.
BATCH_ROWS = 1000


def _in_small_batches(stage: Callable) -> Callable:
    """``stage`` with Arrow batches of at most ``BATCH_ROWS`` rows from now on in this session."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """All columns in one, beside those the operators read: no name can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")


@_in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic (score 0.5 or more) go; it learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.with_score(_rows(docs).select("row", "text"), toxicity.train(docs, labels))
    return scored.filter("score < 0.5").select("row.*")


@_in_small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of many documents stay in one of them; ``n_chars`` follows the text. All documents stay."""
    out = line_dedup.dedup_lines(_rows(docs), min_chars=40, min_docs=5)
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


@_in_small_batches
def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of 0.8 or more on five-word shingles.

    A row is judged by its own text: its name is its id and the hash of its text, and the smallest name of
    a group stays, those without an id last. Rows with equal id and text are one document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.struct(
        F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("text").isNull().alias("no_text"), F.sha2(text, 256).alias("sha")
    )
    groups = ngram_join.ngram_components(docs.select(name.alias("name"), "text"), id_col="name", k=5, percent=80)
    kept = groups.filter(F.col("component_id").eqNullSafe(F.col("name"))).select(F.col("name").alias("kept")).distinct()
    rows = _rows(docs).select("row", name.alias("name"))
    return rows.join(kept, F.col("name").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["name"]).select("row.*")


@_in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(_rows(docs), weights=(5, 2, 1), repeats=3, keep=["row"])
    taken = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and place there."""
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``, each written to the shared folder for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
