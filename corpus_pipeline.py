"""The corpus pipeline: documents in, clean token sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame that
is written as Parquet and read again as the next stage's docs. All stages but the last return the
columns of documents. Rows are judged by their own text: a row without doc_id or text passes the
stages that cannot judge it, and repeated rows share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import bpe, decontaminate, toxicity
from lorebase.llm.line_dedup import dedup_lines
from lorebase.llm.ngram_join import linked_components
from lorebase.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_50k.tiktoken"
NEAR = {"n": 5, "num": 80, "den": 100}
"""Near duplicates in the pipeline: five words and a similarity of 0.8."""


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    labels = labels.filter(~toxicity.held_out(F.col("doc_id")))
    score = toxicity.score_column(toxicity.fit(docs, labels), F.col("text"))
    return docs.select(*COLUMNS).filter(score < toxicity.THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all documents but one; n_chars follows the text."""
    done = dedup_lines(docs.select(*COLUMNS))
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    size = F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    groups = linked_components(docs, **NEAR)
    gone = groups.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of them and of what they decode to."""
    import public_tokenizers

    how = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe.encode(docs.select("doc_id", "text"), *how, and_decode=True).select("doc_id", "ids", *bpe.digests())


STAGES = [
    ("toxicity", toxic),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None
"""SQL can express neither the trained score of the first stage nor the byte pair merges of the last."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
