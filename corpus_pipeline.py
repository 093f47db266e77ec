"""A corpus pipeline: quality, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes what its predecessor kept and returns the columns of documents, but for the last, which packs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgrid.llm.common import materialize, table, text_batches
from termgrid.llm.decontam import without_contaminated
from termgrid.llm.line_dedup import remove_repeated_lines
from termgrid.llm.ngram_join import without_near_duplicates
from termgrid.llm.packing import pack_documents
from termgrid.llm.quality import ACCEPT, fit_quality, score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not accept go.

    A null or empty text is scored like any other. Repeated rows get the same answer each; a null doc_id has no label and is
    only scored. Columns besides those of documents are left out. Without labels every document scores 0.5 and goes.
    """
    text_batches(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model).filter(F.col("quality_score") >= ACCEPT).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and with them documents of which nothing else is left.

    n_chars follows the text. A document that loses nothing stays as it is, an empty one too.
    """
    text_batches(spark)
    kept = remove_repeated_lines(docs, carry=("lang", "source", "n_chars")).filter((F.col("n_removed") == 0) | (F.length("kept") > 0))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the least id; rows are told apart by their texts, not their ids."""
    text_batches(spark)
    return without_near_duplicates(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A null or empty text holds none. Rows are named by doc_id: all rows of an id go if one of them holds an item, those without
    an id too. Columns besides those of documents are left out. Without items or documents nothing goes.
    """
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, packed into sequences.

    A null text is an empty one and has the closing token alone. Repeated rows are packed as often as they stand there, under the same doc_id.
    Columns besides doc_id and text are left out. No documents give no rows.
    """
    text_batches(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("line dedup", line_dedup), ("near duplicates", near_duplicate_groups), ("decontamination", decontamination), ("packing", packing)]
#: A learned model, 64-bit fingerprints and a genetic search have no SQL form; tests/llm compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
