"""The training-data pipeline over ``documents``: quality, near copies, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm._common import BATCHES, Scratch, table
from tracefold.llm.decontamination import drop_contaminated
from tracefold.llm.packing import pack_documents
from tracefold.llm.pii import sanitise_documents
from tracefold.llm.quality import keep_selected
from tracefold.llm.simhash import drop_near_copies


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in small Arrow batches from now on, as stages may be computed after they return.

    Executors reuse their workers from stage to stage, and these keep what their largest batch took.
    """
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected by importance resampling; those rejected go.

    Null, empty and wordless texts have ratio 0 and are judged by it; rows of equal id (null ids too) share their
    chance; without labels of both classes all stay; an empty table stays empty; other columns are kept.
    """
    small_batches(spark)
    return keep_selected(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity 0.8): the smallest id.

    Texts without words (null, empty) are copies of each other; rows with a null id all stay; of rows that repeat
    an id one stays; an empty table stays empty; other columns are kept.
    """
    small_batches(spark)
    return drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and wordless texts stay; rows with a null id are judged by their text; repeated rows stay or go together;
    items without id or words find nothing; an empty table stays empty; other columns are kept.
    """
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms generalised in their texts.

    Texts without any, null ones included, are left as they are; every row stays, with a null id or repeated too;
    ``n_chars`` follows a changed text; an empty table stays empty; other columns are kept.
    """
    small_batches(spark)
    return sanitise_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length, none across documents.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each; an empty table
    gives no rows; other columns are ignored.
    """
    small_batches(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("personal_data", personal_data), ("packing", packing)]

#: SQL cannot express the stages (hashed models, XXH64 fingerprints, tokenizers); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's documents are written before the next reads them, those before go."""
    docs, before = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        before.release()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
