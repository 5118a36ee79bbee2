"""Cleaning a corpus: the stages that turn ``documents`` into a training mix.

Each stage is given all rows that the stage before kept and returns rows with the
columns of ``documents``; the last returns the mix.  Between stages the rows are a
table in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packwatch.llm import decontaminate, minhash_dedup, mixing, quality_pu, substring_dedup
from packwatch.llm.tables import Kept, read

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
_OTHERS = ["lang", "source", "n_chars"]


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents; one that is missing is null, others are left out, whatever their names."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is scored as an empty one; rows that share an id or have none are
    judged one by one, equal texts alike; an empty table gives an empty table, and
    without labels of 1 every row stays.
    """
    scored = quality_pu.scored(_shaped(docs), read(spark, sf_dir, "labels"), threshold=0.3, keep=_OTHERS)
    return scored.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of 0.8 or more.

    Texts without words, null ones too, aren't duplicates of each other; of rows with
    equal id and text one stays; a row without an id goes where its group has one with
    an id; an empty table gives an empty table.
    """
    return minhash_dedup.one_of_each(_shaped(docs), shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand earlier are cut out; texts of nothing else go, others stay as they are.

    Texts without words stay, a null one as an empty one; rows without an id come
    first, rows that share one are ordered by text; n_chars is counted anew where
    something was cut; an empty table gives an empty table.
    """
    cut = substring_dedup.repeats(_shaped(docs), window=50, keep=_OTHERS, layout=True)
    rest = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return rest.select("doc_id", F.col("kept_text").alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item, or a whole shorter item, go.

    Texts without words, null ones too, stay; every row of an id is judged by its own
    text; an empty table, or one without items, stays as it is.
    """
    found = decontaminate.contamination(_shaped(docs), read(spark, sf_dir, "benchmark"), window=10, keep=_OTHERS)
    return found.where("not contaminated").select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    A null source is one of its own, the last; texts without words have size 0 and
    give nothing; rows that share an id keep their own rows; an empty table gives an
    empty table.
    """
    return mixing.mix_sources(_shaped(docs), weights=(1, 2, 3), most=3)


STAGES = [("quality classifier", quality), ("near dedup", near_dedup), ("substring dedup", repeated_passages), ("decontamination", benchmark_leaks), ("mixing", mix)]

#: SQL can't express the classifier; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents`` to the mix."""
    kept, docs = Kept(spark), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept.keep(docs, f"stage-{k + 1}")
    return docs
