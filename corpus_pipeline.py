"""A training corpus from raw documents: rules, near copies, repeated passages, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, further columns of docs included, whatever their names. run() writes each stage's rows
to the shared folder and reads them again; what a stage wrote on its way is deleted when it is done.

An empty table gives an empty result in every stage. What each does with nulls, repeated rows and
long texts stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import mixing, neardup, packing, rules, suffixes
from quernstone.sources import tables
from quernstone.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go.

    A null or empty text goes, as it has no words; null lang or source is a group of its own; repeated rows share
    their verdict; a null id does not matter; a text's length does not either."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays (five words, similarity 0.8).

    Texts without words and rows with a null id stay; of rows with equal id and text the least (by its fields as JSON) stays; rows with one id and
    different texts are judged each by its own text; ties go to the smallest id; texts are compared whole."""
    return neardup.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are cut from the texts; every row stays, and n_chars follows.

    A null text and rows with a null id stay as they are; rows with equal ids are no smaller than each other, so
    nothing is cut between them; a text may end up empty; texts are read whole."""
    out = suffixes.without_repeats(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them.

    A null or empty text has size 0 and is taken as its source's hash threshold falls; null source is a source of its
    own, the last; repeated rows fall alike; a null id has a hash as any other."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their place in a sequence.

    A null or empty text is its end id alone; longer texts are cut into pieces; repeated rows and null ids are packed
    like any other; ties of length go by id and piece."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the sketches, suffixes and packing; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        mark, before = len(tables.WRITTEN), docs
        docs = tables.written(stage(spark, docs, sf_dir))
        tables.forget_since(spark, mark, but=docs)
        tables.forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
