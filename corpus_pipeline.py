"""From raw documents to packed windows: each stage is written as Parquet and read again as the next one's input.

All stages: a null text is an empty one; texts of any length are taken whole; an empty table gives an empty one; rows with
equal ids are rows of their own; columns beyond those that a stage reads pass through unchanged, whatever their names
(packing returns pieces instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolens.llm import mixing, packing, quality, rules, similar, simhash
from repolens.llm.queries import table
from repolens.session import drop_tables, new_path, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty ones; repeated rows are each judged alike; equal scores are judged alike (the
    bound is inclusive); without usable labels every score is 0.5 and all stay.
    """
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go; the texts of those that stay lose their failing lines.

    Null and empty texts have too few words and go; repeated rows are each judged alike; other columns (a length, say) are
    not computed anew.
    """
    ship(spark)
    return rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard similarity of 0.8 or more) stays: that with the smallest id.

    Null and empty texts are one group, texts of fewer than five words are one shingle; null ids come last; rows with one id
    but several texts are judged text by text; of full repeats one stays.
    """
    ship(spark)
    return simhash.keep_one(docs, groups=similar.near_duplicates)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves their sources by weight.

    Null sources are one source; ties of id are ordered by the text's hash; full repeats take neighbouring places.
    """
    ship(spark)
    return mixing.in_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows, whose ids follow the mix: files keep no order, so each document's place in it is computed again.

    Null and empty texts give their end id; repeated rows are packed each; long texts are cut into windows.
    """
    import public_tokenizers

    ship(spark)
    mixed = mixing.mix(docs, columns=["text"]).select("doc_id", "row.text", "position")
    return packing.pack_documents(mixed, public_tokenizers.path("word_bpe_49k.json"), digest=True, place_col="position")


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Trained trees, connected components and tokenizers are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_tables(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
