"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``, the last one the packed pieces.
Every stage works on whole texts of any length; an empty table gives an empty one; further columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import leaks, lines, nearcopies, packing, quality, simhash
from loam.llm.common import components, cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as low in quality or toxic or without words, go.

    Null and empty texts have no words. Rows are judged one by one: repeated rows and null ids stay or go by their texts.
    """
    return quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("_kept").select(*COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document that has nothing left was a repeat as a whole and goes, too.

    Null and empty texts stay, as do rows without an id, unchanged. Repeated rows of one id lose the same lines.
    """
    kept = lines.dedup(docs.select(*COLUMNS)).where("_n_dropped = 0 or trim(text) <> ''")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five-word shingles, the document of the least id stays.

    Linked are documents of a Jaccard similarity of 0.8 or more, and those whose SimHashes are at most 2 bits apart; texts without
    words are alike. Rows of one id are told apart by their texts, and of repeated rows one stays. Rows without an id stay.
    """
    rows = simhash.near_duplicates(docs, width=5).where("id is not null").select("id", "x", "root").distinct()
    known = cut(rows.join(nearcopies.classes(docs, width=5).distinct(), ["id", "x"], "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long"))))
    # a label's classes are joined by the roots that its documents share with others
    shared = known.select("root", "label").distinct()
    joined = components(shared.join(shared.groupBy("root").agg(F.min("label").alias("v")), "root").select(F.col("label").alias("u"), "v"))
    firsts = known.groupBy("label").agg(F.min(F.struct("id", "x")).alias("first")).join(joined.withColumnRenamed("id", "label"), "label", "left")
    stay = firsts.groupBy(F.coalesce("component", "label")).agg(F.min("first").alias("first")).select(F.col("first.id").alias("doc_id"), F.col("first.x").alias("_x"))
    hashed = docs.select(*COLUMNS).withColumn("_x", F.xxhash64("text"))
    once = hashed.join(stay, ["doc_id", "_x"], "left_semi").dropDuplicates(["doc_id", "_x"])
    return once.unionByName(hashed.where("doc_id is null")).select(*COLUMNS)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts hold none; repeated rows and null ids go by their texts."""
    return leaks.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of at most 2048. A null or empty text is its end token alone; repeated rows each have pieces."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality", good_quality), ("lines", fresh_lines), ("near_duplicates", distinct_documents), ("benchmark", clean_of_benchmarks), ("packing", packed)]

#: Tokenizers, near-duplicates and trained models are not for SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
