"""A corpus pipeline over ``documents``: five stages, each a written table.

Language and quality reject what is not fit to train on, near-duplicate removal keeps one document
of each group, decontamination drops what holds benchmark passages, and packing lays the
rest out in training sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.llm import decontaminate, langid, minhash, packing, quality
from condensa.llm.shared import marked, staged

#: A document is rejected if no language reaches this probability, or it has no letters.
LEAST_LANGUAGE = 0.4


def _apart(docs: DataFrame) -> DataFrame:
    """The columns under other names, so that an operator's own ones don't clash with any of them."""
    return docs.toDF(*[f"in_{c}" for c in docs.columns])


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select([F.col(f"in_{c}").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, trained on them, can tell.

    Documents without a letter (null and empty ones too) go. Rows are judged one by one: repeated
    rows share their fate. An empty table stays empty.
    """
    found = langid.identify(_apart(docs), langid.train(docs), id_col="in_doc_id", text_col="in_text")
    return _back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)), docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, trained on the labelled ones, doesn't reject.

    Rows are judged one by one, by their text only; a null text counts as an empty one. Without labels nothing is rejected.
    """
    found = quality.score(_apart(docs), quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), id_col="in_doc_id", text_col="in_text")
    return _back(found.where(F.col("predicted") == 1), docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the document with the smallest id.

    Rows that repeat an id are one document, of which the row with the least hash stays. A row without an id
    goes if a document with an id is like it, or a row without one like it stays. Rows without words are like no other, but
    repeated ids count there too. Only rows in question are shuffled.
    """
    key = F.coalesce(F.col("in_doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("in_text"), F.lit(1 << 62)))
    rows = _apart(docs).withColumn("key", key)
    found = minhash.near_duplicates(rows, id_col="key", text_col="in_text")
    odd = found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    odd = staged(odd.select(F.col("doc_id").alias("key"), "kept"), "repeated")
    rows = marked(rows, odd, "key", "odd")
    asked = rows.where("odd").join(odd.hint("merge"), "key", "left")
    row = F.struct(*[f"in_{c}" for c in docs.columns])
    first = asked.where("kept").groupBy("key").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return _back(rows.where("not odd"), docs).unionByName(_back(asked.where("kept is null"), docs)).unionByName(_back(first, docs))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and wordless texts hold none; repeated rows share their fate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their training sequences; a null text is just its end id, repeated rows are each packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", distinct_enough),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: The trained stages have no SQL form; tests hold the rows against brute-force versions of the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
