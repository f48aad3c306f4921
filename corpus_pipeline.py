"""A corpus pipeline of five stages over `documents`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last return the columns of
docs, for the rows that stay (with their lines deduplicated after stage 2); the last one packs what is
left. Between stages docs is written as Parquet and read again. Rows with nulls, empty texts, repeats and
further columns go through each stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import decontaminate, line_dedup, packing, quality, simhash
from tidewave.llm.common import cut, table
from tidewave.llm.queries import tokenizer_path


def _shielded(docs: DataFrame) -> DataFrame:
    """docs with further columns under names that no operator uses; _restored gives their own back."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)])


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*_shielded(docs).columns).toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted quality of 1 stay. The model learns from labelled rows of docs that aren't held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _restored(quality.score_documents(_shielded(docs), model).where("predicted = 1"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 characters stay in the first document that has them only. n_chars follows the text."""
    out = _restored(line_dedup.dedup_lines(_shielded(docs)), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles, found by SimHash, the row with the smallest id stays.

    Rows without an id stay.
    """
    marked = simhash.similar_groups(docs.select("doc_id", "text").where("doc_id IS NOT NULL"))
    gone = marked.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule calls contaminated go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of 1024 tokens."""
    return packing.pack(spark, cut(packing.pieces_of(docs, tokenizer_path()), "pieces"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
