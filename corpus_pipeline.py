"""Corpus pipeline: raw documents to encoded, clean, unrepeated text.

Each stage is a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next stage's docs. Part of the subpackage ``llm``.

Defined cases: a null text scores as an empty one and stays null through toxicity; from
line dedup on it is the empty text. Texts without words are near copies of nothing, so
they all stay. Rows that repeat a doc_id are scored and cut one by one, are one document
for lines, and of near copies all rows with the smallest doc_id stay; a null doc_id is
smaller than any other for lines and larger than any other for near copies. Texts of any
length pass whole. A score of exactly the threshold rejects. An empty table gives an empty
result with all columns. Other columns pass unchanged, but for n_chars (made if it is
missing) and, in the last stage, ids, score, nbest and n_pieces, which are results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.llm import decontaminate, line_dedup, near_dedup, piece_codec, toxicity
from sphaera.llm.common import materialise


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, if with an empty text."""
    return _sized(line_dedup.LineIndex.build(docs).rewrite(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest doc_id stays."""
    return near_dedup.deduplicate(docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; every document stays."""
    return _sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids, score and nbest of every document, beside its columns."""
    return piece_codec.encode(docs).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", cut_benchmarks),
    ("encode", encode_pieces),
]

#: Classifier and lattice search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
