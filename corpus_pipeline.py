"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All but the last return the columns of documents, n_chars being counted anew where the text is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.llm import decontam, linededup, pieces, simhash, toxicity
from lattisca.llm.common import spool, table

#: The conditional random field and the tokenizer's lattice can't be written in SQL.
ORACLE_SQL = None


def _counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels of its training ids, does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later occurrences of three-line windows."""
    return _counted(linededup.line_dedup(docs), docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.representatives(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the spans that benchmark windows cover in them."""
    found = decontam.find_phrases(docs, table(spark, sf_dir, "benchmark"), cut=True)
    return _counted(found.filter(~decontam.contaminated()), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the scores of its best segmentations."""
    return pieces.encode_table(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "n_tokens", "ids", "scores")


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", repeated_lines_out),
    ("SimHash near-dedup", near_copies_out),
    ("benchmark decontamination", benchmark_out),
    ("SentencePiece encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to token ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
