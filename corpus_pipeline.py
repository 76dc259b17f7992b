"""A training corpus from the ``documents`` table, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents; the last returns the packed pieces.  ``run``
writes each stage's result to the shared folder and reads it again for the next.

1. language: documents whose text is null or has no letter go (``und``).
2. lines: later runs of repeated lines are cut out of the texts; a document that
   loses all its lines goes.
3. near_duplicates: of each SimHash group the document with the smallest
   identifier stays (4-word shingles, 4 bits).
4. benchmark: documents that hold a window of a benchmark item go.
5. packing: the token sequences are packed into bins.

Nulls, empty texts, repeated rows and empty tables are handled as the operators'
docstrings say; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm.common import documents, read_table, staged
from tidepool.llm.decontaminate import decontaminate
from tidepool.llm.langid import keep_identified
from tidepool.llm.lines import without_repeated_lines
from tidepool.llm.packing import pack_documents
from tidepool.llm.queries import tokenizer_path
from tidepool.llm.simhash import keep_one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, shingle_words=4, max_bits=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path(), near=False)  # one of each group is left


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: SQL has neither the tokenizer, the suffix automata nor XXH64; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
