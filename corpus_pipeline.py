"""A corpus pipeline over documents: quality, lines, near copies, benchmark passages, source weights.

Each stage takes (spark, docs, sf_dir) and returns documents again, in the same columns; ``run`` writes what a stage
returns as Parquet in the shared folder, reads it as the next one's docs and deletes it once that one has written its own. Null texts pass as empty ones do in
every operator: they score as empty, have no lines, no near copies, no passages, and size 0 in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import compression_quality, decontamination, line_spread, mixing, ngram_join
from tidelog.llm.common import discard, materialize, read_table


def _recount(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return compression_quality.keep_good(docs, compression_quality.train(docs, read_table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites, for the number of sites there are, are cut from the texts."""
    return _recount(line_spread.cut_lines(docs, line_spread.least_sites(docs), counted=False), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that of the least doc_id."""
    return ngram_join.keep_one(docs).select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts."""
    return _recount(decontamination.remove_contamination(docs, read_table(spark, sf_dir, "benchmark")), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_documents(docs, mixing.mix_sources(docs))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("mix", mix)]

#: Compression and dependent rounding have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
