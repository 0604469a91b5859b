"""The corpus pipeline: documents in, encoded documents out. Part of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import bpe, decontaminate, jaccard, lines, quality
from pactlake.llm.storage import saved
from pactlake.llm.substrings import bit_filter

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Words of a passage whose later copies line dedup deletes, be it on one line; as many as op2 looks for.
PASSAGE = 35


def _rows(docs: DataFrame) -> DataFrame:
    """docs as id and text beside one column of all others, whatever they are called."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "doc_id", "text")


def _docs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again, of rows(row, text)."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return _docs(quality.apply_cascade(_rows(docs), quality.plan_cascade(docs), keep=("row", "text"), base=False).filter("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of three lines, or of one or two that hold PASSAGE words.

    One all of whose lines went goes too. n_chars follows the text.
    """
    out = lines.dedup_lines(_rows(docs), keep=("row",), words=PASSAGE).filter("n_removed = 0 or n_removed < n_lines")
    row = F.col("row")
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("cut").cast("bigint")).otherwise(F.col("row.n_chars")))
    return _docs(out.select(row.alias("row"), F.col("cut").alias("text")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of texts that share 0.8 of their five-word shingles; of equal rows one."""
    found = saved(jaccard.jaccard_components(docs, k=5, num=80, den=100).select("rid", "is_first"), "near")
    touched = saved(found.groupBy("rid").agg(F.min("is_first").alias("is_first"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not is_first"), "touched")
    parted = bit_filter(touched, "rid")(_rows(docs).withColumn("rid", F.xxhash64("doc_id", "text")))
    clear = parted.filter(~F.col("maybe")).select("row", "text")
    met = parted.filter("maybe").join(touched, "rid", "left")
    single, several = met.filter("n is null"), met.filter("n > 1 and is_first").dropDuplicates(["rid"])
    return _docs(clear.unionByName(single.select("row", "text")).unionByName(several.select("row", "text")), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _docs(decontaminate.decontaminate(_rows(docs), benchmark, keep=("row", "text")).filter("n_hit = 0"), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text, of each document."""
    told = docs.select("doc_id", "text", F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("sha256"))
    out = bpe.round_trip(told, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, keep=("doc_id", "sha256"))
    return out.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("sha256")).alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the byte-pair encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
