"""From raw documents to packed training sequences, by the operators of ``textward.llm``.

Each filtering stage returns its documents with all their columns, whatever their names. Rows with one doc_id, or none, are
judged each by its own text. Null, empty and wordless texts fail the quality rules; in the later stages, called alone, they
are no language, hold no line to remove and are like nothing; of equal ones with one doc_id near-dedup keeps one, and each is
packed as a document of the end token alone. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import common, langid, linededup, neardup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    with common.batches(spark, 2000):
        return common.materialize(langid.keep(docs), "known")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines go from the texts; a document of which nothing else was left goes too."""
    lines, gone = common.unused(docs, "n_lines", "n_removed")
    kept = linededup.remove(docs, counts=(lines, gone))
    kept = kept.filter((F.col(gone) == 0) | F.col("text").rlike(common.WORD))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*common.own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences. Executors still hold memory of earlier stages: fewer words are remembered, less text is encoded at once."""
    with common.batches(spark, 2000):
        return common.materialize(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=100_000, chunk=1 << 20), "pieces")


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("packing", pack)]

#: SQL has no tokenizer and no such classifier; test_pipeline holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to what the one before has written, which then goes."""
    docs, before = common.spread(common.table(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.drop(before)
        before = docs
    return docs
