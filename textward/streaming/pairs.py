"""Prompts and answers that come as two streams: joined within a bound of time, scanned, and prompts without an answer told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.plans.config import Config
from textward.plans.guard import scan_pairs


def joined(prompts: DataFrame, answers: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """conv_id, turn, input_text, output_text, answered: each prompt with the answer of the next turn, if one comes ``within``.

    Both are (conv_id, turn, ts, text). A prompt without an answer comes out, with a null, when none can come any more.
    State is kept for ``within`` and ``late``; rows later than ``late`` are dropped and counted.
    """
    p = prompts.withWatermark("ts", late).select("conv_id", "turn", F.col("ts").alias("asked"), F.col("text").alias("input_text"))
    a = answers.withWatermark("ts", late).select(F.col("conv_id").alias("conv"), (F.col("turn") - 1).alias("of"), F.col("ts").alias("given"), F.col("text").alias("output_text"))
    on = (F.col("conv_id") == F.col("conv")) & (F.col("turn") == F.col("of")) & (F.col("given") >= F.col("asked")) & (F.col("given") <= F.col("asked") + F.expr(f"interval {within}"))
    return p.join(a, on, "left").select("conv_id", "turn", "input_text", "output_text", F.col("conv").isNotNull().alias("answered"))


def scanned_pairs(prompts: DataFrame, answers: DataFrame, within: str = "1 hour", late: str = "10 minutes", config: Config | None = None) -> DataFrame:
    """The joined pairs with both scans, blocked and block_reason; of a prompt without an answer the prompt counts alone."""
    return scan_pairs(joined(prompts, answers, within, late), config=config)
