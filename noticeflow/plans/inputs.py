"""What extraction stages read: cleaned pages, and documents as primary and secondary text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import html, sections, text
from noticeflow.functions.pieces import reading
from noticeflow.operators import attempts


def from_pages(pages: DataFrame, key: str = "page_id", content: str = "html") -> DataFrame:
    """EXT1, CLN1: key, input, input_truncated: a page cleaned for extraction and cut to the cap."""
    return reading(pages.select(key, content), content, html.clean_for_extraction, "input string, input_truncated boolean")


def from_sources(docs: DataFrame, key: str = "doc_id", source: str = "source_text") -> DataFrame:
    """EXT2, PRJ18: key, primary, secondary, input_truncated: the document cut to the cap, then split."""
    cut, truncated = text.capped(text.strip(F.col(source)))
    return docs.select(key, sections.stage_text(cut).alias("t"), truncated.alias("input_truncated")).select(key, "t.*", "input_truncated")


def asked(inputs: DataFrame, prompt: str, client, stage: str, key: str, attempt: int = 1, read: Column | None = None) -> DataFrame:
    """EXT1, EXT2, live and opt-in: (key, stage, attempt, payload, input_truncated), the rows that the
    plans take, from a client of your own. Inputs without text aren't asked."""
    said = F.col("input") if read is None else read
    wanted = inputs.select(key, "input_truncated", said.alias("_read")).filter(text.strip(F.col("_read")) != "")
    rows = attempts.call(wanted.withColumn("_ask", F.concat(F.lit(prompt + "\n\n"), F.col("_read"))), client, "_ask")
    return rows.select(key, F.lit(stage).alias("stage"), F.lit(attempt).alias("attempt"), "payload", "input_truncated")
