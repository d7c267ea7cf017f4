"""Text expressions for tags, labels and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from walletlens.schema import NULL_TOKENS

PLACEHOLDER = "{transaction_summary}"


def null_if_token(text: Column) -> Column:
    """The texts that stand for a missing value become null."""
    return F.when(~text.isin(NULL_TOKENS), text)


def combine_tags(*tags: Column) -> Column:
    """Present tags joined by a comma; empty text where none is present."""
    return F.concat_ws(", ", *[F.when(tag != "nan", tag) for tag in tags])


def format_tag(tag: Column) -> Column:
    """lower case with spaces; 'unknown' for a missing tag."""
    return F.coalesce(F.translate(F.lower(tag), "_", " "), F.lit("unknown"))


def component_title(component: Column) -> Column:
    """F13"""
    return F.initcap(F.translate(component, "_", " "))


def year_month_label(year: Column, month: Column) -> Column:
    """F6"""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def render_prompt(template: Column, summary: Column) -> Column:
    """F8"""
    return F.replace(template, F.lit(PLACEHOLDER), summary)
