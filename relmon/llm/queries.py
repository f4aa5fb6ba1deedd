"""The registered queries of the operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relmon.llm import (bpe_codec, compression_quality, exact_dedup, fill_middle, filter_audit, html_extract, line_dedup, mixing, pii,
                        quality_rules, simhash_dedup, token_count, warc)
from relmon.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_token_counts(spark, sf_dir):
    """Tokens of every whole document, and whether they pass the limit."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_bpe_codec(spark, sf_dir):
    """Every whole document encoded and decoded again; digests of both."""
    return bpe_codec.codec_digests(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_exact_dedup(spark, sf_dir):
    """Equal texts: the row that stays, group size and digest of every document."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op7_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


@query
def op3_temperature_mixing(spark, sf_dir):
    """How often each document of each source is in the mixture."""
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark, sf_dir):
    """Base counts, log-likelihood ratio and verdict of every document."""
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_line_dedup(spark, sf_dir):
    """Every document without the lines of recurring templates."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), **line_dedup.WHOLE)


@query
def op8_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op9_compression_quality(spark, sf_dir):
    """Calibrated quality score of every document."""
    return compression_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_pii_spans(spark, sf_dir):
    """Personal data of every document: base counts and digest, all spans."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op11_warc(spark, sf_dir):
    """Every page written to WARC archives and read back from byte ranges."""
    return warc.page_records(table(spark, sf_dir, "pages"))


@query
def op12_filter_audit(spark, sf_dir):
    """What every order of the five filters removes of each source, step by step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_fill_middle(spark, sf_dir):
    """Every document cut, reordered and restored; digests of both texts."""
    return fill_middle.digests(table(spark, sf_dir, "documents"))
