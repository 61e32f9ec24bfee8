"""The operators' queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, decontaminate, jaccard, licenses, lines, mixing, quality, sharding, token_files, urls
from .common import table

#: The rules that op4 judges pages by.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def length_share(size: Column) -> Column:
    """The share of a document by its words: the binary digits of their number, so a long text counts for more than a short one."""
    return F.length(F.bin(size))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share_of=length_share).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def page_places(pages: DataFrame) -> DataFrame:
    """(doc_id, path) of the documents that pages show: a page's url ends in the number of its document, before `.html` or a slash.

    The path is host and path of the url without that slash, so a page stands in
    the folder above it, however its url ends. Pages without a host or such a
    number show none.
    """
    path = F.regexp_replace(F.concat(urls.host_of(F.col("url")), urls.path_of(F.col("url"))), "/+$", "")
    number = F.regexp_extract("path", r"^[^/]+/(?:.*/)?([0-9]+)(?:\.html)?$", 1).try_cast("long")
    return pages.select(path.alias("path")).select(number.alias("doc_id"), "path").where("doc_id is not null")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), page_places(table(spark, sf_dir, "pages")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_equal", "n_near", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pareto_mix, op2_decontaminate, op3_quality_cascade, op4_url_filter, op5_license_scan, op6_token_files, op7_shards, op8_line_dedup, op9_ngram_jaccard, op10_token_counts)
}
