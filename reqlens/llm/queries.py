"""Queries that apply each corpus operator, with production parameters, to its whole table; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqlens.llm import ann, bpe, html, jaccard, mixing, pu, quality, sharding, substring, urlfilter
from reqlens.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=("ids_le", "decoded"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.pu_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_duplicate_spans(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), gram=3, similar=(90, 100)).select("doc_id", "n_shingles", "component_id")


def capture_day(page_id):
    """The tables hold no fetch dates: captures are dated by their id, over a year."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(366)).cast("int"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """A list of dated entries drawn from the hosts, registered domains and URLs that occur, by the digits of their MD5.

    A fifth of the hosts and domains and a hundredth of the URLs are listed on some day of the year, and half of these
    leave the list again up to 128 days later.
    """
    host = urlfilter.host_of(F.col("url"))
    labels = F.split(host, r"\.")
    named = pages.where(host != "").select(
        F.explode(
            F.array(
                F.struct(F.lit("host").alias("kind"), host.alias("entry"), F.lit(5).alias("of")),
                F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".").alias("entry"), F.lit(5).alias("of")),
                F.struct(F.lit("url").alias("kind"), urlfilter.url_key(F.col("url")).alias("entry"), F.lit(100).alias("of")),
            )
        ).alias("e")
    )
    digit = lambda at, n: F.conv(F.substring(F.col("h"), at, n), 16, 10).cast("int")
    drawn = named.select("e.kind", "e.entry", "e.of").distinct().withColumn("h", F.md5(F.concat_ws("|", "kind", "entry"))).where(digit(1, 4) % F.col("of") == 0)
    day = F.date_add(F.lit("2023-12-01").cast("date"), digit(5, 2))
    added = drawn.select("kind", "entry", day.alias("listed_on"), F.lit("add").alias("action"))
    gone = drawn.where(digit(7, 1) < 8).select("kind", "entry", F.date_add(day, F.lit(1) + digit(9, 2) % 128).alias("listed_on"), F.lit("remove").alias("action"))
    return added.unionByName(gone)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages.withColumn("fetched_on", capture_day(F.col("page_id"))), dated_lists(pages))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=1.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_mixing, op3_quality_rules, op4_pu_quality, op5_html_text, op6_substring_dedup, op7_sharding, op8_ngram_jaccard, op9_url_filters, op10_nearest)
}

from reqlens.llm.oracles import ORACLES as ORACLE_SQL  # noqa: E402, F401
