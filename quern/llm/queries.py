"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table, written
from . import bpe, mix, neighbours, rankagg, spans, split, terms
from .sql import SQL  # noqa: F401


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "search_queries").where("judged")
    return rankagg.ranking(table(spark, d, "score_lists"), judged, table(spark, d, "ranker_weights"), top=3).select("query_id", "doc_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = rankagg.ranking(table(spark, d, "score_lists"), table(spark, d, "search_queries"), table(spark, d, "ranker_weights"))
    return rows.select("query_id", "doc_id", F.round(F.col("significance") + 1e-11, 9).alias("significance"), F.round(F.col("mean_rank") + 1e-11, 9).alias("mean_rank"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.distinctive(terms.current_records(table(spark, d, "doc_tokens"))).select("doc_id", "term")


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = terms.log_entropy(terms.current_records(table(spark, d, "doc_tokens")))
    return rows.select("doc_id", "term", "tf", "df", F.round("weight", 6).alias("weight"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(terms.current_records(table(spark, d, "doc_tokens"))).where("mark is not null").select("term", "mark")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(terms.current_records(table(spark, d, "doc_tokens")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(table(spark, d, "pdf_pages")).where("forced").select("document_id", "page").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(table(spark, d, "pdf_pages"))


def p7_reported(spark: SparkSession, d: str) -> DataFrame:
    """Pieces per document against what the latest answers reported (the largest count, as answers have no order)."""
    made = split.split_texts(table(spark, d, "pdf_pages")).groupBy("document_id").agg(F.count(F.lit(1)).alias("pieces"))
    said = table(spark, d, "pdf_responses").where("status").groupBy("document_id").agg(F.max("chunks_indexed").alias("reported"))
    return made.join(said, "document_id", "full")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "ids")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("source is not null").select("doc_id", "source", "text"))
    return written(bpe.encode_column(docs, out="size", counts_only=True).select("doc_id", "source", "size"), "sizes")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(_sizes(spark, d), table(spark, d, "source_weights"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    weights, sizes = table(spark, d, "source_weights"), _sizes(spark, d)
    return mix.reached_shares(mix.mix(sizes, weights), weights, sizes)


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p5_found, p5_weights, p6_found, p6_counts, p7_found, p7_pieces, p7_reported, p8_ids, p9_mix, p9_shares)}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "doc_vectors"), 0.90)


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "doc_vectors"))


QUERIES |= {f.__name__: f for f in (p2_found, p2_nearest)}


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_characters(table(spark, d, "documents"))


def p10_links(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_links(table(spark, d, "documents"))


QUERIES |= {f.__name__: f for f in (p10_found, p10_shared, p10_links)}
