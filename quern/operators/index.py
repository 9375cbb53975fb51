"""Relational index tables over documents ``(doc_id, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem_terms


def analysed(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``(key, toks)`` without stemming; null text gives no tokens, rows without a key are left out."""
    return docs.where(F.col(key).isNotNull()).select(key, T.tokens(column).alias("toks"))


def token_positions(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    return toks.select(key, F.posexplode("toks").alias("pos", "term"))


def stemmed_terms(tf: DataFrame) -> DataFrame:
    """``tf`` by stems. The stemmer runs once per distinct term; empty stems are dropped."""
    stems = tf.select("term").distinct().select("term", stem_terms("term").alias("stem"))
    rows = tf.join(stems, "term").where(F.col("stem") != "")
    return rows.groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def lexed(docs: DataFrame, key: str = "doc_id", column: str = "text", words_only: bool = True) -> DataFrame:
    """``(key, toks)`` by the alternative lexer, words stemmed, digits and symbols as they are; with ``words_only`` no lone symbols or digits.

    The stemmer runs once per distinct word; a word's stem takes its place in the record. Rows without a key are left out.
    """
    toks = T.lexer_tokens(column)
    kept = T.words_of_lexer(toks) if words_only else toks
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key), F.posexplode_outer(kept).alias("pos", "term"))
    words = rows.where(F.col("term").rlike(r"^\p{L}")).select("term").distinct().select("term", stem_terms("term").alias("stem"))
    placed = rows.join(words, "term", "left").select(key, F.when(F.col("term").isNotNull(), F.struct("pos", F.coalesce("stem", "term").alias("t"))).alias("p"))
    return placed.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("l")).select(key, F.col("l.t").alias("toks"))


def term_freq(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    return toks.select(key, F.explode("toks").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def postings(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``term_freq`` with the document's length ``dl`` in each row, so that scoring needs no join for it."""
    return toks.select(key, F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    return toks.select(key, F.size("toks").cast("long").alias("dl"))


def vocabulary(tf: DataFrame) -> DataFrame:
    """``(term, df, occurrences)``; deletions fall out as it is an aggregate of what is there."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row ``(n, total_len)``; documents without tokens count."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))


def fragments(tf: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct ``(fragment, key)``: every term of a document and its prefixes."""
    return tf.select(key, F.explode(T.edge_ngrams("term")).alias("fragment")).distinct()


def phonetic(tf: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct ``(code, key)``."""
    return tf.select(T.soundex("term").alias("code"), key).where("code <> ''").distinct()
