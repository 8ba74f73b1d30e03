"""Corpus and term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import DEFAULT, TokenOptions, raw_tokens, tokens
from tessel.operators.ordering import numbered, numbered_by_id, sum_by_id


#: Rows up to which a limit is a top-k sort of whole rows.
SHORT_LIMIT = 10_000


def corpus_stats(docs: DataFrame, options: TokenOptions = DEFAULT, text: str = "text") -> DataFrame:
    """One row: docs, bytes_in, tokens, token_chars (before stemming), avg_token_len. Rows without text don't count."""
    per = docs.filter(F.col(text).isNotNull()).select(F.octet_length(text).alias("b"), raw_tokens(F.col(text), options).alias("t"))
    per = per.select("b", F.size("t").cast("long").alias("n"), F.length(F.array_join("t", "")).cast("long").alias("c"))
    sums = per.agg(F.count("*").alias("docs"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("c"), F.lit(0)).alias("token_chars"))
    return sums.withColumn("avg_token_len", F.coalesce(F.try_divide(F.col("token_chars").cast("double"), F.col("tokens").cast("double")), F.lit(0.0)))


def term_freq(docs: DataFrame, options: TokenOptions = DEFAULT, text: str = "text") -> DataFrame:
    """(term, freq) over all documents."""
    return docs.select(F.explode(tokens(F.col(text), options)).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def unique_terms(docs: DataFrame, options: TokenOptions = DEFAULT, approximate: bool = False) -> DataFrame:
    spread = docs.select(F.explode(tokens(F.col("text"), options)).alias("term"))
    return spread.agg((F.approx_count_distinct("term") if approximate else F.count_distinct("term")).alias("unique_terms"))


def ranked_terms(freq: DataFrame) -> DataFrame:
    """(rank, term, freq) by frequency, then term. Terms of one frequency are split by their first two bytes' order."""
    start = freq.withColumn("_start", F.substring("term", 1, 2))
    return numbered(start, ["freq", "_start"], [F.col("freq").desc(), F.col("_start")], [F.col("term")]).select("rank", "term", "freq")


def top_terms(freq: DataFrame, n: int = 50) -> DataFrame:
    """The first n terms, at least one: a top-k sort, no rank over all."""
    first = freq.orderBy(F.col("freq").desc(), "term").limit(max(1, n))
    return numbered(first.withColumn("_all", F.lit(0)), ["_all"], [F.col("_all")], [F.col("freq").desc(), F.col("term")]).select("rank", "term", "freq")


def zipf(freq: DataFrame) -> DataFrame:
    """(rank, freq, zipf_pred): the frequency that the highest one divided by the rank predicts."""
    highest = freq.agg(F.max("freq").alias("f1"))
    return ranked_terms(freq).select("rank", "freq", (highest.scalar().cast("double") / F.col("rank").cast("double")).alias("zipf_pred"))


def limit_docs(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first n documents with text, by key; n of 0 still takes one, a negative n all."""
    there = docs.filter(F.col(text).isNotNull())
    if n < 0:
        return there
    if n <= SHORT_LIMIT:
        return there.orderBy(key).limit(max(1, n))
    # A long limit ranks ids only; the texts come back by key.
    return there.join(numbered_by_id(there.select(key), key, "_rank").filter(F.col("_rank") <= n).select(key), key, "left_semi")


def limit_bytes(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents by key until their bytes reach the limit; the one that crosses it is in. A negative limit takes all."""
    there = docs.filter(F.col(text).isNotNull())
    if limit < 0:
        return there
    # Sums over ids and lengths only; the texts come back by key.
    sizes = sum_by_id(there.select(key, F.octet_length(text).cast("long").alias("_n")), F.col("_n"), "_upto", key)
    rank = numbered_by_id(sizes, key, "_rank").filter((F.col("_upto") - F.col("_n") < limit) | (F.col("_rank") == 1))
    return there.join(rank.select(key), key, "left_semi")


def throughput(bytes_in: Column, seconds: Column) -> Column:
    """KB a second, 0 without time."""
    return F.when(seconds > 0, bytes_in / 1024.0 / seconds).otherwise(F.lit(0.0))


def average_length(docs: DataFrame, first: int = 1000, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.orderBy(key).limit(first).agg(F.avg(F.length(text)).alias("avg_len"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1").withColumnRenamed("count", "n")
