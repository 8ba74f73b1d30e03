"""Ranked retrieval by term frequency and inverse document frequency."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.text import DEFAULT, TokenOptions, query_terms
from tessel.operators.boolean import NOT, TERM, QueryError, boolean_batch, boolean_search, compile_query, is_boolean, lex
from tessel.sources.storage import cut

TOP = 20


def idf(docs: Column, df: Column) -> Column:
    return F.log((docs + 1.0) / (df + 1.0))


def scoring_terms(query: str, options: TokenOptions = DEFAULT, strict_terms: bool = False) -> list[str]:
    """Terms that score, in order, repeats kept. By default the whole query is tokenised, so operator words and negated
    words count too; strict_terms leaves both out."""
    if not strict_terms:
        return query_terms(query, options)
    out, negated = [], False
    for t in lex(query):
        if t.kind == NOT:
            negated = True
        elif t.kind == TERM:
            out += [] if negated else query_terms(t.text, options)
            negated = False
    return out


def scores(posted: DataFrame, queries: list[tuple[int, str]], n_docs: int, options: TokenOptions = DEFAULT, strict_terms: bool = False) -> DataFrame:
    """(qid, doc_id, score) with score over 0, for documents that have a scoring term.

    A term's weight is its number in the query; document frequencies come from the same postings. Contributions add up
    as they come, so ranks compare scores by ranking, which takes no notice of the order of a sum.
    """
    spark = posted.sparkSession
    weights: Counter[tuple[int, str]] = Counter((qid, term) for qid, text in queries for term in scoring_terms(text, options, strict_terms))
    terms = sorted({t for _, t in weights})
    asked = spark.createDataFrame([(qid, term, times) for (qid, term), times in weights.items()], "qid long, term string, times long")
    found = posted.filter(F.col("term").isin(*terms)) if terms else posted.limit(0)
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    known = asked.join(frequency, "term").select("qid", "term", (F.col("times") * idf(F.lit(float(n_docs)), F.col("df"))).alias("w"))
    parts = found.join(F.broadcast(known), "term").select("qid", "doc_id", (F.col("tf") * F.col("w")).alias("c"))
    return parts.groupBy("qid", "doc_id").agg(F.sum("c").alias("score")).filter("score > 0")


def ranking(score: Column) -> Column:
    """What ranks compare: the score to nine digits after the point."""
    return F.rint(score * 1e9)


def ranked_search(posted: DataFrame, docs: DataFrame, query: str, n_docs: int | None = None, options: TokenOptions = DEFAULT, strict_terms: bool = False) -> DataFrame:
    """(doc_id, score) of all hits. A query with operators first selects documents; one without takes any of its terms."""
    n = docs.count() if n_docs is None else n_docs
    scored = scores(posted, [(0, query)], n, options, strict_terms).drop("qid")
    tokens = lex(query)
    if is_boolean(tokens):
        return scored.join(boolean_search(posted, docs, query, options), "doc_id", "left_semi")
    if not tokens:
        raise QueryError("empty query")
    return scored


def top(hits: DataFrame, n: int = TOP) -> DataFrame:
    """The best n hits, at least one: score falling, then doc_id."""
    return hits.orderBy(ranking(F.col("score")).desc(), "doc_id").limit(max(1, n))


def with_hits(hits: DataFrame, n: int = TOP) -> DataFrame:
    """The best n with hits, the number there were before the cut. Scores are written once and read by both."""
    hits = cut(hits, "hits")
    return top(hits, n).withColumn("hits", hits.agg(F.count("*")).scalar())


def ranked_batch(posted: DataFrame, docs: DataFrame, queries: list[tuple[int, str]], n_docs: int, n: int = TOP, options: TokenOptions = DEFAULT, on_error: str = "raise") -> DataFrame:
    """(qid, doc_id, score, rank): the best n of each query; one scan scores the batch, another selects the documents
    of queries with operators. Empty queries have no rows. on_error: raise, or skip queries that aren't well formed."""
    chosen, selecting = [], []
    for qid, text in queries:
        tokens = lex(text)
        if not tokens:
            continue
        if is_boolean(tokens):
            try:
                compile_query(text, options)
            except QueryError:
                if on_error != "skip":
                    raise
                continue
            selecting.append((qid, text))
        chosen.append((qid, text))
    scored = scores(posted, chosen, n_docs, options)
    if selecting:
        ids = [q for q, _ in selecting]
        scored = scored.filter(~F.col("qid").isin(*ids)).union(scored.filter(F.col("qid").isin(*ids)).join(boolean_batch(posted, docs, selecting, options), ["qid", "doc_id"], "left_semi"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(ranking(F.col("score")).desc(), "doc_id"))
    # Spark keeps n rows a query in each task before the window (its group limit), so no query's hits meet in one task.
    return scored.withColumn("rank", best.cast("long")).filter(F.col("rank") <= max(1, n))


def shown(score: Column) -> Column:
    """Six significant digits without trailing zeros, for display."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", score), r"(\.\d*?)0+$", "$1"), r"\.$", "")
