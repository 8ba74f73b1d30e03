"""Command line: stats, index, bool, rank and serve. Exit code 0 for success, 1 for an error, 2 for wrong usage."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import TokenOptions
from tessel.operators import boolean as B
from tessel.operators import ranked as R
from tessel.operators import stats as S
from tessel.sources import tables as T


def _flag(value: str) -> bool:
    return value != "0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessel")
    commands = top.add_subparsers(dest="command", required=True)
    corpus = argparse.ArgumentParser(add_help=False)
    corpus.add_argument("--docs", required=True, help="parquet with doc_id and text")
    corpus.add_argument("--keep-numbers", type=_flag, default=False)
    corpus.add_argument("--stem", type=_flag, default=False)
    corpus.add_argument("--min-len", type=int, default=1)
    corpus.add_argument("--limit-docs", type=int, default=-1)
    stats = commands.add_parser("stats", parents=[corpus])
    stats.add_argument("--limit-bytes", type=int, default=-1)
    stats.add_argument("--out", help="folder for term_freq, top_terms and zipf")
    stats.add_argument("--top-n", type=int, default=50)
    index = commands.add_parser("index", parents=[corpus])
    index.add_argument("--out", required=True)
    asked = argparse.ArgumentParser(add_help=False)
    asked.add_argument("--index", required=True)
    asked.add_argument("--q")
    asked.add_argument("--qfile")
    asked.add_argument("--top", type=int, default=R.TOP)
    for name in ("bool", "rank"):
        commands.add_parser(name, parents=[asked])
    serve = commands.add_parser("serve")
    serve.add_argument("--index", required=True)
    serve.add_argument("--port", type=int, default=8080)
    return top


def _options(a: argparse.Namespace) -> TokenOptions:
    return TokenOptions(a.keep_numbers, a.stem, a.min_len)


def _docs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return S.limit_docs(spark.read.parquet(a.docs), a.limit_docs)


def _stats(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = S.limit_bytes(_docs(spark, a), a.limit_bytes)
    start = time.perf_counter()
    row = S.corpus_stats(docs, _options(a)).first()
    took = time.perf_counter() - start
    for name, value in row.asDict().items():
        print(f"{name} {value}")
    print(f"seconds {took:.3f}\nKB_per_s {row['bytes_in'] / 1024 / took:.1f}")
    freq = S.term_freq(docs, _options(a))
    print(f"unique_terms {freq.count()}")
    if a.out:
        T.write_report(freq, f"{a.out}/term_freq")
        T.write_report(S.top_terms(freq, a.top_n).orderBy("rank"), f"{a.out}/top_terms")
        T.write_report(S.zipf(freq).orderBy("rank"), f"{a.out}/zipf")


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    start = time.perf_counter()
    index = T.Index.build(_docs(spark, a), a.out, _options(a))
    print(f"docs {index.n_docs}\nterms {index.dictionary.count()}\ntime_ms {round((time.perf_counter() - start) * 1000)}")


def answer(index: T.Index, kind: str, query: str, top: int) -> tuple[int, list]:
    """Hits before the cut, and the rows shown: doc_id, title, url, and the score of a ranked query."""
    if kind == "bool":
        found = B.boolean_search(index.postings, index.forward, query, index.options)
        shown = found.orderBy("doc_id").limit(max(1, top))
        order = [F.col("doc_id")]
    else:
        found = R.ranked_search(index.postings, index.forward, query, index.n_docs, index.options)
        shown = R.top(found, top).withColumn("shown", R.shown(F.col("score")))
        order = [F.col("score").desc(), F.col("doc_id")]
    return found.count(), B.with_metadata(shown, index.forward).orderBy(*order).collect()


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    index = T.Index(spark, a.index)
    asked = [a.q] if a.q is not None else [r["q"] for r in T.read_queries(spark, a.qfile).orderBy("qid").toLocalIterator()]
    for query in asked:
        start = time.perf_counter()
        hits, rows = answer(index, a.command, query, a.top)
        print(f"hits {hits}")
        for r in rows:
            print("\t".join(map(str, [r["doc_id"], *([r["shown"]] if a.command == "rank" else []), r["title"], r["url"]])))
        print(f"time_ms {round((time.perf_counter() - start) * 1000)}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
        if a.command in ("bool", "rank") and a.q is None and a.qfile is None:
            print("tessel: --q or --qfile is needed", file=sys.stderr)
            return 2
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("tessel").getOrCreate()
    try:
        if a.command == "serve":
            from tessel.web import serve

            serve(T.Index(spark, a.index), a.port)
        else:
            {"stats": _stats, "index": _index, "bool": _search, "rank": _search}[a.command](spark, a)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
