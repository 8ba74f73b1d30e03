"""Document store operations: filters for dumps, insertion without repeats, refreshing and its modes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessel.functions.text import clean_article, clean_html, clean_markup, clean_post, encode_url, is_service_page
from tessel.operators.ordering import numbered_by_id

# Addresses of articles and questions.
WIKI_BASE = "https://ru.wikipedia.org/wiki/"
POST_BASE = "https://ru.stackoverflow.com/questions/"
#: Characters that a text needs: cleaned ones in extracts, raw ones in crawls.
EXTRACT_LENGTH, CRAWL_WIKI_LENGTH, CRAWL_POST_LENGTH = 100, 100, 50


def _filled(column: Column) -> Column:
    return column.isNotNull() & (F.length(column) > 0)


def wiki_articles(pages: DataFrame) -> DataFrame:
    """Pages with a title and a text that are no redirects and no service pages."""
    kept = pages.filter(_filled(F.col("title")) & _filled(F.col("revision.text")) & ~is_service_page(F.col("title")))
    return kept.filter(F.col("redirect").isNull()) if "redirect" in pages.columns else kept


def extract_wiki(pages: DataFrame, least: int = EXTRACT_LENGTH) -> DataFrame:
    """Corpus documents of articles: cleaned text of at least least characters."""
    t = clean_markup(F.col("revision.text"))
    kept = wiki_articles(pages).withColumn("_clean", t).filter(F.length("_clean") >= least)
    meta = F.struct(F.concat(F.lit(WIKI_BASE), F.replace("title", F.lit(" "), F.lit("_"))).alias("url"), F.col("revision.timestamp").cast("string").alias("timestamp"), F.octet_length("revision.text").cast("long").alias("raw_length_bytes"), F.lit("ru").alias("language"))
    return kept.select(F.col("id").cast("string").alias("external_id"), F.lit("wikipedia").alias("source"), "title", F.col("_clean").alias("text"), meta.alias("meta"))


def extract_posts(rows: DataFrame, least: int = EXTRACT_LENGTH) -> DataFrame:
    """Corpus documents of questions: cleaned body of at least least characters, after the title where there is one."""
    kept = rows.filter(F.col("_PostTypeId").cast("string") == "1").withColumn("_clean", clean_post(F.col("_Body"))).filter(F.length("_clean") >= least)
    title = F.coalesce(F.col("_Title"), F.lit(""))
    text = F.when(title != "", F.concat(title, F.lit(". "), F.col("_clean"))).otherwise(F.col("_clean"))
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    meta = F.struct(F.concat(F.lit(POST_BASE), F.col("_Id").cast("string")).alias("url"), F.coalesce(F.col("_CreationDate").cast("string"), F.lit("")).alias("timestamp"), F.coalesce(F.col("_Tags"), F.lit("")).alias("tags"), number("_Score").alias("score"), number("_ViewCount").alias("views"), F.octet_length("_Body").cast("long").alias("raw_length_bytes"), F.lit("ru").alias("language"))
    return kept.select(F.col("_Id").cast("string").alias("external_id"), F.lit("stackexchange").alias("source"), F.when(title != "", title).otherwise(F.concat(F.lit("Вопрос "), F.col("_Id").cast("string"))).alias("title"), text.alias("text"), meta.alias("meta"))


def crawl_wiki(pages: DataFrame, now: float, version: int = 1) -> DataFrame:
    """Raw documents of articles, with the crawler's cleaning and percent-encoded addresses."""
    kept = wiki_articles(pages).filter(F.length("revision.text") >= CRAWL_WIKI_LENGTH)
    clean = clean_article(F.col("revision.text"))
    return kept.select(F.concat(F.lit(WIKI_BASE), encode_url(F.replace("title", F.lit(" "), F.lit("_")))).alias("url"), F.col("revision.text").alias("raw_html"), clean.alias("clean_text"), F.lit(version).alias("clean_version"), F.lit("wikipedia").alias("source"), F.lit(now).alias("last_crawled_at"), F.col("id").cast("string").alias("external_id"), "title", F.col("revision.timestamp").cast("string").alias("timestamp")).withColumn("clean_len", F.length("clean_text").cast("long"))


def crawl_posts(rows: DataFrame, now: float, version: int = 1) -> DataFrame:
    kept = rows.filter((F.col("_PostTypeId").cast("string") == "1") & (F.length("_Body") >= CRAWL_POST_LENGTH))
    title = F.coalesce(F.nullif(F.col("_Title"), F.lit("")), F.concat(F.lit("Вопрос "), F.col("_Id").cast("string")))
    return kept.select(F.concat(F.lit(POST_BASE), F.col("_Id").cast("string")).alias("url"), F.col("_Body").alias("raw_html"), clean_html(F.col("_Body")).alias("clean_text"), F.lit(version).alias("clean_version"), F.lit("stackoverflow").alias("source"), F.lit(now).alias("last_crawled_at"), F.col("_Id").cast("string").alias("external_id"), title.alias("title"), F.col("_CreationDate").cast("string").alias("creation_date"), F.coalesce(F.col("_Tags"), F.lit("")).alias("tags"), F.coalesce(F.col("_Score").cast("int"), F.lit(0)).alias("score")).withColumn("clean_len", F.length("clean_text").cast("long"))


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "url", order: str | None = None) -> DataFrame:
    """Incoming rows whose key isn't stored yet, one per key: the first by order, any where no order is stated."""
    once = incoming.dropDuplicates([key]) if order is None else first_by(incoming, key, order)
    return once.join(stored.select(key), key, "left_anti")


def resumed(records: DataFrame, start_from: int, key: str = "doc_id") -> DataFrame:
    """Records from an offset on, the first being 0, in the order of a whole-number key; offset says which each one is."""
    return numbered_by_id(records, key, "offset").withColumn("offset", F.col("offset") - 1).filter(F.col("offset") >= max(0, start_from))


def save_points(records: DataFrame, every: int) -> DataFrame:
    """(saved, offset) of records with offset: after each so many records, and at the end, the offset to go on from."""
    least = records.agg(F.min("offset").alias("least"))
    point = F.floor((F.col("offset") - least.scalar()) / every) if every > 0 else F.lit(0)
    return records.groupBy(point.alias("saved")).agg((F.max("offset") + 1).alias("offset"))


def from_sources(docs: DataFrame, enabled: dict[str, bool], column: str = "source") -> DataFrame:
    """Documents of the sources that are on; a source that isn't named is off, and so is none at all."""
    return docs.filter(F.coalesce(F.col(column).isin(*[s for s, on in sorted(enabled.items()) if on]), F.lit(False)))


def uniqueness(df: DataFrame, *keys: str) -> DataFrame:
    """(key, rows, missing, repeated): for each column that has to be unique, the rows, those without a value, and those
    beyond the first of their value. A column holds its contract if repeated is 0."""
    parts = [df.groupBy(F.col(k).alias("v")).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("count"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("count") - 1)), F.lit(0)).alias("repeated")).select(F.lit(k).alias("key"), "rows", "missing", "repeated") for k in keys]
    return reduce(DataFrame.union, parts)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, once its keys are known to be unique; ValueError names the ones that aren't."""
    broken = [r["key"] for r in uniqueness(df, *keys).filter("repeated > 0").collect()]
    if broken:
        raise ValueError(f"not unique: {', '.join(broken)}")
    return df


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """df with counters that fill while it is written: rows processed, and those for which each condition holds."""
    told = Observation(name)
    return df.observe(told, F.count("*").alias("processed"), *[F.count_if(c).alias(n) for n, c in counters.items()]), told


def clean_view(raw: DataFrame) -> DataFrame:
    return raw.drop("raw_html")


def stale(df: DataFrame, before: float, missing: bool = False, column: str = "last_crawled_at", most: int | None = None, key: str = "url") -> DataFrame:
    """Rows last seen before a time; rows never seen too if missing is set. most: so many of them in one run, those never
    seen first, then the oldest, ties by key; each task keeps so many before they meet."""
    old = F.col(column) < F.lit(before)
    found = df.filter((F.col(column).isNull() | old) if missing else old)
    return found if most is None else found.orderBy(F.col(column).asc_nulls_first(), key).limit(most)


def mode(stored: DataFrame, now: float, after_days: float) -> str | None:
    """seed for an empty store, recrawl if a row is stale, else None."""
    if stored.isEmpty():
        return "seed"
    return None if stale(stored, now - after_days * 86_400).isEmpty() else "recrawl"


def change_counts(stored: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """One row: processed, updated, unchanged and failed, of the stored rows that were fetched again. Of a key's
    bodies the least counts, as in changed, so a failure beside a body is none."""
    fresh = fetched.groupBy(key).agg(F.min("body").alias("_body"))
    joined = stored.join(fresh, key)
    differs = F.md5(F.col("_body")) != F.md5(F.coalesce("raw_html", F.lit("")))
    return joined.agg(F.count("*").alias("processed"), F.count_if(differs).alias("updated"), F.count_if(~differs).alias("unchanged"), F.count_if(F.col("_body").isNull()).alias("failed"))


def changed(stored: DataFrame, fetched: DataFrame, now: float, key: str = "url") -> DataFrame:
    """stored with raw_html and last_crawled_at of those rows set whose fetched body has another digest. Rows without
    a fetched body, or with an equal one, stay as they are; of several bodies of a key the least counts, so reruns agree."""
    fresh = fetched.groupBy(key).agg(F.min("body").alias("_body"))
    joined = stored.join(fresh, key, "left")
    differs = F.col("_body").isNotNull() & (F.md5(F.col("_body")) != F.md5(F.coalesce("raw_html", F.lit(""))))
    return joined.select(*[F.when(differs, F.col("_body")).otherwise(F.col(c)).alias(c) if c == "raw_html" else F.when(differs, F.lit(now)).otherwise(F.col(c)).alias(c) if c == "last_crawled_at" else F.col(c) for c in stored.columns])
