"""Readers and writers: XML dumps, JSON lines, CSV reports, query files and the persisted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import DEFAULT, TokenOptions
from tessel.operators import postings as P
from tessel.sources.storage import spread

PAGE = "title string, ns int, id long, redirect struct<_title string>, revision struct<id long, timestamp string, text string>"
POST = "_Id string, _PostTypeId string, _ParentId string, _Title string, _Body string, _Score int, _ViewCount int, _AnswerCount int, _Tags string, _CreationDate string"
DOCUMENT = "id long, external_id string, source string, title string, text string, meta struct<url string, timestamp string, raw_length_bytes long, language string, tags string, score int, views int>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an encyclopedia dump, packed or not; a stated schema saves a pass over it."""
    return spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a post dump; attributes become columns with a leading underscore."""
    return spark.read.format("xml").option("rowTag", "row").schema(POST).load(path)


def parse_page(column: str) -> Column:
    """The same for a column of page texts."""
    return F.from_xml(column, PAGE, {"rowTag": "page"})


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside a field are doubled."""
    df.write.option("header", True).option("escape", '"').csv(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, q) of the non-empty lines of a file of queries, in the order of the lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("qid", "q"))
    return lines.filter(F.length("q") > 0).select(F.col("qid").cast("long").alias("qid"), "q")


class Index:
    """A persisted index: postings by term, the dictionary, the forward index, and a row that describes them.

    Postings are range-partitioned and sorted by term, so a query reads the row groups of its terms only.
    """

    VERSION = 2
    PARTS = ("postings", "dictionary", "forward", "about")

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.dictionary, self.forward, self.about = (spark.read.parquet(f"{path}/{p}") for p in self.PARTS)
        row = self.about.first()
        if row["version"] != self.VERSION:
            raise ValueError(f"index version {row['version']} isn't {self.VERSION}")
        self.n_docs, self.options = row["docs"], TokenOptions(row["keep_numbers"], row["stem"], row["min_len"])

    @classmethod
    def build(cls, docs: DataFrame, path: str, options: TokenOptions = DEFAULT, text: str = "text") -> Index:
        """Write the index of the documents that have text and open it."""
        spark = docs.sparkSession
        there = docs.filter(F.col(text).isNotNull())
        posted = P.postings(spread(there), options, positions=True, text=text)
        posted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        P.dictionary(spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/dictionary")
        P.forward_index(there).write.parquet(f"{path}/forward")
        n = spark.read.parquet(f"{path}/forward").count()
        spark.createDataFrame([(cls.VERSION, n, options.keep_numbers, options.stem, options.min_len)], "version int, docs long, keep_numbers boolean, stem boolean, min_len int").write.parquet(f"{path}/about")
        return cls(spark, path)

    def check(self) -> None:
        """Raise where the parts don't belong together."""
        n = self.forward.count()
        if n != self.n_docs:
            raise ValueError(f"{n} documents in the forward index, {self.n_docs} stated")
        if not self.postings.join(self.forward, "doc_id", "left_anti").isEmpty():
            raise ValueError("postings of documents that the forward index doesn't have")
