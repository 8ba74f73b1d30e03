"""Pieces that the training-data operators share: storage between jobs, bounded samples, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.storage import cut, storage_root, sweep

__all__ = ["WORD", "bit_mix", "by_place", "cut", "id_remainder", "join_hot", "let_go", "maybe_in", "read_table", "sample_order", "shuffle_width", "storage_root", "sweep", "text_slices"]

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the filter that keeps texts out of a shuffle where they have no part in it: at most 2 MB, whatever the corpus.
#: Once it is full it lets all texts through, which costs time and changes nothing.
FILTER_BITS, FILTER_ROW = 1 << 24, 1 << 15
#: Parts over which a key's rows are dealt where one key may hold very many.
PARTS = 128


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def sample_order(column: Column, seed: int) -> Column:
    """A fixed pseudo-random order of ids, used to draw bounded samples that reruns repeat."""
    return F.xxhash64(F.lit(seed), column)


def maybe_in(docs: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """docs with a boolean column: false only where the row's key is surely not among keys (one column, key)."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    rows = keys.select(bit(F.col(key)).alias("b")).select(F.floor(F.col("b") / FILTER_ROW).alias("_row"), (F.col("b") % FILTER_ROW).alias("at"))
    bitmap = rows.groupBy("_row").agg(F.bitmap_construct_agg("at").alias("_bits"))
    joined = docs.withColumn("_row", F.floor(bit(docs[key]) / FILTER_ROW)).join(F.broadcast(bitmap), "_row", "left")
    at = bit(docs[key]) % FILTER_ROW
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(name, F.col("_bits").isNotNull() & there).drop("_row", "_bits")


def by_place(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named by their place, and the new names of those wanted. What an operator adds can then
    clash with no column of docs, whatever its name; toDF(*docs.columns) gives the names back."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*places), [places[docs.columns.index(w)] for w in wanted]


def join_hot(rows: DataFrame, found: DataFrame, key: str, by: Column) -> DataFrame:
    """rows joined to found, which has one row per key. A key's rows are dealt over PARTS parts by the column by, and
    found goes to each part that there is, so a key with a third of all rows is no single task."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    spread = dealt.select(key, "_part").distinct().join(found, key)
    return dealt.join(spread, [key, "_part"]).drop("_part")


def let_go() -> None:
    """Give memory that a finished task of a reused Python worker holds back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(batch, column: str, chars: int):
    """Parts of an Arrow batch with about so many characters of text each, at least one row."""
    import pyarrow.compute as pc

    start = at = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()):
        if at and at + n > chars:
            yield batch.slice(start, i - start)
            start, at = i, 0
        at += n
    if start < batch.num_rows:
        yield batch.slice(start)


def bit_mix(x):
    """Finaliser of splitmix64 over a numpy uint64 array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
