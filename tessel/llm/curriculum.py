"""Mixing sources to target weights over a time-varying curriculum.

Targets: sources share a total by weight, none above a multiple of its own size. Each source has a weight schedule over
training time t in [0, 1], linear between a start and an end factor; its integral says how much of the target is due by
t. A source's documents, in a fixed pseudo-random order and repeated as the target asks, stand at cumulative word
positions; inverting the integral turns each into a training position, and the mix is range-sorted by that position.
Cumulative sums are taken in two steps (within slices of a source, then over slices), so no source is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.shared import WORD, by_place, cut, shuffle_width

#: Repeating weights of sources in code point order, null last.
WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2
#: Repeating factors at the start and the end of training.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
#: Rows that one slice of a source holds on average.
SLICE_ROWS = 4_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, n, source_size, weight, slot, target) of sizes (source, n, source_size), one row per source.

    The level rises for all until a source is full; full ones, in the order in which they fill, leave the rest to the
    others. A source without words has target 0. Sums are whole numbers, so reruns and other engines agree.
    """
    named = sizes.withColumn("slot", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.lit(None)
    for i, x in enumerate(weights):
        w = F.when(F.col("slot") % len(weights) == i, F.lit(x)).otherwise(w)
    named = named.withColumn("weight", w.cast("long"))
    filled = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("slot"))
    total = F.sum("source_size").over(Window.partitionBy())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * ceiling
    level = (total * share - full) / F.sum("weight").over(after)
    ranked = named.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("source_size") * ceiling)
    # Sources fill in order, so the first that doesn't fill sets the level of all after it.
    line = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("slot"), F.col("level")))).over(Window.partitionBy())
    target = F.when(line.isNull(), F.col("source_size") * F.lit(float(ceiling))).otherwise(F.least(F.col("source_size") * F.lit(float(ceiling)), line["level"] * F.col("weight")))
    return ranked.withColumn("target", target).select("source", "n", "source_size", "weight", "slot", "target")


def integral(t: Column, start: Column, end: Column) -> Column:
    """Share of a source's target that is due by time t, for a weight linear from start to end."""
    return (start * t + (end - start) * t * t / 2) / ((start + end) / 2)


def position(due: Column, start: Column, end: Column) -> Column:
    """Time at which the share due is reached: the inverse of integral."""
    slope = end - start
    area = due * (start + end) / 2
    return F.when(F.abs(slope) < 1e-12, due).otherwise((F.sqrt(start * start + 2 * slope * area) - start) / slope)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", ident: Column | None = None) -> DataFrame:
    """One row per row of docs: key, size, source_size, target, taken (words, repeats counted), source, times, positions;
    and ident, which says what row it is, if there is one.

    A document is taken 0, 1 or 2 times: in each pass over its source it is taken if the middle of its words stands
    below the target, so a source misses its target by half a document at most. positions holds the training position
    of each time it is taken. Order within a source: md5 of the key as text, then key, then size; rows equal in these
    are interchangeable, or go by ident. A null text has no words and is never taken; null sources form one source, the
    last. Words of a text are counted whole, however long; an empty table gives an empty one; other columns of docs are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), words_in(F.col(f"`{text}`")).alias("size"), F.col(f"`{source}`").alias("source"), *([] if ident is None else [ident.alias("ident")]))
    more = [] if ident is None else ["ident"]
    rows = cut(rows.withColumn("mark", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))), "sizes")
    named = targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    named = cut(named.withColumn("slices", F.greatest(F.lit(1), (F.col("n") / SLICE_ROWS).cast("long"))), "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # The mark's first 8 hex digits deal a source's rows into slices that keep the order of marks.
    joined = rows.join(named, same(rows, named)).drop(named["source"])
    joined = joined.withColumn("slice", F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(1 << 32)))
    sliced = joined.groupBy("slot", "slice").agg(F.sum("size").alias("words"))
    ahead = sliced.select("slot", "slice", (F.sum("words").over(Window.partitionBy("slot").orderBy("slice")) - F.col("words")).alias("ahead"))
    dealt = joined.join(ahead, ["slot", "slice"])
    inside = Window.partitionBy("slot", "slice").orderBy("mark", F.col("key").asc_nulls_last(), "size", *more).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("ahead") + F.sum("size").over(inside) - F.col("size") / 2
    placed = dealt.withColumn("middle", middle)
    start, end = F.lit(None), F.lit(None)
    for i, (a, b) in enumerate(SCHEDULES):
        start, end = F.when(F.col("slot") % len(SCHEDULES) == i, F.lit(a)).otherwise(start), F.when(F.col("slot") % len(SCHEDULES) == i, F.lit(b)).otherwise(end)
    passes = F.filter(F.array(F.col("middle"), F.col("middle") + F.col("source_size")), lambda m: (m < F.col("target")) & (F.col("size") > 0))
    placed = placed.withColumn("positions", F.transform(passes, lambda m: position(m / F.col("target"), start.cast("double"), end.cast("double"))))
    out = placed.withColumn("times", F.size("positions").cast("long")).withColumn("taken", F.col("size") * F.col("times"))
    out = cut(out.select("key", "size", "source_size", "target", "taken", "source", "times", "positions", *more), "mix")
    return out if ident is not None else by_position(out.withColumnRenamed("key", key), F.try_element_at("positions", F.lit(1)), key)


def by_position(df: DataFrame, at: Column, *ties: str) -> DataFrame:
    """Range-sort by a position from 0 to 1. The ranges are known, so no sample of the rows is needed. Rows without a
    position come last, dealt by hash to as many partitions again; ties names the columns that order equal positions."""
    width = shuffle_width(df.sparkSession)
    late = F.lit(width) + F.pmod(F.xxhash64(*ties), F.lit(width)) if ties else F.lit(width - 1)
    place = F.when(at.isNull(), late).otherwise(F.least(F.lit(width - 1), F.floor(at * width))).cast("int")
    return df.repartitionById(width * 2 if ties else width, place).sortWithinPartitions(at.asc_nulls_last(), *ties)


def training_stream(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, range-sorted by training position; columns of docs only.

    A row meets its own positions by a digest of key, source and text, nulls told apart from all values; rows that share
    all three are interchangeable and numbered. Null texts and texts without words aren't taken; null keys and sources
    are as any other. Texts are moved whole, however long; an empty table gives an empty one; columns may have any names.
    """
    rows, (t, k, s) = by_place(docs, text, key, source)
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    ident = F.unhex(F.md5(F.concat_ws("\n", F.md5(told(k)), F.md5(told(s)), F.md5(told(t)))))
    number = F.row_number().over(Window.partitionBy("ident").orderBy("order"))
    mixed = mix(rows, t, k, s, ident).filter(F.size("positions") > 0).select("ident", "positions", F.struct(F.size("positions"), "positions").alias("order"))
    # Rows with one digest are alike in all that counts here, so any numbering pairs them with their positions.
    mixed = mixed.withColumn("mine", number).drop("order")
    ours = rows.withColumn("ident", ident).withColumn("order", F.monotonically_increasing_id()).withColumn("theirs", number).drop("order")
    # The numbers meet in a condition, not in the join's keys: both sides stay dealt by digest alone.
    taken = ours.join(mixed, "ident").filter(F.col("theirs") - F.col("mine") == 0).withColumn("at", F.explode("positions"))
    return by_position(taken, F.col("at")).select(*rows.columns).toDF(*docs.columns)
