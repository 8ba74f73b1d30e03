"""Line dedup by content-defined chunks, in built-in expressions only.

Lines are hashed; a hash that rolls over each two neighbouring lines proposes a boundary after the second where it
divides by SPACING and the one before it doesn't, so boundaries follow content, not line numbers, and every chunk of a
text with two lines or more has at least two. Chunks are counted over the whole corpus; one that stands in a document
with a smaller id, or earlier in the same text, goes. A text that goes whole, as a copy does, is done with. In the others
a repeated passage may be too short to hold a chunk, or its ends may lie inside one; an exact pass over each two
neighbouring lines follows there, which finds every repeated run of two lines or more to its last line. Bytes are
compared by their SHA-256, which two different passages don't share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import by_place, cut, join_hot, maybe_in

#: A boundary stands at one of so many places.
SPACING = 3


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def chunks(text: Column) -> Column:
    """array<struct<h, at, lines>>: the chunks of two lines or more, by SHA-256, with their first line's number. Empty for
    a text of one line; null for null."""

    def cuts(hashes: Column) -> Column:
        n = F.size(hashes)
        proposed = lambda i: (i >= 2) & (F.pmod(F.xxhash64(F.get(hashes, i - 2), F.get(hashes, i - 1)), F.lit(SPACING)) == 0)
        # i lines stand before a boundary, at least two after the last one.
        inner = F.filter(F.sequence(F.lit(1), n), lambda i: (i <= n - 2) & proposed(i) & ~proposed(i - 1))
        return F.concat(F.array(F.lit(0)), inner, F.array(n))

    def between(lines: Column) -> Column:
        def spans(edges: Column) -> Column:
            return F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(F.unhex(F.sha2(F.array_join(F.slice(lines, a + 1, b - a), "\n").cast("binary"), 256)).alias("h"), a.alias("at"), (b - a).alias("lines")))

        return F.filter(_let(_let(F.transform(lines, lambda x: F.xxhash64(x)), cuts), spans), lambda c: c["lines"] >= 2)

    return F.when(text.isNotNull(), _let(F.split(text, "\n", -1), between))


def line_pairs(text: Column) -> Column:
    """array<binary>: the SHA-256 of each two neighbouring lines, in order. Empty for a text of one line; null for null."""
    pair = lambda a, b: F.unhex(F.sha2(F.concat(a, F.lit("\n"), b), 256))
    return _let(F.split(text, "\n", -1), lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), pair))


def _going(seen: DataFrame, label: str) -> DataFrame:
    """(_id, h, lines, places) of seen (_k, _id, h, at, lines): where a text has what stands in a document with a smaller
    id, or earlier in itself. What only rows without key have is owned by none, and stays."""
    seen = cut(seen, label)
    counted = seen.groupBy("h").agg(F.min("_k").alias("owner"), F.count("*").alias("times"))
    repeated = cut(counted.filter("times > 1 AND owner IS NOT NULL").select("h", "owner"), "repeated")
    # What doesn't repeat stays out of the join; what very many texts have is dealt over many tasks.
    near = maybe_in(seen, repeated, "h", "_again").filter("_again").drop("_again")
    by_text = join_hot(near, repeated, "h", F.col("_id")).groupBy("_id", "h").agg(F.collect_set("at").alias("places"), F.min("at").alias("first"), F.first("lines").alias("lines"), F.bool_or(F.col("_k").eqNullSafe(F.col("owner"))).alias("owns"))
    return by_text.select("_id", "h", "lines", F.when(F.col("owns"), F.array_remove("places", F.col("first"))).otherwise(F.col("places")).alias("places")).filter(F.size("places") > 0)


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose _id is none of ids. All but the bitmap's false hits stay where they are."""
    marked = maybe_in(rows, ids, "_id", "_in")
    false = cut(marked.filter("_in").select("_id").distinct().join(ids, "_id", "left_anti"), "false-hits")
    again = maybe_in(marked.filter("_in").drop("_in"), false, "_id", "_false").filter("_false").drop("_false").join(false, "_id", "left_semi")
    return marked.filter("NOT _in").drop("_in").unionByName(again)


def going_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_id, goes, whole): for each key and text, as the digest that text_id makes, the numbers of the lines that go,
    maybe repeated, or only how many there are where all of them go by chunks. A null text, or one of a single line, has
    none."""
    rows = docs.select(F.col(f"`{key}`").alias("_k"), text_id(docs, text, key).alias("_id"), F.col(f"`{text}`").alias("t"))
    size = F.size(F.split("t", "\n", -1))
    spread = rows.select("_k", "_id", size.alias("n"), F.explode(chunks(F.col("t"))).alias("c")).select("_k", "_id", F.col("c.h").alias("h"), F.struct("c.at", "n").alias("at"), F.col("c.lines").alias("lines"))
    by_chunk = _going(spread, "line-chunks").select("_id", "lines", F.explode("places").alias("p"))
    by_chunk = by_chunk.select("_id", F.sequence("p.at", F.col("p.at") + F.col("lines") - 1).alias("goes"), F.col("p.n").alias("n"))
    by_chunk = cut(by_chunk.groupBy("_id").agg(F.flatten(F.collect_list("goes")).alias("goes"), F.first("n").alias("n")), "lines-by-chunk")
    whole = by_chunk.filter(F.size("goes") == F.col("n"))
    left = _without(rows, whole.select("_id"))
    by_pair = _going(left.select("_k", "_id", F.posexplode(line_pairs(F.col("t"))).alias("at", "h"), F.lit(2).alias("lines")), "line-pairs")
    by_pair = by_pair.select("_id", F.concat("places", F.transform("places", lambda i: i + 1)).alias("goes"))
    parts = by_chunk.filter(F.size("goes") < F.col("n")).select("_id", "goes").union(by_pair)
    parts = parts.groupBy("_id").agg(F.flatten(F.collect_list("goes")).alias("goes")).withColumn("whole", F.lit(False))
    return parts.union(whole.select("_id", F.array("n").alias("goes"), F.lit(True).alias("whole")))


def text_id(docs: DataFrame, text: str, key: str) -> Column:
    """A digest of key and text, null for a null text: rows that share both are judged alike."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), docs[key].cast("string")), F.lit("")), F.lit("\n"), docs[text])))


def remove_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", counts: bool = True) -> DataFrame:
    """docs without the runs of two lines or more that repeat; with removed_chunks, their number, and removed_lines
    unless counts is off.

    A line goes if it and a neighbour stand, byte for byte (by SHA-256) and in this order, in a document with a smaller
    id or earlier in the same text; a document of which all chunks go gives others no reason to go. So of every line the
    first one stays: nothing is lost from the corpus but its repeats. Blank lines are lines. Rows that share a key are one document and keep what it owns; a row without key
    owns nothing. A null text stays null, a text of one line stays as it is, and a text of which all lines go becomes
    empty. A text however long is judged whole, in time that its lines are in proportion to; an empty table gives an
    empty one. n_chars follows the text where docs has it. Columns of docs may have any names; one called like a count
    gives way to the count.
    """
    names = docs.columns
    rows, (t, k) = by_place(docs, text, key)
    found = cut(going_lines(rows, t, k), "going-lines")
    rows = rows.withColumn("_id", text_id(rows, t, k))
    # Texts that go whole aren't moved; of the others only those with repeated lines meet these.
    whole, parts = found.filter("whole").select("_id", F.get("goes", F.lit(0)).alias("n")), found.filter("NOT whole").select("_id", "goes")
    empty = maybe_in(rows.drop(t), whole.select("_id"), "_id", "_in").filter("_in").drop("_in").join(whole, "_id")
    empty = empty.select(*[F.lit("").alias(c) if c == t else F.col(c) for c in rows.columns], F.struct(F.lit("").alias("text"), F.lit(1).cast("long").alias("chunks"), F.col("n").cast("long").alias("lines")).alias("_done"))
    marked = maybe_in(_without(rows, whole.select("_id")), parts.select("_id"), "_id", "_has").withColumn("_has", F.col("_has") & F.col("_id").isNotNull())
    joined = marked.filter("_has").join(parts, "_id", "left").unionByName(marked.filter("NOT _has"), allowMissingColumns=True)
    body = F.col(t)

    def judged(lines: Column) -> Column:
        # array_except is by hash, so the work is linear in the lines.
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "goes")
        runs = F.size(F.array_except("goes", F.transform("goes", lambda i: i + 1)))
        return _let(kept, lambda k: F.struct(F.array_join(F.transform(k, lambda i: F.get(lines, i)), "\n").alias("text"), runs.cast("long").alias("chunks"), (F.size(lines) - F.size(k)).cast("long").alias("lines")))

    none = F.lit(0).cast("long")
    result = F.when(F.col("goes").isNull(), F.struct(body.alias("text"), none.alias("chunks"), none.alias("lines"))).otherwise(_let(F.split(body, "\n", -1), judged))
    done = joined.withColumn("_done", result).select(*rows.columns, "_done").union(empty)
    told = {"removed_chunks": F.col("_done.chunks"), "removed_lines": F.col("_done.lines")} if counts else {}
    own = [(place, name) for place, name in zip(rows.columns, names) if name not in told]
    columns = [F.col("_done.text") if place == t else F.length("_done.text").cast("long") if name == "n_chars" else F.col(place) for place, name in own]
    # Names that repeat in docs are given only at the end.
    return done.select(*[c.alias(f"c{i}") for i, c in enumerate([*columns, *told.values()])]).toDF(*[name for _, name in own], *told)
