"""Inverted and forward index as tables, and the sizes of their packed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import vbyte
from tessel.functions.text import DEFAULT, TokenOptions, display_title, tokens


def occurrences(docs: DataFrame, options: TokenOptions = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, pos): pos counts kept tokens from 0."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(tokens(F.col(text), options)).alias("pos", "term")).select("term", "doc_id", F.col("pos").cast("long").alias("pos"))


def _let(value: Column, body) -> Column:
    """body(value), value being computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _starts(words: Column) -> Column:
    """Where runs of equal words start among sorted ones, of which there is at least one."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))


def _runs(words: Column, placed: Column | None = None) -> Column:
    """(term, tf) for each run of equal words among sorted ones, null without words; with positions, of which placed has
    each word's beside it."""

    def cut_at(starts: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            n = F.coalesce(F.get(starts, k + 1), F.size(words)) - start
            own = [] if placed is None else [F.slice(placed, start + 1, n).alias("positions")]
            return F.struct(F.get(words, start).alias("term"), n.cast("long").alias("tf"), *own)

        return F.transform(starts, run)

    return F.when(F.size(words) > 0, _let(_starts(words), cut_at))


def postings(docs: DataFrame, options: TokenOptions = DEFAULT, positions: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf), with the sorted positions on request. Keyed by term and document, so no term is one group.

    Counts are added up before the shuffle, and a filter on term reaches the occurrences. Positions would all go through
    it, so they are sorted and cut into runs inside a document's row, without a shuffle: there a document is one row.
    """
    if not positions:
        return occurrences(docs, options, key, text).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    pairs = F.sort_array(F.transform(tokens(F.col(text), options), lambda t, i: F.struct(t.alias("term"), i.cast("long").alias("pos"))))
    runs = _let(pairs, lambda s: _let(s["term"], lambda w: _let(s["pos"], lambda p: _runs(w, p))))
    return docs.select(F.col(key).alias("doc_id"), F.inline(runs)).select("term", "doc_id", "tf", "positions")


def all_postings(docs: DataFrame, options: TokenOptions = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """postings without positions, for jobs that take every term. Where no id repeats, which a job over the ids alone
    tells, words are counted inside their row: no shuffle, and no table of a task's words in memory. Else as postings."""
    if not docs.groupBy(key).count().filter("count > 1").isEmpty():
        return postings(docs, options, key=key, text=text)
    runs = _let(F.sort_array(tokens(F.col(text), options)), lambda w: _runs(w))
    return docs.select(F.col(key).alias("doc_id"), F.inline(runs)).select("term", "doc_id", "tf")


def distinct_terms(docs: DataFrame, options: TokenOptions = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, distinct_terms): how many different terms each document has, counted inside its row."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.size(F.array_distinct(tokens(F.col(text), options))), F.lit(0)).cast("long").alias("distinct_terms"))


def dictionary(posted: DataFrame) -> DataFrame:
    """(term, df, cf): documents that have the term, and occurrences."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def dictionary_stats(words: DataFrame) -> DataFrame:
    return words.agg(F.count("*").alias("terms"), F.coalesce(F.avg(F.octet_length("term")), F.lit(0.0)).alias("avg_term_len_bytes"))


def postings_lists(posted: DataFrame) -> DataFrame:
    """(term, docs): the export form, one sorted list per term. A list grows with the corpus; queries use postings."""
    return posted.groupBy("term").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))


#: Document ids of one term that a task takes together. Rare terms have a block for each posting where blocks are short.
BLOCK = 1 << 20


def _dealt(rows: DataFrame, order: str) -> DataFrame:
    """Rows with their block of the stated order, null last, dealt by term and block. Joins infer that a term isn't null;
    said here, all readers of the shuffle have the same filter."""
    return rows.filter("term IS NOT NULL").withColumn("_block", F.coalesce(F.floor(F.col(order) / BLOCK), F.lit((1 << 63) - 1))).repartition("term", "_block")


def _of_blocks(dealt: DataFrame, amount: Column) -> DataFrame:
    """(term, _block, _of): amount by term and block. Every column is asked for, so that Spark finds the same shuffle here
    and where the rows themselves are read, and makes it once."""
    rest = F.max(F.xxhash64(*[c for c in dealt.columns if c not in ("term", "_block")])).alias("_rest")
    return dealt.groupBy("term", "_block").agg(amount.alias("_of"), rest).filter("_rest IS NOT NULL").drop("_rest")


def _with_previous(posted: DataFrame) -> DataFrame:
    """Postings with _previous, the term's document before, null for the first.

    A frequent term is split into blocks of ids; the last id of the block before stands in for a block's first row.
    """
    dealt = _dealt(posted, "doc_id")
    before = F.lag("_of").over(Window.partitionBy("term").orderBy("_block"))
    ahead = _of_blocks(dealt, F.max("doc_id")).select("term", "_block", before.alias("_ahead")).filter("_ahead IS NOT NULL")
    inside = F.lag("doc_id").over(Window.partitionBy("term", "_block").orderBy(F.col("doc_id").asc_nulls_last()))
    joined = dealt.withColumn("_inside", inside).join(ahead.hint("merge"), ["term", "_block"], "left")
    return joined.select(*posted.columns, F.coalesce("_inside", "_ahead").alias("_previous"))


def _gap(previous: str = "_previous") -> Column:
    return F.col("doc_id") - F.coalesce(previous, F.lit(0))


def doc_gaps(posted: DataFrame) -> DataFrame:
    """Postings with doc_gap: the distance to the term's previous document, from 0 for the first."""
    return _with_previous(posted).select(*posted.columns, _gap().alias("doc_gap"))


def position_gaps(posted: DataFrame) -> DataFrame:
    """Postings with pos_gaps in place of positions: distances within a document, from 0 for the first."""
    p = F.col("positions")
    gaps = F.zip_with(p, F.concat(F.array(F.lit(0).cast("long")), F.slice(p, 1, F.size(p) - 1)), lambda a, b: a - b)
    return posted.withColumn("pos_gaps", gaps).drop("positions")


def undo_doc_gaps(gapped: DataFrame, order: str) -> DataFrame:
    """doc_id as the running sum of doc_gap in the stated order, whole numbers, within a term. A frequent term is summed in
    blocks of that order; the sums of the blocks before stand in for a block's start."""
    dealt = _dealt(gapped, order)
    before = F.sum("_of").over(Window.partitionBy("term").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ahead = _of_blocks(dealt, F.sum("doc_gap")).select("term", "_block", before.alias("_ahead")).filter("_ahead IS NOT NULL")
    inside = F.sum("doc_gap").over(Window.partitionBy("term", "_block").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.withColumn("_inside", inside).join(ahead.hint("merge"), ["term", "_block"], "left")
    return joined.select(*gapped.columns, F.when(F.col("doc_gap").isNotNull(), F.coalesce("_ahead", F.lit(0)) + F.col("_inside")).alias("doc_id"))


def packed(posted: DataFrame) -> DataFrame:
    """(term, doc_id, bytes): each posting's gap, count and position gaps in variable bytes. Takes positions."""
    gapped = position_gaps(doc_gaps(posted))
    return gapped.select("term", "doc_id", vbyte.encode_all(F.concat(F.array(F.col("doc_gap"), F.col("tf")), "pos_gaps")).alias("bytes"))


def _own_bytes() -> Column:
    """Bytes of a posting's count and position gaps: a byte each, where no position needs more."""
    p, start = F.col("positions"), F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    each = F.aggregate(p, start, lambda a, x: F.struct(x.alias("at"), (a["n"] + vbyte.length(x - a["at"])).alias("n")), lambda a: a["n"])
    return vbyte.length(F.col("tf")) + F.when(F.get(p, F.size(p) - 1) < 128, F.size(p)).when(F.size(p) == 1, vbyte.length(F.get(p, F.lit(0)))).otherwise(each)


def _sized(posted: DataFrame) -> DataFrame:
    """(term, doc_id, _own, _previous): positions are measured where they are, and only their bytes go on to the gaps."""
    return _with_previous(posted.select("term", "doc_id", _own_bytes().alias("_own")))


def _postings_bytes() -> Column:
    return F.coalesce(F.sum(F.col("_own") + vbyte.length(_gap())), F.lit(0)).alias("postings_bytes")


def packed_bytes(posted: DataFrame) -> DataFrame:
    """One row: postings_bytes, without packing anything."""
    return _sized(posted).agg(_postings_bytes())


def forward_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, url, title): empty where missing, the title falling back to the URL's."""
    have = set(docs.columns)
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in have else F.lit("")
    title = F.col("title") if "title" in have else F.lit(None).cast("string")
    return docs.select(F.col(key).alias("doc_id"), url.alias("url"), display_title(title, url).alias("title"))


# Bytes of the packed files' headers and records.
FORWARD_HEADER, FORWARD_RECORD, INVERTED_HEADER, INVERTED_RECORD, DOC_ID_BYTES = 20, 24, 40, 24, 4


def index_sizes(posted: DataFrame, forward: DataFrame) -> DataFrame:
    """One row: bytes of the packed forward index and of the inverted index with plain and with packed postings. One pass
    over the postings: a term counts at its first document."""
    first = F.col("_previous").isNull()
    words = _sized(posted).agg(F.count_if(first).alias("terms"), F.coalesce(F.sum(F.when(first, F.octet_length("term"))), F.lit(0)).alias("term_bytes"), F.count("*").alias("n"), _postings_bytes())
    heap = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("url") + F.octet_length("title")), F.lit(0)).alias("heap"))
    both = words.select("*", *[heap.select(c).scalar().alias(c) for c in heap.columns])
    head = F.lit(INVERTED_HEADER) + F.col("terms") * INVERTED_RECORD + F.col("term_bytes")
    return both.select((F.lit(FORWARD_HEADER) + F.col("docs") * FORWARD_RECORD + F.col("heap")).cast("long").alias("fwd_bytes"), (head + F.col("n") * DOC_ID_BYTES).cast("long").alias("inv1_bytes"), (head + F.col("postings_bytes")).cast("long").alias("inv2_bytes"))
