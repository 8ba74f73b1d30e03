"""What whole-index queries cost by their plans, and their results on odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as X
from tessel.functions import vbyte
from tessel.functions.text import TokenOptions
from tessel.operators import postings as P
from tessel.operators import ranked as R

ROWS = [(0, "b a b"), (1, "a ёж a-b"), (2, None), (3, ""), (4, "1 !"), (9, "a " * 200 + "b"), (None, "a z")]


@pytest.fixture
def plan_of(spark):
    """The physical plan before adaptive execution, with the shuffles that it makes once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def counted(rows):
    return sorted(((t, i, n) for (t, i), n in Counter((t, i) for i, x in rows for t in X.query_terms(x or "")).items()), key=repr)


def test_words_are_counted_inside_rows_or_added_up_where_ids_repeat(spark, docs, plan_of):
    once = P.all_postings(docs)
    assert sorted(map(tuple, once.collect()), key=repr) == counted(ROWS)
    assert "Exchange" not in plan_of(once) and "HashAggregate" not in plan_of(once)
    again = ROWS + [(0, "b c")]
    got = P.all_postings(spark.createDataFrame(again, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == counted(again)
    assert P.all_postings(docs.limit(0)).collect() == []
    stemmed = P.all_postings(spark.createDataFrame([(7, "Машины машина x9 я")], "doc_id long, text string"), TokenOptions(True, True, 2))
    assert sorted(map(tuple, stemmed.collect())) == [("x9", 7, 1), ("машин", 7, 2)]


def gaps(posted):
    out, last = {}, {}
    for t, i in sorted(posted, key=lambda r: (r[0], r[1] is None, r[1] or 0)):
        out[t, i] = None if i is None else i - last.get(t, 0)
        last[t] = i
    return out


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_gaps_read_one_shuffle_and_keep_rows_without_id(docs, plan_of, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    gapped = P.doc_gaps(P.all_postings(docs))
    assert {(r["term"], r["doc_id"]): r["doc_gap"] for r in gapped.collect()} == gaps([(t, i) for t, i, _ in counted(ROWS)])
    assert plan_of(gapped).count("ReusedExchange") == 1


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_decoding_reads_each_shuffle_once(docs, plan_of, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    gapped = P.doc_gaps(P.all_postings(docs).select("term", "doc_id")).withColumnRenamed("doc_id", "place")
    back = P.undo_doc_gaps(gapped, "place")
    assert all(r["doc_id"] == r["place"] for r in back.collect()) and back.count() == len(counted(ROWS))
    assert plan_of(back.select("term", "doc_id")).count("ReusedExchange") == 2


def size_of(n):
    return 5 if n is None else next((k for k in range(1, 5) if n < 1 << 7 * k), 5)


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_sizes_take_one_pass_over_the_texts(spark, plan_of, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(3)
    rows = ROWS + [(i * i * 700, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(n))) for i, n in enumerate((90, 128, 129, 400, 20_000), 4)]
    rows.append((5, "once " + "a " * 16_500 + "twice " + "a " * 200 + "twice once"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = defaultdict(list)
    for i, x in rows:
        for at, t in enumerate(X.query_terms(x or "")):
            places[t, i].append(at)
    far = gaps(places)
    want = sum(size_of(far[k]) + size_of(len(p)) + sum(size_of(b - a) for a, b in zip([0] + p, p)) for k, p in places.items())
    posted = P.postings(docs, positions=True)
    sized, both = P.packed_bytes(posted), P.index_sizes(posted, P.forward_index(docs))
    assert sized.first()[0] == want
    terms = {t for t, _ in places}
    head = 40 + 24 * len(terms) + sum(len(t.encode()) for t in terms)
    assert tuple(both.first()) == (20 + 24 * len(rows), head + 4 * len(places), head + want)
    for df in (sized, both):
        plan = plan_of(df)
        assert plan.count("ReusedExchange") == 1 and "postings-" not in plan


def test_scores_of_dealt_documents_add_up_in_place(spark, plan_of):
    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 3)) for i in range(40)] + [(50, "z")], "doc_id long, text string").repartition("doc_id")
    got = R.ranked_batch(P.all_postings(docs), docs, [(1, "a b c"), (2, "c c z"), (3, "and or")], 41, n=15, on_error="skip")
    ranks = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r["qid"], r["rank"])):
        ranks[r["qid"]].append(r["doc_id"])
    assert ranks == {1: [i for i in range(40) if i % 3 == 2] + [1, 4], 2: [50] + [i for i in range(40) if i % 3 == 2] + [1]}
    plan = plan_of(got)
    assert re.search(r"hashpartitioning\(qid#\d+L, \d+\)", plan) and not re.search(r"hashpartitioning\(qid#\d+L, doc_id", plan)
    assert "collect_list" not in plan


def test_ranks_compare_nine_digits(spark):
    hits = spark.createDataFrame([(1, 0.3), (0, 0.1 + 0.2), (2, 0.3 + 1e-8)], "doc_id long, score double")
    assert [r["doc_id"] for r in R.top(hits).collect()] == [2, 0, 1]
    assert [r["doc_id"] for r in R.top(hits.withColumn("score", F.when(F.col("doc_id") == 0, 0.3).otherwise(0.1 + F.lit(0.2)))).collect()] == [0, 1, 2]


def coded(n):
    """The bytes that the reference's coder puts out."""
    out = []
    while n >= 128:
        out.append(n & 127)
        n >>= 7
    return out + [n | 128]


def test_numbers_of_five_bytes(spark):
    numbers = [(1 << 28) - 1, 1 << 28, 310_799_741, (1 << 32) - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", vbyte.encode(F.col("n")).alias("b")).withColumn("d", vbyte.decode_all(F.col("b"))[0]).collect()
    assert all(r["b"] == coded(r["n"]) and max(r["b"]) < 256 and r["d"] == r["n"] for r in got)


def test_entities_without_their_semicolon_are_decoded():
    assert X.html_text("<title>the&amp;&amp;&amp</title><p>b &quot c &am d</p>") == 'the&&& b " c &am d'
