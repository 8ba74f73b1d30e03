import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions.text import DEFAULT, TokenOptions
from tessel.operators import boolean as B
from tessel.operators import postings as P
from tessel.operators import ranked as R

TEXTS = [(0, "a a b"), (1, "b"), (2, "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def posted(docs):
    return P.postings(docs).cache()


def rpn(text):
    return " ".join(t.text if t.kind == B.TERM else t.kind for t in B.to_rpn(B.lex(text)))


def test_rpn():
    assert rpn("python && java") == "python java AND"
    assert rpn("a OR b AND NOT c") == "a b c NOT AND OR"
    assert rpn("(a OR b) AND c") == "a b OR c AND"
    assert rpn("not not a") == "a NOT NOT"
    assert rpn("a or b or c") == "a b OR c OR"
    assert [t.text for t in B.lex("foo&bar|x")] == ["foo&bar|x"]
    for bad in ("(a", "a)"):
        with pytest.raises(B.QueryError, match="mismatched"):
            rpn(bad)


@pytest.mark.parametrize("bad", ["a b", "a AND", "", "()", "NOT", "&&"])
def test_arity(bad):
    with pytest.raises(B.QueryError):
        B.compile_query(bad)


@pytest.mark.parametrize("good", ["AND a b", "a b AND", "a NOT"])
def test_odd_but_well_formed(good):
    assert B.compile_query(good).terms


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize(("text", "hits"), [("a and b", [0]), ("a or c", [0, 2]), ("!a", [1, 2]), ("b && !a", [1]), ("not 123", [0, 1, 2]), ("123", []), ("a&b", [0]), ("zzz", [])])
def test_boolean(docs, posted, text, hits):
    assert ids(B.boolean_search(posted, docs, text)) == hits


def test_sets(spark):
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert ids(B.intersect(df(1, 3, 5), df(3, 4, 5))) == [3, 5]
    assert ids(B.union(df(1, 3, 5), df(3, 4, 5))) == [1, 3, 4, 5]
    assert ids(B.complement(df(1, 3, 5), df(*range(6)))) == [0, 2, 4]
    assert ids(B.page(df(*range(120)), 2)) == list(range(100, 120))
    assert ids(B.page(df(*range(3)), -1)) == [0, 1, 2]


tree = st.recursive(st.sampled_from("abcd"), lambda t: st.one_of(st.tuples(st.just("not"), t), st.tuples(st.sampled_from(["and", "or"]), t, t)), max_leaves=8)


def spell(t):
    return t if isinstance(t, str) else f"not ({spell(t[1])})" if t[0] == "not" else f"({spell(t[1])} {t[0]} {spell(t[2])})"


def holds(t, words):
    return t in words if isinstance(t, str) else not holds(t[1], words) if t[0] == "not" else (all if t[0] == "and" else any)([holds(t[1], words), holds(t[2], words)])


@settings(max_examples=300, deadline=None)
@given(tree)
def test_rpn_means_the_tree(t):
    for bits in range(16):
        words = {w for i, w in enumerate("abcd") if bits >> i & 1}
        got = B.fold_rpn(B.to_rpn(B.lex(spell(t))), lambda x: x in words, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)
        assert got == holds(t, words)


def best(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in R.top(df).collect()]


@pytest.mark.parametrize(("text", "expected"), [("a", [(0, 1.386294)]), ("a b", [(0, 1.673976), (1, 0.287682)]), ("a a", [(0, 2.772589)]), ("b && !a", [(1, 0.287682)]), ("!a", []), ("zzz", [])])
def test_ranked(docs, posted, text, expected):
    assert best(R.ranked_search(posted, docs, text)) == expected


def test_ranked_options(docs, posted):
    assert R.scoring_terms("b && !a and not c", DEFAULT, strict_terms=True) == ["b"]
    assert R.scoring_terms("b AND not a") == ["b", "and", "not", "a"]
    got = R.ranked_batch(posted, docs, [(1, "a"), (2, "b and not a"), (3, ""), (4, "(x")], 3, on_error="skip").orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in got] == [(1, 0, 1, 1.386294), (2, 1, 1, round(math.log(4 / 3), 6))]
    with pytest.raises(B.QueryError):
        R.ranked_batch(posted, docs, [(4, "(x")], 3)
    assert [r["hits"] for r in R.with_hits(R.ranked_search(posted, docs, "a b"), 1).collect()] == [2]


def test_shown(spark):
    df = spark.createDataFrame([(5.0,), (459.0312,), (0.1000001,)], "s double").select(R.shown(F.col("s")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["5", "459.031", "0.1"]


def test_postings(docs):
    full = P.postings(docs, positions=True)
    assert sorted((r["term"], r["doc_id"], r["tf"], r["positions"]) for r in full.collect()) == [("a", 0, 2, [0, 1]), ("b", 0, 1, [2]), ("b", 1, 1, [0]), ("c", 2, 1, [0])]
    coded = {(r["term"], r["doc_id"]): r["bytes"] for r in P.packed(full).collect()}
    assert coded[("a", 0)] == [128, 130, 128, 129] and coded[("b", 1)] == [129, 129, 128]
    assert P.packed_bytes(full).first()[0] == sum(map(len, coded.values()))
    sizes = P.index_sizes(full, P.forward_index(docs)).first()
    assert (sizes["fwd_bytes"], sizes["inv1_bytes"]) == (20 + 3 * 24, 40 + 3 * 24 + 3 + 4 * 4)
    assert P.index_sizes(full.limit(0), P.forward_index(docs.limit(0))).first()["inv2_bytes"] == 40


def test_gaps_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rows = spark.createDataFrame([("t", i, 1) for i in (0, 3, 4, 5, 17, 18, 40)], "term string, doc_id long, tf long")
    assert [r["doc_gap"] for r in P.doc_gaps(rows).orderBy("doc_id").collect()] == [0, 3, 1, 1, 12, 1, 22]


def test_options_reach_postings(spark):
    df = spark.createDataFrame([(7, "Машины x9 я")], "doc_id long, text string")
    assert {r["term"] for r in P.postings(df, TokenOptions(True, True, 2)).collect()} == {"машин", "x9"}
