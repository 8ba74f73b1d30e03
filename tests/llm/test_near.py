"""Fingerprints, SimHash groups and line chunks against brute force."""

import hashlib
import itertools
import os
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import gray_simhash as G
from tessel.llm import line_chunks as L
from tessel.llm import order_minhash as M
from tessel.llm import queries
from tessel.llm.curriculum import training_stream
from tessel.llm.components import connected
from tests.llm.conftest import multiset


def plain_sketch_element(text):
    """Occurrence-numbered k-mers, the slow way."""
    seen = Counter()
    out = []
    for i in range(max(1, len(text) - M.K + 1)):
        kmer = text[i : i + M.K]
        out.append((kmer, seen[kmer]))
        seen[kmer] += 1
    return out


def test_occurrences():
    for text in ("abcabcabcabcabcabcabcabcabcabc", "x" * 50, "the quick brown fox"):
        h = M._kmer_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), M.K)
        assert M._occurrences(h).tolist() == [n for _, n in plain_sketch_element(text)]
        assert len(set(h.tolist())) == len({k for k, _ in plain_sketch_element(text)})


def test_sketch_properties():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    text = " ".join(words)
    s = M.sketch(text)
    assert (s == M.sketch(text)).all() and len(M.to_hex(s)) == 4 * M.SKETCH
    near = [M.likeness(s, M.sketch(" ".join(words[: 400 - cut] + ["zz"] * cut))) for cut in (0, 20, 100, 300)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.7
    # The same words in another order share sets of k-mers, not their order.
    halves = " ".join(words[200:] + words[:200])
    assert M.likeness(s, M.sketch(halves)) < 0.75 < M.likeness(s, M.sketch(text + "!"))
    for t in ("", "a", "ab", "abcdefghijk", "a" * 500, "short text of some words"):
        assert M.likeness(M.sketch(t), M.sketch(t)) == 1
    assert M.likeness(M.sketch("a"), M.sketch("b")) == 0


def test_edited(docs, empty, fixture_rows):
    for width in (1, 2, 7, 50):
        got = multiset(M.edited_fingerprints(docs, width), "doc_id", "n_chars", "edited_sha256")
        order = sorted(((i, t or "") for i, t, *_ in fixture_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
        expected = []
        for n, (i, t) in enumerate(order):
            after = order[(n + 1) % len(order)][1]
            half = len(t) // 2
            expected.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
        assert got == sorted(expected, key=repr)
    # Fingerprints and likenesses of the query, by the operator's own signature of each text, and by that of texts alone.
    sign = lambda t: [M.to_hex(M.sketch(t))[i : i + 4] for i in range(0, 4 * M.SKETCH, 4)]
    alike = lambda a, b: sum(x == y for x, y in zip(a, b)) / M.SKETCH
    rows = []
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        own, edited, following = sign(t), sign(t[: len(t) - len(t) // 2] + after[: len(t) // 2]), sign(after)
        rows.append((i, "".join(own), "".join(edited), alike(own, edited), alike(own, following)))
    assert multiset(M.edited_fingerprints(docs, 3), "doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == sorted(rows, key=repr)
    assert multiset(M.fingerprints(docs), "doc_id", "fingerprint") == sorted(((i, "".join(sign(t))) for i, t in order), key=repr)
    assert M.edited_fingerprints(empty).count() == 0
    alone = M.edited_fingerprints(docs.filter("doc_id = 5")).first()
    assert alone["near_next"] == 1.0


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(codes):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(codes)), 2):
        if (codes[a] ^ codes[b]).bit_count() <= G.DISTANCE:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(codes))]


def family(seed, families=12, each=30, loose=200):
    rng = np.random.default_rng(seed)
    out = []
    for base in rng.integers(0, 1 << 63, families, dtype=np.uint64):
        for _ in range(each):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(k)
            out.append(x)
    return sorted({*out, *map(int, rng.integers(0, 1 << 63, loose))})


def test_index_finds_the_same_groups():
    codes = family(1)
    truth = groups(codes)
    c = np.array(codes, np.uint64)
    rank = c.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    order = np.argsort(rank)
    u, v = G.GrayIndex(c[order]).links()
    label = np.arange(len(c))
    a, b = G.forest(u, v)
    label[a] = b
    back = np.empty(len(c), int)
    back[order] = label
    named = {}
    assert [named.setdefault(int(x), i) for i, x in enumerate(back)] == [truth.index(t) for t in truth]


@pytest.mark.parametrize("hot", [20_000, 5])
def test_links(spark, monkeypatch, hot):
    monkeypatch.setattr(G, "HOT", hot)
    codes = family(2, 4, 20, 60)
    signed = [x - (1 << 64) if x >> 63 else x for x in codes]
    found = connected(G.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    root = {r["node"]: r["root"] for r in found}
    truth = groups(codes)
    mine = [root.get(x, x) for x in signed]
    assert len(set(zip(mine, truth))) == len(set(mine)) == len(set(truth))


def in_gray_order(codes):
    """mask, lead, rank of every code in every table, in the tables' order."""
    code = np.repeat(np.array(codes, np.uint64), len(G.block_masks()))
    mask = np.tile(np.array(G.block_masks(), np.uint64), len(codes))

    def rank(x):
        for s in (1, 2, 4, 8, 16, 32):
            x = x ^ (x >> np.uint64(s))
        return (x ^ np.uint64(1 << 63)).view(np.int64)

    lead, whole = rank(code & mask), rank(code)
    order = np.lexsort((whole, lead, mask.view(np.int64)))
    return mask[order].view(np.int64), whole[order]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_every_link_comes_from_the_hierarchy(monkeypatch):
    """All fingerprints of a driver table: the searches alone give the groups of brute force, with far fewer comparisons."""
    import pyarrow.parquet as pq

    made = []
    index = G.GrayIndex
    monkeypatch.setattr(G, "GrayIndex", lambda *a: made.append(index(*a)) or made[-1])
    codes = sorted({G.fingerprint(t) for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()})
    u, v = G.linked(*in_gray_order(codes))
    n, at = len(codes), {x: i for i, x in enumerate(codes)}
    a, b = (np.array([at[int(x)] for x in side.view(np.uint64)]) for side in (u, v))
    label = np.arange(n)
    child, root = G.forest(a, b)
    label[child] = root
    c = np.array(codes, np.uint64)
    near = np.bitwise_count(c[:, None] ^ c[None, :]) <= G.DISTANCE
    truth = np.arange(n)
    child, root = G.forest(*np.nonzero(np.triu(near, 1)))
    truth[child] = root
    assert (label == truth).all() and (truth != np.arange(n)).any()
    assert sum(len(x.codes) for x in made) == 15 * n and sum(x.searches for x in made) >= 15 * (n - 1)
    assert sum(x.compared for x in made) < 15 * n * n / 2 / 8


@pytest.mark.parametrize("leading", [0, G.block_masks()[3]])
def test_search_of_dense_groups(monkeypatch, leading):
    """Groups that fill the steps of a search, which then takes fewer searchers at a time."""
    monkeypatch.setattr(G, "LOOKED_AT", 200)
    codes = family(3, 3, 150, 20)
    _, rank = in_gray_order(codes)
    c = np.array(codes, np.uint64)
    rank = c & np.uint64(leading or (1 << 64) - 1)
    whole = c.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank, whole = rank ^ (rank >> np.uint64(s)), whole ^ (whole >> np.uint64(s))
    c = c[np.lexsort((whole, rank))]
    u, v = G.GrayIndex(c, leading).links()
    apart = c[:, None] ^ c[None, :]
    pairs = np.nonzero(np.triu((np.bitwise_count(apart) <= G.DISTANCE) & (apart & np.uint64(leading) == 0), 1))
    mine, truth = np.arange(len(c)), np.arange(len(c))
    for label, (x, y) in ((mine, (u, v)), (truth, pairs)):
        child, root = G.forest(x, y)
        label[child] = root
    assert (mine == truth).all() and len(set(truth.tolist())) < len(c) * 0.7


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (41, 40), (200, 150)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(42)}, **{i: 100 for i in range(100, 160)}, 200: 100}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(docs, empty, fixture_rows):
    codes = [simhash(t) for _, t, *_ in fixture_rows]
    label = groups(codes)
    least = {g: min((i for (i, *_), x in zip(fixture_rows, label) if x == g and i is not None), default=None) for g in set(label)}
    expected = sorted(((i, f"{c:016x}", least[g]) for (i, *_), c, g in zip(fixture_rows, codes, label)), key=repr)
    assert multiset(G.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert G.near_duplicates(empty).count() == 0
    kept = G.keep_one(docs)
    assert kept.columns == docs.columns and multiset(kept, "doc_id") == sorted({(i,) for i in least.values()}, key=repr)
    assert G.fingerprint(None) == G.fingerprint(" \n") == 0


def as_signed(x):
    return x - (1 << 64) if x >> 63 else x


def cut_lines(text):
    parts = text.split("\n")
    text_hash = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    roll = lambda v, seed: xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    hit = lambda i: i >= 2 and as_signed(roll(text_hash[i - 1], roll(text_hash[i - 2], 42))) % L.SPACING == 0
    edges = [0, *[i for i in range(1, len(parts) - 1) if hit(i) and not hit(i - 1)], len(parts)]
    return [("\n".join(parts[a:b]), b - a) for a, b in itertools.pairwise(edges)]


def test_chunks_are_cut_by_content(spark):
    lines = [f"line number {i} of the shared passage" for i in range(60)]
    texts = ["\n".join(lines), "\n".join(["one more line", *lines]), "\n".join(lines[5:]), "one line", "", "a\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.chunks(F.col("t")).alias("c")).orderBy("i").collect()
    plain = [[(hashlib.sha256(b.encode()).digest(), n) for b, n in cut_lines(t) if n >= 2] for t in texts]
    assert [[(bytes(c["h"]), c["lines"]) for c in r["c"]] for r in rows] == plain
    first = set(plain[0])
    assert len(first) > 6 and all(len(first & set(p)) >= len(first) - 3 for p in plain[1:3])


def plain_going(many):
    """For each (key, parts of a text in order): which parts stand in a smaller key, or earlier among themselves."""
    times = Counter(p for _, x in many for p in x)
    owner = {}
    for i, x in sorted(((i, x) for i, x in many if i is not None), key=lambda r: r[0]):
        for p in x:
            owner.setdefault(p, i)
    return [[times[p] > 1 and p in owner and (owner[p] != i or p in x[:at]) for at, p in enumerate(x)] for i, x in many]


def plain_passages(rows):
    """(key, text, runs, lines) after removal: by chunks, and where a text doesn't go whole by pairs of lines."""
    there = [(i, t) for i, t in rows if t is not None]
    # Single lines are no chunks: each is made a part of its own.
    cut = [(i, [b if n >= 2 else (n_th, b) for n_th, (b, n) in enumerate(cut_lines(t))]) for i, t in there]
    by_chunk = [[g and isinstance(p, str) for g, p in zip(gone, x)] for gone, (_, x) in zip(plain_going(cut), cut)]
    whole = [all(g) for g in by_chunk]
    left = [(i, list(itertools.pairwise(t.split("\n")))) for (i, t), w in zip(there, whole) if not w]
    by_pair = iter(plain_going(left))
    judged = iter([(list(range(t.count("\n") + 1)) if w else sorted({at + d for at, g in enumerate(next(by_pair)) if g for d in (0, 1)})) for (_, t), w in zip(there, whole)])
    out = []
    for i, t in rows:
        goes = set(next(judged)) if t is not None else set()
        kept = "\n".join(s for at, s in enumerate((t or "").split("\n")) if at not in goes)
        out.append((i, None if t is None else kept, sum(at - 1 not in goes for at in goes), len(goes)))
    return out


def shared_runs():
    """Documents of ten lines of their own; later ones also have a run of 2 to 6 lines from inside an earlier one."""
    rows = [(i, [f"own line {j} of document {i}" for j in range(10)]) for i in range(40)]
    for i in range(10, 40):
        n, at = 2 + i % 5, i % 4 + 1
        rows[i][1][at + 2 : at + 2] = rows[i - 10][1][at : at + n] if i < 20 else [f"own line {j} of document {i % 10}" for j in range(at, at + n)]
    return [(i, "\n".join(x)) for i, x in rows]


def test_every_shared_run_goes(spark, tmp_path):
    rows = shared_runs()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_line_chunks"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        own = "\n".join(x for x in t.split("\n") if x.endswith(f"document {i}"))
        assert (got[i]["text"], got[i]["n_chars"], got[i]["removed_lines"]) == (own, len(own), t.count("\n") - own.count("\n")), i
        assert got[i]["removed_chunks"] == (i >= 10)
    assert multiset(corpus_pipeline.lines(spark, df, ""), "doc_id", "text") == sorted(((i, r["text"]) for i, r in got.items()), key=repr)


def test_passages(spark, docs, empty, fixture_rows):
    got = L.remove_passages(docs)
    expected = plain_passages([r[:2] for r in fixture_rows])
    assert multiset(got, "doc_id", "text", "removed_chunks", "removed_lines") == sorted(expected, key=repr)
    assert got.columns == [*docs.columns, "removed_chunks", "removed_lines"] and L.remove_passages(empty).count() == 0
    assert got.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    # Few different lines, blank ones among them, in repeated keys and without key: runs overlap and repeat in a text.
    rng = np.random.default_rng(5)
    rows = [(None if k == 9 else int(k), "\n".join("" if x == 7 else f"line {x}" for x in rng.integers(0, 9, rng.integers(1, 14)))) for k in rng.integers(0, 10, 40)] + [(11, None), (None, None), (12, "")]
    got = L.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert multiset(got, "doc_id", "text", "removed_chunks", "removed_lines") == sorted(plain_passages(rows), key=repr)
    # Each line that stands in a row with a key still stands in one.
    left = {x for i, t, *_ in plain_passages(rows) if i is not None and t for x in t.split("\n")}
    assert {x for i, t in rows if i is not None and t for x in t.split("\n") if x} <= left


INNER = ["_id", "_k", "_has", "_done", "_whole", "_row", "_bits", "_mark", "_touched", "_part", "stays", "goes", "at", "h", "n", "t", "c0", "c1", "k", "fp", "key", "ident", "order", "theirs", "mine", "positions", "size", "slot", "mark", "removed_chunks", "removed_lines", "least", "root"]


def test_names_clash_with_nothing(spark, docs, empty):
    """Every name that the stages use inside, as a column of the input: nothing crashes, and nothing is written over."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(25)
    odd = plain.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in INNER]).cache()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, "")
        if name != "encoding":
            assert got.columns == odd.columns, name
            for r in got.collect():
                assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in INNER), name
        expected = stage(spark, plain, "")
        assert multiset(got, "doc_id", "source") == multiset(expected, "doc_id", "source"), name
    assert L.remove_passages(odd).columns == [c for c in odd.columns if not c.startswith("removed")] + ["removed_chunks", "removed_lines"]


def test_nothing_is_lost_without_keys(spark):
    """Null keys with unlike texts, a key that repeats with unlike texts, and the key none beside a null one."""
    text = lambda n: "\n".join(f"line {n} {j} of words" for j in range(6))
    rows = [*[(None, text(n), "s") for n in range(6)], ("none", text(6), "s"), ("7", text(7), "s"), ("7", text(8), None), ("none", text(9), "s")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string").withColumn("lang", F.lit("en"))
    assert multiset(L.remove_passages(df, counts=False), "doc_id", "text", "source") == sorted(rows, key=repr)
    assert multiset(G.keep_one(df), "doc_id", "text", "source") == sorted(rows, key=repr)
    taken = {r["text"]: r for r in training_stream(df).collect()}
    assert set(taken) <= {t for _, t, _ in rows} and all((r["doc_id"], t, r["source"]) in rows for t, r in taken.items())
    assert len(taken) >= 9


def test_every_component_keeps_a_row(spark):
    text = lambda n: " ".join(f"word{n}x{j}" for j in range(40))
    # Texts without key, a key with two texts one of which is another document's, and rows that are equal throughout.
    rows = [(None, text(0), "a"), (None, text(1), "a"), (None, text(1), "b"), (None, text(2), "a"), (1, text(3), "a"), (2, text(3), "a"), (2, text(4), "a"), (5, text(5), "a"), (5, text(5), "a"), (6, None, "a"), (None, "", "a"), (7, text(2), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    label = groups([simhash(t) for _, t, _ in rows])
    least = {}
    for (i, *_), g in zip(rows, label):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    got = G.keep_one(df.repartition(5)).collect()
    component = {t: g for (_, t, _), g in zip(rows, label)}
    assert sorted(component[r["text"]] for r in got) == sorted(least)
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == least[component[r["text"]]] and tuple(r) in rows for r in got)
    assert multiset(G.keep_one(df.coalesce(1)), *df.columns) == sorted(map(tuple, got), key=repr)
