import bz2

import pytest
from pyspark.sql import functions as F

from tessel.config import Config
from tessel.functions.text import query_terms
from tessel.operators import ingest as I
from tessel.operators import ordering as O
from tessel.operators import postings as P
from tessel.operators import stats as S
from tessel.sources import packed_files as K
from tessel.sources import storage
from tessel.sources import tables as T
from tessel.sources.storage import spread
from tessel.streaming import ingest as N


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, "b a b"), (1, "a ёж"), (2, None), (3, "c 1")], "doc_id long, text string").cache()


def test_stats(docs):
    row = S.corpus_stats(docs).first()
    assert (row["docs"], row["bytes_in"], row["tokens"], row["token_chars"]) == (3, 5 + 6 + 3, 6, 7)
    assert S.corpus_stats(docs.limit(0)).first()["avg_token_len"] == 0.0
    freq = S.term_freq(docs)
    ranked = [(r["rank"], r["term"], r["freq"]) for r in S.ranked_terms(freq).orderBy("rank").collect()]
    assert ranked == [(1, "a", 2), (2, "b", 2), (3, "c", 1), (4, "еж", 1)]
    assert [tuple(r) for r in S.top_terms(freq, 0).collect()] == [(1, "a", 2)]
    assert [round(r["zipf_pred"], 3) for r in S.zipf(freq).orderBy("rank").collect()] == [2.0, 1.0, 0.667, 0.5]
    assert S.unique_terms(docs).first()[0] == 4


def test_limits(docs, monkeypatch):
    monkeypatch.setattr(O, "STRIDE", 2)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(S.limit_docs(docs, 0)) == [0] and ids(S.limit_docs(docs, 2)) == [0, 1] and ids(S.limit_docs(docs, -1)) == [0, 1, 3]
    monkeypatch.setattr(S, "SHORT_LIMIT", 0)
    assert ids(S.limit_docs(docs, 2)) == [0, 1]
    assert ids(S.limit_bytes(docs, 5)) == [0] and ids(S.limit_bytes(docs, 6)) == [0, 1] and ids(S.limit_bytes(docs, 0)) == [0] and ids(S.limit_bytes(docs, -1)) == [0, 1, 3]


PAGE = '<page><title>{}</title><ns>0</ns><id>{}</id>{}<revision><id>1</id><timestamp>2020-01-01T00:00:00Z</timestamp><text>{}</text></revision></page>'


def test_dumps(spark, tmp_path):
    long = "Слово " * 30
    body = PAGE.format("Дед Мороз", 1, "", long) + PAGE.format("R", 2, '<redirect title="X"/>', long) + PAGE.format("Шаблон:Q", 3, "", long) + PAGE.format("Short", 4, "", "мало")
    path = tmp_path / "w.xml.bz2"
    path.write_bytes(bz2.compress(f'<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">{body}</mediawiki>'.encode()))
    pages = T.read_pages(spark, str(path))
    got = I.extract_wiki(pages).collect()
    assert [(r["external_id"], r["title"], r["meta"]["url"]) for r in got] == [("1", "Дед Мороз", "https://ru.wikipedia.org/wiki/Дед_Мороз")]
    raw = I.crawl_wiki(pages, 5.0).first()
    assert raw["url"].endswith("/%D0%94%D0%B5%D0%B4_%D0%9C%D0%BE%D1%80%D0%BE%D0%B7") and raw["clean_len"] == len(long.strip())
    rows = tmp_path / "p.xml"
    rows.write_text(f'<posts><row Id="1" PostTypeId="1" Title="T" Body="&lt;p&gt;{long}&lt;/p&gt;" Score="3" ViewCount="9" Tags="&lt;a&gt;"/><row Id="2" PostTypeId="2" Body="{long}"/><row Id="3" PostTypeId="1" Body="&lt;p&gt;Short&lt;/p&gt;"/></posts>', encoding="utf-8")
    posts = T.read_posts(spark, str(rows))
    got = I.extract_posts(posts).collect()
    assert [(r["external_id"], r["text"][:5], r["meta"]["score"], r["meta"]["tags"]) for r in got] == [("1", "T. Сл", 3, "<a>")]
    assert [r["source"] for r in I.crawl_posts(posts, 1.0).collect()] == ["stackoverflow"]
    T.write_documents(I.extract_wiki(pages), str(tmp_path / "out"))
    assert T.read_documents(spark, str(tmp_path / "out")).first()["meta"]["language"] == "ru"


def test_store(spark):
    rows = spark.createDataFrame([("u", "1"), ("u", "1"), ("v", "2")], "url string, raw_html string")
    assert I.new_rows(rows, rows.limit(0)).count() == 2 and I.new_rows(rows, rows.filter("url = 'u'")).count() == 1
    day = 86_400.0
    stored = spark.createDataFrame([("u", "x", 0.0), ("v", "y", 9 * day), ("w", "z", None)], "url string, raw_html string, last_crawled_at double")
    assert I.mode(stored.limit(0), 0, 1) == "seed" and I.mode(stored, 10 * day, 1.5) == "recrawl" and I.mode(stored.filter("url <> 'u'"), 10 * day, 1.5) is None
    assert {r["url"] for r in I.stale(stored, day, missing=True).collect()} == {"u", "w"}
    fetched = spark.createDataFrame([("u", "x2"), ("v", "y"), ("w", None)], "url string, body string")
    got = {r["url"]: (r["raw_html"], r["last_crawled_at"]) for r in I.changed(stored, fetched, 7.0).collect()}
    assert got == {"u": ("x2", 7.0), "v": ("y", 9 * day), "w": ("z", None)}


def test_runs(spark, tmp_path):
    rows = spark.createDataFrame([("u", "1"), ("u", "0"), ("v", "2"), (None, "3")], "url string, raw_html string")
    assert {r["raw_html"] for r in I.new_rows(rows.filter("url IS NOT NULL"), rows.limit(0), order="raw_html").collect()} == {"0", "2"}
    assert [tuple(r) for r in I.uniqueness(rows, "url", "raw_html").collect()] == [("url", 4, 1, 1), ("raw_html", 4, 0, 0)]
    assert I.require_unique(rows, "raw_html") is rows
    with pytest.raises(ValueError, match="not unique: url"):
        I.require_unique(rows, "raw_html", "url")
    counted, told = I.observed(rows, "run", inserted=F.col("url") == "u", failed=F.col("url").isNull())
    counted.write.parquet(f"{tmp_path}/out")
    assert told.get == {"processed": 4, "inserted": 2, "failed": 1}
    assert {r["url"] for r in I.from_sources(rows, {"u": True, "v": False}, "url").collect()} == {"u"}
    assert I.from_sources(rows, {}, "url").count() == 0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"sources": {"a": true}, "most_per_run": 5}')
    (tmp_path / "c.yaml").write_text("sources: {a: true}\nmost_per_run: 5\n")
    told = Config.read(f"{tmp_path}/c.json", {"TESSEL_MOST_PER_RUN": "7", "TESSEL_STORE": "s3://x"})
    assert told == Config(store="s3://x", sources={"a": True}, most_per_run=7) and Config.of({}, {}) == Config()
    for bad in ({"odd": 1}, {"save_every": -1}):
        with pytest.raises(ValueError, match="unknown|negative"):
            Config.of(bad, {})
    pytest.importorskip("yaml")
    assert Config.read(f"{tmp_path}/c.yaml", {}) == Config(sources={"a": True}, most_per_run=5)


def test_reports_and_queries(spark, tmp_path):
    T.write_report(spark.createDataFrame([('a,"b"', 1)], "term string, freq int").coalesce(1), str(tmp_path / "r"))
    assert [p.read_text() for p in (tmp_path / "r").glob("*.csv")] == ['term,freq\n"a,""b""",1\n']
    (tmp_path / "q.txt").write_text("one\n\ntwo three\n")
    assert [tuple(r) for r in T.read_queries(spark, str(tmp_path / "q.txt")).collect()] == [(0, "one"), (2, "two three")]


def test_index(spark, docs, tmp_path):
    index = T.Index.build(docs, str(tmp_path / "i"))
    index.check()
    assert index.n_docs == 3 and index.dictionary.filter("term = 'b'").first()["cf"] == 2
    posted = P.postings(docs, positions=True)
    dense = spark.createDataFrame([(0, "u", "T"), (1, "", "ы"), (2, "w", "")], "doc_id long, url string, title string")
    K.write_forward(dense, str(tmp_path / "f"))
    forward = K.PackedForward(str(tmp_path / "f"))
    assert [forward.get(i) for i in range(3)] == [("u", "T"), ("", "ы"), ("w", "")]
    K.write_plain(posted, 4, str(tmp_path / "p"))
    K.write_packed(posted, 4, str(tmp_path / "k"))
    assert K.PackedInverted(str(tmp_path / "p")).get("a") == [(0, 1, []), (1, 1, [])]
    packed = K.PackedInverted(str(tmp_path / "k"))
    assert packed.get("b") == [(0, 2, [0, 2])] and packed.get("еж") == [(1, 1, [1])] and packed.get("zz") == [] and packed.terms == 4
    with pytest.raises(ValueError):
        K.PackedForward(str(tmp_path / "k"))


def test_stream(spark, tmp_path):
    schema = spark.createDataFrame([("", "", "")], "url string, raw_html string, clean_text string").schema
    for i, urls in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(u, f"<{u}>", u) for u in urls], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = N.read_stream(spark, str(tmp_path / "in"), schema)
        N.ingest_once(stream, str(tmp_path / "raw"), str(tmp_path / "clean"), str(tmp_path / "ck")).awaitTermination()
        got = sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "raw")).collect())
        assert got == (["a", "b"] if i == 0 else ["a", "b", "c"])
    assert spark.read.parquet(str(tmp_path / "clean")).columns == ["url", "clean_text"]
    unique = N.unique_stream(N.read_stream(spark, str(tmp_path / "in"), schema))
    unique.writeStream.format("memory").queryName("uniq").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("uniq").agg(F.count("*")).first()[0] == 3


def test_positions_inside_rows(spark):
    """Nulls, empty texts, texts without words, repeats and a long text, against a plain loop."""
    texts = [None, "", "  12 ", "b a b", "A a-a a", "word " * 30_000 + "end word", "b a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {}
    for i, text in enumerate(texts):
        for at, term in enumerate(query_terms(text or "")):
            expected.setdefault((term, i), []).append(at)
    got = P.postings(docs, positions=True)
    assert {(r["term"], r["doc_id"]): r["positions"] for r in got.collect()} == expected
    assert got.count() == len(expected)
    assert sorted(got.drop("positions").collect()) == sorted(P.postings(docs).collect())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert P.postings(docs.limit(0), positions=True).isEmpty()


def test_small_tables_are_dealt_and_large_ones_stay(spark, monkeypatch):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in spread(one).collect()) == list(range(100))
    monkeypatch.setattr(storage, "SPREAD_BYTES", 1)
    assert spread(one).rdd.getNumPartitions() == 1


def test_repeated_fetches_of_a_key_agree(spark):
    stored = spark.createDataFrame([("u", "b", 1.0), ("v", "b", 1.0), ("w", "b", 1.0)], "url string, raw_html string, last_crawled_at double")
    fetched = spark.createDataFrame([("u", None), ("u", "d"), ("u", "c"), ("v", None), ("w", "b")], "url string, body string")
    for rows in (fetched, fetched.orderBy(F.col("body").desc_nulls_first())):
        after = {r["url"]: (r["raw_html"], r["last_crawled_at"]) for r in I.changed(stored, rows, 2.0).collect()}
        assert after == {"u": ("c", 2.0), "v": ("b", 1.0), "w": ("b", 1.0)}
        assert I.change_counts(stored, rows).first().asDict() == {"processed": 3, "updated": 1, "unchanged": 1, "failed": 1}
