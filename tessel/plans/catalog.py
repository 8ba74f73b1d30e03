"""Registered queries of the retrieval engine, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.config import Config
from tessel.functions import text as X
from tessel.functions import vbyte
from tessel.functions.text import TokenOptions
from tessel.operators import boolean as B
from tessel.operators import ingest as I
from tessel.operators import postings as P
from tessel.operators import ranked as R
from tessel.operators import stats as S
from tessel.sources.storage import new_place, spread
from tessel.streaming.ingest import ingest_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _tokens(column: str = "text", pattern: str = X.WORDS) -> str:
    return f"regexp_extract_all(translate({column}, '{X.FOLD_FROM}', '{X.FOLD_TO}'), '{pattern}')"


_WORDS = f"words AS (SELECT doc_id, unnest({_tokens()}) AS term FROM documents)"
_POSTED = f"{_WORDS}, posted AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY ALL)"
_PLACED = f"lists AS (SELECT doc_id, {_tokens()} AS l FROM documents), placed AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM lists)"
_FREQ = f"{_WORDS}, freq AS (SELECT term, count(*) AS freq FROM words GROUP BY term)"
_STEM_SQL = X.STEM
NUMBERS, STEMMED, LONG = TokenOptions(keep_numbers=True), TokenOptions(stem=True), TokenOptions(min_len=3)


def _stats_sql(pattern: str) -> str:
    return f"WITH t AS (SELECT text, {_tokens(pattern=pattern)} AS l FROM documents WHERE text IS NOT NULL) SELECT count(*)::BIGINT AS docs, sum(strlen(text))::BIGINT AS bytes_in, sum(len(l))::BIGINT AS tokens, sum(length(array_to_string(l, '')))::BIGINT AS token_chars, sum(length(array_to_string(l, '')))::DOUBLE / sum(len(l))::DOUBLE AS avg_token_len FROM t"


@query(_stats_sql(X.WORDS))
def corpus_stats(spark, d):
    return S.corpus_stats(documents(spark, d))


@query(_stats_sql(X.WORDS_AND_NUMBERS))
def corpus_stats_numbers(spark, d):
    return S.corpus_stats(documents(spark, d), NUMBERS)


@query(f"WITH {_FREQ} SELECT term, freq FROM freq")
def term_freq(spark, d):
    return S.term_freq(documents(spark, d))


@query(f"WITH {_FREQ} SELECT term, freq FROM freq WHERE length(term) >= 3")
def term_freq_min3(spark, d):
    return S.term_freq(documents(spark, d), LONG)


@query(f"WITH w AS (SELECT unnest({_tokens(pattern=X.WORDS_AND_NUMBERS)}) AS term FROM documents) SELECT term, count(*) AS freq FROM w GROUP BY term")
def term_freq_numbers(spark, d):
    return S.term_freq(documents(spark, d), NUMBERS)


@query(f"WITH {_WORDS} SELECT regexp_replace(term, '{_STEM_SQL}', '\\1') AS term, count(*) AS freq FROM words GROUP BY 1")
def term_freq_stem(spark, d):
    return S.term_freq(documents(spark, d), STEMMED)


_LATIN, _CYRILLIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "АБЦДЕФГХИЙКЛМНОПЯРСТУВЫЁЭЗабцдефгхийклмнопярстувыёэз"
# The stemmer's endings once more, as the SQL that states the result has to name them itself.
_ENDINGS_SQL = "иями|ями|ами|ыми|ими|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ая|яя|ою|ею|ую|юю|ам|ям|ах|ях|ом|ем|а|я|ы|и|о|е|у|ю|ь"


@query(f"WITH d AS (SELECT translate(text, '{_LATIN}', '{_CYRILLIC}') AS t FROM documents), w AS (SELECT unnest(regexp_extract_all(replace(lower(t), 'ё', 'е'), '[a-z]+(?:-[a-z]+)*|[а-я]+(?:-[а-я]+)*')) AS term FROM d) SELECT regexp_replace(term, '^(.{{3,}}?)(?:{_ENDINGS_SQL})$', '\\1') AS term, count(*) AS freq FROM w GROUP BY 1")
def term_freq_stem_cyrillic(spark, d):
    """Documents in Cyrillic letters, ё among them: folding, tokens and stems of another alphabet."""
    return S.term_freq(documents(spark, d).select(F.translate("text", _LATIN, _CYRILLIC).alias("text")), STEMMED)


@query(f"WITH {_WORDS} SELECT d.doc_id, count(DISTINCT term) AS distinct_terms FROM documents d LEFT JOIN words w ON d.doc_id = w.doc_id GROUP BY d.doc_id")
def distinct_terms(spark, d):
    return P.distinct_terms(documents(spark, d))


@query(f"WITH {_WORDS} SELECT count(DISTINCT term) AS unique_terms FROM words")
def unique_terms(spark, d):
    return S.unique_terms(documents(spark, d))


@query(f"WITH {_FREQ} SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq FROM freq ORDER BY freq DESC, term LIMIT 50")
def top_terms(spark, d):
    return S.top_terms(S.term_freq(documents(spark, d)))


@query(f"WITH {_FREQ} SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq FROM freq")
def ranked_terms(spark, d):
    return S.ranked_terms(S.term_freq(documents(spark, d)))


@query(f"WITH {_FREQ}, r AS (SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, freq, max(freq) OVER () AS f1 FROM freq) SELECT rank, freq, f1::DOUBLE / rank::DOUBLE AS zipf_pred FROM r")
def zipf(spark, d):
    return S.zipf(S.term_freq(documents(spark, d)))


@query(f"WITH {_POSTED} SELECT * FROM posted")
def postings_tf(spark, d):
    return P.all_postings(documents(spark, d))


@query(f"WITH {_POSTED} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posted GROUP BY term")
def doc_freq(spark, d):
    return P.dictionary(P.all_postings(documents(spark, d)))


@query(f"WITH {_WORDS} SELECT count(*) AS terms, avg(strlen(term)) AS avg_term_len_bytes FROM (SELECT DISTINCT term FROM words)")
def dict_stats(spark, d):
    return P.dictionary_stats(P.dictionary(P.all_postings(documents(spark, d))))


@query(f"WITH {_PLACED} SELECT term, doc_id, pos FROM placed")
def occurrences(spark, d):
    return P.occurrences(documents(spark, d))


@query(f"WITH {_PLACED} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM placed GROUP BY ALL")
def postings_positions(spark, d):
    return P.postings(documents(spark, d), positions=True).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(f"WITH {_POSTED} SELECT term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs FROM posted GROUP BY term")
def postings_lists(spark, d):
    return P.postings_lists(P.all_postings(documents(spark, d))).withColumn("docs", F.array_join(F.col("docs").cast("array<string>"), ","))


_GAPPED = f"{_POSTED}, gapped AS (SELECT term, doc_id, tf, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS doc_gap FROM posted)"


@query(f"WITH {_GAPPED} SELECT * FROM gapped")
def doc_gaps(spark, d):
    return P.doc_gaps(P.all_postings(documents(spark, d)))


@query(f"WITH {_PLACED}, g AS (SELECT term, doc_id, pos, pos - lag(pos, 1, 0) OVER (PARTITION BY term, doc_id ORDER BY pos) AS gap FROM placed) SELECT term, doc_id, string_agg(gap::VARCHAR, ',' ORDER BY pos) AS pos_gaps FROM g GROUP BY ALL")
def pos_gaps(spark, d):
    return P.position_gaps(P.postings(documents(spark, d), positions=True)).select("term", "doc_id", F.array_join(F.col("pos_gaps").cast("array<string>"), ",").alias("pos_gaps"))


@query(f"WITH {_POSTED} SELECT term, doc_id FROM posted")
def gap_decode(spark, d):
    posted = P.all_postings(documents(spark, d)).select("term", "doc_id")
    gapped = P.doc_gaps(posted).withColumnRenamed("doc_id", "place")
    return P.undo_doc_gaps(gapped, "place").select("term", "doc_id")


_LENGTH = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
_PACKED = f"{_PLACED}, p AS (SELECT term, doc_id, pos - lag(pos, 1, 0) OVER (PARTITION BY term, doc_id ORDER BY pos) AS gap FROM placed), per AS (SELECT term, doc_id, count(*) AS tf, sum({_LENGTH.format('gap')}) AS b FROM p GROUP BY ALL), q AS (SELECT term, doc_id, tf, b, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS dg FROM per), size AS (SELECT sum(b + {_LENGTH.format('tf')} + {_LENGTH.format('dg')})::BIGINT AS postings_bytes FROM q)"


@query(f"WITH {_PACKED} SELECT postings_bytes FROM size")
def vbyte_size(spark, d):
    return P.packed_bytes(P.postings(documents(spark, d), positions=True))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v < 128 THEN (v + 128)::VARCHAR WHEN v < 16384 THEN (v & 127)::VARCHAR || ',' || ((v >> 7) + 128)::VARCHAR WHEN v < 2097152 THEN (v & 127)::VARCHAR || ',' || ((v >> 7) & 127)::VARCHAR || ',' || ((v >> 14) + 128)::VARCHAR ELSE (v & 127)::VARCHAR || ',' || ((v >> 7) & 127)::VARCHAR || ',' || ((v >> 14) & 127)::VARCHAR || ',' || ((v >> 21) + 128)::VARCHAR END AS bytes, v AS decoded FROM (SELECT l_orderkey, l_linenumber, (l_partkey * l_linenumber * 37)::BIGINT AS v FROM lineitem)")
def vbyte_bytes(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * F.col("l_linenumber") * 37).cast("long").alias("v"))
    coded = rows.withColumn("b", vbyte.encode(F.col("v")))
    return coded.select("l_orderkey", "l_linenumber", F.array_join(F.col("b").cast("array<string>"), ",").alias("bytes"), vbyte.decode_all(F.col("b"))[0].alias("decoded"))


@query(f"WITH {_PACKED}, w AS (SELECT count(DISTINCT term) AS terms, count(*) AS n FROM q), tb AS (SELECT sum(strlen(term)) AS b FROM (SELECT DISTINCT term FROM q)), f AS (SELECT count(*) AS docs FROM documents) SELECT (20 + 24 * docs)::BIGINT AS fwd_bytes, (40 + 24 * terms + b + 4 * n)::BIGINT AS inv1_bytes, (40 + 24 * terms + b + postings_bytes)::BIGINT AS inv2_bytes FROM w, tb, f, size")
def index_sizes(spark, d):
    docs = documents(spark, d)
    return P.index_sizes(P.postings(docs, positions=True), P.forward_index(docs))


@query("SELECT page_id AS doc_id, url, coalesce(nullif(regexp_extract(url, '/wiki/([^?#]*)', 1), ''), url) AS title FROM pages")
def forward_index(spark, d):
    return P.forward_index(table(spark, d, "pages"), "page_id")


def _has(term: str) -> str:
    return f"list_contains(l, '{term}')"


def _boolean_sql(test: str) -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, {_tokens()} AS l FROM documents) WHERE {test}"


def _boolean(text: str):
    def run(spark, d):
        docs = documents(spark, d)
        return B.boolean_search(P.postings(docs), docs, text)

    return run


BOOLEAN = {
    "bool_and": ("the AND idiot", f"{_has('the')} AND {_has('idiot')}"),
    "bool_or": ("clown || moron", f"{_has('clown')} OR {_has('moron')}"),
    "bool_not": ("NOT the", f"NOT {_has('the')}"),
    "bool_nested": ("(der OR les) && !(und and not die) or that", f"(({_has('der')} OR {_has('les')}) AND NOT ({_has('und')} AND NOT {_has('die')})) OR {_has('that')}"),
    "bool_multi_piece_term": ("the&of,and", f"{_has('the')} AND {_has('of')} AND {_has('and')}"),
    "bool_empty_leaf": ("NOT 123", "true"),
    "bool_double_not": ("not not the", _has("the")),
}
for _name, (_text, _test) in BOOLEAN.items():
    QUERIES[_name] = _boolean(_text)
    ORACLES[_name] = _boolean_sql(_test)


@query(_boolean_sql(f"{_has('the')} OR {_has('de')}") + " ORDER BY doc_id LIMIT 50 OFFSET 100")
def bool_page(spark, d):
    return B.page(_boolean("the or de")(spark, d), 2)


@query("SELECT doc_id FROM documents WHERE doc_id % 6 = 0")
def set_intersect(spark, d):
    docs = documents(spark, d).select("doc_id")
    return B.intersect(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def set_union(spark, d):
    docs = documents(spark, d).select("doc_id")
    return B.union(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 <> 0")
def set_complement(spark, d):
    docs = documents(spark, d).select("doc_id")
    return B.complement(docs.filter("doc_id % 2 = 0"), docs)


def _ranked_sql(terms: list[str], test: str = "true", limit: int = 20) -> str:
    asked = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"WITH {_POSTED}, l AS (SELECT doc_id, {_tokens()} AS l FROM documents), n AS (SELECT count(*) AS n FROM documents), asked(i, term) AS (VALUES {asked}), df AS (SELECT term, count(*) AS df FROM posted GROUP BY term), s AS (SELECT doc_id, sum(tf * ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE))) AS score FROM asked JOIN posted USING (term) JOIN df USING (term), n GROUP BY doc_id), hit AS (SELECT doc_id, score FROM s JOIN l USING (doc_id) WHERE score > 0 AND ({test})) SELECT doc_id, round(score, 6) AS score, (SELECT count(*) FROM hit) AS hits FROM hit ORDER BY round(hit.score, 9) DESC, doc_id LIMIT {limit}"


def _ranked(text: str, **options):
    def run(spark, d):
        docs = documents(spark, d)
        return R.with_hits(R.ranked_search(P.postings(docs), docs, text, **options)).withColumn("score", F.round("score", 6))

    return run


RANKED = {
    "tfidf_top": ("the of idiot", ["the", "of", "idiot"], "true", {}),
    "tfidf_dup_term": ("clown clown moron", ["clown", "clown", "moron"], "true", {}),
    "tfidf_boolean": ("(the and idiot) or scum", ["the", "and", "idiot", "or", "scum"], f"({_has('the')} AND {_has('idiot')}) OR {_has('scum')}", {}),
    "tfidf_negated": ("the && !of", ["the", "of"], f"{_has('the')} AND NOT {_has('of')}", {}),
    "tfidf_strict": ("the && !of", ["the"], f"{_has('the')} AND NOT {_has('of')}", {"strict_terms": True}),
    "tfidf_only_not": ("!the", ["the"], f"NOT {_has('the')}", {}),
}
for _name, (_text, _terms, _test, _options) in RANKED.items():
    QUERIES[_name] = _ranked(_text, **_options)
    ORACLES[_name] = _ranked_sql(_terms, _test)

BATCH = [(0, "the of that"), (1, "der die und"), (2, "moron clown"), (3, ""), (4, "les et le"), (5, "zzzz"), (6, "the and not of")]


@query(f"WITH {_POSTED}, n AS (SELECT count(*) AS n FROM documents), asked(qid, term) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, s in BATCH for t in s.split()) + "), df AS (SELECT term, count(*) AS df FROM posted GROUP BY term), s AS (SELECT qid, doc_id, sum(tf * ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE))) AS score FROM asked JOIN posted USING (term) JOIN df USING (term), n GROUP BY ALL), r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0 AND (qid <> 6 OR doc_id IN (SELECT doc_id FROM posted WHERE term = 'the' AND doc_id NOT IN (SELECT doc_id FROM posted WHERE term = 'of')))) SELECT qid::BIGINT AS qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def query_batch(spark, d):
    docs = documents(spark, d)
    return R.ranked_batch(P.postings(docs), docs, BATCH, docs.count()).withColumn("score", F.round("score", 6))


_OPERATOR = r"(?i)(^|[\s!()]|&&|\|\|)(and|or|not)($|[\s!()]|&&|\|\|)|[!()]|&&|\|\|"


# None of the benchmark's texts with an operator is well formed; those are skipped, as each program of the reference does.
@query(f"WITH {_POSTED}, n AS (SELECT count(*) AS n FROM documents), asked AS (SELECT item_id AS qid, unnest({_tokens()}) AS term FROM benchmark WHERE NOT regexp_matches(text, '{_OPERATOR}')), df AS (SELECT term, count(*) AS df FROM posted GROUP BY term), s AS (SELECT qid, doc_id, sum(tf * ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE))) AS score FROM asked JOIN posted USING (term) JOIN df USING (term), n GROUP BY ALL), r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT qid::BIGINT AS qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def benchmark_batch(spark, d):
    """Every text of benchmark as a query. Documents are dealt by id, so a document's scores add up where it is read."""
    docs = documents(spark, d).repartition("doc_id")
    asked = [(r["item_id"], r["text"]) for r in table(spark, d, "benchmark").filter("text IS NOT NULL").orderBy("item_id").collect()]
    return R.ranked_batch(P.all_postings(docs), docs, asked, docs.count(), on_error="skip").withColumn("score", F.round("score", 6))


BOOLEAN_BATCH = [(0, "the and of"), (1, "not the"), (2, "(a b"), (3, "der or les")]


@query(f"WITH l AS (SELECT doc_id, {_tokens()} AS l FROM documents) SELECT 0::BIGINT AS qid, doc_id FROM l WHERE {_has('the')} AND {_has('of')} UNION ALL SELECT 1, doc_id FROM l WHERE NOT {_has('the')} UNION ALL SELECT 3, doc_id FROM l WHERE {_has('der')} OR {_has('les')}")
def boolean_batch(spark, d):
    docs = documents(spark, d)
    return B.boolean_batch(P.postings(docs), docs, BOOLEAN_BATCH, on_error="skip")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 37")
def limit_docs(spark, d):
    return S.limit_docs(documents(spark, d), 37).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS before FROM documents) WHERE before < 200000")
def limit_bytes(spark, d):
    return S.limit_bytes(documents(spark, d), 200_000).select("doc_id")


def _entities(column: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''")):
        column = f"replace({column}, '{a}', '{b}')"
    return column


_SQUEEZE = "trim(regexp_replace({0}, '[\\s\\v\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
_POST_SQL = _SQUEEZE.format(_entities("regexp_replace(regexp_replace(regexp_replace(html, '<code>.*?</code>', ' [код] ', 'gs'), '<pre>.*?</pre>', ' [блок кода] ', 'gs'), '<[^>]+>', '', 'g')"))


@query(f"SELECT page_id, {_POST_SQL} AS clean FROM pages")
def clean_html_pages(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_post(F.col("html")).alias("clean"))


_MARKUP_SQL = "html"
for _pattern, _by, _flags in ((r"\{\{[^}]+\}\}", "", "g"), (r"\[\[(?:Файл|File|Image):[^\]]+\]\]", "", "gi"), (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1", "g"), (r"\[https?://[^\]]+\]", "", "g"), ("<[^>]+>", "", "g"), ("''{2,}", "", "g")):
    _MARKUP_SQL = f"regexp_replace({_MARKUP_SQL}, '{_pattern}', '{_by}', '{_flags}')"


@query(f"SELECT page_id, {_SQUEEZE.format(_MARKUP_SQL)} AS clean FROM pages")
def clean_markup_pages(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_markup(F.col("html")).alias("clean"))


_PARSED_SQL = "html"
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _PARSED_SQL = f"replace({_PARSED_SQL}, '{_entity}', '{_char}')"
for _pattern in ("<!--.*?-->", "<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<(?:pre|code)[^>]*>.*?</(?:pre|code)>", "<[^>]*>"):
    _PARSED_SQL = f"regexp_replace({_PARSED_SQL}, '{_pattern}', ' ', 'gs')"


@query(f"SELECT page_id, {_SQUEEZE.format(_PARSED_SQL)} AS clean FROM pages")
def clean_parsed_pages(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_html(F.col("html")).alias("clean"))


@query(f"SELECT doc_id, {_SQUEEZE.format('text')} AS text FROM documents")
def ws_norm(spark, d):
    return documents(spark, d).select("doc_id", X.squeeze(F.col("text")).alias("text"))


URLS = ["https://ru.wikipedia.org/wiki/%D0%94%D0%B5%D0%B4_%D0%9C%D0%BE%D1%80%D0%BE%D0%B7?x=1", "https://x.org/wiki/A_b+c#d", "https://x.org/none", "https://x.org/wiki/"]


@query("SELECT * FROM (VALUES (0::BIGINT, 'Дед Мороз'), (1, 'A b+c'), (2, 'https://x.org/none'), (3, 'https://x.org/wiki/')) t(i, title)")
def title_from_url(spark, d):
    rows = spark.createDataFrame(list(enumerate(URLS)), "i long, url string")
    return rows.select("i", X.display_title(F.lit(None).cast("string"), F.col("url")).alias("title"))


@query("SELECT 0::BIGINT AS i, 'C/D_%D0%BC%20x~.-%2A%2B' AS url")
def url_encoding(spark, d):
    return spark.createDataFrame([(0, "C/D_м x~.-*+")], "i long, t string").select("i", X.encode_url(F.col("t")).alias("url"))


@query("SELECT page_id, replace(url, '_', ' ') || '%zzA%' AS title FROM pages")
def escaped_titles(spark, d):
    coded = F.concat(F.lit("https://w.example/wiki/"), X.encode_url(F.col("url")), F.lit("%zz%41%?q=1"))
    return table(spark, d, "pages").select("page_id", X.title_of_url(coded).alias("title"))


@query("SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def dedupe_url(spark, d):
    return I.first_by(table(spark, d, "pages"), "url", "page_id").select("url", "page_id")


@query("SELECT p.page_id FROM pages p WHERE p.page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) AND p.page_id = (SELECT min(page_id) FROM pages q WHERE q.url = p.url AND q.page_id % 3 <> 0)")
def insert_new(spark, d):
    pages = table(spark, d, "pages")
    return I.new_rows(I.first_by(pages.filter("page_id % 3 <> 0"), "url", "page_id"), pages.filter("page_id % 3 = 0")).select("page_id")


_WHEN = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch(ts) END"


def _seen(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last_crawled_at"))


def _middle(spark, d) -> float:
    return table(spark, d, "events").agg((F.unix_micros(F.min("ts").cast("timestamp")) / 2e6 + F.unix_micros(F.max("ts").cast("timestamp")) / 2e6).alias("m")).first()["m"]


_MIDDLE_SQL = "(SELECT epoch(min(ts)) / 2 + epoch(max(ts)) / 2 FROM events)"


@query(f"SELECT event_id FROM events WHERE {_WHEN} < {_MIDDLE_SQL}")
def stale_docs(spark, d):
    return I.stale(_seen(spark, d), _middle(spark, d)).select("event_id")


@query(f"SELECT event_id FROM events WHERE {_WHEN} IS NULL OR {_WHEN} < {_MIDDLE_SQL}")
def stale_or_missing(spark, d):
    return I.stale(_seen(spark, d), _middle(spark, d), missing=True).select("event_id")


@query(f"SELECT event_id FROM (SELECT event_id, {_WHEN} AS seen FROM events) WHERE seen IS NULL OR seen < {_MIDDLE_SQL} ORDER BY seen NULLS FIRST, event_id LIMIT 500")
def stale_in_one_run(spark, d):
    return I.stale(_seen(spark, d), _middle(spark, d), missing=True, most=500, key="event_id").select("event_id")


@query("SELECT doc_id, \"offset\" FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS \"offset\" FROM documents) WHERE \"offset\" >= 70")
def resume_from_offset(spark, d):
    return I.resumed(documents(spark, d).select("doc_id"), 70)


@query("SELECT ((o - 70) // 50)::BIGINT AS saved, max(o) + 1 AS \"offset\" FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) WHERE o >= 70 GROUP BY 1")
def save_points(spark, d):
    return I.save_points(I.resumed(documents(spark, d).select("doc_id"), 70), 50)


SOURCES = Config.of({"sources": {"src3": True, "src7": True, "src9": False}}, {}).sources


@query("SELECT doc_id FROM documents WHERE source IN ('src3', 'src7')")
def enabled_sources(spark, d):
    return I.from_sources(table(spark, d, "documents"), SOURCES).select("doc_id")


@query("SELECT 'url' AS key, count(*) AS rows, count(*) - count(url) AS missing, count(url) - count(DISTINCT url) AS repeated FROM pages UNION ALL SELECT 'page_id', count(*), count(*) - count(page_id), count(page_id) - count(DISTINCT page_id) FROM pages")
def unique_keys(spark, d):
    return I.uniqueness(table(spark, d, "pages"), "url", "page_id")


@query("SELECT count(*) AS processed, count(*) FILTER (page_id % 5 <> 0 AND page_id % 4 = 0) AS updated, count(*) FILTER (page_id % 5 <> 0 AND page_id % 4 <> 0) AS unchanged, count(*) FILTER (page_id % 5 = 0) AS failed FROM pages WHERE page_id % 3 <> 1")
def change_counts(spark, d):
    pages = table(spark, d, "pages")
    body = F.when(F.col("page_id") % 5 != 0, F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    return I.change_counts(pages.select("page_id", F.col("html").alias("raw_html")), pages.filter("page_id % 3 <> 1").select("page_id", body.alias("body")), "page_id")


@query("SELECT page_id FROM pages WHERE page_id % 7 IN (3, 4, 6) OR page_id % 2 = 1")
def service_titles(spark, d):
    """Titles built from pages: a word of a list, then for even ids a colon and the address."""
    names = F.array(*[F.lit(x) for x in ("Википедия", "Template", "Файл", "Город", "категория", "Модуль", "Портал и")])
    title = F.concat(F.get(names, (F.col("page_id") % 7).cast("int")), F.when(F.col("page_id") % 2 == 0, F.lit(":")).otherwise(F.lit(" ")), "url")
    first = F.regexp_replace(title, ":", " ")
    titled = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, title).otherwise(first).alias("title"))
    return titled.filter(~X.is_service_page(F.col("title"))).select("page_id")


@query("SELECT page_id, md5(CASE WHEN page_id % 4 = 0 THEN html || '!' ELSE html END) AS digest, CASE WHEN page_id % 4 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS last_crawled_at FROM pages")
def update_on_change(spark, d):
    stored = table(spark, d, "pages").select("page_id", F.col("html").alias("raw_html"), F.lit(1.0).alias("last_crawled_at"))
    fetched = table(spark, d, "pages").filter("page_id % 3 <> 1").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("body"))
    late = table(spark, d, "pages").filter("page_id % 3 = 1 AND page_id % 4 = 0").select("page_id", F.concat("html", F.lit("!")).alias("body"))
    return I.changed(stored, fetched.union(late), 2.0, "page_id").select("page_id", F.md5("raw_html").alias("digest"), "last_crawled_at")


TITLES = ["Википедия:Правила", "Шаблон:Инфобокс", "Файл:Image.jpg", "Категория:Тест", "Москва", "Звёздные войны: Эпизод", "wikipedia:x", "Модуль:"]


@query("SELECT * FROM (VALUES ('Москва'), ('Звёздные войны: Эпизод'), ('wikipedia:x')) t(title)")
def service_filter(spark, d):
    return spark.createDataFrame([(t,) for t in TITLES], "title string").filter(~X.is_service_page(F.col("title")))


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_text_md5(spark, d):
    return S.duplicate_keys(documents(spark, d).select(F.md5("text").alias("digest")), "digest")


STEMS = ["машины", "машина", "мама", "дом", "яблоками", "линиями", "его", "красного", "frameworks"]


@query("SELECT * FROM (VALUES ('машины', 'машин'), ('машина', 'машин'), ('мама', 'мам'), ('дом', 'дом'), ('яблоками', 'яблок'), ('линиями', 'лин'), ('его', 'его'), ('красного', 'красн'), ('frameworks', 'frameworks')) t(term, stem)")
def stem_literals(spark, d):
    return spark.createDataFrame([(t,) for t in STEMS], "term string").select("term", X.stem(F.col("term")).alias("stem"))


@query("SELECT avg(length(text)) AS avg_len FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 1000)")
def avg_len_first_1000(spark, d):
    return S.average_length(documents(spark, d))


@query("SELECT url, md5(html) AS digest FROM (SELECT url, html, row_number() OVER (PARTITION BY url ORDER BY page_id) AS r FROM pages) WHERE r = 1")
def streaming_ingest(spark, d):
    """Pages as a stream of files, stored once each."""
    home = new_place(spark, "ingest")
    pages = I.first_by(table(spark, d, "pages"), "url", "page_id").select("url", F.col("html").alias("raw_html"))
    pages.write.parquet(f"{home}/incoming")
    stream = spark.readStream.schema(pages.schema).parquet(f"{home}/incoming")
    ingest_once(stream, f"{home}/raw", f"{home}/clean", f"{home}/progress").awaitTermination()
    return spark.read.parquet(f"{home}/raw").select("url", F.md5("raw_html").alias("digest"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked retrieval with metadata: the best documents for a query of three words."""
    docs = documents(spark, sf_dir)
    return B.with_metadata(R.top(R.ranked_search(P.postings(docs), docs, "the of idiot")), P.forward_index(docs)).orderBy(F.col("score").desc(), "doc_id")
