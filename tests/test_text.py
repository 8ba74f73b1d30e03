import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import text as X
from tessel.functions import vbyte
from tessel.functions.text import TokenOptions


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


CASES = [
    ("Ёжик и ёлка", {}, "ежик и елка"),
    ("Привет, мир!", {}, "привет мир"),
    ("Санкт-Петербург", {}, "санкт-петербург"),
    ("-тест-", {}, "тест"),
    ("frameworkи", {}, "framework и"),
    ("x86 test123 done", {}, "x test done"),
    ("x86 test123 done", {"keep_numbers": True}, "x86 test123 done"),
    ("я в дом", {"min_len": 2}, "дом"),
    ("машины машина", {"stem": True}, "машин машин"),
    ("für straße", {}, "f r stra e"),
    ("a--b a–b a-б", {}, "a b a-b a б"),
    ("1аb a1б a-1б", {"keep_numbers": True}, "1аb a1 б a-1 б"),
    ("win10 123 abc123", {"keep_numbers": True}, "win10 123 abc123"),
    ("мама дом яблоками", {"stem": True}, "мам дом яблок"),
    ("", {}, ""),
]


def test_tokens(spark):
    for options in {tuple(sorted(o.items())) for _, o, _ in CASES}:
        rows = [(t, e) for t, o, e in CASES if tuple(sorted(o.items())) == options]
        opt = TokenOptions(**dict(options))
        assert column(spark, [t for t, _ in rows], lambda c: F.array_join(X.tokens(c, opt), " ")) == [e for _, e in rows]
        assert [" ".join(X.query_terms(t, opt)) for t, _ in rows] == [e for _, e in rows]


def scan(text, numbers):
    """A character machine: the script of the first letter holds; a hyphen joins if a fitting character follows."""
    text = text.translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO))
    kind = lambda c: "l" if "a" <= c <= "z" else "c" if "а" <= c <= "я" else "d" if "0" <= c <= "9" else ""
    out, word, script = [], "", ""
    fits = lambda k, s: (k == "d" and numbers) or (k in ("l", "c") and (not s or s == k))
    i = 0
    while i < len(text):
        k = kind(text[i])
        if word and text[i] == "-" and i + 1 < len(text) and fits(kind(text[i + 1]), script):
            word += "-"
        elif fits(k, script) if word else fits(k, ""):
            if not word:
                script = k if k != "d" else ""
            word += text[i]
        else:
            if word:
                out.append(word)
            word, script = "", ""
            if fits(k, ""):
                word, script = text[i], k if k != "d" else ""
        i += 1
    return out + [word] * bool(word)


@settings(max_examples=400, deadline=None)
@given(st.text("abZ аЯё19--– ,é", max_size=24), st.booleans())
def test_pattern_is_the_machine(text, numbers):
    assert X.query_terms(text, TokenOptions(keep_numbers=numbers)) == scan(text, numbers)


def test_clean_post(spark):
    cases = {
        "<p>Текст в <strong>параграфе</strong> с тегами</p>": "Текст в параграфе с тегами",
        "Текст <code>print('hello')</code> продолжение <pre>a\nb</pre> конец": "Текст [код] продолжение [блок кода] конец",
        "Текст с &lt;тегами&gt; и &amp; символами &quot;кавычки&quot;": 'Текст с <тегами> и & символами "кавычки"',
        "&amp;lt;": "&lt;",
        "": "",
        None: "",
    }
    assert column(spark, list(cases), X.clean_post) == list(cases.values())


def test_clean_markup(spark):
    cases = {
        "Текст {{Шаблон|параметр=значение}} продолжение": "Текст продолжение",
        "Текст [[Файл:Image.jpg|thumb|Описание]] и [[ФАЙЛ:x]] продолжение": "Текст и продолжение",
        "[[Москва]] / [[Москва|столица России]]": "Москва / столица России",
        "Текст    с     множественными\n\n\nпробелами ": "Текст с множественными пробелами",
        "'''a''' <b>b</b> [https://x.y z]": "a b",
        None: "",
    }
    assert column(spark, list(cases), X.clean_markup) == list(cases.values())


def test_clean_html_and_article(spark):
    assert column(spark, ["<p>a <b>b</b><code>c</code> &eacute;</p>", None], X.clean_html) == ["a b é", ""]
    assert X.html_text("<p>a<code>c</code></p>", keep_code=True) == "a c"
    unseen = "<p>a</p><script>var x='</p>';</script><style>p{c:d}</style><template><b>t</b></template><p>b <code>q</code>"
    assert X.html_text(unseen) == "a b" and X.html_text(unseen, keep_code=True) == "a b q"
    text = "A <!-- n --> B<ref name=x>r</ref> [https://u label] [https://u] [[Category:Q]] {{t|{{u}}}} [[P|Q]]&nbsp;''i''"
    assert column(spark, [text], X.clean_article) == ["A B label Q i"]


def test_urls(spark):
    urls = {"https://ru.wikipedia.org/wiki/%D0%94%D0%B5%D0%B4_%D0%9C%D0%BE%D1%80%D0%BE%D0%B7?x=1": "Дед Мороз", "https://a/b": "https://a/b", "/wiki/a%ZZ_b": "a%ZZ b", "/wiki/a+b%5Fc": "a+b_c"}
    assert column(spark, list(urls), lambda c: X.display_title(F.lit(""), c)) == list(urls.values())
    assert column(spark, ["C/D м~*"], X.encode_url) == ["C/D%20%D0%BC~%2A"]


def test_vbyte(spark):
    cases = {0: [128], 1: [129], 127: [255], 128: [0, 129], 300: [44, 130], 16384: [0, 0, 129], 2147483647: [127, 127, 127, 127, 135]}
    rng = random.Random(1)
    numbers = list(cases) + [rng.randrange(1 << rng.randrange(1, 32)) for _ in range(200)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i long, n long")
    got = df.select("i", "n", vbyte.encode(F.col("n")).alias("b"), vbyte.length(F.col("n")).alias("l")).withColumn("d", vbyte.decode_all(F.col("b"))).orderBy("i").collect()
    assert [r["b"] for r in got[: len(cases)]] == list(cases.values())
    assert all(r["d"] == [r["n"]] and len(r["b"]) == r["l"] for r in got)
    for bad in ([0], [0, 0, 0, 0, 0, 129]):
        with pytest.raises(Exception, match="number"):
            spark.createDataFrame([(bad,)], "b array<int>").select(vbyte.decode_all(F.col("b"))).collect()


def test_service_pages_and_tags(spark):
    assert column(spark, ["Шаблон:Инфобокс", "Москва", "a:b"], X.is_service_page) == [True, False, False]
    assert column(spark, ["<a><b-c>", ""], lambda c: F.array_join(X.split_tags(c), "|")) == ["a|b-c", ""]
    assert re.fullmatch(X.STEM, "аба") is None


def test_decode_url_keeps_what_is_no_escape(spark):
    cases = [("a%41_b", "aA b"), ("%zz%41", "%zzA"), ("100%", "100%"), ("%%41+%4", "%A+%4"), ("%D0%BC%5F%2b", "м_+"), ("", ""), (None, None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, u string").select("i", X.decode_url(F.col("u")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [b for _, b in cases]
