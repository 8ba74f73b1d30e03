"""Small tables with everything that operators have to bear: nulls, empty and long texts, ties, repeats, odd columns."""

import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = {"en": "the er ing and tion ly".split(), "de": "der ung sch ein keit ö".split(), "fr": "eau oir eux le ê ai".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, key string, score double, fp string, h string"


def prose(rng, lang, words):
    out = []
    for i in range(words):
        out.append("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def lines(rng, lang, n):
    return "\n".join(prose(rng, lang, rng.randint(9, 20)) for _ in range(n))


def rows():
    rng = random.Random(4)
    out = []
    for i in range(60):
        lang = list(SYLLABLES)[i % 3]
        out.append((i, lines(rng, lang, rng.randint(1, 9)), lang, f"s{i % 4}"))
    shared = lines(rng, "en", 8)
    out += [(60 + i, f"{prose(rng, 'en', 12)}\n{shared}\n{prose(rng, 'en', 12)}", "en", "s0") for i in range(4)]
    out += [(70, out[5][1], "fr", "s9"), (71, out[5][1] + " x", "fr", None), (72, None, None, None), (73, "", "en", "s1"), (74, " \n\t ", "en", "s1")]
    out += [(75, "123 456 !!", None, "s2"), (None, out[7][1], "de", "s2"), (76, prose(rng, "en", 3000), "en", "s3"), (77, "x" * 9000, "en", "s3")]
    out += [out[3], out[3]]
    return [(*r, None if r[1] is None else len(r[1]), "k", "t", "key", 0.5, "fp", "h") for r in out]


@pytest.fixture(scope="session")
def fixture_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    return spark.createDataFrame(fixture_rows, SCHEMA).repartition(3, F.col("n_chars")).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
