"""Registration with and without the training-data subpackage, and registered queries against their SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tessel.operators import boolean as B
from tessel.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "events", "lineitem")


def test_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, check=True)
    assert int(said.stdout) == len(catalog.QUERIES)


def test_every_query_has_sql_or_says_why():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["corpus_stats_numbers", "term_freq_stem", "ranked_terms", "postings_positions", "doc_gaps", "vbyte_size", "bool_nested", "bool_page", "tfidf_boolean", "tfidf_strict", "query_batch", "boolean_batch", "limit_bytes", "clean_markup_pages", "ws_norm", "insert_new", "update_on_change", "clean_parsed_pages", "bool_double_not", "term_freq_stem_cyrillic", "distinct_terms", "stale_in_one_run", "resume_from_offset", "save_points", "enabled_sources", "unique_keys", "change_counts", "service_titles", "gap_decode", "index_sizes", "tfidf_top", "title_from_url", "escaped_titles"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        cursor = con.execute(catalog.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        expected = cursor.fetchall()
    got = catalog.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    plain = lambda rows: sorted(tuple(near(v) for v in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(expected)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
def test_benchmark_batch_asks_every_text(spark):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        expected = con.execute(catalog.ORACLES["benchmark_batch"]).fetchall()
        texts = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    got = catalog.QUERIES["benchmark_batch"](spark, DATA).select("qid", "doc_id", "score", "rank").collect()
    near = lambda rows: sorted((q, d, round(s, 5), k) for q, d, s, k in rows)
    assert near(got) == near(expected)
    plain = {i for i, t in texts if not B.is_boolean(B.lex(t))}
    assert {r["qid"] for r in got} == plain and len(plain) > len(catalog.BATCH)
