import pytest

from tessel import web
from tessel.cli import main
from tessel.sources.tables import Index


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("cli")
    rows = [(i, f"moon star word{i}" if i % 2 else "sun moon", f"https://x/{i}", f"<T{i}>") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, url string, title string").write.parquet(f"{home}/docs")
    assert main(["index", "--docs", f"{home}/docs", f"--out={home}/index", "--keep-numbers=1"], spark) == 0
    return home


def test_search(spark, home, capsys):
    assert main(["bool", "--index", f"{home}/index", "--q", "moon and not star", "--top", "2"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[:3] == ["hits 60", "0\t<T0>\thttps://x/0", "2\t<T2>\thttps://x/2"]
    (home / "q.txt").write_text("star\n\nword7\n")
    assert main(["rank", "--index", f"{home}/index", "--qfile", str(home / "q.txt"), "--top=1"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "hits 60" and out[1].startswith("1\t0.68") and out[3] == "hits 1" and out[4].startswith("7\t")


def test_stats(spark, home, capsys):
    assert main(["stats", "--docs", f"{home}/docs", "--out", f"{home}/reports", "--limit-docs", "10", "--top-n", "1"], spark) == 0
    out = dict(line.split(" ", 1) for line in capsys.readouterr().out.splitlines())
    assert out["docs"] == "10" and out["unique_terms"] == "4"
    assert spark.read.option("header", True).csv(f"{home}/reports/top_terms").collect()[0]["term"] == "moon"


def test_exit_codes(spark, home):
    assert main(["bool", "--index", f"{home}/index", "--q", "a b"], spark) == 1
    assert main(["bool", "--index", f"{home}/index"], spark) == 2 and main(["nothing"], spark) == 2


def test_web(spark, home):
    index = Index(spark, f"{home}/index")
    assert web.respond(index, "/")[0] == 200 and web.respond(index, "/x")[0] == 404
    status, body = web.respond(index, "/search?q=star&page=1")
    assert status == 200 and "60 hits" in body and body.count("<li") == 10 and "&lt;T" in body and ">back<" in body and ">next<" not in body
    assert web.respond(index, "/search?q=(a")[0] == 500
    assert [web.page_number(x) for x in ("2", "-1", "x", "")] == [2, 0, 0, 0]
