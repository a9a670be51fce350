"""The commands, on small files."""

import json

import pytest

from lattica import cli


class Kept:
    """The session of the tests, as cli.main would build one."""

    def __init__(self, spark):
        self.spark = spark

    def build(self, *_):
        return self.spark


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", Kept(spark))
    return lambda *argv: cli.main(list(argv))


def test_registry(run, tmp_path, capfd):
    (tmp_path / "p.json").write_text(json.dumps({"papers": [{"id": "a1", "domain": "nlp", "title": "Parsing", "processed": True}, {"id": "b2", "domain": "ml", "title": "Other", "processed": False}]}))
    run("registry", "--file", f"file://{tmp_path}/p.json", "--text", "pars")
    out = capfd.readouterr().out
    assert "a1" in out and "b2" not in out


def test_evaluate(run, spark, tmp_path):
    n = 20
    spark.createDataFrame([(f"paper:{i}", "mentions", f"e{i % 4}") for i in range(n)], "h string, r string, t string").write.parquet(f"{tmp_path}/train")
    spark.createDataFrame([(f"paper:{i}",) for i in range(n)], "node string").write.parquet(f"{tmp_path}/papers")
    spark.createDataFrame([(f"paper:{i}", f"paper:{(i + 4) % n}") for i in range(n)], "query string, candidate string").write.parquet(f"{tmp_path}/truth")
    run("evaluate", "--train", f"{tmp_path}/train", "--papers", f"{tmp_path}/papers", "--truth", f"{tmp_path}/truth", "--out", f"{tmp_path}/out", "--dim", "4", "--epochs", "3", "--seeds", "1", "2")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.seed for r in rows) == [1, 2] and all(r.n == n and 0 < r.mrr <= 1 for r in rows)


def test_compare(run, spark, tmp_path):
    t = [("a", "uses", "b", 1), ("c", "is", "d", 2)]
    spark.createDataFrame(t, "subject string, predicate string, object string, ord long").write.parquet(f"{tmp_path}/one")
    spark.createDataFrame(t[:1], "subject string, predicate string, object string, ord long").write.parquet(f"{tmp_path}/two")
    run("compare", "--fixed", f"{tmp_path}/one", "--free", f"{tmp_path}/two", "--out", f"{tmp_path}/report")
    from lattica.sources.writers import read_report

    assert {(r.side, r.n) for r in read_report(spark, f"{tmp_path}/report", "overlap", "side string, n long").collect()} == {("both", 1), ("fixed", 1)}


def test_unknown_command():
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
