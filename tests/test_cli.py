"""The command line on a small corpus."""

from datetime import datetime, timedelta

import pytest

from rillgraph import cli
from rillgraph.config import Options
from rillgraph.functions.vectors import hashed_vector


@pytest.fixture
def posts(spark, tmp_path):
    t = datetime(2017, 1, 1)
    rows = [(i, ["تیم", "گل", "w%d" % (i % 3), "لیگ"], ["PersianWord"] * 4, t + timedelta(minutes=7 * i), 1, 1, "") for i in range(60)]
    path = str(tmp_path / "posts")
    spark.createDataFrame(rows, "pid bigint, tokens array<string>, types array<string>, dt timestamp_ntz, user_id bigint, window_no int, deleted string").write.parquet(path)
    return path


def test_run_graphs_and_evaluate(spark, posts, tmp_path, capsys):
    out = ["--out-dir", str(tmp_path / "out"), "--embed-dim-hashing", "64", "--ts-seconds", "600", "--offline"]
    assert cli.main(["run", "--posts", posts, *out]) == 0
    assert cli.main(["graphs", "--posts", posts, "--store", str(tmp_path / "store"), "--limit", "10", "--subject-filter", "--offline"]) == 0
    assert cli.main(["graphs", "--posts", posts, "--store", str(tmp_path / "store"), "--show", "2", "--offline"]) == 0
    assert "تیم" in capsys.readouterr().out
    gold = str(tmp_path / "gold")
    spark.createDataFrame([(i, "1", "تیم") for i in range(60)], "sequence_id bigint, topics_id string, topics_str string").write.parquet(gold)
    assert cli.main(["evaluate", "--posts", posts, "--gold", gold, *out]) == 0
    assert "cluster_entropy" in capsys.readouterr().out
    more = ["--store", str(tmp_path / "store"), "--score-cache", str(tmp_path / "scores"), "--t-d", "1.1", "--no-verbose"]
    for _ in range(2):
        assert cli.main(["run", "--posts", posts, *out, *more]) == 0
    assert spark.read.json(str(tmp_path / "store")).groupBy("pid").count().where("count > 1").count() == 0
    assert cli.main(["evaluate", "--posts", posts, "--gold", gold, "--all", *out]) == 0
    report = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/evaluation"))
    assert sorted(r.td for r in report.collect()) == ["1.1", "1.2"]


def vectors_of(model, max_length):
    def encode(phrases):
        assert model == "m" and max_length == 9
        return [hashed_vector(p, 64) for p in phrases]

    return encode


def answers_of(model, temperature):
    def ask(text):
        if text.endswith("w2 لیگ"):
            raise OSError("no answer")
        return '[["تیم", "با", "لیگ"], ["گل", "در", "لیگ"]]'

    return ask


def test_clients(spark, posts, tmp_path):
    """Models by name: failed answers stay missing; vectors from a cache give what the embedder gives."""
    out = ["--posts", posts, "--out-dir", str(tmp_path / "out"), "--ts-seconds", "600", "--store", str(tmp_path / "store"), "--kg-backend", "client", "--kg-client", "tests.test_cli:answers_of", "--kg-max-retries", "1", "--kg-workers", "2"]
    model = ["--embed-backend", "model", "--embed-client", "tests.test_cli:vectors_of", "--embed-model", "m", "--embed-max-length", "9", "--embed-cache", str(tmp_path / "vectors")]
    assert cli.main(["run", *out, *model]) == 0
    kept = {r.pid for r in spark.read.json(str(tmp_path / "store")).collect()}
    assert kept == {i for i in range(60) if i % 3 != 2} and spark.read.parquet(str(tmp_path / "vectors")).count() > 0
    read = lambda o: sorted(map(tuple, spark.read.option("sep", "\t").csv(str(tmp_path / o / ("topics_" + Options(ts_seconds=600).stamp()))).collect()))
    assert cli.main(["run", *out, "--out-dir", str(tmp_path / "other"), "--embed-dim-hashing", "64"]) == 0
    assert read("out") == read("other")
    with pytest.raises(ValueError, match="module:function"):
        cli.main(["run", *out, "--kg-client", ""])
