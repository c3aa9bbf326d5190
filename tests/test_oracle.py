"""Every query against its SQL on the smallest test data; the others run."""

from pathlib import Path

from tests import oracle
import pytest
from pyspark.sql import functions as F

import rillgraph.catalog as catalog
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(FOLDER).exists():
        pytest.skip("no test data")
    return oracle.view(FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLE:
        assert oracle.difference(df, con, catalog.ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    if not Path(FOLDER).exists():
        pytest.skip("no test data")
    import __spark_entry__ as entry

    assert set(entry.entry(spark).columns) == {"subject_idx", "kind", "phrase", "n", "t1", "score"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_titles_of_several_words(spark, con, tmp_path):
    for t in Path(FOLDER).glob("*.parquet"):
        (tmp_path / t.name).symlink_to(t)
    (tmp_path / "final_events.parquet").unlink()
    heads = [" ".join(r.t) for r in spark.read.parquet(f"{FOLDER}/posts.parquet").selectExpr("slice(tokens, 1, 3) t").where("size(t) = 3 and not exists(t, x -> x is null)").limit(200).collect()]
    events = spark.read.parquet(f"{FOLDER}/final_events.parquet").withColumn("titles", F.array(*map(F.lit, heads)))
    events.toPandas().to_parquet(tmp_path / "final_events.parquet")
    df = catalog.QUERIES["q_whole_title_in_text"](spark, str(tmp_path))
    assert df.where(F.col("titles").contains(" ")).count() > 0
    assert oracle.difference(df, oracle.view(str(tmp_path)), catalog.ORACLE["q_whole_title_in_text"]) == ""
