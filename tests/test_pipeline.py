"""The whole run on a corpus with a planted burst, in batch and as a stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillgraph.config import Options
from rillgraph.operators import subjects, windows
from rillgraph.plans import pipeline
from rillgraph.sources import results
from rillgraph.streaming import events as streaming

QUIET = ("bank price rose today", "team won match today", "rain fell city today", "doctor helped child today")
BURST = "fire destroyed tower downtown tonight"
SCHEMA = "pid bigint, tokens array<string>, types array<string>, dt timestamp_ntz, user_id bigint, window_no int, deleted string"


def corpus(spark):
    rows, origin = [], datetime(2017, 1, 1)
    for w in range(4):
        for i in range(24):
            late = w == 2 and i >= 12
            at = origin + timedelta(hours=12 * w, minutes=690 + i - 12 if late else 25 * i)
            words = (BURST if w == 2 and (i < 2 or late) else QUIET[i % 4]).split()
            rows.append((1000 + 24 * w + i, words, ["PersianWord"] * len(words), at, -1, w + 1, ""))
    return spark.createDataFrame(rows, SCHEMA)


def classifier(spark):
    words = {0: "fire tower rain", 1: "bank price", 6: "team match", 7: "doctor child"}
    return subjects.KeywordClassifier(spark.createDataFrame([(s, t) for s, ts in words.items() for t in ts.split()], "subject_idx int, term string"))


OPTIONS = Options(embed_dim_hashing=128, clustering="louvain")


@pytest.fixture(scope="module")
def run(spark):
    return pipeline.run(corpus(spark), classifier(spark), OPTIONS)


def test_counts(run):
    stats = run.stats.first()
    assert (stats.n_posts, stats.n_windows) == (96, 4) and stats.n_events >= 1


def test_burst_is_found_in_its_window(run):
    found = [r for r in run.topics.collect() if "fire" in r.topic or "tower" in r.topic]
    assert found and {r.window for r in found} <= {3, 4}


def test_assignments(run):
    rows = run.assignments.collect()
    assert len(rows) == 96 and len({r.pid for r in rows}) == 96
    burst = {r.pid for r in corpus(run.posts.sparkSession).where(F.array_contains("tokens", "fire")).collect()}
    hit = {r.pid for r in rows if r.event_number != "0"}
    assert hit and hit & burst and all(r.event_number for r in rows)


def test_report_counts_posts(run):
    assert all(r.posts >= 1 and r.titles for r in run.report.collect())


def test_max_windows(spark):
    assert pipeline.prepared(corpus(spark), Options(max_windows=2)).select("window").distinct().count() == 2


def test_thresholds_are_monotone(spark):
    of = lambda **o: pipeline.run(corpus(spark), classifier(spark), Options(embed_dim_hashing=128, **o))
    assert of(t_d=3.0).events.count() <= of(t_d=1.2).events.count()
    assert of(thresh_ts=50.0).finals.count() <= of(thresh_ts=0.0).finals.count()


def test_calibrated_run(spark):
    run = pipeline.run(corpus(spark), classifier(spark), Options(embed_dim_hashing=64, calibrate_thresh_ps=True))
    assert run.assigned.count() == 0 or run.assignments.count() == 96


def test_save(spark, run, tmp_path):
    options = Options(out_dir=str(tmp_path))
    pipeline.save(run, options)
    back = results.scan_assignments(spark, f"{tmp_path}/assignments_{options.stamp()}")
    assert back.count() == 96 and back.select("window").distinct().count() == 4


def test_stream_gives_the_batch_events(spark, run, tmp_path):
    posts = windows.with_windows(corpus(spark))
    for w in range(1, 5):
        posts.where(F.col("window") == w).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = streaming.EventStream(classifier(spark), OPTIONS, str(tmp_path / "out"))
    stream = streaming.read_posts(spark, str(tmp_path / "in"), SCHEMA + ", window bigint")
    query = stream.writeStream.foreachBatch(sink.process).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.subject_idx, r.window, r.event_no, tuple(r.titles), tuple(r.post_ids), round(r.score, 9))
    assert sorted(map(key, sink.events(spark).collect())) == sorted(map(key, run.events.collect()))
    for _ in range(2):  # the second time everything is there already
        known = streaming.RunningRegistry(sink, OPTIONS.thresh_ts).update(spark)
        assert sorted(known.sizes.tolist()) == sorted(r.n for r in run.finals.collect())


def test_second_deliveries_and_late_posts_of_a_stream(spark, run, tmp_path):
    posts = windows.with_windows(corpus(spark))
    sink = streaming.EventStream(classifier(spark), OPTIONS, str(tmp_path / "out"))
    sink.process(posts.where("window <= 2").unionByName(posts.where("window = 2")), 0)
    sink.process(posts.where("window = 3").unionByName(posts.where("window = 1")), 1)  # window 1 is closed
    sink.process(posts.limit(0), 2)
    sink.process(posts.where("window = 4"), 3)
    sink.process(posts.where("window = 4"), 3)  # run again after a failure
    key = lambda r: (r.subject_idx, r.window, r.event_no, tuple(r.titles), tuple(r.post_ids), round(r.score, 9))
    assert sorted(map(key, sink.events(spark).collect())) == sorted(map(key, run.events.collect()))
    assert spark.read.parquet(str(tmp_path / "out/windows/3")).first().late == posts.where("window = 1").count()
    with pytest.raises(RuntimeError, match="batch before 9"):
        sink.process(posts, 9)


def test_stateless_and_windowed_streams(spark, tmp_path):
    corpus(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    posts = streaming.read_posts(spark, str(tmp_path / "in"), SCHEMA)
    out = streaming.windowed_counts(posts).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    assert {r.n_posts for r in spark.table("counts").collect()} <= {24}
    out = streaming.streamed_mentions(posts).writeStream.format("memory").queryName("men").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("men").where("kind = 'edge'").count() > 0
