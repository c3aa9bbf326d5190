"""Structured Streaming: events of a stream of posts, one micro-batch after another, with the state in the shared folder."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.config import Options
from rillgraph.functions.text import epoch_seconds, normalise_phrase
from rillgraph.operators import events, graph, triples
from rillgraph.operators.fold import GlobalEvents, SubjectFold, unit
from rillgraph.operators.subjects import SubjectClassifier, assign_subjects, labelled_posts
from rillgraph.operators.windows import distinct_posts
from rillgraph.plans.files import children, exists
from rillgraph.plans.materialize import materialize
from rillgraph.schemas import SUBJECT_EVENTS

STATE = "subject_idx int, state binary"
PROGRESS = "done bigint, closed bigint, late bigint"


def read_posts(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Posts as a stream of Parquet files, in the order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(posts: DataFrame, hours: int = 12, late: str = "2 hours") -> DataFrame:
    """Posts of each tumbling window, final once the watermark has passed it; posts later than ``late`` are dropped."""
    timed = posts.withColumn("at", F.col("dt").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", f"{hours} hours").alias("w")).agg(F.count("*").alias("n_posts")).select(F.col("w.start").alias("start"), "n_posts")


def streamed_mentions(posts: DataFrame) -> DataFrame:
    """Mentions of a stream of posts, stateless: chain triples, one row per end and relation."""
    rows = posts.select("pid", epoch_seconds("dt").alias("t"), F.posexplode(triples.chain_triples("tokens")).alias("pos", "x"))
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), normalise_phrase(F.col(f"x.{c}")).alias("phrase"))
    return rows.select("pid", "t", "pos", F.explode(F.array(of("node", "h"), of("node", "o"), of("edge", "r"))).alias("m")).select("pid", "t", "pos", "m.kind", "m.phrase").where("phrase <> ''")


class EventStream:
    """The sink of a stream: ``posts.writeStream.foreachBatch(EventStream(...).process)``.

    A batch holds the posts of whole windows (column ``window``), in order. Posts delivered twice count once. Windows that an
    earlier batch has closed are over: posts that come later for them are counted in ``late`` and left out. State is written
    per batch and read from the batch before, so a batch that is run again after a failure gives the same result.
    """

    def __init__(self, classifier: SubjectClassifier, options: Options, folder: str, embed: Callable | None = None) -> None:
        self.classifier, self.options, self.folder, self.embed = classifier, options, folder.rstrip("/"), embed

    def process(self, posts: DataFrame, batch: int) -> None:
        spark = posts.sparkSession
        done, closed, late = self._progress(spark, batch)
        every, posts = posts, distinct_posts(posts.where(F.col("window") > closed))
        posts = materialize(posts.drop("late"), "stream-posts")
        late += every.where(F.col("window") <= closed).count()
        if posts.isEmpty():
            return self._carry(spark, batch, late)
        assigned = assign_subjects(self.classifier.scores(posts), self.options.thresh_ps)
        kept = labelled_posts(posts, assigned)
        placed = graph.placed_triples(kept, assigned, triples.extract(kept, most=self.options.kg_max_triples_per_post).select("pid", "triples")).join(posts.select("pid", "window"), "pid")
        rows = placed.select("subject_idx", "window", "pid", "t", "pos", *(normalise_phrase(F.col(c)).alias(c) for c in "hro"))
        clock = posts.groupBy("window").agg(F.max(epoch_seconds("dt")).alias("now")).orderBy("window").collect()
        ticks = [(r["window"], done + k + 1, r["now"]) for k, r in enumerate(clock)]
        options, embed = self.options, self.embed

        def fold(key: tuple, state: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            stream = pickle.loads(state["state"][0]) if len(state) else SubjectFold(options)
            raw = events.phrase_embedder(options, embed)
            of = dict(list(pdf.sort_values(["window", "t", "pid", "pos"], kind="stable").groupby("window", sort=False)))
            out = []
            for window, ordinal, now in ticks:
                if window in of:
                    x = of[window]
                    stream.take(x["h"].tolist(), x["r"].tolist(), x["o"].tolist(), x["t"].to_numpy(), x["pid"].to_numpy(), lambda p: unit(raw(p)))
                for k, e in enumerate(stream.end_window(ordinal, now, raw)):
                    out.append({"subject_idx": key[0], "window": window, "event_no": k} | e)
            return pd.DataFrame({"subject_idx": [key[0]], "state": [pickle.dumps(stream)], "events": [pickle.dumps(out)]})

        old = self._state(spark, batch).select(F.col("subject_idx").alias("s"), "state")
        new = old.groupBy("s").cogroup(rows.groupBy("subject_idx")).applyInPandas(fold, "subject_idx int, state binary, events binary")
        new.write.mode("overwrite").parquet(f"{self.folder}/state/{batch}")
        new = spark.read.parquet(f"{self.folder}/state/{batch}")

        def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for blob in pdf["events"]:
                    yield pd.DataFrame(pickle.loads(blob), columns=events.EVENT_COLUMNS)

        new.select("events").mapInPandas(unpacked, SUBJECT_EVENTS).write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        progress = (done + len(ticks), max(t[0] for t in ticks), late)
        spark.createDataFrame([progress], PROGRESS).write.mode("overwrite").parquet(f"{self.folder}/windows/{batch}")

    def _previous(self, spark: SparkSession, kind: str, batch: int, schema: str) -> DataFrame:
        path = f"{self.folder}/{kind}/{batch - 1}"
        if batch > 0 and not exists(spark, path):  # a lost table must not restart every subject with an empty graph
            raise RuntimeError(f"no {kind} of the batch before {batch}: {path}")
        return spark.read.parquet(path) if batch > 0 else spark.createDataFrame([], schema)

    def _state(self, spark: SparkSession, batch: int) -> DataFrame:
        return self._previous(spark, "state", batch, STATE)

    def _progress(self, spark: SparkSession, batch: int) -> tuple[int, int, int]:
        """Windows closed so far, the last of them, and posts that came too late."""
        rows = self._previous(spark, "windows", batch, PROGRESS).collect()
        return tuple(rows[0]) if rows else (0, -(2**62), 0)

    def _carry(self, spark: SparkSession, batch: int, late: int) -> None:
        done, closed, _ = self._progress(spark, batch)
        self._state(spark, batch).select("subject_idx", "state").write.mode("overwrite").parquet(f"{self.folder}/state/{batch}")
        spark.createDataFrame([(done, closed, late)], PROGRESS).write.mode("overwrite").parquet(f"{self.folder}/windows/{batch}")

    def events(self, spark: SparkSession) -> DataFrame:
        """The events of all batches so far."""
        return spark.read.parquet(f"{self.folder}/events").drop("batch")



class RunningRegistry:
    """Global events of a stream: each call takes the batches in that are new since the last, in order; the centres are kept in
    the sink's folder, so a restart goes on where it stopped."""

    def __init__(self, sink: EventStream, threshold: float) -> None:
        self.sink, self.threshold = sink, threshold

    def update(self, spark: SparkSession) -> GlobalEvents:
        root = f"{self.sink.folder}/registry"
        done = max((int(n) for n in children(spark, root) if exists(spark, f"{root}/{n}/_SUCCESS")), default=-1)
        known = GlobalEvents(self.threshold)
        if done >= 0:
            rows = spark.read.parquet(f"{root}/{done}").orderBy("number").toPandas()
            if len(rows):
                known = GlobalEvents(self.threshold, np.stack(rows["centre"].to_list()), rows["n"].to_numpy("int64"))
        batches = sorted(int(n.removeprefix("batch=")) for n in children(spark, f"{self.sink.folder}/events") if n.startswith("batch="))
        for batch in (b for b in batches if b > done):
            found = spark.read.parquet(f"{self.sink.folder}/events/batch={batch}").where("vector is not null").orderBy("window", "subject_idx", "event_no")
            vectors = found.select("vector").toPandas()["vector"].to_list()  # the new events of one batch
            if vectors:
                known.join(np.stack(vectors))
            rows = [(k + 1, int(n), c.tolist()) for k, (n, c) in enumerate(zip(known.sizes, known.centres))]
            spark.createDataFrame(rows, "number int, n int, centre array<float>").write.mode("overwrite").parquet(f"{root}/{batch}")
        return known
