"""Triples of posts: extraction, parsing and cleaning."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rillgraph.functions.arrays import let
from rillgraph.functions.text import squeezed

DEFAULT_RELATION = "مرتبط با"
MAX_PART = 60
MAX_TRIPLES = 32
TRIPLES = "array<struct<h:string,r:string,o:string>>"
TRIPLES_TYPE = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in "hro"]))
# Keys under which an answer may hold its triples, in the order of search.
ANSWER_KEYS = ("Knowledge Graph", "knowledge_graph", "graph", "triples", "relationships")


def as_triples(lists: str | Column) -> Column:
    """Structs of the members that have three parts."""
    return F.transform(F.filter(lists, lambda t: F.size(t) == 3), lambda t: F.struct(t[0].alias("h"), t[1].alias("r"), t[2].alias("o")))


def clean_triples(triples: str | Column, relation: str = DEFAULT_RELATION) -> Column:
    """White space squeezed; empty relations replaced; triples with an empty or equal end, or a part of more than 60
    characters, dropped; each kept once, in order. Null gives an empty array."""
    blank = lambda c: squeezed(F.coalesce(c, F.lit("")))
    named = lambda c: F.coalesce(F.nullif(blank(c), F.lit("")), F.lit(relation))
    parts = F.transform(triples, lambda t: F.struct(blank(t["h"]).alias("h"), named(t["r"]).alias("r"), blank(t["o"]).alias("o")))
    fits = lambda t: F.greatest(F.length(t["h"]), F.length(t["r"]), F.length(t["o"])) <= MAX_PART
    good = F.filter(parts, lambda t: (t["h"] != "") & (t["o"] != "") & (t["h"] != t["o"]) & fits(t))
    return F.coalesce(F.array_distinct(good), F.array().cast(TRIPLES))


def chain_triples(tokens: str | Column, chunk: int = 2, most: int = MAX_TRIPLES, relation: str = DEFAULT_RELATION) -> Column:
    """The offline extractor: chunks of words, each linked to the next by one constant relation.

    Words are the pieces between white space, as tokens may hold spaces. Fewer than two words give no triples.
    """
    words = F.filter(F.split(squeezed(F.concat_ws(" ", tokens)), " "), lambda w: w != "")
    pieces = lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w), F.lit(chunk)), lambda i: F.array_join(F.slice(w, i, chunk), " ")))
    link = lambda a, b: F.struct(a.alias("h"), F.lit(relation).alias("r"), b.alias("o"))
    pairs = lambda c: F.when(F.size(c) > 1, F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), link))
    return F.slice(clean_triples(let(words, lambda w: let(pieces(w), pairs))), 1, most)


def prompt_for(text: str) -> str:
    """What a client may ask a language model for one post; any prompt will do whose answer :func:`parse_answer` reads."""
    return (
        "List the facts of the post as a JSON array of [head, relation, tail], each a few words of the post's language. Leave out opinions and "
        f"repetitions. If there are none, answer [].\nPost: the fire in the tower was put out by the city's firemen\n"
        f'Answer: [["fire", "was in", "tower"], ["firemen", "put out", "fire"]]\nPost: {text}\nAnswer:'
    )


def parse_answer(answer: str | None, most: int = MAX_TRIPLES) -> list[tuple[str, str, str]]:
    """Triples of a model's answer: JSON (a list, or an object that holds one, perhaps as a string, perhaps fenced), else
    every ``[a, b, c]`` in the text."""
    text = re.sub(r"```(?:json)?", "", answer or "").strip()
    found = _from_json(text, 0)
    if not found:
        groups = ([p.strip().strip("'\"").strip() for p in g.split(",")] for g in re.findall(r"\[([^\[\]]+?)\]", text))
        found = [tuple(g) for g in groups if len(g) == 3 and all(g)]
    return found[:most]


def _from_json(value: object, depth: int) -> list[tuple[str, str, str]]:
    if isinstance(value, str) and depth < 4:
        try:
            return _from_json(json.loads(value), depth + 1)
        except ValueError:
            return []
    if isinstance(value, dict):
        return next((got for k in ANSWER_KEYS if k in value and (got := _from_json(value[k], depth + 1))), [])
    if isinstance(value, list):
        return [tuple(str(x).strip() for x in item) for item in value if isinstance(item, (list, tuple)) and len(item) == 3]
    return []


@pandas_udf(TRIPLES_TYPE)
def _parse(answers: pd.Series) -> pd.Series:
    return answers.map(lambda a: [dict(zip("hro", t)) for t in parse_answer(a)])


def parse_triples(answers: str | Column) -> Column:
    """:func:`parse_answer` as a column function (the JSON may hold JSON in a string, which needs recursion)."""
    return _parse(answers)


def extract_with_client(posts: DataFrame, ask: Callable[[str], str], retries: int = 5, first_wait: float = 1.0, most: int = MAX_TRIPLES, workers: int | None = None) -> DataFrame:
    """``(pid, triples, status)`` from an injected client, asked once per post with retries and growing pauses.

    An answer that never comes gives no triples and the status ``failed``, so it can be told from an empty graph. ``workers``
    is the number of tasks, each of which asks one question at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            triples, status = [], []
            for text in b["text"]:
                got, state = [], "failed"
                for attempt in range(max(1, retries)):
                    try:
                        got, state = [dict(zip("hro", t)) for t in parse_answer(ask(text), most)], "ok"
                        break
                    except Exception:
                        time.sleep(min(first_wait * 2**attempt, 30.0) * random.uniform(0.5, 1.0))
                triples.append(got)
                status.append(state)
            yield pd.DataFrame({"pid": b["pid"], "triples": triples, "status": status})

    texts = posts.select("pid", F.concat_ws(" ", "tokens").alias("text"))
    texts = texts.repartition(workers, "pid") if workers else texts
    out = texts.mapInPandas(run, f"pid long, triples {TRIPLES}, status string")
    return out.withColumn("triples", F.slice(clean_triples("triples"), 1, most))


def extract(posts: DataFrame, backend: str = "heuristic", ask: Callable[[str], str] | None = None, **options) -> DataFrame:
    """``(pid, triples, status)`` by one of the backends."""
    if backend == "heuristic":
        return posts.select("pid", chain_triples("tokens", **options).alias("triples"), F.lit("ok").alias("status"))
    if backend == "client" and ask is not None:
        return extract_with_client(posts, ask, **options)
    raise ValueError(f"unknown extraction backend: {backend!r}")


def triple_stats(graphs: DataFrame) -> DataFrame:
    """Posts with a graph, triples, triples a post."""
    return graphs.agg(F.count("*").alias("n_graphs"), F.coalesce(F.sum(F.greatest(F.size("triples"), F.lit(0))), F.lit(0)).alias("n_triples")).withColumn("triples_a_graph", F.col("n_triples") / F.greatest("n_graphs", F.lit(1)))
