"""Queries over the test tables, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.config import Options, stamped_path
from rillgraph.functions import text, vectors
from rillgraph.operators import burst, cluster, evaluate, events, graph, subjects, triples, windows
from rillgraph.plans import pipeline
from rillgraph.plans.materialize import application_folder, materialize
from rillgraph.sources import caches, corpus, kgstore, results
from rillgraph.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HOUR = 3600.0  # interval of the burst queries: an hour suits the posts' two months better than the default minute
#: Forgetting threshold of the queries on the graph that is left: the stored graphs of the test data hardly burst, and at the
#: default of 1.2 (see q_survivors) not one relation survives.
T_D = 0.9


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def _read(s: SparkSession, d: str, table: str) -> DataFrame:
    return s.read.parquet(f"{d}/{table}.parquet")


def _posts(s: SparkSession, d: str) -> DataFrame:
    return windows.distinct_posts(corpus.scan_posts(s, f"{d}/posts.parquet"))


def _windowed(s: SparkSession, d: str) -> DataFrame:
    """Windows first: the first midnight then comes from a plain scan, not from posts made distinct twice."""
    return windows.distinct_posts(windows.with_windows(corpus.scan_posts(s, f"{d}/posts.parquet")))


def _lexicon(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "subject_lexicon")


def _scores(s: SparkSession, d: str) -> DataFrame:
    return subjects.KeywordClassifier(_lexicon(s, d)).scores(_posts(s, d))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return subjects.assign_subjects(_scores(s, d), 0.5)


def _graphs(s: SparkSession, d: str) -> DataFrame:
    return kgstore.graphs(_read(s, d, "kg_store"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    return graph.placed_triples(_posts(s, d), _assigned(s, d), _graphs(s, d))


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return graph.mentions(_placed(s, d))


def _now(s: SparkSession, d: str) -> float:
    return corpus.scan_posts(s, f"{d}/posts.parquet").agg(F.max(text.epoch_seconds("dt"))).first()[0] or 0.0


def _folder(s: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads again."""
    return f"{application_folder(s)}/{name}-{uuid.uuid4().hex}"


def _round(c: str, to: str | None = None, places: int = 6):  # noqa: ANN202
    return F.round(c, places).alias(to or c)


# -- shared SQL --------------------------------------------------------------------------------------------------

SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def squeezed_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACES}', ' ', 'g'))"


def normal_sql(c: str) -> str:
    return squeezed_sql(f"translate(coalesce({c}, ''), 'يك' || chr(8204), 'یک ')")


POSTS_SQL = """
p0 as (select * from (select *, row_number() over (partition by pid order by dt, window_no) k from posts) where k = 1),
p as (select *, cast(floor((epoch_us(dt) - epoch_us((select date_trunc('day', min(dt)) from p0))) / (12 * 3600 * 1e6)) as bigint) + 1 as win,
      epoch_us(dt) / 1e6 as t from p0)"""
SCORES_SQL = (
    POSTS_SQL
    + """,
lex as (select distinct subject_idx, term from subject_lexicon where subject_idx is not null and term is not null),
hits as (select pid, subject_idx, count(*) hits from (select distinct pid, unnest(tokens) term from p) join lex using (term) group by all),
scores as (select pid, subject_idx, cast(hits as float) / cast(sum(hits) over (partition by pid) as float) score from hits),
assigned as (select pid, subject_idx from scores where score >= 0.5)"""
)
CLEAN_SQL = f"""
last as (select * from (select *, row_number() over (partition by pid order by seq desc) k from kg_store) where k = 1),
raw as (select pid, unnest(triples) m, generate_subscripts(triples, 1) i from last),
parts as (select pid, i, {squeezed_sql("coalesce(m[1], '')")} h, {squeezed_sql("coalesce(m[2], '')")} r0, {squeezed_sql("coalesce(m[3], '')")} o from raw where len(m) = 3),
good as (select pid, i, h, case when r0 = '' then 'مرتبط با' else r0 end r, o from parts),
kept as (select pid, h, r, o, min(i) i from good where h <> '' and o <> '' and h <> o and greatest(length(h), length(r), length(o)) <= 60 group by all),
graphs as (select pid, h, r, o, row_number() over (partition by pid order by i) - 1 as pos from kept)"""
PLACED_SQL = SCORES_SQL + "," + CLEAN_SQL + ",\nplaced as (select subject_idx, pid, t, pos, h, r, o from graphs join (select pid, t from p) using (pid) join assigned using (pid))"
MENTIONS_SQL = (
    PLACED_SQL
    + f""",
men as (select * from (
  select subject_idx, 'node' kind, {normal_sql("h")} phrase, h surface, t, pid, pos, 0 as rol from placed union all
  select subject_idx, 'node', {normal_sql("o")}, o, t, pid, pos, 1 from placed union all
  select subject_idx, 'edge', {normal_sql("r")}, r, t, pid, pos, 2 from placed) where phrase <> ''),
rels as (select * from (select subject_idx, {normal_sql("h")} n1, {normal_sql("r")} e, {normal_sql("o")} n2, t, pid, pos from placed) where n1 <> '' and e <> '' and n2 <> '' and n1 <> n2)"""
)
BURST_SQL = (
    MENTIONS_SQL
    + """,
clock as (select max(epoch_us(dt) / 1e6) as now from posts),
born as (select subject_idx, kind, phrase, min(t) t1, count(*) n from men group by all),
m as (select *, greatest(1, cast(ceil((now - t1) / 3600) as bigint)) m from born, clock),
bins as (select subject_idx, kind, phrase, t1, n, m, now, least(cast(floor((t - t1) / 3600) as bigint), m - 1) k from men join m using (subject_idx, kind, phrase)),
burst as (select subject_idx, kind, phrase, n, t1, case when m <= 1 then 1.0 else (n * 0.1 + 0.9 * x / (m - 1)) / (n * 1.0 - 0.9 * x / (m - 1)) end score
          from (select subject_idx, kind, phrase, n, t1, m, sum(k) x from bins group by all))"""
)
ALIVE_SQL = BURST_SQL + f",\nalive as (select subject_idx, kind, phrase, score from burst where score >= {T_D})"
PRUNED_SQL = (
    ALIVE_SQL
    + """,
pruned as (select * from rels where exists (select 1 from alive x where x.subject_idx = rels.subject_idx and x.kind = 'node' and x.phrase = n1)
  and exists (select 1 from alive x where x.subject_idx = rels.subject_idx and x.kind = 'node' and x.phrase = n2)
  and exists (select 1 from alive x where x.subject_idx = rels.subject_idx and x.kind = 'edge' and x.phrase = e)),
pairs as (select subject_idx, a, b, greatest(max(coalesce(score, 0)), 0) weight from (
  select r.subject_idx, least(n1, n2) a, greatest(n1, n2) b, x.score from pruned r left join alive x on x.subject_idx = r.subject_idx and x.kind = 'edge' and x.phrase = r.e) group by all)"""
)


# -- scans, windows, statistics ----------------------------------------------------------------------------------


@query(f"with {POSTS_SQL} select pid, win as \"window\" from p")
def q_window_assign(s: SparkSession, d: str) -> DataFrame:
    return _windowed(s, d).select("pid", "window")


@query(f"with {POSTS_SQL} select pid, cast(window_no as bigint) as \"window\" from p0")
def q_file_windows(s: SparkSession, d: str) -> DataFrame:
    return windows.with_windows(windows.distinct_posts(corpus.scan_posts(s, f"{d}/posts.parquet")), 0).select("pid", "window")


@query(f"with {POSTS_SQL} select win as \"window\", min(t) first_s, max(t) last_s, count(*) n_posts from p group by 1")
def q_window_stats(s: SparkSession, d: str) -> DataFrame:
    return windows.window_stats(_windowed(s, d))


@query(f"with {POSTS_SQL} select win as \"window\", row_number() over (order by win) as ordinal from (select distinct win from p)")
def q_window_ordinals(s: SparkSession, d: str) -> DataFrame:
    return windows.window_ordinals(_windowed(s, d))


@query(f"with {POSTS_SQL} select pid, win as \"window\" from (select pid, win, dense_rank() over (order by win) k from p) where k <= 10")
def q_max_windows(s: SparkSession, d: str) -> DataFrame:
    return windows.first_windows(_windowed(s, d), 10).select("pid", "window")


@query(f"""with {POSTS_SQL} select cast(sum(n) as bigint) n_posts, count(*) n_windows, min(a) first_s, max(b) last_s, round(avg(n), 6) posts_a_window
from (select win, count(*) n, min(t) a, max(t) b from p group by 1)""")
def q_stream_stats(s: SparkSession, d: str) -> DataFrame:
    return windows.stream_stats(_windowed(s, d)).select("n_posts", "n_windows", "first_s", "last_s", _round("posts_a_window"))


@query(f"with {POSTS_SQL} select pid, coalesce(array_to_string(tokens, ' '), '') as \"text\" from p")
def q_text(s: SparkSession, d: str) -> DataFrame:
    return _posts(s, d).select("pid", text.text_of("tokens").alias("text"))


@query(f"with {POSTS_SQL} select pid, unnest(tokens) token, unnest(range(len(tokens))) as pos, window_no from p0")
def q_nested_scan(s: SparkSession, d: str) -> DataFrame:
    """The nested form of the corpus, a row per window and hour with parallel arrays, read back into posts."""
    one = windows.distinct_posts(_read(s, d, "posts"))
    names = (("pid", "pids"), ("tokens", "tokens"), ("types", "types"), ("deleted", "deleted"), ("dt", "dts"), ("user_id", "user_ids"))
    rows = one.groupBy("window_no", F.date_trunc("hour", "dt").alias("hour")).agg(F.collect_list(F.struct(*(c for c, _ in names))).alias("x"))
    nested = rows.select(*(F.col(f"x.{c}").alias(n) for c, n in names), "window_no")
    return corpus.from_nested(nested).select("pid", F.posexplode("tokens").alias("pos", "token"), "window_no").select("pid", "token", F.col("pos").cast("long").alias("pos"), "window_no")


# -- text --------------------------------------------------------------------------------------------------------


@query(f"select distinct t as token, {normal_sql('t')} as phrase from (select unnest(tokens) t from posts)")
def q_normalise_phrase(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "posts").select(F.explode("tokens").alias("token")).distinct().select("token", text.normalise_phrase(F.col("token")).alias("phrase"))


@query(r"select doc_id, translate(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g'), 'يك', 'یک') as plain from documents")
def q_strip_punctuation(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "documents").select("doc_id", text.strip_punctuation(F.col("text")).alias("plain"))


_ALIASES = ", ".join(f"('{k}', '{v}')" for k, v in subjects.LABEL_SUBJECTS.items())


@query(f"""with names(name, subject) as (values {_ALIASES}), l as (select distinct label, trim(translate(lower({normal_sql('label')}), '_', ' ')) k from subject_labels)
select label, coalesce((select min(subject) from names where name = k), (select min(subject) from names where replace(name, ' ', '') = replace(k, ' ', ''))) subject from l""")
def q_canonical_subject(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "subject_labels").select("label").distinct().select("label", subjects.canonical_subject(F.col("label")).alias("subject"))


# -- subjects ----------------------------------------------------------------------------------------------------


@query(f"with {SCORES_SQL} select pid, subject_idx, round(cast(score as double), 6) score from scores")
def q_keyword_scores(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).select("pid", "subject_idx", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"with {SCORES_SQL} select pid, subject_idx from assigned")
def q_assign_subjects(s: SparkSession, d: str) -> DataFrame:
    return _assigned(s, d)


@query(f"with {SCORES_SQL} select pid, user_id from p where pid in (select pid from assigned)")
def q_noise_drop(s: SparkSession, d: str) -> DataFrame:
    return subjects.labelled_posts(_posts(s, d), _assigned(s, d)).select("pid", "user_id")


_NAMES = ", ".join(f"({i}, '{x}')" for i, x in [*enumerate(subjects.SUBJECTS), (-1, "(unlabelled)")])


@query(f"""with {SCORES_SQL}, names(i, subject) as (values {_NAMES}) select i as subject_idx, subject,
case when i = -1 then (select count(*) from p where pid not in (select pid from assigned)) else (select count(*) from assigned where subject_idx = i) end n_posts from names""")
def q_subject_counts(s: SparkSession, d: str) -> DataFrame:
    return subjects.subject_counts(_posts(s, d), _assigned(s, d))


@query(f"""with {SCORES_SQL}, best as (select coalesce(max(score), 0) b from p left join scores using (pid) group by pid),
o as (select cast(b as double) b, row_number() over (order by b) k, count(*) over () n from best),
c as (select (select b from o where k = least(795, n)) lo, coalesce((select b from o where k = least(795, n) + 1), (select b from o where k = least(795, n)) + 1) hi from (select max(n) n from o))
select round(case when hi > lo then (lo + hi) / 2 else lo + 1e-9 end, 6) threshold from c""")
def q_calibrate_threshold(s: SparkSession, d: str) -> DataFrame:
    return subjects.calibrated_threshold(_posts(s, d), _scores(s, d)).select(_round("threshold"))


@query("""with l as (select vec_id as pid, unnest(range(len(embedding))) as label, unnest(embedding) as logit from embeddings),
e as (select pid, label, exp(cast(logit as double) - max(cast(logit as double)) over (partition by pid)) x from l),
f as (select pid, label, x / sum(x) over (partition by pid) score from e)
select pid, cast(label % 8 as integer) subject_idx, round(max(cast(score as float))::double, 5) score from f group by all""")
def q_softmax_subjects(s: SparkSession, d: str) -> DataFrame:
    """The places of a vector as the logits of a classifier's labels, eight subjects in turn."""
    logits = _read(s, d, "embeddings").select(F.col("vec_id").alias("pid"), F.posexplode("embedding").alias("label", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return subjects.logits_to_scores(logits, {i: i % 8 for i in range(64)}).select("pid", "subject_idx", F.round(F.col("score").cast("double"), 5).alias("score"))


@query("""select vec_id as pid, cast(label % 8 as integer) subject_idx, round(max(cast(1 / (1 + exp(-cast(logit as double))) as float))::double, 5) score
from (select vec_id, unnest(range(len(embedding))) as label, unnest(embedding) as logit from embeddings) group by all""")
def q_sigmoid_subjects(s: SparkSession, d: str) -> DataFrame:
    logits = _read(s, d, "embeddings").select(F.col("vec_id").alias("pid"), F.posexplode("embedding").alias("label", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return subjects.logits_to_scores(logits, {i: i % 8 for i in range(64)}, "sigmoid").select("pid", "subject_idx", F.round(F.col("score").cast("double"), 5).alias("score"))


# -- triples and their store -------------------------------------------------------------------------------------


@query(f"""with {POSTS_SQL}, w as (select pid, list_filter(string_split(trim(regexp_replace(coalesce(array_to_string(tokens, ' '), ''), '{SPACES}', ' ', 'g')), ' '), lambda x: x <> '') ws from p0),
c as (select pid, list_transform(range(1, len(ws) + 1, 2), lambda i: array_to_string(ws[i : i + 1], ' ')) cs from w where len(ws) >= 2),
r as (select pid, unnest(range(1, len(cs))) i, cs from c),
g as (select pid, i, cs[i] h, cs[i + 1] o from r where cs[i] <> cs[i + 1] and greatest(length(cs[i]), length(cs[i + 1])) <= 60),
u as (select pid, h, o, min(i) i from g group by all), n as (select pid, h, o, row_number() over (partition by pid order by i) - 1 as pos from u)
select pid, pos, h, 'مرتبط با' as r, o from n where pos < 32""")
def q_chain_triples(s: SparkSession, d: str) -> DataFrame:
    rows = triples.extract(_posts(s, d)).select("pid", F.posexplode("triples").alias("pos", "x"))
    return rows.select("pid", F.col("pos").cast("long").alias("pos"), "x.h", "x.r", "x.o")


@query(f"with {CLEAN_SQL} select pid, pos, h, r, o from graphs")
def q_clean_triples(s: SparkSession, d: str) -> DataFrame:
    return _graphs(s, d).select("pid", F.posexplode("triples").alias("pos", "x")).select("pid", F.col("pos").cast("long").alias("pos"), "x.h", "x.r", "x.o")


@query(f"with {CLEAN_SQL} select (select count(*) from last) n_graphs, (select count(*) from graphs) n_triples, round((select count(*) from graphs) / (select count(*) from last), 6) triples_a_graph")
def q_triple_stats(s: SparkSession, d: str) -> DataFrame:
    return triples.triple_stats(_graphs(s, d)).select("n_graphs", "n_triples", _round("triples_a_graph"))


def _stripped_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACES}', ''), '{SPACES}$', '')"


@query(f"""with {CLEAN_SQL}, three as (select pid, i, row_number() over (partition by pid order by i) k, {_stripped_sql("m[1]")} || '|' || {_stripped_sql("m[2]")} || '|' || {_stripped_sql("m[3]")} x from raw where len(m) = 3)
select pid, string_agg(x, ';' order by i) parsed from three where k <= 32 group by pid""")
def q_parse_triples(s: SparkSession, d: str) -> DataFrame:
    """Stored graphs written as models answer: an object with a string that holds the list, in a fenced block."""
    rows = kgstore.latest(_read(s, d, "kg_store")).where(F.exists("triples", lambda t: F.size(t) == 3))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.to_json("triples").alias("Knowledge Graph"))), F.lit("\n```"))
    return rows.select("pid", F.array_join(F.transform(triples.parse_triples(answer), lambda t: F.concat_ws("|", t["h"], t["r"], t["o"])), ";").alias("parsed"))


_JOINED_SQL = "array_to_string(list_transform(triples, lambda m: coalesce(array_to_string(list_transform(m, lambda x: coalesce(x, '-')), '|'), '-')), ';')"


def _joined(triples_: str = "triples"):  # noqa: ANN202
    return F.array_join(F.transform(triples_, lambda m: F.coalesce(F.array_join(F.transform(m, lambda x: F.coalesce(x, F.lit("-"))), "|"), F.lit("-"))), ";")


@query(f"select seq, pid, backend, {_JOINED_SQL} as graph from (select *, row_number() over (partition by pid order by seq desc) k from kg_store) where k = 1")
def q_kg_latest(s: SparkSession, d: str) -> DataFrame:
    return kgstore.latest(_read(s, d, "kg_store")).select("seq", "pid", "backend", _joined().alias("graph"))


@query(f"with {CLEAN_SQL}, g as (select pid, string_agg(h || '|' || r || '|' || o, ';' order by pos) graph from graphs group by 1) select seq, pid, graph from last join g using (pid) order by seq, pid limit 20")
def q_show_graphs(s: SparkSession, d: str) -> DataFrame:
    rows = kgstore.shown(_read(s, d, "kg_store"), 20)
    return rows.select("seq", "pid", F.array_join(F.transform("triples", lambda t: F.concat_ws("|", t["h"], t["r"], t["o"])), ";").alias("graph"))


@query(f"with {CLEAN_SQL}, g as (select pid, string_agg(h || '|' || r || '|' || o, ';' order by pos) graph from graphs group by 1) select pid, coalesce(graph, '') graph from (select distinct pid from kg_store) left join g using (pid)")
def q_kg_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Graphs appended to a log of JSON lines in two writes, the first of them empty, compacted, and read again."""
    path, rows = _folder(s, "kg"), _graphs(s, d)
    kgstore.put(rows.withColumn("triples", F.slice("triples", 1, 0)), f"{path}/log", "first")
    kgstore.put(rows, f"{path}/log", "second")
    kgstore.compact(kgstore.scan_json(s, f"{path}/log"), f"{path}/compact")
    found = kgstore.graphs(kgstore.readable(kgstore.scan_json(s, f"{path}/compact")))
    return found.select("pid", F.array_join(F.transform("triples", lambda t: F.concat_ws("|", t["h"], t["r"], t["o"])), ";").alias("graph"))


@query("select distinct pid, status, n from (select pid, 'ok' status, 1 n from posts where pid % 3 <> 0)")
def q_kg_ensure(s: SparkSession, d: str) -> DataFrame:
    """A store that is filled by an extractor which fails on a third of the posts: failures stay missing, however often it runs."""
    path = f"{_folder(s, 'ensure')}/log"
    graph_ = F.array(F.struct(F.lit("a").alias("h"), F.lit("b").alias("r"), F.lit("c").alias("o")))
    extractor = lambda p: p.select("pid", graph_.alias("triples"), F.when(F.col("pid") % 3 == 0, "failed").otherwise("ok").alias("status"))
    for _ in range(2):
        store = kgstore.ensure_graphs(_posts(s, d).select("pid"), path, extractor, "x")
    return store.groupBy("pid").agg(F.lit("ok").alias("status"), F.count("*").cast("int").alias("n"))


@query("select seq, pid, backend from (select *, row_number() over (partition by pid, backend order by seq desc) k from kg_store) where k = 1")
def q_kg_latest_by_backend(s: SparkSession, d: str) -> DataFrame:
    return kgstore.latest(_read(s, d, "kg_store"), by_backend=True).select("seq", "pid", "backend")


@query(f"with {POSTS_SQL} select pid, win as \"window\" from p where pid not in (select pid from kg_store)")
def q_kg_missing(s: SparkSession, d: str) -> DataFrame:
    return kgstore.missing(_windowed(s, d), _read(s, d, "kg_store")).select("pid", "window")


@query(f"""with {POSTS_SQL}, last as (select * from (select *, row_number() over (partition by pid order by seq desc) k from kg_store) where k = 1)
select pid, coalesce({_JOINED_SQL}, '') graph from p0 left join (select pid, triples from last) using (pid)""")
def q_kg_lookup(s: SparkSession, d: str) -> DataFrame:
    return kgstore.lookup(_posts(s, d), _read(s, d, "kg_store")).select("pid", _joined().alias("graph"))


# -- the stream graph --------------------------------------------------------------------------------------------


@query(f"with {MENTIONS_SQL} select subject_idx, kind, phrase, surface, t, pid, pos, rol as role from men")
def q_mentions(s: SparkSession, d: str) -> DataFrame:
    return _mentions(s, d).select("subject_idx", "kind", "phrase", "surface", "t", "pid", F.col("pos").cast("long").alias("pos"), "role")


@query(f"with {MENTIONS_SQL} select subject_idx, kind, phrase, count(*) n_mentions, min(t) first_t, max(t) last_t, count(distinct pid) n_posts from men group by all")
def q_entity_summary(s: SparkSession, d: str) -> DataFrame:
    return graph.entities(_mentions(s, d))


_TITLES_SQL = MENTIONS_SQL + """,
forms as (select kind, phrase, surface, count(*) n, min(struct_pack(t := t, pid := pid, pos := pos, rol := rol)) seen from men group by all),
ranked as (select *, row_number() over (partition by kind, phrase order by n desc, seen) rk from forms)"""


@query(f"with {_TITLES_SQL} select kind, phrase, surface as title from ranked where rk = 1")
def q_modal_title(s: SparkSession, d: str) -> DataFrame:
    return graph.modal_titles(_mentions(s, d), ["kind", "phrase"])


@query(f"with {_TITLES_SQL} select kind, phrase, surface, n, rk as rank from ranked")
def q_all_titles(s: SparkSession, d: str) -> DataFrame:
    return graph.titles(_mentions(s, d), ["kind", "phrase"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {MENTIONS_SQL} select * from rels")
def q_relations(s: SparkSession, d: str) -> DataFrame:
    return graph.relations(_placed(s, d)).withColumn("pos", F.col("pos").cast("long"))


@query(f"with {BURST_SQL} select subject_idx, kind, phrase, greatest(k, 0) as \"interval\", count(*) n from bins group by all")
def q_nap_histogram(s: SparkSession, d: str) -> DataFrame:
    return burst.nap_histogram(_mentions(s, d), graph.ENTITY, _now(s, d), HOUR)


@query("""with e as (select event_type, epoch_us(ts) / 1e6 t from events), f as (select event_type, min(t) t1, (select max(t) from e) as now from e group by 1),
b as (select event_type, least(cast(floor((t - t1) / 86400) as bigint), greatest(1, cast(ceil((now - t1) / 86400) as bigint)) - 1) k, greatest(1, cast(ceil((now - t1) / 86400) as bigint)) m from e join f using (event_type)),
g as (select event_type, m, unnest(range(m)) k from (select distinct event_type, m from b))
select event_type, array_to_string(list(n order by k), ',') naps from (select g.event_type, g.k, (select count(*) from b where b.event_type = g.event_type and b.k = g.k) n from g) group by 1""")
def q_nap_dense(s: SparkSession, d: str) -> DataFrame:
    found = _event_times(s, d, "event_type")
    dense = burst.dense_histogram(found, ["event_type"], found.agg(F.max("t")).first()[0] or 0.0, 86400.0)
    return dense.select("event_type", F.array_join(F.transform("naps", lambda n: n.cast("string")), ",").alias("naps"))


def _event_times(s: SparkSession, d: str, entity: str) -> DataFrame:
    return _read(s, d, "events").select(entity, text.epoch_seconds("ts").alias("t"))


@query(f"with {BURST_SQL} select subject_idx, kind, phrase, n, t1, round(score, 6) score from burst")
def q_burst_scores(s: SparkSession, d: str) -> DataFrame:
    return burst.burst_scores(_mentions(s, d), graph.ENTITY, _now(s, d), HOUR).select(*graph.ENTITY, "n", "t1", _round("score"))


@query("""with e as (select user_id, epoch_us(ts) / 1e6 t from events), f as (select user_id, min(t) t1, count(*) n, (select max(t) from e) as now from e group by 1),
g as (select *, greatest(1, cast(ceil((now - t1) / 60) as bigint)) m from f),
x as (select user_id, n, m, sum(least(cast(floor((t - t1) / 60) as bigint), m - 1)) x from e join g using (user_id) group by all)
select user_id, n, round(case when m <= 1 then 1.0 else (n * 0.1 + 0.9 * x / (m - 1)) / (n * 1.0 - 0.9 * x / (m - 1)) end, 6) score from x""")
def q_burst_users(s: SparkSession, d: str) -> DataFrame:
    found = _event_times(s, d, "user_id")
    return burst.burst_scores(found, ["user_id"], found.agg(F.max("t")).first()[0] or 0.0).select("user_id", "n", _round("score"))


@query(f"""with {BURST_SQL}, nap as (select subject_idx, kind, phrase, t1, m, now, greatest(k, 0) k, count(*) nap from bins group by all),
w as (select *, case when m <= 1 then 1.0 else 0.1 + 0.9 * k / (m - 1) end w, greatest(1.0, now - t1) life from nap)
select subject_idx, kind, phrase, round(ln(sum(nap / life * w) / sum(life / nap * w)), 5) log_score from w group by all""")
def q_burst_reciprocal(s: SparkSession, d: str) -> DataFrame:
    scored = burst.burst_scores(_mentions(s, d), graph.ENTITY, _now(s, d), HOUR, mode="reciprocal")
    return scored.select(*graph.ENTITY, F.round(F.log("score"), 5).alias("log_score"))


@query(f"with {BURST_SQL} select subject_idx, kind, phrase, n, t1, round(score, 6) score from burst where score >= 1.2")
def q_survivors(s: SparkSession, d: str) -> DataFrame:
    """Scored after the filter that follows from the closed form: fewer than three mentions never reach 1.2."""
    scored = burst.burst_scores(_mentions(s, d), graph.ENTITY, _now(s, d), HOUR, at_least=burst.least_mentions(1.2))
    return burst.survivors(scored, 1.2).select(*graph.ENTITY, "n", "t1", _round("score"))


@query(f"with {BURST_SQL} select case when score < 1 then 'not bursty' when score = 1 then 'verge' else 'bursty' end meaning, count(*) n from burst group by 1")
def q_interpret(s: SparkSession, d: str) -> DataFrame:
    return burst.burst_scores(_mentions(s, d), graph.ENTITY, _now(s, d), HOUR).groupBy(burst.interpret(F.col("score")).alias("meaning")).agg(F.count("*").alias("n"))


@dataclass
class _Left:
    """What is left of the graph at the end of the stream; every part is read from what was written once."""

    placed: DataFrame
    found: DataFrame
    alive: DataFrame
    nodes: DataFrame
    pruned: DataFrame


def _left(s: SparkSession, d: str) -> _Left:
    placed = materialize(_placed(s, d), "placed")
    found = graph.mentions(placed)
    scored = burst.burst_scores(found, graph.ENTITY, _now(s, d), HOUR, at_least=burst.least_mentions(T_D))
    alive = materialize(burst.survivors(scored, T_D), "alive")
    nodes = alive.where("kind = 'node'").select("subject_idx", F.col("phrase").alias("node"), "score")
    return _Left(placed, found, alive, nodes, graph.prune_relations(graph.relations(placed), alive))


def _pairs(left: _Left) -> DataFrame:
    return graph.pair_weights(left.pruned, left.alive.where("kind = 'edge'").select("subject_idx", F.col("phrase").alias("e"), "score"))


def _members(left: _Left) -> DataFrame:
    found = graph.components(left.nodes, materialize(_pairs(left).where("weight > 0"), "pairs"))
    return materialize(found.select("subject_idx", F.col("node").alias("phrase"), F.col("component").alias("cluster")), "members")


@query(f"with {ALIVE_SQL} select subject_idx, kind, phrase, row_number() over (partition by subject_idx, kind order by phrase) - 1 as entity_id from alive")
def q_reindex(s: SparkSession, d: str) -> DataFrame:
    return graph.with_dense_ids(_left(s, d).alive, ["subject_idx", "kind"], "phrase").select(*graph.ENTITY, "entity_id")


@query(f"with {PRUNED_SQL} select * from pruned")
def q_prune_relations(s: SparkSession, d: str) -> DataFrame:
    return _left(s, d).pruned.select("subject_idx", "n1", "e", "n2", "t", "pid", F.col("pos").cast("long").alias("pos"))


@query(f"with {PRUNED_SQL} select subject_idx, a, b, round(weight, 6) weight from pairs")
def q_pair_weights(s: SparkSession, d: str) -> DataFrame:
    return _pairs(_left(s, d)).select("subject_idx", "a", "b", _round("weight"))


_COMPONENTS_SQL = PRUNED_SQL + """,
both_ as (select subject_idx, a u, b v from pairs where weight > 0 union select subject_idx, b, a from pairs where weight > 0),
reach(subject_idx, node, c) as (select subject_idx, phrase, phrase from alive where kind = 'node' union select r.subject_idx, v, c from reach r join both_ on both_.subject_idx = r.subject_idx and u = node),
comp as (select subject_idx, node, min(c) component from reach group by all)"""


@query(f"with recursive {_COMPONENTS_SQL} select * from comp")
def q_components(s: SparkSession, d: str) -> DataFrame:
    return _members(_left(s, d)).select("subject_idx", F.col("phrase").alias("node"), F.col("cluster").alias("component"))


@query(f"with recursive {_COMPONENTS_SQL} select x.component as cluster, p.subject_idx, n1, e, n2, t, pid, pos from pruned p join comp x on x.subject_idx = p.subject_idx and x.node = n1 join comp y on y.subject_idx = p.subject_idx and y.node = n2 and x.component = y.component")
def q_induced_relations(s: SparkSession, d: str) -> DataFrame:
    left = _left(s, d)
    return graph.induced_relations(left.pruned, _members(left)).select("cluster", "subject_idx", "n1", "e", "n2", "t", "pid", F.col("pos").cast("long").alias("pos"))


@query(f"with recursive {_COMPONENTS_SQL} select subject_idx, component as cluster, count(*) n from comp group by all having count(*) >= 2")
def q_min_event_size(s: SparkSession, d: str) -> DataFrame:
    large = events.large_clusters(_members(_left(s, d)), ["subject_idx", "cluster"])
    return large.groupBy("subject_idx", "cluster").agg(F.count("*").alias("n"))


@query(f"""with recursive {_COMPONENTS_SQL}, sc as (select c.subject_idx, component as cluster, avg(score) score from comp c join alive a on a.subject_idx = c.subject_idx and a.kind = 'node' and a.phrase = node group by all having count(*) >= 2)
select subject_idx, cluster, round(score, 6) score, row_number() over (partition by subject_idx order by round(score, 6) desc, cluster) - 1 as event_no from sc""")
def q_event_score(s: SparkSession, d: str) -> DataFrame:
    left = _left(s, d)
    members = events.large_clusters(_members(left), ["subject_idx", "cluster"])
    scored = members.join(left.nodes.withColumnRenamed("node", "phrase"), ["subject_idx", "phrase"])
    per = events.event_scores(scored, ["subject_idx", "cluster"]).withColumn("score", F.round("score", 6))
    return events.ranked_events(per, ["subject_idx"], "cluster").withColumn("event_no", F.col("event_no").cast("long"))


@query(f"""with recursive {_COMPONENTS_SQL}, nn as (select c.subject_idx, component as cluster, node, (select count(*) from men where men.subject_idx = c.subject_idx and kind = 'node' and phrase = node) n from comp c),
r as (select *, row_number() over (partition by subject_idx, cluster order by n desc, node desc) k, count(*) over (partition by subject_idx, cluster) z from nn) select subject_idx, cluster, node as keyword, k as rank from r where k <= 3 and z >= 2""")
def q_keyword_topk(s: SparkSession, d: str) -> DataFrame:
    left = _left(s, d)
    members = events.large_clusters(_members(left), ["subject_idx", "cluster"])
    counts = graph.entities(left.found.where("kind = 'node'")).select("subject_idx", "phrase", F.col("n_mentions").alias("n"))
    nodes = members.join(counts, ["subject_idx", "phrase"]).select("subject_idx", "cluster", F.col("phrase").alias("node"), F.col("phrase").alias("title"), "n")
    return events.top_keywords(nodes, ["subject_idx", "cluster"])


@query(f"""with recursive {_COMPONENTS_SQL}, ps as (select c.subject_idx, c.component as cluster, m.pid from comp c join men m on m.subject_idx = c.subject_idx and m.kind = 'node' and m.phrase = c.node group by all)
select subject_idx, cluster, string_agg(pid::varchar, ',' order by pid) posts from ps group by all""")
def q_event_posts(s: SparkSession, d: str) -> DataFrame:
    """The set of posts of every event."""
    left = _left(s, d)
    held = _members(left).join(left.found.where("kind = 'node'").select("subject_idx", "phrase", "pid"), ["subject_idx", "phrase"])
    posts = held.groupBy("subject_idx", "cluster").agg(F.sort_array(F.collect_set("pid")).alias("posts"))
    return posts.select("subject_idx", "cluster", F.array_join(F.transform("posts", lambda p: p.cast("string")), ",").alias("posts"))


_VECTOR_SQL = """,
names as (select distinct phrase from alive), gr as (select phrase, substr(' ' || phrase || ' ', i, 3) g from (select phrase, unnest(range(1, length(phrase) + 1)) i from names)),
hb as (select phrase, concat('0x', substr(md5(g), 1, 8))::bigint % 64 k, sum(case when concat('0x', substr(md5(g), 9, 1))::bigint % 2 = 1 then 1 else -1 end) w from gr group by all having w <> 0),
un as (select phrase, k, cast(w / sqrt(sum(w * w) over (partition by phrase)) as float)::double w from hb),
big as (select subject_idx, component as cluster, count(*) z from comp group by all having count(*) >= 2),
centre as (select b.subject_idx, b.cluster, k, cast(sum(w) / any_value(z) as float)::double w from big b join comp c on c.subject_idx = b.subject_idx and c.component = b.cluster join un on phrase = node group by all),
far as (select subject_idx, cluster, sqrt(sum(w * w)) l from centre group by all)"""


@query(f"""with recursive {_COMPONENTS_SQL}{_VECTOR_SQL},
ind as (select x.component as cluster, p.subject_idx, n1, e, n2, t, pid, pos from pruned p join comp x on x.subject_idx = p.subject_idx and x.node = n1 join comp y on y.subject_idx = p.subject_idx and y.node = n2 and x.component = y.component),
kinds as (select distinct subject_idx, cluster, n1, e, n2 from ind),
sums as (select subject_idx, cluster, n1, e, n2, k, sum(w) w from (select kinds.*, unnest([n1, e, n2]) phrase from kinds) join un using (phrase) group by all),
sims as (select s.subject_idx, s.cluster, n1, e, n2, sqrt(sum(s.w * s.w)) a, sum(s.w * coalesce(c.w, 0)) dot from sums s left join centre c on c.subject_idx = s.subject_idx and c.cluster = s.cluster and c.k = s.k group by all),
cosines as (select ind.*, round(coalesce(case when a * l > 0 then dot / (a * l) end, 0), 5) sim from ind left join sims using (subject_idx, cluster, n1, e, n2) left join far using (subject_idx, cluster)),
best as (select *, row_number() over (partition by subject_idx, cluster order by sim desc, t, pid, pos) n from cosines)
select subject_idx, cluster, n1 || ' ' || e || ' ' || n2 as title, min(n) as rank from best where n <= 3 group by all""")
def q_title_topk(s: SparkSession, d: str) -> DataFrame:
    """The titles of every event: of its relations the three whose summed vectors are closest to the event's centroid."""
    left = _left(s, d)
    members = _members(left)
    rels = materialize(graph.induced_relations(left.pruned, members), "induced")
    vector = vectors.md5_vectors(left.alive.select("phrase").distinct(), "phrase")
    vector = materialize(vector.select("phrase", vectors.l2_normalise(F.col("vector")).alias("vector")), "phrase-vectors")
    centres = vectors.mean_vectors(members.join(vector, "phrase"), ["subject_idx", "cluster"], to="centre")
    rows = rels.join(centres, ["subject_idx", "cluster"])
    for c in ("n1", "e", "n2"):
        rows = rows.join(vector.select(F.col("phrase").alias(c), F.col("vector").alias(f"v_{c}")), c)
    alike = F.round(F.coalesce(events.relation_similarity(F.col("v_n1"), F.col("v_e"), F.col("v_n2"), F.col("centre")), F.lit(0.0)), 5)
    rows = rows.select("subject_idx", "cluster", F.concat_ws(" ", "n1", "e", "n2").alias("title"), alike.alias("similarity"), F.struct("t", "pid", "pos").alias("seq"))
    return events.top_titles(rows, ["subject_idx", "cluster"])


_FOLD_SQL = MENTIONS_SQL + """,
tick as (select win, max(t) as now, row_number() over (order by win) ord from p group by 1),
few as (select subject_idx, kind, phrase from men group by all having count(*) >= 3),
mw as (select m.subject_idx, m.kind, m.phrase, m.t, ord from men m join few f on f.subject_idx = m.subject_idx and f.kind = m.kind and f.phrase = m.phrase join (select pid, win from p) w using (pid) join tick using (win)),
fold(ord, subject_idx, kind, phrase, born, n, t1, score) as (
  select 0::bigint, 0, '', '', 0::bigint, 0::bigint, 0.0::double, 0.0::double union all
  select * from (select * from (
    select ord, subject_idx, kind, phrase, born, n, t1, case when m <= 1 then 1.0 else (n * 0.1 + 0.9 * x / (m - 1)) / (n * 1.0 - 0.9 * x / (m - 1)) end score from (
      select ord, subject_idx, kind, phrase, born, count(*) n, any_value(first) t1, any_value(m) m, sum(least(floor((t - first) / 3600), m - 1)) x from (
        select c.ord, c.subject_idx, c.kind, c.phrase, c.born, mw.t, min(mw.t) over per as first, greatest(1, ceil((c.now - min(mw.t) over per) / 3600)) m from (
          select tick.ord, tick.now, k.subject_idx, k.kind, k.phrase, min(k.born) born from (select ord + 1 ord, subject_idx, kind, phrase, born from fold where phrase <> '' union all
            select distinct mw.ord, mw.subject_idx, mw.kind, mw.phrase, mw.ord from mw where mw.ord = (select max(ord) + 1 from fold)) k join tick on tick.ord = k.ord group by all) c
        join mw on mw.subject_idx = c.subject_idx and mw.kind = c.kind and mw.phrase = c.phrase and mw.ord between c.born and c.ord
        window per as (partition by c.subject_idx, c.kind, c.phrase)) group by all)) where score >= 1.2
  union all select max(ord) + 1, 0, '', '', 0, 0, 0.0, 0.0 from fold having max(ord) < (select max(ord) from tick)))"""


@query(f"with recursive {_FOLD_SQL} select subject_idx, kind, phrase, win as \"window\", n, t1, round(score, 6) score from fold join tick using (ord) where phrase <> ''")
def q_forgetting_fold(s: SparkSession, d: str) -> DataFrame:
    """Scores of living entities after every window; those below 1.2 are forgotten and may be born again."""
    posts = materialize(_windowed(s, d).select("pid", "dt", "window"), "posts")
    found = _mentions(s, d).join(posts.select("pid", "window"), "pid")
    folded = graph.forgetting_fold(found, materialize(events.window_clock(posts), "clock"), HOUR)
    return folded.select("subject_idx", "kind", "phrase", "window", "n", "t1", _round("score"))


@query(f"with {POSTS_SQL} select win as \"window\", row_number() over (order by win) ordinal, max(t) as now from p group by 1")
def q_window_clock(s: SparkSession, d: str) -> DataFrame:
    return events.window_clock(_windowed(s, d)).select("window", "ordinal", "now")


@query()
def q_louvain(s: SparkSession, d: str) -> DataFrame:
    left = _left(s, d)
    return cluster.cluster_graphs(left.nodes.select("subject_idx", "node"), _pairs(left))


@query(f"with {PRUNED_SQL} select subject_idx, count(*) nodes, 0 as across, true as no_worse from alive where kind = 'node' group by 1")
def q_louvain_sound(s: SparkSession, d: str) -> DataFrame:
    """Of the communities: every node is in one, none spans two components, and modularity is no worse than the components'."""
    left = _left(s, d)
    pairs = materialize(_pairs(left), "pairs")
    whole = graph.components(left.nodes, pairs.where("weight > 0")).withColumnRenamed("component", "whole")
    found = materialize(cluster.cluster_graphs(left.nodes.select("subject_idx", "node"), pairs).join(whole, ["subject_idx", "node"]), "louvain")
    per = found.groupBy("subject_idx", "cluster").agg(F.count("*").alias("n"), (F.count_distinct("whole") > 1).cast("int").alias("across"))
    counts = per.groupBy("subject_idx").agg(F.sum("n").alias("nodes"), F.sum("across").cast("int").alias("across"))
    scores = [graph.modularity(found, pairs, c).withColumnRenamed("modularity", c) for c in ("cluster", "whole")]
    both = scores[0].join(scores[1], "subject_idx").select("subject_idx", (F.col("cluster") >= F.col("whole") - 1e-9).alias("no_worse"))
    return counts.join(both, "subject_idx", "left").select("subject_idx", "nodes", "across", F.coalesce("no_worse", F.lit(True)).alias("no_worse"))


@query()
def q_spectral(s: SparkSession, d: str) -> DataFrame:
    left = _left(s, d)
    return cluster.cluster_graphs(left.nodes.select("subject_idx", "node"), _pairs(left), "spectral", clusters=8)


@query()
def q_hcluster(s: SparkSession, d: str) -> DataFrame:
    left = _left(s, d)
    embed = vectors.hashing_embedder(512)
    return cluster.cluster_graphs(left.nodes.select("subject_idx", "node", embed(F.col("node")).alias("vector")), _pairs(left), "hcluster", distance=0.5)


# -- vectors -----------------------------------------------------------------------------------------------------


@query("""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) l from v)
select vec_id, round(l, 4) length, unnest(range(len(e))) part, unnest(list_transform(e, lambda x: round(cast(x / l as float)::double, 5) + 0.0)) as "value" from n""")
def q_l2_norm(s: SparkSession, d: str) -> DataFrame:
    rows = _read(s, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 4).alias("length"), F.posexplode(vectors.l2_normalise(F.col("embedding"))).alias("part", "value"))
    return rows.select("vec_id", "length", F.col("part").cast("long").alias("part"), (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"))


_CENTRES_SQL = """places as (select label, i, avg(x) x from (select label, unnest(range(len(embedding))) i, unnest(embedding)::double x from embeddings) group by all),
centres as (select label, list(cast(x as float)::double order by i) c from places group by 1),
v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings)"""


@query(f"with {_CENTRES_SQL} select label, i as part, round(cast(x as float)::double, 5) + 0.0 as mean from places")
def q_centroid(s: SparkSession, d: str) -> DataFrame:
    centres = vectors.mean_vectors(_read(s, d, "embeddings"), ["label"], "embedding")
    return centres.select("label", F.posexplode("vector").alias("part", "mean")).select("label", F.col("part").cast("long").alias("part"), (F.round(F.col("mean").cast("double"), 5) + 0.0).alias("mean"))


def _nearest(s: SparkSession, d: str, measure) -> DataFrame:  # noqa: ANN001
    """Each vector's nearest centroid. The centroids are as many as there are labels, so they are broadcast as one array."""
    centres = vectors.mean_vectors(_read(s, d, "embeddings"), ["label"], "embedding").agg(F.array_sort(F.collect_list(F.struct("label", "vector"))).alias("cs"))
    rows = _read(s, d, "embeddings").select("vec_id", "embedding").join(F.broadcast(centres))
    far = F.transform("cs", lambda c: F.struct(F.round(measure(F.col("embedding"), c["vector"]), 6).alias("distance"), c["label"].alias("label")))
    return rows.select("vec_id", F.array_min(far).alias("x")).select("vec_id", "x.label", "x.distance")


@query(f"with {_CENTRES_SQL} select vec_id, arg_min(label, struct_pack(d := dist, l := label)) label, min(dist) distance from (select vec_id, label, round(1 - list_cosine_similarity(e, c), 6) dist from v, centres) group by 1")
def q_cosine_nn(s: SparkSession, d: str) -> DataFrame:
    return _nearest(s, d, lambda a, b: 1 - vectors.cosine(a, b))


@query(f"with {_CENTRES_SQL} select vec_id, arg_min(label, struct_pack(d := dist, l := label)) label, min(dist) distance from (select vec_id, label, round(list_distance(e, c), 6) dist from v, centres) group by 1")
def q_euclid_nn(s: SparkSession, d: str) -> DataFrame:
    return _nearest(s, d, vectors.euclidean)


_GRAM_SQL = """ph as (select distinct unnest(titles) phrase from subject_events), gr as (select phrase, substr(' ' || phrase || ' ', i, 3) g from (select phrase, unnest(range(1, length(phrase) + 1)) i from ph)),
hb as (select phrase, concat('0x', substr(md5(g), 1, 8))::bigint % 64 bucket, case when concat('0x', substr(md5(g), 9, 1))::bigint % 2 = 1 then 1 else -1 end sign from gr)"""


@query(f"with {_GRAM_SQL} select phrase, bucket, cast(sum(sign) as bigint) weight from hb where phrase is not null group by all having sum(sign) <> 0")
def q_hash_embed_md5(s: SparkSession, d: str) -> DataFrame:
    phrases = _read(s, d, "subject_events").select(F.explode("titles").alias("phrase")).distinct()
    return vectors.md5_buckets(phrases, "phrase")


@query()
def q_hash_embed(s: SparkSession, d: str) -> DataFrame:
    """The exact hashing embedder over every title; tested against a plain implementation."""
    phrases = _read(s, d, "subject_events").select(F.explode("titles").alias("phrase")).distinct()
    return phrases.select("phrase", vectors.hashing_embedder(512)(F.col("phrase")).alias("vector"))


@query("select vec_id, k as part, round(sum(x * m) / greatest(sum(m), 1e-9), 5) + 0.0 as mean from (select vec_id, (i % 8) as k, (i // 8) as j, e as x, (case when (i // 8) % 3 = 0 then 0 else 1 end) m from (select vec_id, unnest(range(64)) i, unnest(embedding)::double e from embeddings)) group by all")
def q_masked_mean(s: SparkSession, d: str) -> DataFrame:
    """The 64 places of a vector as the hidden states of eight tokens, every third of them masked out."""
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice("embedding", j * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(j % 3 == 0, 0.0).otherwise(1.0))
    rows = _read(s, d, "embeddings").select("vec_id", vectors.masked_mean(states, mask).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("part", "mean")).select("vec_id", F.col("part").cast("long").alias("part"), (F.round(F.col("mean").cast("double"), 5) + 0.0).alias("mean"))


# -- events and results ------------------------------------------------------------------------------------------


_REGISTRY_SQL = """ev as (select *, row_number() over (order by win, subject_idx, vec_id) i from (
  select vec_id, window_no::bigint win, list_position([{names}], subject) - 1 subject_idx, titles, post_ids, list_transform(vector, lambda x: x::double) v from (select distinct on (vec_id) * from subject_events order by vec_id) where vector is not null)),
fold(i, number, vs, ns) as (
  select 1::bigint, 1::bigint, [v], [1::bigint] from ev where i = 1 union all
  select i, case when far < 12.0 then best else len(vs) + 1 end, case when far < 12.0 then list_transform(vs, lambda c, k: case when k = best then list_transform(c, lambda x, j: (x * ns[k] + v[j]) / (ns[k] + 1)) else c end) else list_append(vs, v) end,
    case when far < 12.0 then list_transform(ns, lambda n, k: case when k = best then n + 1 else n end) else list_append(ns, 1) end
  from (select *, list_position(ds, far) best from (select *, list_min(ds) far from (select e.i, v, vs, ns, list_transform(vs, lambda c: list_distance(c, v)) ds from fold join ev e on e.i = fold.i + 1)))),
numbered as (select ev.*, number from ev join fold using (i))""".replace("{names}", ", ".join(f"'{x}'" for x in subjects.SUBJECTS))


@query(f"""with recursive {_REGISTRY_SQL}
select number as event_number, count(*) as n, string_agg(distinct subject_idx::varchar, ',' order by subject_idx::varchar) subjects, string_agg(distinct win::varchar, ',' order by win::varchar) windows,
(select string_agg(p::varchar, ',' order by p) from (select distinct unnest(post_ids) p from numbered y where y.number = x.number)) posts,
(select string_agg(t, '|' order by t) from (select distinct unnest(titles) t from numbered y where y.number = x.number)) titles from numbered x group by number""")
def q_registry(s: SparkSession, d: str) -> DataFrame:
    """The subject events of the test data merged into global events, in order."""
    text_of = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",")
    posts = F.array_join(F.transform(F.array_sort("post_ids"), lambda x: x.cast("string")), ",")
    titles = F.nullif(F.array_join(F.array_sort(F.filter("titles", lambda x: x.isNotNull())), "|"), F.lit(""))
    return _registered(s, d)[0].select(F.col("event_number").cast("long"), F.col("n").cast("long"), text_of("subjects").alias("subjects"), text_of("windows").alias("windows"), F.nullif(posts, F.lit("")).alias("posts"), titles.alias("titles"))


@query(f"with recursive {_REGISTRY_SQL} select vec_id, number as event_number from numbered")
def q_registry_bridge(s: SparkSession, d: str) -> DataFrame:
    """Which global event took each subject event in."""
    return _registered(s, d)[1].select(F.col("event_no").cast("long").alias("vec_id"), F.col("number").cast("long").alias("event_number"))


def _stored_events(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in subjects.SUBJECTS))
    one = _read(s, d, "subject_events").dropDuplicates(["vec_id"])
    return one.select((F.array_position(names, F.col("subject")) - 1).cast("int").alias("subject_idx"), F.col("window_no").cast("long").alias("window"), F.col("vec_id").cast("int").alias("event_no"), "titles", "post_ids", "vector", "score", "keywords")


def _registered(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return events.register(_stored_events(s, d), 12.0)


@query("""select vec_id, array_to_string(list_filter(titles, lambda x: x <> ''), ' | ') topic, window_no::bigint as "window" from (select distinct on (vec_id) * from subject_events order by vec_id)""")
def q_topics(s: SparkSession, d: str) -> DataFrame:
    rows = _stored_events(s, d)
    return rows.select(F.col("event_no").cast("long").alias("vec_id"), text.joined_nonempty(F.coalesce("titles", F.array().cast("array<string>")), " | ").alias("topic"), "window")


@query(f"""with {POSTS_SQL}, ev as (select distinct w, pid, event_number from (select unnest(windows)::bigint w, post_ids, event_number from final_events), unnest(post_ids) u(pid)),
l as (select w, pid, string_agg(event_number::varchar, ',' order by event_number) ns from ev group by all)
select win as "window", p.pid, coalesce(ns, '0') event_number from p left join l on l.pid = p.pid and l.w = win""")
def q_assignments(s: SparkSession, d: str) -> DataFrame:
    numbered = _read(s, d, "final_events").select(F.explode("windows").alias("window"), "post_ids", F.col("event_number").alias("number")).withColumn("window", F.col("window").cast("long"))
    return results.assignments(_windowed(s, d), numbered)


@query("""select event_number as event, array_to_string(list_sort(subjects), ',') subjects, array_to_string(list_sort(windows), ',') windows, cast(len(post_ids) as bigint) posts, array_to_string(titles[1:10], ' | ') titles from final_events""")
def q_final_report(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in subjects.SUBJECTS))
    finals = _read(s, d, "final_events").withColumn("subjects", F.transform("subjects", lambda x: (F.array_position(names, x) - 1).cast("int")))
    return results.report(finals)


@query("select vec_id, array_to_string(list_distinct_ordered, '|') strings from (select vec_id, list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda z: list_position(a, z[1]) = z[2]), lambda z: z[1]) list_distinct_ordered from (select vec_id, list_concat(coalesce(titles, []), coalesce(keywords, [])) a from (select distinct on (vec_id) * from subject_events order by vec_id)))")
def q_all_strings(s: SparkSession, d: str) -> DataFrame:
    rows = _stored_events(s, d)
    return rows.select(F.col("event_no").cast("long").alias("vec_id"), F.array_join(events.all_strings("titles", "keywords"), "|").alias("strings"))


@query("""select distinct window_no::bigint as "window", trim(unnest(titles)) as title from subject_events where len(list_filter(titles, lambda x: x <> '')) > 0""")
def q_topics_file(s: SparkSession, d: str) -> DataFrame:
    """Topics written as a table of text and scanned again: each title once per window."""
    path = f"{_folder(s, 'topics')}/topics"
    results.save_table(results.topics(_stored_events(s, d)), path)
    return results.scan_topics(s, path).select("window", "title")


@query(f"""with {POSTS_SQL}, ev as (select distinct w, pid, event_number from (select unnest(windows)::bigint w, post_ids, event_number from final_events), unnest(post_ids) u(pid))
select win as "window", p.pid, coalesce(cast(min(event_number) as integer), 0) event_number from p left join ev on ev.pid = p.pid and w = win group by all""")
def q_assignments_file(s: SparkSession, d: str) -> DataFrame:
    """Assignments written with a folder for every window and scanned again: the first event of each post."""
    path = f"{_folder(s, 'assignments')}/assignments"
    results.save_table(q_assignments(s, d), path, "window")
    return results.scan_assignments(s, path).select("window", "pid", "event_number")


@query(f"""with {POSTS_SQL}, tt as (select distinct w::bigint w, t title from (select w, unnest(titles) t from (select unnest(windows) w, titles from final_events))),
x as (select pid, win, coalesce(array_to_string(tokens, ' '), '') txt from p),
named as (select pid, string_agg(distinct title, '|' order by title) title from x join tt on w = win and title <> '' and contains(txt, title) group by pid),
ev as (select distinct w, pid, event_number from (select unnest(windows)::bigint w, post_ids, event_number from final_events), unnest(post_ids) u(pid)),
first as (select p.pid, win, coalesce(cast(min(event_number) as integer), 0) event_number from p left join ev on ev.pid = p.pid and w = win group by all)
select pid as sequence_id, event_number, win as "window", coalesce(title, '') title from first left join named using (pid)""")
def q_standardised(s: SparkSession, d: str) -> DataFrame:
    """Assignments of every post with the titles of its window that stand in its text."""
    numbered = _read(s, d, "final_events").select(F.explode("windows").alias("window"), "post_ids", F.col("event_number").alias("number")).withColumn("window", F.col("window").cast("long"))
    assigned = results.assignments(_windowed(s, d), numbered).select("window", "pid", evaluate.first_number("event_number").alias("event_number"))
    return results.standardised(assigned, q_whole_title_in_text(s, d))


@query("select 'win-' || w || '_tn-0.15_te-0.2_td-' || t || '_ts-2.0_ps-0.5_clu-louvain' as stamp, w::varchar win, t::varchar td from (values ('6', '1.2'), ('12', '1e-05')) v(w, t)")
def q_runs(s: SparkSession, d: str) -> DataFrame:
    """The parameter sets in a folder for which both results exist: a third has topics only."""
    out = _folder(s, "runs")
    some = _stored_events(s, d)
    for o in (Options(window_hours=6), Options(window_hours=12, t_d=1e-5), Options(window_hours=24)):
        results.save_table(results.topics(some), stamped_path(out, "topics", o.stamp()))
        if o.window_hours != 24:
            results.save_table(q_assignments(s, d), stamped_path(out, "assignments", o.stamp()), "window")
    return results.runs(s, out).select("stamp", F.regexp_extract("stamp", "win-([^_]*)", 1).alias("win"), F.regexp_extract("stamp", "_td-([^_]*)", 1).alias("td"))


@query(f"with {SCORES_SQL} select pid, subject_idx, round(cast(score as double), 6) score from scores")
def q_score_cache(s: SparkSession, d: str) -> DataFrame:
    """Scores from a cache: half of the posts are scored first, then all, of which only the other half is computed."""
    path, classifier = f"{_folder(s, 'scores')}/cache", subjects.KeywordClassifier(_lexicon(s, d))
    posts = materialize(_posts(s, d).select("pid", "tokens"), "posts")
    caches.cached_scores(posts.where("pid % 2 = 0"), path, "keyword", classifier.scores)
    return caches.cached_scores(posts, path, "keyword", classifier.scores).select("pid", "subject_idx", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("select distinct phrase, length(phrase)::double as part0, length(replace(phrase, ' ', ''))::double as part1 from (select unnest(titles) phrase from subject_events) where phrase is not null")
def q_embedding_cache(s: SparkSession, d: str) -> DataFrame:
    """Vectors of phrases from a cache; the second call finds all of them there."""
    path = f"{_folder(s, 'embeddings')}/cache"
    embed = lambda c: F.array(F.length(c), F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("array<float>")
    phrases = _read(s, d, "subject_events").select(F.explode("titles").alias("phrase"))
    caches.cached_embeddings(phrases, path, "lengths", embed)
    found = caches.cached_embeddings(phrases, path, "lengths", lambda c: F.array(F.lit(-1.0), F.lit(-1.0)).cast("array<float>"))
    return found.select("phrase", F.col("vector")[0].cast("double").alias("part0"), F.col("vector")[1].cast("double").alias("part1"))


@query("""with w as (select time_bucket(interval 12 hours, dt, timestamp '1970-01-01') as "start", dt from posts) select "start", count(*) n_posts from w
where "start" + interval 12 hours <= (select max(dt) from posts) - interval 2 hours group by 1""")
def q_stream_counts(s: SparkSession, d: str) -> DataFrame:
    """Structured Streaming over the posts: deliveries of every tumbling window, written once the watermark has passed it."""
    folder = _folder(s, "stream")
    schema = _read(s, d, "posts").schema
    posts = streams.read_posts(s, f"{d}/posts.parquet*", schema, 1_000_000)
    job = streams.windowed_counts(posts).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return s.read.schema("start timestamp, n_posts bigint").parquet(f"{folder}/out").select(F.to_timestamp_ntz(F.to_utc_timestamp("start", F.current_timezone()).cast("string")).alias("start"), "n_posts")


# -- evaluation --------------------------------------------------------------------------------------------------


def _system(s: SparkSession, d: str) -> DataFrame:
    """For the posts of the gold standard: the event of the stored final events with the smallest number, and its titles."""
    rows = _read(s, d, "final_events").select(F.explode("post_ids").alias("sequence_id"), F.struct("event_number", "titles").alias("x"))
    return rows.groupBy("sequence_id").agg(F.min(F.struct("x.event_number", "x.titles")).alias("x")).select("sequence_id", "x.event_number", "x.titles")


_SYSTEM_SQL = """sys as (select pid, min(event_number) ev from (select unnest(post_ids) pid, event_number from final_events) group by 1),
g as (select sequence_id, any_value(topics_id) ids, any_value(topics_str) strs from gold where topics_id is not null group by 1),
m as (select sequence_id, trim(string_split(ids, ',')[1]) cls, ids, strs, ev from g join sys on pid = sequence_id),
inn as (select * from m where trim(ids) <> '0')"""


@query(f"""with {_SYSTEM_SQL}, c as (select ev, cls, count(*) n from inn group by all), t as (select n, sum(n) over (partition by ev) z from c)
select round(-sum(n * log2(n / z)) / sum(n), 6) entropy from t""")
def q_entropy_single(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate.in_class(evaluate.matched_samples(_gold(s, d), _system(s, d))).withColumn("cls", F.trim(F.split_part("topics_id", F.lit(","), F.lit(1))))
    return evaluate.entropy_single(rows, "event_number", "cls").select(_round("entropy"))


def _gold(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "gold").where("topics_id is not null").dropDuplicates(["sequence_id"])


@query()
def q_entropy_multi(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate.in_class(evaluate.matched_samples(_gold(s, d), _system(s, d))).select("sequence_id", F.array_distinct(evaluate.label_list("topics_id")).alias("classes"), F.array(F.col("event_number").cast("string")).alias("clusters"))
    return evaluate.entropy(rows, "clusters", "classes", "sequence_id").select(_round("entropy"))


@query(f"""with {_SYSTEM_SQL}, pr as (select unnest(string_split(ids, ',')) i, unnest(string_split(strs, ',')[1:len(string_split(ids, ','))]) t from m where strs is not null),
every as (select max(try_cast(trim(x) as integer)) mx from (select unnest(string_split(ids, ',')) x from m))
select cast(l as integer) as label, coalesce((select string_agg(distinct trim(t), '|' order by trim(t)) from pr where try_cast(trim(i) as integer) = l and trim(t) <> ''), 'WRONGDETECT') titles from (select unnest(range(mx + 1)) l from every)""")
def q_gold_titles(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate.matched_samples(_gold(s, d), _system(s, d))
    return evaluate.gold_titles(rows).select("label", F.array_join("titles", "|").alias("titles"))


@query("""with f as (select event_number, list_sort(list_distinct(list_filter(titles, lambda x: x is not null))) ts from final_events) select l::integer as label, coalesce((select array_to_string(ts, ',') from f where event_number = l), '') merged
from (select unnest(range(max(event_number) + 1)) l from final_events)""")
def q_merged_titles(s: SparkSession, d: str) -> DataFrame:
    return evaluate.merged_titles(_read(s, d, "final_events").select(F.col("event_number").alias("label"), "titles"))


_FIRST = "coalesce(titles[1], '')"  # of a sorted list


@query(f"""with {_SYSTEM_SQL}, pr as (select unnest(string_split(ids, ',')) i, unnest(string_split(strs, ',')[1:len(string_split(ids, ','))]) t from m where strs is not null),
gt as (select l as label, coalesce((select list_sort(list(distinct trim(t))) from pr where try_cast(trim(i) as integer) = l and trim(t) <> ''), ['WRONGDETECT']) titles from (select unnest(range(max(try_cast(trim(x) as integer)) + 1)) l from (select unnest(string_split(ids, ',')) x from m))),
st as (select l as label, coalesce((select list_sort(list_distinct(titles)) from final_events where event_number = l and l in (select ev from inn)), []) titles from (select unnest(range(max(ev) + 1)) l from inn)),
sw as (select label, unnest(string_split(array_to_string(titles, ' '), ' ')) w, len(titles) z from st), gw as (select label, unnest(string_split({_FIRST}, ' ')) w from gt),
sx as (select string_agg(array_to_string(titles, ' '), ' ') x from st), gx as (select string_agg({_FIRST}, ' ') x from gt),
r as (select (select avg(h) from (select label, max(case when z > 0 and w in (select unnest(titles) from gt) then 1 else 0 end) h from sw group by 1)) tp,
(select avg(h) from (select label, max(case when contains(x, w) then 1 else 0 end) h from gw, sx group by 1)) tr,
(select avg(case when contains(x, w) then 1 else 0 end) from sw, gx) kp, (select avg(case when contains(x, w) then 1 else 0 end) from gw, sx) kr)
select round(tp, 6) topic_precision, round(tr, 6) topic_recall, round(case when tp + tr > 0 then 2 * tp * tr / (tp + tr) else 0 end, 6) topic_f1, round(kp, 6) keyword_precision, round(kr, 6) keyword_recall, round(case when kp + kr > 0 then 2 * kp * kr / (kp + kr) else 0 end, 6) keyword_f1 from r""")
def q_topic_keyword_prf(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate.matched_samples(_gold(s, d), _system(s, d))
    inside = evaluate.in_class(rows)
    found = evaluate.topic_scores(evaluate.gold_titles(rows), evaluate.label_titles(inside.select(F.col("event_number").alias("label"), "titles")))
    return found.select(*(_round(c) for c in found.columns))


@query("select sequence_id, topics_id, coalesce(try_cast(trim(string_split(topics_id, ',')[1]) as integer), -1) as event_number from gold")
def q_first_number(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "gold").select("sequence_id", "topics_id", evaluate.first_number("topics_id").alias("event_number"))


@query(f"""with {POSTS_SQL}, tt as (select distinct win w, array_to_string(tokens[1:n], ' ') title from p, (values (1), (2), (3)) v(n) where len(tokens) >= n),
x as (select pid, win, coalesce(array_to_string(tokens, ' '), '') txt from p)
select pid, string_agg(distinct title, '|' order by title) titles from x join tt on w = win and trim(title) <> '' and contains(txt, title) group by pid""")
def q_title_in_text(s: SparkSession, d: str) -> DataFrame:
    """The first word, two and three words of every post as titles of its window, looked for in all texts of the window."""
    posts = materialize(_windowed(s, d).select("pid", "window", "tokens"), "posts")
    heads = posts.select("window", F.explode(F.array(*(F.when(F.size("tokens") >= n, F.concat_ws(" ", F.slice("tokens", 1, n))) for n in (1, 2, 3)))).alias("title"))
    return evaluate.titles_in_text(posts.select("pid", "window", text.text_of("tokens").alias("text")), heads.where("title is not null"))


@query(f"""with {POSTS_SQL}, tt as (select distinct w::bigint w, t title from (select w, unnest(titles) t from (select unnest(windows) w, titles from final_events))),
x as (select pid, win, coalesce(array_to_string(tokens, ' '), '') txt from p)
select pid, string_agg(distinct title, '|' order by title) titles from x join tt on w = win and title <> '' and contains(txt, title) group by pid""")
def q_whole_title_in_text(s: SparkSession, d: str) -> DataFrame:
    """The final events' whole titles, looked for in the texts of their windows."""
    named = _read(s, d, "final_events").select(F.explode("windows").alias("window"), "titles").select(F.col("window").cast("long").alias("window"), F.explode("titles").alias("title"))
    return evaluate.titles_in_text(_windowed(s, d).select("pid", "window", text.text_of("tokens").alias("text")), named)


@query()
def q_evaluate(s: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate(_gold(s, d), _system(s, d))


@query()
def q_pipeline(s: SparkSession, d: str) -> DataFrame:
    """The whole run over all posts with the stored graphs: assignments of every post."""
    run = pipeline.run(_read(s, d, "posts"), subjects.KeywordClassifier(_lexicon(s, d)), Options(ts_seconds=3600, embed_dim_hashing=128), _read(s, d, "kg_store"))
    return run.assignments


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Bursty entities at the end of the stream."""
    return pipeline.bursty_entities(_posts(s, d), _assigned(s, d), _graphs(s, d), Options(ts_seconds=3600))
