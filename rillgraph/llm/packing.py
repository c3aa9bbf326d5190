"""Problem 7: items of varying length into containers of fixed capacity, never split unless longer than the capacity.

Method: length-histogram planning. The numbers of items of each length are planned, not the items: the longest length left
opens a container, the longest that still fits is added again and again, and the resulting pattern is repeated as often as
the counts allow. The plan is a list of ranges of ranks within a length; items take their slots by joining on their rank.
The histogram and the plan have at most as many rows as the capacity has lengths and patterns, however many items there
are. Ranks within a length are counted in two levels (salted parts, then offsets), so one length may be a third of all.

An item longer than the capacity is cut into full containers and a rest, which is placed like any item. Items of no tokens
(null and empty texts) take up no room and lie in container 0. Specs whose capacity is null or below one are left out,
repeated specs count once; without specs or documents there are no rows. Equal lengths are ranked by the hash of the id.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.llm.tokenizer import DEFAULT_TOKENIZER, with_token_counts
from rillgraph.plans.materialize import materialize

#: Items of one length that one task ranks, about.
RANKED_AT_ONCE = 50_000
MAX_SPECS = 1000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots for ``counts`` items of each length (1 to ``capacity``): ``(length, first rank, end, first container, items a
    container)``."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, taken, slots, container = sorted(left), dict.fromkeys(left, 0), [], 0
    while lengths:
        uses: dict[int, int] = {}
        room, at = capacity, len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            if k := min(room // n, left[n]):
                uses[n] = k
                room -= k * n
            at = min(at, bisect_right(lengths, room)) - 1
        times = min(left[n] // k for n, k in uses.items())
        for n, k in uses.items():
            slots.append((n, taken[n], taken[n] + k * times, container, k))
            taken[n] += k * times
            left[n] -= k * times
        container += times
        lengths = [n for n in lengths if left[n]]
    return slots


def pack(documents: DataFrame, specs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, slot_rows: int = 200_000) -> DataFrame:
    """``(spec_id, container, doc_id, piece, start, n_tokens)``: where each document's tokens lie; ``start`` is the piece's
    first token in its document. A plan of more than ``slot_rows`` rows (40 bytes each) is not broadcast."""
    spark = documents.sparkSession
    wanted = {(r.spec_id, r.capacity) for r in specs.where("capacity >= 1").select("spec_id", "capacity").distinct().limit(MAX_SPECS + 1).collect()}
    if len(wanted) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    sized = materialize(with_token_counts(documents, tokenizer), "packing-sizes")
    each = F.array(*(F.struct(F.lit(s).alias("spec_id"), F.lit(int(c)).alias("capacity")) for s, c in sorted(wanted, key=str))) if wanted else F.expr("cast(array() as array<struct<spec_id:int,capacity:int>>)")
    pieces = sized.select("doc_id", "n_tokens", F.explode(each).alias("x")).select("doc_id", "n_tokens", "x.*")
    pieces = pieces.withColumn("piece", F.explode(F.expr("sequence(0L, greatest(cast(ceil(n_tokens / capacity) as bigint) - 1, 0L))")))
    pieces = pieces.withColumn("start", F.expr("piece * capacity")).withColumn("size", F.expr("least(n_tokens - start, cast(capacity as bigint))").cast("int"))
    histogram = pieces.groupBy("spec_id", "capacity", "size").agg(F.count("*").alias("n")).collect()
    slots, salts = [], 1
    for spec_id, capacity in wanted:
        counts = {r["size"]: r["n"] for r in histogram if (r.spec_id, r.capacity) == (spec_id, capacity)}
        salts = max(salts, -(-max(counts.values(), default=1) // RANKED_AT_ONCE))
        slots += [(spec_id, capacity, *s) for s in plan({n: c for n, c in counts.items() if n}, capacity)]
        slots.append((spec_id, capacity, 0, 0, counts.get(0, 0), 0, max(1, counts.get(0, 0))))
    kind = dict(specs.dtypes)["spec_id"]
    n_slots = len(slots)
    slots = spark.createDataFrame(slots, f"spec_id {kind}, capacity int, size int, first long, end long, base long, uses long")
    ranked = _ranked(pieces, salts)
    out = ranked.join(F.broadcast(slots) if n_slots <= slot_rows else slots, ["spec_id", "capacity", "size"]).where("rank >= first and rank < end")
    return out.select("spec_id", F.expr("base + (rank - first) div uses").alias("container"), "doc_id", "piece", "start", F.col("size").cast("long").alias("n_tokens"))


def _ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``rank`` of each piece among those of its spec and size, from 0."""
    by = ["spec_id", "capacity", "size"]
    key = F.xxhash64("doc_id", "piece")
    pieces = pieces.select(*by, "doc_id", "piece", "start", key.alias("key"), F.pmod(key, F.lit(salts)).alias("salt"))
    within = F.row_number().over(Window.partitionBy(*by, "salt").orderBy("key", "doc_id", "piece")) - 1
    if salts == 1:
        return pieces.withColumn("rank", within.cast("long"))
    parts = pieces.groupBy(*by, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return pieces.withColumn("within", within).join(offsets, [*by, "salt"]).withColumn("rank", F.col("within") + F.col("offset"))


def packing_faults(packed: DataFrame, documents: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, documents, overfull, split, broken, wasted)`` of each spec: documents placed; containers beyond their capacity;
    documents in more pieces than they need; documents whose pieces leave out or repeat tokens; and the share of containers
    beyond the fewest that could do."""
    specs = specs.where("capacity >= 1").select("spec_id", "capacity").distinct()
    load = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(specs), "spec_id")
    full = load.groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"), F.count_if(F.col("n") > 0).alias("used"), F.sum("n").alias("tokens"))
    pieces = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end")).join(F.broadcast(specs), "spec_id")
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity")))
    per = pieces.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if(F.col("k") > needed).alias("split"), F.count_if(F.col("end") != F.col("n")).alias("broken"))
    wasted = F.col("used") / F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))) - 1
    return per.join(full, "spec_id").join(F.broadcast(specs), "spec_id").select("spec_id", "documents", "overfull", "split", "broken", wasted.alias("wasted"))


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, capacity, containers, tokens, filled)`` of each spec; ``filled`` is the share of room in use."""
    sums = packed.where("n_tokens > 0").groupBy("spec_id").agg((F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return specs.select("spec_id", "capacity").distinct().join(sums, "spec_id").withColumn("filled", F.expr("tokens / (containers * capacity)"))
