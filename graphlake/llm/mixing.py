"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents form blocks of equal size.  With integer weights w of sum
D (after division by their common divisor), block k of a source may not start
before slot floor(k D / w) and must be done by slot ceil((k + 1) D / w).  Giving
each slot to the released block of earliest deadline meets every deadline on one
channel, so after any number of slots a source is less than one block away from
its share.  The schedule repeats after D slots, so only D slots are ever
computed, by a fold inside one SQL expression; all documents find their slot by
arithmetic on their block's number.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def one_period(spark: SparkSession, weights: list[int], chunk: int = 1024) -> list[int]:
    """The source that owns each slot of one period: earliest deadline first among released blocks.

    The fold goes on from chunk to chunk, so that no array of it is longer than a chunk.
    """
    total = sum(weights)
    w = F.array(*[F.lit(x) for x in weights])

    def slot(state: Column, t: Column) -> Column:
        ready = F.transform(
            F.arrays_zip(state["done"].alias("k"), w.alias("w")),
            lambda x, i: F.when(
                (x["k"] < x["w"]) & (F.floor(x["k"].cast("bigint") * total / x["w"]) <= t),
                F.struct(F.ceil((x["k"].cast("bigint") + 1) * total / x["w"]).alias("deadline"), i.alias("i")),
            ),
        )
        pick = F.array_min(ready)["i"]
        done = F.transform(state["done"], lambda k, i: k + F.when(i == pick, 1).otherwise(0))
        return F.struct(done.alias("done"), F.concat(state["order"], F.array(pick)).alias("order"))

    order: list[int] = []
    done = [0] * len(weights)
    for first in range(0, total, chunk):
        start = F.struct(F.array(*map(F.lit, done)).alias("done"), F.array().cast("array<int>").alias("order"))
        slots = F.sequence(F.lit(first), F.lit(min(first + chunk, total) - 1))
        state = spark.range(1).select(F.aggregate(slots, start, slot).alias("state")).first()["state"]
        done, order = list(state["done"]), order + list(state["order"])
    return order


def plan_phases(spark: SparkSession, weights: list[int], blocks: list[int], max_slots: int = 200_000) -> list[dict]:
    """Phases of the schedule: one ends when a source has no block left; the rest go on at their own ratio.

    Each phase has its first slot, its period's order and, for each source in it, the
    first block and the number of blocks it gives.  Periods of more than ``max_slots``
    together raise before they are computed.
    """
    given, out, start, slots = [0] * len(weights), [], 0, 0
    while True:
        active = [i for i, n in enumerate(blocks) if given[i] < n]
        if not active:
            return out
        divisor = math.gcd(*[weights[i] for i in active])
        own = [weights[i] // divisor for i in active]
        slots += sum(own) if len(active) > 1 else 1
        if slots > max_slots:
            raise ValueError(f"the periods of all phases have more than {max_slots} slots; use coarser weights")
        order = one_period(spark, own) if len(active) > 1 else [0]
        places: list[list[int]] = [[] for _ in active]
        for t, j in enumerate(order):
            places[j].append(t)

        def slot_of(j: int, k: int) -> int:
            return k // own[j] * len(order) + places[j][k % own[j]]

        length = min(slot_of(j, blocks[i] - given[i] - 1) + 1 for j, i in enumerate(active))
        whole, rest = divmod(length, len(order))
        counts = [whole * own[j] + sum(t < rest for t in places[j]) for j in range(len(active))]
        out.append({"start": start, "order": [active[j] for j in order], "first": {i: given[i] for i in active}, "count": dict(zip(active, counts))})
        for j, i in enumerate(active):
            given[i] += counts[j]
        start += length


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal, evaluated inside the engine."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def mix(
    docs: DataFrame,
    weights: dict[str | None, int] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_docs: int = 16,
    max_sources: int = 256,
    max_slots: int = 200_000,
    bucket_docs: int = 1024,
) -> DataFrame:
    """(row struct, source, block, slot, place): every row of ``docs`` with its slot in the mixture.

    The order (slot, place) is the mixture: slots count blocks from 0, places count
    documents inside a block.  ``weights`` gives positive integers per source, the
    null source included; the default is the square root of the sources' sizes,
    scaled to a period of about a thousand slots.  When a source ends, the others keep their ratio, and
    each phase between two ends deviates by less than one block.

    Documents of a source are taken in order of a hash of their columns.  A document's
    number within its source is the total of the earlier buckets of that source
    plus its rank inside its bucket; buckets have about ``bucket_docs`` documents
    whatever the source's size, so no task sorts a whole source.  What is
    broadcast is bounded: the plan by ``max_sources`` squared, the periods by
    ``max_slots``; beyond these bounds the call raises.

    Defined results: the null source is a source of its own; rows that repeat an id
    are documents of their own; a null id is an id; no rows give no rows; the row is
    passed on whole, so names of other columns do not matter.
    """
    spark = docs.sparkSession
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"))
    counted = base.groupBy("source").agg(F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(counted) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["source"]: r["n"] for r in counted}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    if not names:
        return base.select("row", "source", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("place"))
    if weights is None:
        # a period of about a thousand slots, fewer if the periods of many sources would pass max_slots
        total, roots = max(2 * len(names), min(1000, max_slots // (2 * len(names)))), {s: math.sqrt(sizes[s]) for s in names}
        weights = {s: max(1, round(total * roots[s] / sum(roots.values()))) for s in names}
    if any(int(weights.get(s, 0)) < 1 for s in names):
        raise ValueError("each source needs a positive integer weight")
    blocks = [-(-sizes[s] // block_docs) for s in names]
    phases = plan_phases(spark, [int(weights[s]) for s in names], blocks, max_slots)

    per_source = _table(spark, [{"source": s, "no": i, "buckets": -(-sizes[s] // bucket_docs)} for i, s in enumerate(names)], "source string, no int, buckets bigint")
    plan, periods = [], []
    for p, phase in enumerate(phases):
        nth = dict.fromkeys(phase["first"], 0)
        for t, i in enumerate(phase["order"]):
            periods.append({"no": i, "phase": p, "k": nth[i], "at": t})
            nth[i] += 1
        plan += [{"no": i, "phase": p, "first": first, "last": first + phase["count"][i], "own": nth[i], "size": len(phase["order"]), "start": phase["start"]} for i, first in phase["first"].items() if phase["count"][i]]
    plan_table = _table(spark, plan, "no int, phase int, first bigint, last bigint, own bigint, size bigint, start bigint")
    period_table = _table(spark, periods, "no int, phase int, k bigint, at bigint")

    same = base["source"].eqNullSafe(per_source["source"])
    # the place of a row in its source: by a hash of its id and its other columns, so that rows that repeat an id are spread too
    hashable = [F.col("row")[c] for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    keyed = base.join(F.broadcast(per_source), same).select("row", "id", base["source"].alias("source"), "no", F.xxhash64("id", *hashable).alias("hash"), "buckets")
    keyed = keyed.withColumn("bucket", F.pmod("hash", "buckets")).drop("buckets")
    # totals of the earlier buckets, in two levels, so that no task sums all buckets of a source
    sizes_of = keyed.groupBy("no", "bucket").agg(F.count("*").alias("n")).withColumn("shelf", F.floor(F.col("bucket") / 1024))
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    shelves = sizes_of.groupBy("no", "shelf").agg(F.sum("n").alias("n")).withColumn("lead", F.coalesce(F.sum("n").over(ahead("no", "shelf")), F.lit(0)))
    inner = sizes_of.withColumn("inner", F.coalesce(F.sum("n").over(ahead("no", "shelf", "bucket")), F.lit(0)))
    before = inner.join(shelves.select("no", "shelf", "lead"), ["no", "shelf"]).select("no", "bucket", (F.col("lead") + F.col("inner")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("no", "bucket").orderBy("hash", "id"))
    numbered = keyed.withColumn("rank", rank).join(before, ["no", "bucket"]).withColumn("nth", F.col("before") + F.col("rank") - 1)
    placed = numbered.select("row", "source", "no", F.floor(F.col("nth") / block_docs).alias("block"), (F.col("nth") % block_docs).alias("place"))
    p = plan_table.alias("p")
    inside = (placed["no"] == F.col("p.no")) & (placed["block"] >= F.col("p.first")) & (placed["block"] < F.col("p.last"))
    placed = placed.join(F.broadcast(p), inside).select(
        "row", "source", placed["no"].alias("no"), "block", "place", F.col("p.phase").alias("phase"), F.col("p.start").alias("start"), F.col("p.size").alias("size"),
        F.floor((F.col("block") - F.col("p.first")) / F.col("p.own")).alias("turn"), ((F.col("block") - F.col("p.first")) % F.col("p.own")).alias("k"),
    )
    placed = placed.join(F.broadcast(period_table), ["no", "phase", "k"])
    return placed.select("row", "source", "block", (F.col("start") + F.col("turn") * F.col("size") + F.col("at")).alias("slot"), "place")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select(F.col("row.doc_id").alias("doc_id"), "source", "block", "slot", "place")
