"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's hash puts it into one of some thousands of slots, for good.  Which
shard a slot belongs to says a small table, the slot map.  The bytes of each slot are added up;
rebalancing edits the map: it moves slots, or swaps two, between the fullest and the
emptiest shard until sizes are near equal.  Each edit makes a new version, and a
version is stored as the slots that it changed.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, literal_table

MAP_SCHEMA = "version int, slot int, shard int, parent int"


class SlotMap:
    """Shard of every slot, by versions.  ``parent`` tells of which slot a slot was split off."""

    def __init__(self, shards: int, slots: int):
        self.shards, self.slots, self.version = shards, slots, 1
        self.shard = {s: s % shards for s in range(slots)}
        self.parent: dict[int, int] = {}
        self.edits = [{"version": 1, "slot": s, "shard": t, "parent": None} for s, t in self.shard.items()]

    @classmethod
    def load(cls, rows: list, version: int | None = None) -> "SlotMap":
        """The map as of a version, the latest by default, from rows of MAP_SCHEMA."""
        rows = sorted((r for r in rows if version is None or r["version"] <= version), key=lambda r: r["version"])
        out = cls(1, 0)
        out.shard, out.parent = {r["slot"]: r["shard"] for r in rows}, {r["slot"]: r["parent"] for r in rows if r["parent"] is not None}
        out.slots, out.shards, out.version = len(out.shard) - len(out.parent), max(out.shard.values()) + 1, rows[-1]["version"]
        out.edits = []
        return out

    def _edit(self, changed: dict[int, int]) -> None:
        """A new version, if the shards of any slots differ."""
        changed = {s: t for s, t in changed.items() if self.shard.get(s) != t}
        if changed:
            self.version += 1
            self.shard |= changed
            self.edits += [{"version": self.version, "slot": s, "shard": t, "parent": self.parent.get(s)} for s, t in sorted(changed.items())]

    def parts(self) -> dict[int, list[int]]:
        """The slots that each split slot was cut into."""
        out: dict[int, list[int]] = {}
        for slot in sorted(self.parent):
            out.setdefault(self.parent[slot], []).append(slot)
        return out

    def split(self, weight: dict[int, tuple[int, int]], share: int = 8, fine: int = 64) -> None:
        """Cut slots of more than an eighth of a shard (bytes, rows) into pieces of about a 64th; a slot that is cut already stays."""
        total = sum(b for b, _ in weight.values())
        cut, changed = self.parts(), {}
        for slot in sorted(weight):
            size, rows = weight[slot]
            if slot not in cut and rows > 1 and size * self.shards * share > total:
                for _ in range(min(rows, -(-size * self.shards * fine // total))):
                    piece = self.slots + len(self.parent)
                    self.parent[piece] = slot
                    changed[piece] = piece % self.shards
        self._edit(changed)

    def rebalance(self, weight: dict[int, int], spread: float = 0.001, most_steps: int = 20_000) -> None:
        """Move or swap slots between a fuller and an emptier shard until any two differ by ``spread`` of the mean, or nothing helps.

        Each step takes the fullest and the emptiest shard, or the next ones where these can't be helped: a
        record larger than a shard's share fills its shard, and the others are still made equal.
        """
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, size in weight.items():
            held[self.shard[slot]].append((size, slot))
        for one in held:
            one.sort()
        size = [sum(b for b, _ in one) for one in held]
        enough, changed = spread * sum(size) / self.shards, {}
        for _ in range(most_steps):
            order = sorted(range(self.shards), key=lambda i: (size[i], i))
            pairs = ((full, low) for full in reversed(order) for low in order if size[full] - size[low] > enough)
            step = next(((full, low, best) for full, low in pairs if (best := _better(held[full], held[low], size[full] - size[low]))), None)
            if step is None:
                break
            full, low, (i, j) = step
            given, taken = held[full].pop(i), held[low].pop(j) if j is not None else None
            for to, one in ((low, given), (full, taken)):
                if one is not None:
                    bisect.insort(held[to], one)
                    changed[one[1]] = to
            moved = given[0] - (taken[0] if taken else 0)
            size[full] -= moved
            size[low] += moved
        self._edit(changed)

    def grow(self, weight: dict[int, int]) -> None:
        """One more shard, filled to its share from the fullest shards; slots move into it alone."""
        new, self.shards = self.shards, self.shards + 1
        held: list[list[tuple[int, int]]] = [[] for _ in range(new)]
        for slot, size in weight.items():
            held[self.shard[slot]].append((size, slot))
        for one in held:
            one.sort()
        size, want, changed, got = [sum(b for b, _ in one) for one in held], sum(weight.values()) / self.shards, {}, 0
        while got < want:
            full = max(range(new), key=lambda i: (size[i], -i))
            room = max(0, min(want - got, size[full] - want))
            near = [i for i in _about(held[full], room) if 0 < held[full][i][0] <= max(room, 2 * (want - got))]
            if not near:
                break
            given = held[full].pop(min(near, key=lambda i: (abs(held[full][i][0] - room), i)))
            size[full] -= given[0]
            got += given[0]
            changed[given[1]] = new
        if not changed and self.shard:
            changed[min(self.shard)] = new
        self._edit(changed)


def _better(full: list[tuple[int, int]], low: list[tuple[int, int]], gap: int) -> tuple[int, int | None] | None:
    """What to move, as places in the two shards: the slot nearest to half the gap, or two to swap where no slot is near; None where nothing helps."""
    best = min(((abs(2 * full[i][0] - gap), i, None) for i in _about(full, gap / 2) if 0 < full[i][0] < gap), default=None)
    if best is None or best[0] * 8 > gap:
        for j, (there, _) in enumerate(low):
            for i in _about(full, there + gap / 2):
                moved = full[i][0] - there
                if 0 < moved < gap and (best is None or abs(2 * moved - gap) < best[0]):
                    best = abs(2 * moved - gap), i, j
    return best[1:] if best else None


def _about(sizes: list[tuple[int, int]], value: float) -> range:
    """Places of the entries next below and above a size."""
    at = bisect.bisect_left(sizes, (value, -1))
    return range(max(0, at - 1), min(len(sizes), at + 1))


def records(docs: DataFrame, slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, home): sizes in bytes of UTF-8 and 16 more, and the slot by a hash of the id and the text's checksum and size."""
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    out = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return out.withColumn("home", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_of(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """``rows`` with ``slot``: the home, or one of the slots into which it was cut, by the row's place in its written file."""
    cut = slot_map.parts()
    at = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    rows = rows.select("*", at.alias("at"))
    if not cut:
        return rows.withColumn("slot", F.col("home"))
    table = literal_table(rows.sparkSession, [{"home": home, "pieces": pieces} for home, pieces in cut.items()], "home int, pieces array<int>")
    piece = F.get("pieces", F.pmod(F.col("at"), F.size("pieces").cast("bigint")).cast("int"))
    return rows.join(F.broadcast(table), "home", "left").withColumn("slot", F.coalesce(piece, F.col("home"))).drop("pieces")


def weights(rows: DataFrame, slot: str | Column) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every slot that has rows; their number is bounded by the map's."""
    found = rows.groupBy(F.col(slot).alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {r["slot"]: (int(r["bytes"]), r["rows"]) for r in found}


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    return SlotMap.load(spark.read.schema(MAP_SCHEMA).parquet(path).collect(), version)


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append the versions made since the map was loaded or stored."""
    if slot_map.edits:
        literal_table(spark, slot_map.edits, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        slot_map.edits = []


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = 4096,
    spread: float = 0.001,
    map_path: str | None = None,
    known: SlotMap | None = None,
    bucket_rows: int = 1024,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) for every row.

    The law is ``bytes``: sizes of shards are near equal.  ``slot`` is the row's place in its shard, gapless
    from 0; ``virtual_slot`` is what the map places.  ``grown_shard`` is null under this law.

    One scan of the texts writes (id, size, checksum, home), which is all that is
    read later.  Bytes are added up by slot, in each task first.  The driver edits
    the map of at most ``slots`` entries and some for slots that were cut: a slot of more than an eighth of
    a shard, such as one of very many rows equal in id and text, is cut into slots by the rows'
    places in the written table.  ``known`` is a map to edit instead of a new one (slots moved are few
    then); with more ``shards`` than it has it grows.  Versions are appended to ``map_path``, by default a table of the scratch folder.

    Places are numbered in buckets of about ``bucket_rows`` rows of a slot: rows
    of the shard's earlier slots, of the slot's earlier buckets, and the rank in the bucket.  No task sorts a shard or a slot.

    Shards are the same in every run but for rows of slots that were cut, which, like places, follow the rows' places in the written table.

    Defined results: null text has no bytes (checksum 0); null and repeated ids are
    records of their own; no rows give no rows; a record larger than a shard's share
    leaves its shard that much fuller; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    slot_map = known or SlotMap(shards, slots)
    if slot_map.shards > shards:
        raise ValueError(f"the map has {slot_map.shards} shards, more than {shards}")
    rows = scratch.keep(records(docs, slot_map.slots, id_col, text_col), "records")
    by_home = weights(rows, "home")
    if any(b for b, _ in by_home.values()):
        slot_map.split(by_home)
    placed = slot_of(rows, slot_map)
    by_slot = weights(placed, "slot") if slot_map.parent else by_home
    while slot_map.shards < shards:
        slot_map.grow({s: b for s, (b, _) in by_slot.items()})
    slot_map.rebalance({s: b for s, (b, _) in by_slot.items()}, spread)
    store_map(spark, slot_map, map_path or scratch.path("slot-map"))

    lead, plan = [0] * shards, []
    for s in sorted(by_slot):
        n, to = by_slot[s][1], slot_map.shard[s]
        plan.append({"slot": s, "shard": to, "lead": lead[to], "buckets": -(-n // bucket_rows)})
        lead[to] += n
    plan_table = literal_table(spark, plan, "slot int, shard int, lead bigint, buckets bigint")
    placed = placed.join(F.broadcast(plan_table), "slot").withColumn("bucket", F.pmod(F.xxhash64("at", F.lit(1)), F.col("buckets")))
    counts = placed.groupBy("slot", "bucket").agg(F.count("*").alias("n"))
    ahead = counts.select("slot", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("slot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("slot", "bucket").orderBy("at", "doc_id")))
    return ranked.join(ahead, ["slot", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("lead") + F.col("ahead") + F.col("rank") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"), F.lit(slot_map.version).alias("map_version"),
    )


def op13_shard(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
