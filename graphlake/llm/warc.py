"""WARC records and a Merkle fixity audit of two replicas.

Records are hashed with their place; records that begin in one range of offsets
form a leaf range, ranges form a tree per archive, archives a tree over prefixes
of their names' hashes, up to one root.  An audit compares roots and reads, level
by level, only the children of nodes that differ, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Hex digits of an archive's name hash at each level above the archives, the root last.
PREFIXES = (4, 3, 2, 1, 0)


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC response record; nulls are empty."""
    payload = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_archive: int = 512, carry: dict[str, Column] | None = None) -> DataFrame:
    """(archive, offset, length, digest, page_id, *carry) of every page's record in its archive.

    Archives hold the ids of one span of ``per_archive``; rows without an id go to
    archives by a hash of their record.  Within an archive records stand by id, then
    url, then digest.  Rows that repeat an id are records of their own; ``carry`` adds
    expressions over ``pages``.
    """
    carry = carry or {}
    text = record_text(pages[id_col], pages[url_col], pages[html_col])
    by_id = F.concat(F.lit("pages-"), F.floor(pages[id_col] / per_archive).cast("string"))
    archive = F.coalesce(by_id, F.concat(F.lit("urls-"), F.pmod(F.xxhash64(pages[url_col], pages[html_col]), F.lit(4096)).cast("string")))
    rows = pages.select(archive.alias("archive"), pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.octet_length(text).cast("bigint").alias("length"), F.sha2(text, 256).alias("digest"), *[c.alias(name) for name, c in carry.items()])
    before = Window.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("archive", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest", "page_id", *carry)


def _joined(hashes: str, order: str) -> Column:
    """Hash of the hashes of a group, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(hashes).alias("h"))))
    return F.sha2(F.concat_ws(",", F.transform(rows, lambda r: F.concat_ws(":", r["o"].cast("string"), r["h"]))), 256)


class MerkleTree:
    """The levels of one replica's tree, each a written table (archive, key, parent, hash)."""

    def __init__(self, scratch: Scratch, records: DataFrame, range_bytes: int, fanout: int):
        self.records = scratch.keep(
            records.select("archive", "offset", "length", "digest", F.floor(F.col("offset") / range_bytes).alias("key")).withColumn(
                "leaf", F.sha2(F.concat_ws(":", F.col("length").cast("string"), "digest"), 256)
            ),
            "records",
        )
        ranges = self.records.groupBy("archive", "key").agg(_joined("leaf", "offset").alias("hash"))
        #: Range levels, bottom first, then prefix levels, the root last.
        self.levels = [scratch.keep(ranges, "ranges")]
        top = self.levels[0].agg(F.max("key")).first()[0] or 0
        while top > 0:
            up = self.levels[-1].select("archive", F.floor(F.col("key") / fanout).alias("up"), "key", "hash").groupBy("archive", F.col("up").alias("key")).agg(_joined("hash", "key").alias("hash"))
            self.levels.append(scratch.keep(up, "ranges"))
            top //= fanout
        self.fanout, self.depth = fanout, len(self.levels)
        archives = self.levels[-1].select("archive", "hash").withColumn("name", F.sha2("archive", 256))
        self.prefixes = []
        rows = archives.select(F.substring("name", 1, PREFIXES[0]).alias("prefix"), F.col("archive").alias("child"), "hash")
        for n, digits in enumerate(PREFIXES):
            level = scratch.keep(rows.groupBy("prefix").agg(_joined("hash", "child").alias("hash")), "prefixes")
            self.prefixes.append(level)
            if n + 1 < len(PREFIXES):
                rows = level.select(F.substring("prefix", 1, PREFIXES[n + 1]).alias("prefix"), F.col("prefix").alias("child"), "hash")


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """(archive, offset, length, status) of records that differ between two replicas.

    Both inputs have (archive, offset, length, digest), by the index the archives were
    written with.  ``status`` is ``changed``, ``missing`` (not in ``replica``) or
    ``extra``; ``length`` is the primary's, or the replica's for ``extra``.  Rows
    repeated at one offset are one record if equal; two different records at one
    offset are compared as sets.  Null digests are values.  Equal roots end the
    audit at once.  A leaf range holds what begins within ``range_bytes``, an
    inner node ``fanout`` children, so no node's list grows with the data.
    """
    spark = primary.sparkSession
    scratch = Scratch(spark, "merkle")

    def clean(df: DataFrame) -> DataFrame:
        return df.select("archive", F.col("offset").cast("bigint"), F.col("length").cast("bigint"), F.coalesce("digest", F.lit("")).alias("digest")).distinct()

    a, b = (MerkleTree(scratch, clean(x), range_bytes, fanout) for x in (primary, replica))
    names = "archive string, offset bigint, length bigint, status string"
    roots = [t.prefixes[-1].select("hash").collect() for t in (a, b)]
    if roots[0] == roots[1]:
        return spark.createDataFrame([], names)

    def unlike(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        """Keys whose hashes differ or that one side lacks."""
        y = y.withColumnRenamed("hash", "hash2")
        return x.join(y, on, "full_outer").where(~F.col("hash").eqNullSafe(F.col("hash2"))).select(*on)

    # prefixes, root downwards
    bad = None
    for n in range(len(PREFIXES) - 1, -1, -1):
        x, y = a.prefixes[n], b.prefixes[n]
        if bad is not None:
            up = F.substring("prefix", 1, PREFIXES[n + 1])
            x, y = (t.join(bad.withColumnRenamed("prefix", "_up"), up == F.col("_up"), "left_semi") for t in (x, y))
        bad = scratch.keep(unlike(x, y, ["prefix"]), "bad")
    # archives, then ranges downwards; trees of unequal depth have no level in common above the lower one
    depth = max(a.depth, b.depth)

    def level(t: MerkleTree, n: int) -> DataFrame:
        if n < t.depth:
            return t.levels[n]
        return t.levels[-1].select("archive", F.floor(F.col("key") / t.fanout ** (n - t.depth + 1)).alias("key"), F.sha2(F.concat_ws("^", F.col("hash"), F.lit(n)), 256).alias("hash"))

    prefix = F.substring(F.sha2("archive", 256), 1, PREFIXES[0])
    ranges = None
    for n in range(depth - 1, -1, -1):
        x, y = level(a, n), level(b, n)
        if ranges is None:
            x, y = (t.join(bad, prefix == F.col("prefix"), "left_semi") for t in (x, y))
        else:
            up = ranges.select(F.col("archive").alias("_archive"), F.col("key").alias("_key"))
            x, y = (t.join(up, (F.col("archive") == F.col("_archive")) & (F.floor(F.col("key") / fanout) == F.col("_key")), "left_semi") for t in (x, y))
        ranges = scratch.keep(unlike(x, y, ["archive", "key"]), "bad")
    x, y = (t.records.join(ranges, ["archive", "key"], "left_semi").groupBy("archive", "offset").agg(F.max("length").alias("length"), F.array_sort(F.collect_set("leaf")).alias("leaf")) for t in (a, b))
    y = y.select("archive", "offset", F.col("length").alias("length2"), F.col("leaf").alias("leaf2"))
    found = x.join(y, ["archive", "offset"], "full_outer").where(~F.col("leaf").eqNullSafe(F.col("leaf2")))
    status = F.when(F.col("leaf").isNull(), "extra").when(F.col("leaf2").isNull(), "missing").otherwise("changed")
    return found.select("archive", "offset", F.coalesce("length", "length2").alias("length"), status.alias("status"))


def damage(page_id: Column, html: Column) -> tuple[Column, Column]:
    """A second replica's known faults: whether a record is lost, and its text; of 97 consecutive ids one has its first character overwritten, one is lost."""
    kind = F.pmod(page_id, F.lit(97))
    changed = F.when((kind == 13) & (F.length(html) > 0), F.concat(F.lit("\u0001"), F.substring(html, 2, 2**31 - 1))).otherwise(html)
    return F.coalesce(kind == 29, F.lit(False)), changed


def op4_merkle_audit(spark, sf_dir: str) -> DataFrame:
    return audit_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def audit_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, archive, offset, length, status): the audit of pages against their damaged replica, which the primary's index reads: same places, its own bytes."""
    lost, html = damage(pages["page_id"], pages["html"])
    both = index(pages, carry={"lost": lost, "digest2": F.sha2(record_text(pages["page_id"], pages["url"], html), 256)})
    both = Scratch(pages.sparkSession, "replicas").keep(both, "index")
    replica = both.where("not lost").select("archive", "offset", "length", F.col("digest2").alias("digest"))
    found = audit(both.select("archive", "offset", "length", "digest"), replica)
    return found.join(both.select("archive", "offset", "page_id"), ["archive", "offset"], "left").select("page_id", "archive", "offset", "length", "status")


ORACLE_SQL = r"""
with r as (
  select page_id, html, 'pages-' || cast(cast(floor(page_id / 512.0) as bigint) as varchar) as archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || cast(page_id as varchar) || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || cast(strlen(coalesce(html, '')) as varchar)
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages
), i as (
  select page_id, html, archive, strlen(record) as length,
    cast(coalesce(sum(strlen(record)) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
  from r
)
select page_id, archive, "offset", length, case when page_id % 97 = 29 then 'missing' else 'changed' end as status
from i where page_id % 97 = 29 or (page_id % 97 = 13 and length(html) > 0 and html[1] <> chr(1))
"""
