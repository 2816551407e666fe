"""The supplied tables read as a property graph.

region and nation are nested spaces; a supplier provides, a customer consumes;
an order is a flow of its customer, a line a step of it; a part is the interface
or table that a step uses.  The kind of use comes from the line's flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids


#: Bytes that a byte of a table's files may hold once it is read.
COMPRESSION = 100
#: Rows of a table that one task takes where they are dealt by key.
ROWS_PER_TASK = 400_000


def sized(spark: SparkSession) -> None:
    """Let the planner take tables for what they hold, where the session says nothing of it.

    Files of keys and repeated texts are a fiftieth of their rows and less.  By the files' size alone millions of
    rows would be broadcast through the driver; a side that may be small is broadcast once a shuffle has measured it.
    """
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor, "1.0")) == 1:
        spark.conf.set(factor, str(float(COMPRESSION)))


class Tables:
    """The tables of one folder, read on first use; column pruning and filters reach the scans."""

    def __init__(self, spark: SparkSession, folder: str):
        sized(spark)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Into how many parts the rows of a table are dealt, by its row count, which its files tell.

        Parts that are sized by shuffled bytes hold millions of rows where those compress well; the memory of a task grows with them.
        """
        rows = getattr(self, name).count()
        return max(-(-rows // ROWS_PER_TASK), min(self.spark.sparkContext.defaultParallelism, -(-rows // (ROWS_PER_TASK // 20))), 1)


def uses(t: Tables) -> DataFrame:
    """(flow, part, supplier, type, line, quantity): a step's use of a part."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kind = F.when(flag == "R", "READS_FROM").when(flag == "A", "WRITES_TO").when(status == "O", "PRODUCES").otherwise("CONSUMES")
    return t.lineitem.select(F.col("l_orderkey").alias("flow"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), kind.alias("type"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))


def steps(t: Tables) -> DataFrame:
    """(flow, ord, part, type): steps numbered within their flow; (order, line number) is not unique, so all columns decide."""
    w = Window.partitionBy("flow").orderBy("line", "part", "supplier", "type", "quantity")
    return uses(t).repartition(t.parts("lineitem"), "flow").select("flow", "part", "type", F.row_number().over(w).alias("ord"))


def providers(t: Tables) -> DataFrame:
    """(part, app): the one application that exposes a part."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("part")).agg(F.min("l_suppkey").alias("app"))


def channel_uses(t: Tables) -> DataFrame:
    """(channel, role, flow)."""
    role = F.when(F.col("type") == "PRODUCES", "produces").when(F.col("type") == "CONSUMES", "consumes")
    return uses(t).select(F.col("part").alias("channel"), role.alias("role"), "flow").where("role is not null")


def flow_edges(t: Tables) -> DataFrame:
    """(src, dst): a flow that produces a part leads to the flows that the part starts."""
    u = channel_uses(t).distinct()
    made = u.where("role = 'produces'").select("channel", F.col("flow").alias("src"))
    begun = u.where("role = 'consumes'").select("channel", F.col("flow").alias("dst"))
    return made.join(begun, "channel").where("src <> dst").select("src", "dst").distinct()


def containment(t: Tables) -> DataFrame:
    """(node, parent): organization, region, nation, supplier and customer."""
    region = t.region.select(ids.space(F.concat(F.lit("r"), F.col("r_regionkey"))).alias("node"), ids.organization(F.lit(1)).alias("parent"))
    nation = t.nation.select(ids.space(F.concat(F.lit("n"), F.col("n_nationkey"))).alias("node"), ids.space(F.concat(F.lit("r"), F.col("n_regionkey"))).alias("parent"))
    supplier = t.supplier.select(ids.application(F.concat(F.lit("s"), F.col("s_suppkey"))).alias("node"), ids.space(F.concat(F.lit("n"), F.col("s_nationkey"))).alias("parent"))
    customer = t.customer.select(ids.application(F.concat(F.lit("c"), F.col("c_custkey"))).alias("node"), ids.space(F.concat(F.lit("n"), F.col("c_nationkey"))).alias("parent"))
    return region.unionByName(nation).unionByName(supplier).unionByName(customer)


def nodes(t: Tables) -> DataFrame:
    """(id, labels, name)."""
    make = lambda df, key, name, *labels: df.select(key.alias("id"), F.array(*map(F.lit, labels)).alias("labels"), name.alias("name"))
    return (
        make(t.region, ids.space(F.concat(F.lit("r"), F.col("r_regionkey"))), F.col("r_name"), "Space", "Region")
        .unionByName(make(t.nation, ids.space(F.concat(F.lit("n"), F.col("n_nationkey"))), F.col("n_name"), "Space", "Nation"))
        .unionByName(make(t.supplier, ids.application(F.concat(F.lit("s"), F.col("s_suppkey"))), F.col("s_name"), "Application", "Provider"))
        .unionByName(make(t.customer, ids.application(F.concat(F.lit("c"), F.col("c_custkey"))), F.col("c_name"), "Application", "Consumer"))
        .unionByName(make(t.part, ids.channel(F.lit("Topic"), F.col("p_partkey").cast("string")), F.col("p_name"), "Interface", "Topic"))
    )
