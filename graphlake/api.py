"""The graph's answers as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, search, state


class Graph:
    """Queries over ``nodes`` (id, labels, name) and ``edges`` (type, src, dst)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def stats(self) -> DataFrame:
        labels = self.nodes.select(F.explode("labels").alias("name")).groupBy("name").count().withColumn("kind", F.lit("label"))
        return labels.unionByName(self.edges.groupBy(F.col("type").alias("name")).count().withColumn("kind", F.lit("edge")))

    def resolve(self, ref: str) -> DataFrame:
        """The node of that id, else of that name with the shortest id; one row at most."""
        by_id = self.nodes.where(F.col("id") == ref).withColumn("rank", F.lit(0))
        by_name = self.nodes.where(F.col("name") == ref).withColumn("rank", F.lit(1))
        return by_id.unionByName(by_name).orderBy("rank", F.length("id"), "id").limit(1).drop("rank")

    def search(self, query: str, limit: int = 20, within: str | None = None) -> DataFrame:
        """Nodes by score, with the words kept and dropped; ``within`` names a node that contains those asked for."""
        words, ignored = search.query_words(query)
        named = self.nodes
        if within is not None:
            scope = self.resolve(within).select(F.col("id").alias("node"))
            inside = graph.reach(self.edges.where("type = 'CONTAINS'").select("src", "dst"), scope).select(F.col("node").alias("id"))
            named = named.join(inside, "id", "left_semi")
        levels = self.nodes.where(F.arrays_overlap("labels", F.array(F.lit("Application"), F.lit("Space")))).select("id")
        hits = search.search(search.index(named, "id", "name"), words, levels=levels)
        hits = hits.withColumn("dropped", F.concat_ws(" ", F.nullif("dropped", F.lit("")), *map(F.lit, ignored)))
        return hits.join(self.nodes, "id").orderBy("level", F.desc("score"), "id").limit(limit)

    def node(self, ref: str, most: int = 400) -> DataFrame:
        """Neighbours of a node: direction, type, other node."""
        one = self.resolve(ref).select(F.col("id").alias("_id"))
        into = self.edges.join(F.broadcast(one), F.col("dst") == F.col("_id")).select(F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
        out = self.edges.join(F.broadcast(one), F.col("src") == F.col("_id")).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
        return into.unionByName(out).orderBy("direction", "type", "other").limit(most)

    def dependents(self, ref: str, direction: str = "upstream", depth: int = 2, types: list[str] | None = None) -> DataFrame:
        """(node, hops): who depends on a node, or what it depends on, within some hops; the least number is given."""
        edges = self.edges.where(F.col("type").isin(types)) if types else self.edges
        roots = self.resolve(ref).select(F.col("id").alias("node"))
        return graph.reach(edges.select("src", "dst"), roots, depth, reverse=direction == "upstream")

    def changes(self, other: Graph) -> DataFrame:
        """Nodes that differ in another state of the graph."""
        sorted_labels = lambda df: df.select("id", F.array_sort("labels").alias("labels"), "name")
        return state.diff(sorted_labels(self.nodes), sorted_labels(other.nodes), "id")
