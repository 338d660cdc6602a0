"""Knowledge graph: extraction, neighbours, shortest paths, statistics.

Vertices are (entity_id, entity_type, properties, source_system), edges (source_id, target_id, edge_type, weight, seq), a directed multigraph
that is walked both ways; seq is the order of insertion.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def extract_entities(conversations: DataFrame) -> DataFrame:
    """The system, user and project of each (system_id, user_id, project, seq), the first seen of each id; empty ones aside."""

    def kind(column: str, name: str, key: str) -> DataFrame:
        rows = conversations.where(_present(F.col(column)))
        return rows.select(F.concat(F.lit(f"{name}:"), F.col(column)).alias("entity_id"), F.lit(name).alias("entity_type"), F.create_map(F.lit(key), F.col(column)).alias("properties"), F.coalesce("system_id", F.lit("unknown")).alias("source_system"), "seq")

    every = kind("system_id", "system", "name").unionByName(kind("user_id", "user", "user_id")).unionByName(kind("project", "project", "name"))
    return add_entities(every)


def extract_relationships(conversations: DataFrame) -> DataFrame:
    """user worked_on project and system contains project, one edge for each conversation that has both; an unnamed system is ``unknown``."""
    project = F.concat(F.lit("project:"), F.col("project"))
    system = F.coalesce(F.nullif(F.col("system_id"), F.lit("")), F.lit("unknown"))
    rows = conversations.where(_present(F.col("project")))

    def edge(source: Column, kind: str, of: DataFrame, order: int) -> DataFrame:
        return of.select(source.alias("source_id"), project.alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"), system.alias("source_system"), (F.col("seq") * 2 + order).alias("seq"))

    worked = edge(F.concat(F.lit("user:"), F.col("user_id")), "worked_on", rows.where(_present(F.col("user_id"))), 0)
    return worked.unionByName(edge(F.concat(F.lit("system:"), system), "contains", rows, 1))


def add_entities(entities: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """One row for each id, the first by seq."""
    every = entities if new is None else entities.unionByName(new)
    rest = [c for c in every.columns if c not in ("entity_id", "seq")]
    first = every.groupBy("entity_id").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("e"))
    return first.select("entity_id", *[F.col(f"e.{c}").alias(c) for c in rest])


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new)


def neighbours(edges: DataFrame, entities: DataFrame, entity_id: str | None = None, edge_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """Known entities one edge away, in either direction, in order of edges; a loop counts in both directions.

    With ``entity_id`` the filter reaches both scans of the edges; without, every entity's neighbours, first ``limit`` of each.
    """
    edges = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)

    def way(near: str, far: str, name: str, order: int) -> DataFrame:
        rows = edges if entity_id is None else edges.where(F.col(near) == entity_id)
        return rows.select(F.col(near).alias("of_id"), F.col(far).alias("entity_id"), "edge_type", "weight", F.lit(name).alias("direction"), "seq", F.lit(order).alias("turn"))

    both = way("source_id", "target_id", "outgoing", 0).unionByName(way("target_id", "source_id", "incoming", 1))
    found = both.join(entities.select("entity_id", "entity_type"), "entity_id")
    if limit is not None and entity_id is not None:
        found = found.orderBy("seq", "turn").limit(limit)
    elif limit is not None:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("of_id").orderBy("seq", "turn"))).where(F.col("rank") <= limit).drop("rank")
    return found.select("of_id", "entity_id", "entity_type", "edge_type", "weight", "direction", "seq")


def _kept(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loam-"))
    return df.checkpoint(eager=True)


def shortest_paths(edges: DataFrame, entities: DataFrame, source_id: str, max_nodes: int = 3) -> DataFrame:
    """(entity_id, parent_id, nodes): every entity reached from ``source_id`` on a path of at most ``max_nodes`` nodes, with its predecessor.

    Breadth first, level by level: the frontier is joined to edges of both directions, those reached before drop out by an anti-join,
    and of several parents the one of the first edge stays. Levels are written to the checkpoint folder, so plans stay short and a
    lost executor costs one level. Each level's frontier is its own size, never the visited set.
    """
    way = lambda near, far, turn: edges.select(F.col(near).alias("parent_id"), F.col(far).alias("entity_id"), "seq", F.lit(turn).alias("turn"))
    both = way("source_id", "target_id", 0).unionByName(way("target_id", "source_id", 1))
    start = entities.where(F.col("entity_id") == source_id).select("entity_id").limit(1)
    frontier = _kept(start.select("entity_id", F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("nodes")))
    reached = frontier
    for nodes in range(2, max_nodes + 1):
        step = both.join(frontier.select(F.col("entity_id").alias("parent_id")), "parent_id").join(reached.select("entity_id"), "entity_id", "left_anti")
        new = _kept(step.groupBy("entity_id").agg(F.min_by("parent_id", F.struct("seq", "turn")).alias("parent_id")).withColumn("nodes", F.lit(nodes)))
        if new.isEmpty():
            break
        reached, frontier = reached.unionByName(new), new
    return reached


def find_shortest_path(edges: DataFrame, entities: DataFrame, source_id: str, target_id: str, max_nodes: int = 3) -> list[str] | None:
    """The nodes of a shortest path of at most ``max_nodes`` nodes, or None; both ends must be known entities.

    Two searches meet in the middle: each takes about half of the nodes, so frontiers stay small.
    """
    known = {r.entity_id for r in entities.where(F.col("entity_id").isin(source_id, target_id)).select("entity_id").distinct().collect()}
    if {source_id, target_id} - known:
        return None
    if source_id == target_id:
        return [source_id]
    near = shortest_paths(edges, entities, source_id, max_nodes // 2 + 1)
    far = shortest_paths(edges, entities, target_id, max_nodes - max_nodes // 2)
    met = near.select("entity_id", F.col("nodes").alias("n")).join(far.select("entity_id", F.col("nodes").alias("m")), "entity_id").withColumn("total", F.col("n") + F.col("m") - 1)
    best = met.where(F.col("total") <= max_nodes).orderBy("total", "n", "entity_id").limit(1).collect()
    if not best:
        return None

    def back(tree: DataFrame, node: str) -> list[str]:
        path = [node]
        while (row := tree.where(F.col("entity_id") == path[-1]).select("parent_id").first()) and row.parent_id is not None:
            path.append(row.parent_id)
        return path

    return back(near, best[0].entity_id)[::-1] + back(far, best[0].entity_id)[1:]


def statistics(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): entities and edges by type, type null being the total; repeated edges count."""
    e = entities.rollup("entity_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), F.col("entity_type").alias("type"), "n")
    return e.unionByName(edges.rollup("edge_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.col("edge_type").alias("type"), "n"))


def communities(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(entity_id, community): the least id that reaches each entity by label passing, both ways, until no label moves.

    If ``rounds`` are given and labels still move after as many, it fails.
    """
    both = _kept(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("entity_id"), F.col("a").alias("community")).distinct()
    done = 0
    while rounds is None or done < rounds:
        passed = both.join(labels, F.col("a") == F.col("entity_id")).groupBy("b").agg(F.min("community").alias("offer"))
        new = _kept(labels.join(passed, F.col("entity_id") == F.col("b"), "left").select("entity_id", F.least("community", F.coalesce("offer", "community")).alias("community"), (F.col("offer") < F.col("community")).alias("moved")))
        labels = new.drop("moved")
        done += 1
        if new.where("moved").isEmpty():
            return labels
    raise ValueError(f"labels still move after {rounds} rounds")


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(entity_id, rank): PageRank over directed edges, repeated edges counting; dangling rank is spread over all."""
    nodes = _kept(edges.select(F.col("source_id").alias("entity_id")).unionByName(edges.select(F.col("target_id").alias("entity_id"))).distinct())
    n = nodes.count()
    out = _kept(edges.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("w")).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("source_id"))))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    sources = out.select(F.col("source_id").alias("entity_id")).distinct()
    for _ in range(rounds):
        dangling = ranks.join(sources, "entity_id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = out.join(ranks, F.col("source_id") == F.col("entity_id")).groupBy("target_id").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = _kept(nodes.join(given, F.col("entity_id") == F.col("target_id"), "left").select("entity_id", (F.lit((1 - damping + damping * dangling) / max(n, 1)) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks
