"""Code graphs: a row for each (repo_path, commit_hash) with its nodes and edges.

``graphs`` have graph_data parsed as ``loam.schemas.SCHEMAS["graph_data"]``; ``nodes`` and ``links`` are their exploded forms, which the
analyses run on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.scalars import last_part
from loam.schemas import SCHEMAS

KEY = ["repo_path", "commit_hash"]


def parsed(graphs: DataFrame) -> DataFrame:
    return graphs.withColumn("graph_data", F.from_json("graph_data", SCHEMAS["graph_data"]))


def nodes(graphs: DataFrame) -> DataFrame:
    """One row for each node; nodes that aren't objects are left out."""
    return graphs.select(*KEY, "ingested_at", F.explode("graph_data.nodes").alias("node_id", "node")).where("node is not null").select(*KEY, "ingested_at", "node_id", "node.*")


def links(graphs: DataFrame) -> DataFrame:
    return graphs.select(*KEY, F.posexplode("graph_data.edges").alias("seq", "edge")).select(*KEY, "seq", "edge.*")


def upsert(graphs: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each key; of equally late ones a new row wins."""
    latest = Window.partitionBy(*KEY).orderBy(F.col("ingested_at").desc(), F.col("_new").desc(), "nodes_count")
    both = graphs.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_new")


def get(graphs: DataFrame, repo_path: str, commit_hash: str) -> DataFrame:
    return graphs.where((F.col("repo_path") == repo_path) & (F.col("commit_hash") == commit_hash))


def listing(graphs: DataFrame, repo_path: str | None = None, limit: int = 100) -> DataFrame:
    """The newest graphs, without their payload."""
    rows = graphs if repo_path is None else graphs.where(F.col("repo_path") == repo_path)
    return rows.select(*KEY, "nodes_count", "ingested_at").orderBy(F.col("ingested_at").desc(), *KEY).limit(limit)


def latest(graphs: DataFrame) -> DataFrame:
    """The newest graph of each repository."""
    order = Window.partitionBy("repo_path").orderBy(F.col("ingested_at").desc(), "commit_hash")
    return graphs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def unknown_graphs(listed: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return listed.join(known.select(key).distinct(), key, "left_anti")


def type_histogram(of: DataFrame, key: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """Nodes by type; a missing type is ``unknown``."""
    return of.groupBy(*key, F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def graph_similarity(histogram: DataFrame, reference: str, min_similarity: float = 0.3, limit: int | None = 10, key: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """Cosine of type counts of every graph of other repositories with the reference repository's graph.

    ``histogram`` holds one graph for the reference. The reference's histogram has a row for each node type, and is joined on the type: no pairs are formed.
    """
    mine = histogram.where(F.col("repo_path") == reference).select("type", F.col("n").alias("m"))
    length = mine.agg(F.sqrt(F.sum(F.col("m").cast("double") * F.col("m"))).alias("own"))
    others = histogram.where(F.col("repo_path") != reference).join(mine, "type", "left")
    sums = others.groupBy(*key).agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0)).alias("dot"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("length"))
    # the one row of ``length`` is all that is broadcast
    found = sums.crossJoin(F.broadcast(length)).select(*key, F.coalesce(F.try_divide(F.col("dot"), F.nullif(F.col("length") * F.col("own"), F.lit(0.0))), F.lit(0.0)).alias("similarity")).where(F.col("similarity") >= min_similarity)
    return found if limit is None else found.orderBy(F.col("similarity").desc(), *key).limit(limit)


def similar_repositories(graphs: DataFrame, repo_path: str, min_similarity: float = 0.3, limit: int = 10) -> DataFrame:
    own = latest(graphs.where(F.col("repo_path") == repo_path))
    every = graphs.where(F.col("repo_path") != repo_path).unionByName(own)
    return graph_similarity(type_histogram(nodes(every)), repo_path, min_similarity, limit)


def _file(of: DataFrame) -> Column:
    columns = [F.col(c) for c in ("file_path", "file") if c in of.columns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def function_usage(of: DataFrame, name: str, limit: int = 20, types: tuple[str, ...] | None = None, per_repo: int | None = None) -> DataFrame:
    """Repositories with nodes whose name holds ``name``, case aside, and the distinct files they are in.

    Nodes without a file are dropped; ``types`` restricts node types; ``per_repo`` bounds the files listed for a repository.
    """
    rows = of.where(F.contains(F.lower("name"), F.lit(name.lower()))).withColumn("place", _file(of)).where("place is not null")
    rows = rows if types is None else rows.where(F.col("type").isin(*types))
    files = F.array_sort(F.collect_set("place"))
    found = rows.groupBy("repo_path").agg(F.count(F.lit(1)).alias("usages"), (files if per_repo is None else F.slice(files, 1, per_repo)).alias("files"))
    return found.orderBy("repo_path").limit(limit)


def find_function_usage(of: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return function_usage(of, name, limit, ("function", "method", "call", "import"), limit)


#: Patterns of nested quantifiers that are refused.
NESTED = (r"\(\.\*\)\+", r"\(\.\+\)\+", r"\(\.\*\)\*", r"\(\.\+\)\*", r"\(\.\*\)\{", r"\(\.\+\)\{")


def safe_pattern(pattern: str, most: int = 500) -> str:
    """The pattern, if it is short, has no nested quantifiers and compiles; else ValueError."""
    if len(pattern) > most:
        raise ValueError("pattern is too long")
    if any(re.search(x, pattern) for x in NESTED):
        raise ValueError("pattern has nested quantifiers")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"pattern doesn't compile: {e}") from e
    return pattern


def search_patterns(of: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Nodes whose source matches, with its first 100 characters."""
    rows = of.where(F.col("source").rlike(safe_pattern(pattern)))
    return rows.select(*KEY, "node_id", _file(of).alias("file"), F.substring("source", 1, 100).alias("match")).orderBy(*KEY, "node_id").limit(limit)


def severity_filter(severity: Column, level: str) -> Column:
    """ERROR: errors alone; WARNING: warnings, too; anything else: all."""
    return severity.isin("ERROR") if level == "ERROR" else severity.isin("ERROR", "WARNING") if level == "WARNING" else F.lit(True)


def severity_order(severity: Column) -> Column:
    return F.when(severity == "ERROR", 0).when(severity == "WARNING", 1).when(severity == "INFO", 2).otherwise(3)


def problems(of: DataFrame, repo_path: str | None = None, severity: str = "ERROR", limit: int = 50) -> DataFrame:
    """Problems of nodes, worst first; a missing severity is INFO."""
    rows = of if repo_path is None else of.where(F.col("repo_path") == repo_path)
    every = rows.select(*KEY, "node_id", _file(of).alias("file"), F.col("start_line").alias("line"), F.posexplode("problems").alias("seq", "p"))
    level = F.coalesce("p.severity", F.lit("INFO"))
    found = every.select(*KEY, "node_id", "file", F.coalesce("line", F.lit(0)).alias("line"), "seq", level.alias("severity"), F.coalesce("p.message", F.lit("")).alias("message"), F.coalesce("p.category", F.lit("general")).alias("category"))
    return found.where(severity_filter(F.col("severity"), severity)).orderBy(severity_order(F.col("severity")), *KEY, "node_id", "seq").limit(limit)


def unused_imports(of: DataFrame) -> DataFrame:
    """Imports whose last dotted part no call or reference of the same graph is named."""
    imports = of.where("type = 'import'").select(*KEY, F.col("name").alias("import_name"), last_part(F.col("name")).alias("short")).distinct()
    used = of.where("type in ('call', 'reference')").select(*KEY, F.col("name").alias("short")).distinct()
    return imports.join(used, [*KEY, "short"], "left_anti").select(*KEY, "import_name")


def circular_imports(edges: DataFrame, kind: str = "imports") -> DataFrame:
    """Pairs that import each other, in both orders; a self-import is a pair with itself."""
    one = edges.where(F.col("type") == kind).select(*KEY, "source", "target").distinct()
    back = one.select(*KEY, F.col("target").alias("source"), F.col("source").alias("target"))
    return one.join(back, [*KEY, "source", "target"], "left_semi")


def import_patterns(of: DataFrame, top: int = 10, key: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """The most frequent imports of each graph; ties by first appearance (node id)."""
    counts = of.where("type = 'import'").groupBy(*key, "name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first"))
    order = Window.partitionBy(*key).orderBy(F.col("n").desc(), "first", "name")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*key, "name", "n", "rank")
