"""The tool surface: named calls with checked parameters over a set of tables, each a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import codegraph, fitness, graph, ingest, search, timeseries
from loam.operators.embedding import embed
from loam.operators.validation import check_request


@dataclass
class Catalog:
    """Tools over ``tables`` (hot, metrics, series, entities, edges, graphs, traces, nodes, links); ``as_of`` ends every window.

    ``model`` embeds a list of texts; without one, texts have hash-seeded directions.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    as_of: str
    dim: int = 384
    model: Callable | None = None
    tools: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.tools = {n: (f.__doc__ or "").strip().split("\n")[0] for n, f in vars(type(self)).items() if not n.startswith("_") and callable(f)}

    def generate_embedding(self, text: str) -> DataFrame:
        """The vector of a text."""
        check_request("generate_embedding", text=text)
        return self.spark.createDataFrame([(text,)], "text string").select("text", embed(F.col("text"), self.dim, self.model).alias("embedding"))

    def generate_batch_embeddings(self, texts: list[str], batch_size: int = 32) -> DataFrame:
        """The vectors of texts, in their order."""
        check_request("generate_batch_embeddings", texts=texts, batch_size=batch_size)
        return self.spark.createDataFrame(list(enumerate(texts)), "index int, text string").select("index", embed(F.col("text"), self.dim, self.model).alias("embedding"))

    def search_all_systems(self, query: str, limit: int = 10, threshold: float = 0.7, system_id: str | None = None) -> DataFrame:
        """Conversations most similar to a text."""
        check_request("search_all_systems", query=query, limit=limit, threshold=threshold, system_id=system_id)
        vector = self.generate_embedding(query).first().embedding
        return search.search_similar(self.tables["hot"], vector, system_id, limit, threshold)

    def get_system_metrics(self, time_range_days: int = 30) -> DataFrame:
        """Metrics with their points, systems and time range."""
        check_request("get_system_metrics", time_range_days=time_range_days)
        return timeseries.catalog(timeseries.windowed(self.tables["metrics"], self.as_of, time_range_days))

    def analyze_trends(self, metric_name: str, system_id: str | None = None, time_window_days: int = 7) -> DataFrame:
        """Direction, strength and change of a metric."""
        check_request("analyze_trends", metric_name=metric_name, system_id=system_id, time_window_days=time_window_days)
        return timeseries.trends(self.tables["metrics"], self.as_of, time_window_days, ("metric_name",), metric=metric_name, system_id=system_id)

    def detect_anomalies(self, metric_name: str, system_id: str | None = None, time_window_days: int = 7, threshold_std: float = 3.0) -> DataFrame:
        """The number and rate of a metric's anomalies, and the first ten."""
        check_request("detect_anomalies", metric_name=metric_name, system_id=system_id, time_window_days=time_window_days, threshold_std=threshold_std)
        return timeseries.anomaly_summary(self.tables["metrics"], self.as_of, time_window_days, threshold_std, ("metric_name",), metric=metric_name, system_id=system_id)

    def correlate_systems(self, metric_name: str, time_window_days: int = 7) -> DataFrame:
        """Pairs of systems whose values of a metric correlate by over 0.5."""
        check_request("correlate_systems", metric_name=metric_name, time_window_days=time_window_days)
        return timeseries.correlations(self.tables["metrics"], self.as_of, time_window_days, threshold=0.5, metric=metric_name)

    def analyze_changepoints(self, metric_name: str, entity_id: str, time_window_days: int = 30) -> DataFrame:
        """Segments of a series."""
        rows = self.tables["series"].where((F.col("metric_name") == metric_name) & (F.col("entity_id") == entity_id))
        return timeseries.change_points(rows, self.as_of, time_window_days)

    def query_knowledge_graph(self, entity_id: str, edge_type: str | None = None, limit: int = 50) -> DataFrame:
        """Neighbours of an entity."""
        p = check_request("query_knowledge_graph", entity_id=entity_id, edge_type=edge_type, limit=limit)
        return graph.neighbours(self.tables["edges"], self.tables["entities"], entity_id, p["edge_type"], limit)

    def find_path(self, source_id: str, target_id: str, max_hops: int = 3) -> list[str] | None:
        """A shortest path of at most so many nodes."""
        check_request("find_path", source_id=source_id, target_id=target_id, max_hops=max_hops)
        return graph.find_shortest_path(self.tables["edges"], self.tables["entities"], source_id, target_id, max_hops)

    def get_graph_statistics(self) -> DataFrame:
        """Entities and edges by type."""
        return graph.statistics(self.tables["entities"], self.tables["edges"])

    def list_ingested_code_graphs(self, repo_path: str | None = None, limit: int = 100) -> DataFrame:
        """The newest code graphs."""
        return codegraph.listing(self.tables["graphs"], repo_path, limit)

    def get_code_graph_details(self, repo_path: str, commit_hash: str) -> DataFrame:
        """One code graph."""
        return codegraph.get(self.tables["graphs"], repo_path, commit_hash)

    def find_similar_repositories(self, repo_path: str, min_similarity: float = 0.3, limit: int = 10) -> DataFrame:
        """Repositories with a like mix of node types."""
        return codegraph.similar_repositories(self.tables["graphs"], repo_path, min_similarity, limit)

    def get_cross_repo_function_usage(self, function_name: str, limit: int = 20) -> DataFrame:
        """Files that name a function, by repository."""
        return codegraph.function_usage(self.tables["nodes"], function_name, limit)

    def find_function_usage(self, function_name: str, language: str = "python", limit: int = 20) -> DataFrame:
        """Files that define, call or import a function."""
        return codegraph.find_function_usage(self.tables["nodes"], function_name, limit)

    def search_code_patterns(self, pattern: str, limit: int = 100) -> DataFrame:
        """Nodes whose source matches a pattern."""
        return codegraph.search_patterns(self.tables["nodes"], pattern, limit)

    def get_code_problems(self, repo_path: str | None = None, severity: str = "ERROR", limit: int = 50) -> DataFrame:
        """Problems of nodes, worst first."""
        return codegraph.problems(self.tables["nodes"], repo_path, severity, limit)

    def analyze_imports(self, repo_path: str | None = None, analysis_type: str = "unused", limit: int = 50) -> DataFrame:
        """Unused, circular or most frequent imports."""
        of = lambda t: t if repo_path is None else t.where(F.col("repo_path") == repo_path)
        kinds = {"unused": lambda: codegraph.unused_imports(of(self.tables["nodes"])), "circular": lambda: codegraph.circular_imports(of(self.tables["links"])), "patterns": lambda: codegraph.import_patterns(of(self.tables["nodes"]))}
        found = kinds[analysis_type]()
        return found.orderBy("repo_path", "commit_hash", F.to_json(F.struct(*found.columns))).limit(limit)

    def store_memory(self, memory_id: str, text: str, embedding: list[float] | None = None, metadata: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(hot rows, rejects) of one memory."""
        return self.batch_store_memories([(memory_id, text, embedding, metadata or {})])

    def batch_store_memories(self, memories: list[tuple]) -> tuple[DataFrame, DataFrame]:
        """(hot rows, rejects) of a batch of (memory_id, text, embedding, metadata)."""
        if len(memories) > ingest.BATCH_LIMIT:
            raise ValueError(f"a batch has {ingest.BATCH_LIMIT} memories at most")
        rows = self.spark.createDataFrame(memories, "memory_id string, text string, embedding array<float>, metadata map<string,string>")
        return ingest.prepare(rows, self.as_of, self.dim)

    def query_local_traces(self, system_id: str, start: str | None = None, end: str | None = None, task_class: str | None = None, limit: int = 100) -> DataFrame:
        """The newest traces of a system."""
        return fitness.query_traces(self.tables["hot"], system_id, start, end, task_class, limit)

    def run_fitness_analysis(self) -> DataFrame:
        """Reliability signals of the fixed task classes."""
        return fitness.signals(self.tables["traces"], classes=fitness.TASK_CLASSES)

    def get_fitness_analyzer_status(self) -> DataFrame:
        """Selectors and samples of each task class."""
        return fitness.summary(self.run_fitness_analysis())

    def publish(self, rows: DataFrame, topic: str, source: str = "loam") -> DataFrame:
        """Events of rows that have a topic's fields."""
        return ingest.events(rows, topic, source, self.as_of)

    def discover_tools(self, query: str, loaded: tuple[str, ...] = ()) -> DataFrame:
        """Tools whose name or description holds a text, and whether they are loaded."""
        rows = self.spark.createDataFrame([(n, d, n in loaded) for n, d in self.tools.items()], "name string, description string, loaded boolean")
        q = F.lit(query.lower())
        return rows.where(F.contains(F.lower("name"), q) | F.contains(F.lower("description"), q)).orderBy("name")
