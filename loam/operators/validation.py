"""Checks of ids, manifests and request parameters; rows are checked by columns, parameters on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvalidRequest(ValueError):
    """A request parameter is out of its bounds."""


def valid_system_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9_-]{1,100}$"), F.lit(False))


def valid_upload_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9_.-]{1,100}$") & ~c.contains(".."), F.lit(False))


def valid_prefix(c: Column) -> Column:
    """Below ``systems/``, without empty, dot, tilde or wildcard parts."""
    parts = F.split(F.regexp_replace(c, "/$", ""), "/")
    fine = F.forall(parts, lambda p: (p != "") & ~p.isin(".", "..", "~", "*", "?"))
    return F.coalesce(c.startswith("systems/") & ~c.contains("..") & ~c.contains("\x00") & fine, F.lit(False))


def manifest_errors(m: DataFrame, now: str) -> Column:
    """The names of the fields of a manifest row that are out of bounds, empty for a valid one; ``now`` judges the upload time."""
    at = F.try_to_timestamp(F.col("uploaded_at"))
    moment = F.lit(now).cast("timestamp")
    name = lambda f: F.length(f).between(1, 255) & f.rlike(r"^[a-zA-Z0-9_.-]+$") & ~f.contains("..")
    checks = {
        "uploaded_at": at.isNotNull() & (at <= moment + F.make_dt_interval(mins=F.lit(5))) & (at >= moment - F.make_dt_interval(F.lit(365))),
        "conversation_count": F.col("conversation_count").between(0, 1_000_000),
        "total_size_bytes": F.col("total_size_bytes").isNull() | F.col("total_size_bytes").between(0, 100_000_000_000),
        "version": F.coalesce("version", F.lit("1.0")).rlike(r"^\d+\.\d+$"),
        "system_type": F.col("system_type").isNull() | F.length("system_type").between(1, 50),
        "checksum": F.col("checksum").isNull() | F.col("checksum").rlike(r"^[a-f0-9]{64}$"),
        "compression_format": F.when(F.coalesce("compressed", F.lit(False)), F.coalesce(F.col("compression_format").isin("gzip", "zstd", "lz4"), F.lit(False))).otherwise(F.col("compression_format").isNull()),
        "files": F.forall(F.coalesce("files", F.array().cast("array<string>")), name),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(field)) for field, ok in checks.items()]))


def split_valid(m: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with column errors)."""
    marked = m.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


@dataclass
class Bounds:
    """What a parameter may be; None stands for no bound."""

    low: float | None = None
    high: float | None = None
    length: tuple[int, int] | None = None
    pattern: str | None = None
    optional: bool = False
    refuse: tuple[str, ...] = field(default_factory=tuple)

    def check(self, name: str, value: object) -> None:
        if value is None:
            if not self.optional:
                raise InvalidRequest(f"{name} is missing")
            return
        if self.low is not None and (not isinstance(value, (int, float)) or not self.low <= value <= self.high):
            raise InvalidRequest(f"{name} must be from {self.low} to {self.high}")
        if self.length and not self.length[0] <= len(value) <= self.length[1]:
            raise InvalidRequest(f"{name} must have a length of {self.length[0]} to {self.length[1]}")
        if self.pattern and not re.fullmatch(self.pattern, value):
            raise InvalidRequest(f"{name} has characters that aren't allowed")
        if any(x in value for x in self.refuse):
            raise InvalidRequest(f"{name} holds a part that isn't allowed")


METRIC = Bounds(length=(1, 100), pattern=r"[a-zA-Z0-9_:-]+")
SYSTEM = Bounds(length=(0, 100), optional=True)
ENTITY = Bounds(length=(1, 200), refuse=("..", "\x00"))

REQUESTS: dict[str, dict[str, Bounds]] = {
    "generate_embedding": {"text": Bounds(length=(1, 10_000), refuse=("\x00",))},
    "generate_batch_embeddings": {"texts": Bounds(length=(1, 1000)), "batch_size": Bounds(1, 128)},
    "search_all_systems": {"query": Bounds(length=(1, 1000)), "limit": Bounds(1, 1000), "threshold": Bounds(-1.0, 1.0), "system_id": SYSTEM},
    "get_system_metrics": {"time_range_days": Bounds(1, 365)},
    "analyze_trends": {"metric_name": METRIC, "system_id": SYSTEM, "time_window_days": Bounds(1, 90)},
    "detect_anomalies": {"metric_name": METRIC, "system_id": SYSTEM, "time_window_days": Bounds(1, 90), "threshold_std": Bounds(1.0, 10.0)},
    "correlate_systems": {"metric_name": METRIC, "time_window_days": Bounds(1, 90)},
    "query_knowledge_graph": {"entity_id": ENTITY, "edge_type": Bounds(length=(0, 100), optional=True), "limit": Bounds(1, 10_000)},
    "find_path": {"source_id": ENTITY, "target_id": ENTITY, "max_hops": Bounds(1, 10)},
    "get_graph_statistics": {},
}


def check_request(tool: str, **params: object) -> dict[str, object]:
    """The parameters, if they are within the bounds of ``tool``; else InvalidRequest. Edge types come back in lower case."""
    for name, bounds in REQUESTS[tool].items():
        bounds.check(name, params.get(name))
    if tool == "generate_batch_embeddings" and sum(map(len, params["texts"])) > 1_000_000:
        raise InvalidRequest("texts have over 1,000,000 characters")
    if tool == "find_path" and params["source_id"] == params["target_id"]:
        raise InvalidRequest("source_id and target_id are the same")
    if params.get("edge_type"):
        params["edge_type"] = str(params["edge_type"]).lower()
    return params
