"""Classes of texts whose word shingles have a Jaccard similarity of a threshold or more: MinHash bands, verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_counted, released
from .lines import key, squeezed

#: Bands of MinHash values, and values in each: a pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 25 = 5e-5.
BANDS, ROWS = 25, 5
#: Members of one group that are compared in one task.
BLOCK = 500
#: Shingle sets, and bytes of them, that one call of the comparison takes, about.
TOGETHER = 2000, 16_000_000
#: Kinds of shingles that are counted to tell unlike sets apart.
KINDS = 1024
#: Words whose hashes a task remembers.
KNOWN = 300_000
U = np.uint64
_random = np.random.default_rng(42)
FACTORS = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
SEEDS = _random.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles; words and case as ``simhash.fingerprint`` has them."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        known, words = self.known, text.lower().split()
        if len(known) > KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        if not len(h):
            return h
        width = min(self.width, len(h))
        runs = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            runs = (runs ^ (h[k : len(h) - width + 1 + k] * FACTORS[k])) * FACTORS[-1]
            runs ^= runs >> np.uint64(29)
        return np.unique(runs)


def bands(shingles: np.ndarray) -> list[int]:
    """A hash of each band of MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[k : k + 2048, None] * SEEDS[0] + SEEDS[1]).min(axis=0))
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def connect(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between ``sets`` at ``threshold`` or more, enough of them to connect all that are.

    Sets are counted in ``KINDS`` kinds, modulo 256: two differ in as many members, at least, as their counts do together, which
    rules out most unlike sets at array speed. Of the others, a set is compared with members of each component so far, those
    with the most links first, until one is near.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    counts = np.empty((len(sets), KINDS), np.uint8)
    for k, own in enumerate(sets):
        counts[k] = np.bincount((own % U(KINDS)).astype(np.int64), minlength=KINDS)
    most = (1 - threshold) / (1 + threshold) + 1e-9
    root, degree, links = list(range(len(sets))), [0] * len(sets), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for k in range(1, len(sets)):
        allowed = most * (size[:k] + size[k])
        like = np.flatnonzero(np.abs(size[:k] - size[k]) <= allowed)
        far = counts[like] - counts[k]
        like = like[np.minimum(far, -far).sum(axis=1, dtype=np.int64) <= allowed[like]]
        for j in sorted(like.tolist(), key=lambda j: -degree[j]):
            if (other := find(j)) != (own := find(k)) and jaccard(sets[j], sets[k]) >= threshold:
                links.append((j, k))
                root[other] = own
                degree[j] += 1
                degree[k] += 1
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, x, label): a number for each row's class, x being a hash of its text.

    Texts are linked if their word shingles have a Jaccard similarity of ``threshold`` or more; classes are the connected components.

    1. Texts of equal shingles, by 128 bits, are one node.
    2. Nodes that agree in a band of MinHash values form a group. Groups are counted and listed, never paired; of groups of the
       same members one is kept. Every member is compared, on exact shingles, with the group's hub: the member that meets the most others.
    3. Groups that this leaves in more than one component are compared as a whole, in cells of two blocks.

    Every link is verified; what bands miss is in ``BANDS``. Rows of null ids or of texts without words are left out. Rows of one
    id are told apart by their texts. An empty table gives none.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for b in batches:
            out = []
            for i, t, x in zip(*(c.to_pylist() for c in b.columns)):
                own = shingles(t)
                if len(own):
                    out.append((i, x, *key(own.tobytes()), bands(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (*[pa.int64()] * 4, pa.list_(pa.int64())))], ["id", "x", "h", "g", "bands"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, inflate = Shingles(width), zstandard.ZstdDecompressor().decompress
        for b in batches:
            own = [shingles(inflate(z)).tobytes() for z in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], ["node", "own"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    def compare(rows: pa.Table) -> pa.Table:
        found = []
        table = rows.sort_by([("grp", "ascending"), ("cell", "ascending"), ("node", "ascending")])
        names = list(zip(table["grp"].to_pylist(), table["cell"].to_pylist()))
        node, own = table["node"].to_pylist(), table["own"]
        at = 0
        while at < len(names):
            end = at
            while end < len(names) and names[end] == names[at]:
                end += 1
            found += [(node[at + i], node[at + j]) for i, j in connect([np.frombuffer(own[k].as_py(), np.uint64) for k in range(at, end)], threshold)]
            at = end
        return pa.table([pa.array(c, pa.int64()) for c in list(zip(*found)) or [()] * 2], names=["u", "v"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null and text is not null")
    rows = rows.withColumn("x", F.xxhash64("text"))
    sketches = cut(rows.mapInArrow(released(sketch), "id long, x long, h long, g long, bands array<long>"))
    numbered = sketches.groupBy("h", "g").agg(F.min(F.struct("id", "x")).alias("first"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n_rows"))
    nodes = cut(numbered.select(F.monotonically_increasing_id().alias("node"), "h", "g", F.col("first.id").alias("rep"), F.col("first.x").alias("x"), "bands", "n_rows"))
    reach = nodes.select("node", F.explode("bands").alias("value"))
    total = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    met = reach.groupBy("value").agg(F.count(F.lit(1)).alias("n"), total.alias("total")).where("n > 1")
    held = cut(reach.join(met, "value"))
    # the text that others are copies of meets the most others
    scored = held.join(held.groupBy("node").agg(F.sum("n").alias("score")), "node")
    hubs = scored.groupBy("value", "n", "total").agg(F.max(F.struct("score", "node")).alias("hub"))
    groups = hubs.groupBy("hub", "n", "total").agg(F.min("value").alias("value")).select("value", F.col("hub.node").alias("hub"))
    members = cut(held.drop("total").join(groups, "value"))
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("rep").alias("id"), "x")
    texts = squeezed(rows).join(wanted.hint("shuffle_hash"), ["id", "x"]).select("node", "text")
    sets = cut(texts.mapInArrow(released(listed), "node long, own binary").dropDuplicates(["node"]))

    pairs = members.where("node <> hub").select("hub", "node").distinct()
    sided = pairs.join(sets.select(F.col("node").alias("hub"), F.col("own").alias("hub_own")), "hub").join(sets, "node")
    near = cut(sided.select("hub", "node", "hub_own", "own").mapInArrow(released(star), "u long, v long"))
    parted = members.join(components(near).withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    # pairs were compared already
    open_groups = parted.where("n > 2").groupBy("value").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("value")
    blocks = cut(members.join(open_groups, "value").withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least(own, k) * F.col("blocks") + F.greatest(own, k))
    placed = blocks.select(F.col("value").alias("grp"), "node", F.explode(cells).alias("cell")).join(sets, "node")
    known = sets.agg(F.avg(F.length("own"))).first()[0] or 0
    total = blocks.agg(F.sum("blocks")).first()[0] or 0
    parts = max(1, -(-total // TOGETHER[0]), int(total * known) // TOGETHER[1])
    split = F.pmod(F.xxhash64("grp", "cell"), F.lit(parts))
    rest = placed.select("grp", "cell", "node", "own", split.alias("part")).groupBy("part").applyInArrow(released(compare), "u long, v long")
    groups_of = components(near.unionByName(rest)).withColumnsRenamed({"id": "node", "component": "label"})
    labels = nodes.select("node", "h", "g", "n_rows").join(groups_of, "node", "left").select("h", "g", "n_rows", F.coalesce("label", "node").alias("label"))
    return join_counted(sketches.select("id", "x", "h", "g"), labels, ["h", "g"], "n_rows").select("id", "x", "label")
