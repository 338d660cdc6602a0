"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, join_counted, released, table
from .edits import within

#: Entries of a bucket of the segment index, about.
BUCKET = 1_000_000
#: Lines that a task remembers to have entered into the index, so that a frequent line isn't entered again and again.
SEEN = 300_000
#: Lines of one group that are compared in one task; the lines of a larger group are first split by a second segment.
BLOCK = 2000
#: Lines, and characters, that one call of the verifier takes, about.
TOGETHER = 5000, 4_000_000
#: Characters that are hashed at once, and entries that are packed at once.
CHARS, PACK = 1 << 19, 500_000
#: Segments of lines of more characters than this are hashed one by one, so that memory doesn't grow with a line.
HUGE = 1 << 20
ENTRY = np.dtype([("key", "<u4"), ("line", "<i8")])
BASE = 0x9E3779B97F4A7C15
U = np.uint64
_powers = {1: np.ones(1, U), -1: np.ones(1, U)}


def key(line: str) -> tuple[int, int]:
    """128-bit identity of a line, as two signed longs."""
    raw = xxhash.xxh3_128_digest(line)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def allowed(length, limit: int, per: int):
    """Edits that may lie between two lines, the shorter of which has ``length`` characters: one for every ``per``, ``limit`` at most."""
    return np.minimum(limit, length // per)


def segment(length: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment ``k`` of edits + 1 of lines of ``length``, as even as can be, the shorter ones first."""
    size, longer = length // (edits + 1), length % (edits + 1)
    short = edits + 1 - longer
    return k * size + np.maximum(0, k - short), size + (k >= short)


def slots(length: np.ndarray, edits: int, index: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """(which lines, indexed length, segment, start, size): the substrings to enter or, if not ``index``, to look up.

    A line is entered by its own segments. The look-up is Pass-Join's multi-match-aware choice (Li et al. 2011) over lines
    that are not longer: any two lines within ``edits`` share one of these with the other's segments.
    """
    every = np.arange(len(length))
    for k in range(edits + 1):
        if index:
            yield every, length, k, *segment(length, k, edits)
            continue
        for more in range(edits + 1):
            other = length - more
            start, size = segment(other, k, edits)
            low = np.maximum(0, np.maximum(start - k, start + more - (edits - k)))
            high = np.minimum(length - size, np.minimum(start + k, start + more + (edits - k)))
            for step in range(2 * edits + 1):
                fits = np.flatnonzero((low + step <= high) & (size > 0) & (other > edits))
                if not len(fits):
                    break
                yield fits, other[fits], k, low[fits] + step, size[fits]


def _power(sign: int, n: int) -> np.ndarray:
    if len(_powers[sign]) < n:
        step = U(BASE if sign > 0 else pow(BASE, -1, 1 << 64))
        _powers[sign] = np.concatenate((np.ones(1, U), np.cumprod(np.full(max(n, 2 * CHARS), step))))
    return _powers[sign][:n]


def mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def hashed(lines: list[str], length: np.ndarray, edits: np.ndarray, limit: int, per: int, salt: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """((hash, line, start, size) to enter, the same to look up) of ``lines``, by number; ``salt`` sets lines apart.

    Substrings are hashed by differences of a running polynomial, all lines at once. ``edits`` says what each line's own index
    allows; look-ups go by the indexed length, as ``allowed`` has it, or by ``edits`` where ``per`` is 0.
    """
    small = length <= HUGE + limit
    codes = np.frombuffer("".join([x for x, s in zip(lines, small) if s]).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    sums = np.concatenate((np.zeros(1, U), np.cumsum((codes + U(1)) * _power(1, len(codes)))))
    first = np.cumsum(np.where(small, length, 0)) - np.where(small, length, 0)
    back, out = _power(-1, len(sums)), ([], [])
    for side in (0, 1):
        for t in range(1, limit + 1):
            own = np.flatnonzero(edits == t if side == 0 or not per else length // per >= t)
            for which, indexed, k, start, size in slots(length[own], t, side == 0):
                fits = np.ones(len(which), bool) if side == 0 or not per else allowed(indexed, limit, per) == t
                which, indexed, start, size = own[which[fits]], indexed[fits], start[fits], size[fits]
                huge = np.flatnonzero(indexed > HUGE)
                at = np.where(indexed > HUGE, 0, first[which] + start)
                value = (sums[np.where(indexed > HUGE, 0, at + size)] - sums[at]) * back[at]
                for j in huge.tolist():
                    value[j] = xxhash.xxh3_64_intdigest(lines[which[j]][start[j] : start[j] + size[j]])
                name = indexed.astype(U) * U(64) + U(k + 1)
                out[side].append((mix(value ^ mix(name if salt is None else name ^ salt[which])), which, start, size))
    empty = (np.empty(0, U), *[np.empty(0, np.int64)] * 3)
    return tuple([np.concatenate(c) for c in zip(empty, *part)] for part in out)


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(id, x, h, g, at, more, size): each document's distinct lines of at least ``least`` characters, white space stripped.

    ``at`` is the number of the line where one first occurs, ``more`` holds those where it does again, or is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            row, keys, ats, more, sizes = [], [], [], [], []
            for r, text in enumerate(b.column(2).to_pylist()):
                found: dict[str, int] = {}
                for at, line in enumerate((text or "").split("\n")):
                    line = line.strip()
                    if len(line) >= least:
                        if line in found:
                            k = found[line]
                            more[k] = [*(more[k] or ()), at]
                            continue
                        found[line] = len(row)
                        row.append(r)
                        keys.append(digest(line))
                        ats.append(at)
                        more.append(None)
                        sizes.append(len(line))
            take, half = pa.array(row, pa.int64()), np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array(ats, pa.int32()), pa.array(more, pa.list_(pa.int32())), pa.array(sizes, pa.int64())],
                ["id", "x", "h", "g", "at", "more", "size"],
            )

    return docs.select("id", "x", "text").mapInArrow(released(run), "id long, x long, h long, g long, at int, more array<int>, size long")


def packed(sides: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """(bucket, indexed, entries) from (hash, line) to enter and to look up."""
    out = []
    for side, (hashes, owner) in enumerate(sides):
        bucket = (hashes >> U(32)) % U(buckets)
        order = np.argsort(bucket, kind="stable")
        entry = np.empty(len(order), ENTRY)
        entry["key"], entry["line"] = (hashes & U(0xFFFFFFFF))[order], owner[order]
        edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0, [True]))) if len(order) else np.zeros(1, np.int64)
        out += [(int(bucket[order[s]]), side == 0, entry[s:e].tobytes()) for s, e in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "indexed", "entries"])


PACKED = "bucket long, indexed boolean, entries binary"


def entries(docs: DataFrame, limit: int, per: int, least: int, buckets: int) -> DataFrame:
    """(bucket, indexed, entries): packed index and probe entries of the lines that may have edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        lines, owners, chars = [], [], 0
        done: tuple[list, list] = ([], [])

        def work() -> int:
            nonlocal lines, owners, chars
            length, owner = np.fromiter(map(len, lines), np.int64, len(lines)), np.array(owners, U).view(np.int64)
            for part, (value, which, _, _) in zip(done, hashed(lines, length, allowed(length, limit, per), limit, per)):
                part.append((value, owner[which]))
            lines, owners, chars = [], [], 0
            return sum(len(x) for part in done for x, _ in part)

        def flush() -> pa.RecordBatch:
            out = packed([tuple(map(np.concatenate, zip(*part))) if part else (np.empty(0, U), np.empty(0, np.int64)) for part in done], buckets)
            done[0].clear()
            done[1].clear()
            return out

        digest, short = xxhash.xxh3_128_digest, max(least, per)
        for b in batches:
            for text in b.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    line = line.strip()
                    if len(line) < short or (h := int.from_bytes(digest(line)[:8], "little")) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    lines.append(line)
                    owners.append(h)
                    chars += len(line)
                    if chars >= CHARS and work() >= PACK:
                        yield flush()
        work()
        yield flush()

    return docs.select("text").mapInArrow(released(run), PACKED)


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """``batches``, cut so that the texts in ``column`` have ``CHARS`` bytes together, or are one."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, side="right")))
            yield b.slice(at, end - at)
            at = end


def shared(entered: DataFrame) -> DataFrame:
    """(grp, n, bucket, key, line): groups of ``n`` lines that may be near each other, and the key that they share.

    A group holds the lines of one index key: those with a segment and those with a substring equal to it. Members are
    listed, not paired, and groups of the same lines under several keys are one, under the least key.
    """

    def run(rows: pa.Table) -> pa.Table:
        indexed, blobs, bucket = rows["indexed"].to_numpy(zero_copy_only=False), rows["entries"].to_pylist(), rows["bucket"][0]
        both = [np.frombuffer(b"".join([x for x, i in zip(blobs, indexed) if i == side]), ENTRY) for side in (True, False)]
        known, code = np.unique(np.concatenate([x["line"] for x in both]), return_inverse=True)
        pairs = np.concatenate([x["key"] for x in both]).astype(U) << U(32) | code.astype(U)
        index, probe = np.unique(pairs[: len(both[0])]), np.unique(pairs[len(both[0]) :])
        every = np.union1d(index, probe[np.isin(probe >> U(32), index >> U(32))])
        keys, members = every >> U(32), known[(every & U(0xFFFFFFFF)).astype(np.int64)]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(every) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(every)))
        # the same members make the same name
        names = np.add.reduceat(mix(members.view(U)), starts) if len(starts) else np.empty(0, U)
        many = np.repeat(sizes > 1, sizes)
        spread = lambda x: np.repeat(x, sizes)[many]
        return pa.table({"grp": spread(names).view(np.int64), "n": spread(sizes), "bucket": pa.repeat(bucket, int(many.sum())), "key": keys[many].view(np.int64), "line": members[many]})

    found = entered.groupBy("bucket").applyInArrow(released(run), "grp long, n long, bucket long, key long, line long")
    return found.groupBy("grp", "line").agg(F.max("n").alias("n"), F.min(F.struct("bucket", "key")).alias("at")).select("grp", "n", "at.bucket", "at.key", "line")


def split(crowded: DataFrame, limit: int, per: int, buckets: int, more: int) -> DataFrame:
    """(grp, n, bucket, key, line): crowded groups, with (grp, bucket, key, node, line), split by a second segment.

    Lines of a group that are near each other by way of their common segment are as near without it. What is left of each is split
    and looked up like a line of its own, within the group, in ``more`` buckets. Rests too short to be split go together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4):
            grp, bucket, wanted, node, lines = (c.to_pylist() for c in b.columns)
            length = np.fromiter(map(len, lines), np.int64, len(lines))
            rests, owners, salts = [], [], []
            for value, which, start, size in hashed(lines, length, allowed(length, limit, per), limit, per):
                hit = (((value >> U(32)) % U(buckets)).astype(np.int64) == np.array(bucket, np.int64)[which]) & ((value & U(0xFFFFFFFF)).astype(np.int64) == np.array(wanted, np.int64)[which])
                for j in np.flatnonzero(hit).tolist():
                    k, s, e = int(which[j]), int(start[j]), int(start[j] + size[j])
                    rests.append(lines[k][:s] + "\n" + lines[k][e:])
                    owners.append(node[k])
                    salts.append(grp[k])
            owner, salt = np.array(owners, np.int64), mix(np.array(salts, np.int64).view(U))
            length = np.fromiter(map(len, rests), np.int64, len(rests))
            sides = [(value, owner[which]) for value, which, _, _ in hashed(rests, length, np.where(length > limit, limit, 0), limit, 0, salt)]
            short = length <= 2 * limit
            sides[0] = (np.concatenate([sides[0][0], salt[short]]), np.concatenate([sides[0][1], owner[short]]))
            yield packed(sides, more)

    return shared(crowded.select("grp", "bucket", "key", "node", "line").mapInArrow(released(run), PACKED))


def squeezed(docs: DataFrame) -> DataFrame:
    """``docs`` with its column ``text`` as compressed bytes, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            k = b.schema.names.index("text")
            z = pa.array([None if t is None else press(t) for t in b.column(k).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z if j == k else b.column(j) for j in range(b.num_columns)], b.schema.names)

    kept = docs.withColumn("text", F.col("text").cast("binary"))
    return kept.mapInArrow(released(run), kept.schema)


def line_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, h, line): the texts of the wanted lines (node, h, g, id, x), from compressed documents (id, x, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for z, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                nodes = {(w["h"], w["g"]): w["node"] for w in want}
                for line in {x.strip() for x in inflate(z).decode().split("\n")} if z is not None else ():
                    if (node := nodes.get(key(line))) is not None:
                        out.append((node, key(line)[0], line))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.string()))], ["node", "h", "line"])

    lists = wanted.groupBy("id", "x").agg(F.collect_list(F.struct("node", "h", "g")).alias("want"))
    joined = texts.select("id", "x", "text").join(lists.hint("shuffle_hash"), ["id", "x"])
    return joined.select("text", "want").mapInArrow(released(run), "node long, h long, line string").dropDuplicates(["node"])


def counted(lines: list[str]) -> np.ndarray:
    """A row for each line: how often it has characters of each of 64 kinds, and pairs of characters of each of 128 kinds, modulo 256."""
    out = np.empty((len(lines), 192), np.uint8)
    for k, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
        out[k, :64] = np.bincount(codes & 63, minlength=64)
        out[k, 64:] = np.bincount((codes[:-1] * np.uint32(31) + codes[1:]) & 127, minlength=128)
    return out


def connect(lines: list[str], limit: int, per: int = 0) -> list[tuple[int, int]]:
    """Links between ``lines`` that are within ``limit`` edits, or one for every ``per`` characters, enough of them to connect all that are.

    An edit changes the length by at most one, counts of characters by two and counts of pairs of characters by four, together;
    this rules out most unlike lines at array speed. Of the others, a line is verified against members of each component
    so far, those with the most links first, until one is near.
    """
    size, counts = np.fromiter(map(len, lines), np.int64, len(lines)), counted(lines)
    root, degree, links = list(range(len(lines))), [0] * len(lines), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for k in range(1, len(lines)):
        like = np.flatnonzero(np.abs(size[:k] - size[k]) <= limit)
        for part, change in ((slice(0, 64), 2), (slice(64, 192), 4)):
            far = counts[like, part] - counts[k, part]
            like = like[np.minimum(far, -far).sum(axis=1, dtype=np.int64) <= change * limit]
        for j in sorted(like.tolist(), key=lambda j: -degree[j]):
            reach = min(limit, min(size[j], size[k]) // per) if per else limit
            if (other := find(j)) != (own := find(k)) and within(lines[k], lines[j], int(reach)) is not None:
                links.append((j, k))
                root[other] = own
                degree[j] += 1
                degree[k] += 1
    return links


def verified(groups: DataFrame, texts: DataFrame, on: str, limit: int, per: int) -> DataFrame:
    """(u, v): links, as nodes, that connect the lines of each group (grp, n, and the name ``on``) that are as near as ``allowed`` has it.

    A group of more lines than a block is compared block against block, in cells that different tasks can take.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = groups.agg(F.sum(blocks)).first()[0] or 0
    known = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars")).first()
    parts = max(1, -(-rows // TOGETHER[0]), -(-rows * (known.chars or 0) // max(1, known.n) // TOGETHER[1]))
    placed = groups.join(texts, on)

    def run(rows: pa.Table) -> pa.Table:
        found = []
        table = rows.sort_by([("grp", "ascending"), ("cell", "ascending"), ("node", "ascending")])
        grp, cell, node, line = (table[c].to_pylist() for c in ("grp", "cell", "node", "line"))
        at = 0
        while at < len(grp):
            end = at
            while end < len(grp) and (grp[end], cell[end]) == (grp[at], cell[at]):
                end += 1
            found += [(node[at + i], node[at + j]) for i, j in connect(line[at:end], limit, per)]
            at = end
        return pa.table([pa.array(c, pa.int64()) for c in list(zip(*found)) or [()] * 2], names=["u", "v"])

    own = F.pmod(F.xxhash64("node"), blocks)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.least(own, k) * blocks + F.greatest(own, k))
    part = F.pmod(F.xxhash64("grp", "cell"), F.lit(parts))
    return placed.select("grp", "node", "line", F.explode(cells).alias("cell")).withColumn("part", part).groupBy("part").applyInArrow(released(run), "u long, v long")


def classes(docs: DataFrame, limit: int, least: int, per: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, lines, links) of ``docs(id, x, text)``.

    lines: (node, h, g, first, at, size, n_docs, root), a row for each distinct line; first is the least id that has it and
    root the node of its class' first line. links: (u, v), enough of the near nodes to connect all that are.
    """
    found = cut(occurrences(docs, least))
    lines = found.groupBy("h", "g").agg(F.min("id").alias("first"), F.min_by("at", "id").alias("at"), F.min_by("x", "id").alias("x"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    lines = cut(lines.withColumn("node", F.monotonically_increasing_id()))
    one = np.array([per * limit + limit])
    each = limit + 1 + sum(len(w) for w, *_ in slots(one, limit, False))
    buckets = max(1, -(-lines.where(F.col("size") >= per).count() * each // BUCKET))
    groups = cut(shared(entries(docs, limit, per, least, buckets)).withColumnRenamed("line", "h"))
    wanted = lines.join(groups.select("h").distinct(), "h").select("node", "h", "g", F.col("first").alias("id"), "x")
    texts = cut(line_texts(squeezed(docs.select("id", "x", "text")), wanted))
    near = verified(groups.where(F.col("n") <= BLOCK).select("grp", "n", "h"), texts, "h", limit, per)
    crowded = groups.where(F.col("n") > BLOCK)
    if members := crowded.count():
        again = cut(split(crowded.join(texts, "h"), limit, per, buckets, max(1, -(-members * each // BUCKET))))
        near = near.unionByName(verified(again.select("grp", "n", F.col("line").alias("node")), texts, "node", limit, per))
    links = cut(near.distinct())
    joined = components(links).withColumnRenamed("id", "node")
    members = lines.join(joined, "node").select("node", "component", "first", "at")
    roots = members.groupBy("component").agg(F.min(F.struct("first", "at", "node")).alias("root"))
    rooted = members.join(roots, "component").select("node", F.col("root.node").alias("root"))
    return found, lines.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node")), links


def dropped(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, x, drops): the numbers of the lines that each document loses."""
    fate = lines.where("n_docs > 1 or root <> node").select("h", "g", "n_docs", F.col("first").alias("_first"), (F.col("root") == F.col("node")).alias("_stays"))
    gone = join_counted(found, fate, ["h", "g"], "n_docs").where(~F.col("_stays") | (F.col("id") > F.col("_first"))).select("id", "x", F.array("at").alias("numbers"))
    again = found.where("more is not null").select("id", "x", F.col("more").alias("numbers"))
    # a line that goes goes with its repeats
    return gone.unionByName(again).groupBy("id", "x").agg(F.flatten(F.collect_list("numbers")).alias("drops"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2, least: int = 1, per: int = 8) -> DataFrame:
    """``docs`` with their texts free of repeated lines, and columns _n_lines and _n_dropped.

    Two lines are linked if they are at most ``limit`` edits apart and at most one edit for every ``per`` characters of the shorter: a
    fixed number of edits would link unlike short lines, and lines of fewer than ``per`` characters if they are equal. Outer
    white space is left out; lines of fewer than ``least`` characters (by default blank ones) always stay. Of each class, the
    line that comes first by (id, line number) stays, and every other occurrence is dropped, in the same document too. Links are
    verified, and classes are their connected components.

    1. Equal lines are one line, aggregated in each task before they are shuffled.
    2. Each line enters its segments, one more than edits, in an index and probes it with the substrings that could be a segment of a
       line a little shorter; entries of 12 bytes meet in bounded buckets. Crowded keys are split by a second segment.
    3. Lines that share a key are verified by a banded bit-parallel edit distance, texts being fetched for them only, unless
       their counts of characters rule it out or they are connected already.

    Null and empty texts come back as they are. Rows with a null id stay as they are, and nothing is dropped for their sake.
    Rows of one id count as one document, each keeping what the document's first row would. Other columns are kept,
    whatever their names. An empty table gives none.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at_id, at_text = (docs.columns.index(c) for c in (id_col, text_col))
    rows = plain.withColumnsRenamed({names[at_text]: "text"}).withColumn("id", F.col(names[at_id]).cast("long")).withColumn("x", F.xxhash64("text"))
    keyed = rows.where("id is not null").select("id", "x", "text")
    found, lines, _ = classes(keyed, limit, max(1, least), max(1, per))
    joined = squeezed(rows).join(dropped(found, lines).hint("shuffle_hash"), ["id", "x"], "left")
    kinds = rows.select(*[c for c in rows.columns if c not in ("id", "x")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for z, drop in zip(b.column(b.schema.names.index("text")).to_pylist(), b.column(b.schema.names.index("drops")).to_pylist()):
                text = None if z is None else inflate(z).decode()
                n_lines.append(0 if text is None else text.count("\n") + 1)
                n_dropped.append(len(drop or ()))
                if drop:
                    gone = set(drop)
                    text = "\n".join([line for k, line in enumerate(text.split("\n")) if k not in gone])
                texts.append(text)
            keep = [n for n in b.schema.names if n not in ("id", "x", "drops")]
            cols = [pa.array(texts, pa.string()) if n == "text" else b.column(b.schema.names.index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*keep, "_n_lines", "_n_dropped"])

    schema = kinds.add("_n_lines", "long").add("_n_dropped", "long")
    result = joined.mapInArrow(released(run), schema)
    return result.select(*[F.col("text" if k == at_text else n).alias(docs.columns[k]) for k, n in enumerate(names)], "_n_lines", "_n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
