"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, released, table
from .edits import nearest

U = np.uint64
#: Bits of the table that tells whether eight bytes may begin a piece.
BITS = 22
FACTOR = U(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    """Lower case, with white space as single spaces."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece): errors + 1 pieces, as even as can be; one of them is untouched by any ``errors`` edits."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def grouped(cuts: list[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
    """For each piece, (start, end, errors) of the two pieces that it is one of, or three at the end.

    Of all such groups, one has fewer errors than pieces, and so one untouched piece within (Navarro and Baeza-Yates 1999).
    """
    ends = [a + len(p) for a, p in cuts]
    whole = max(1, len(cuts) // 2)
    for k in range(len(cuts)):
        g = min(k // 2, whole - 1)
        last = len(cuts) - 1 if g == whole - 1 else 2 * g + 1
        yield cuts[2 * g][0], ends[last], last - 2 * g


def _eights(raw: bytes) -> list[np.ndarray]:
    """The eight bytes at each place of ``raw``, place p being number p // 8 of array p % 8."""
    raw += b"\0" * 16
    return [np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k) for k in range(8)]


def _at(eights: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    out = np.empty(len(places), U)
    for k in range(8):
        own = places % 8 == k
        out[own] = eights[k][places[own] // 8]
    return out


class Matcher:
    """Finds items of one block in texts, each within its error budget.

    Pieces are looked up by their first bytes, eight at most, at every place of a text, and by their last eight: arrays of 40 bytes a
    piece. Where one is found, it is verified with its neighbour first and with the whole item then.
    """

    def __init__(self, items: list[str], rate: float, least: int):
        self.items = items
        self.budgets = [budget(len(x), rate) if len(x) >= least else 0 for x in items]
        self.least = least
        found, groups = [], []
        for k, (own, e) in enumerate(zip(items, self.budgets)):
            cuts = pieces(own, e) if own else []
            found += [(k, start, piece.encode()) for start, piece in cuts]
            groups += grouped(cuts)
        item, start = (np.array([f[c] for f in found], np.int32) for c in (0, 1))
        self.near = np.array(groups, np.int32).reshape(-1, 3)
        size = np.array([len(f[2]) for f in found], np.int32)
        first, last = (np.frombuffer(b"".join([end(f[2]).ljust(8, b"\0") for f in found]), "<u8") for end in (lambda p: p[:8], lambda p: p[-8:]))
        self.groups = []
        for q in np.unique(np.minimum(size, 8)).tolist():
            own = np.flatnonzero(np.minimum(size, 8) == q)
            own = own[np.argsort(first[own], kind="stable")]
            keys, at, n = np.unique(first[own], return_index=True, return_counts=True)
            seen = np.zeros(1 << BITS, bool)
            seen[(keys * FACTOR) >> U(64 - BITS)] = True
            self.groups.append((U((1 << 8 * q) - 1), seen, keys, at, n, own.astype(np.int32), item[own], start[own], size[own], last[own] if q == 8 else None))

    def hits(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, start, piece): where in ``raw`` a piece begins, and where the piece begins in its item."""
        eights, out = _eights(raw), []
        for mask, seen, keys, at, n, own, item, start, size, last in self.groups:
            for k, view in enumerate(eights):
                key = view & mask
                maybe = np.flatnonzero(seen[(key * FACTOR) >> U(64 - BITS)])
                j = np.minimum(np.searchsorted(keys, key[maybe]), len(keys) - 1)
                right = keys[j] == key[maybe]
                place, j = maybe[right] * 8 + k, j[right]
                many = n[j]
                which = np.repeat(at[j] - np.cumsum(many) + many, many) + np.arange(many.sum())
                place = np.repeat(place, many)
                if last is not None:
                    end = place + size[which] - 8
                    fits = end <= len(raw)
                    place, which, end = place[fits], which[fits], end[fits]
                    same = _at(eights, end) == last[which]
                    place, which = place[same], which[same]
                out.append((place, item[which], start[which], own[which]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item number, distance, end) of the best match of each item in each text, in plain form."""
        texts = [plain(t) for t in texts]
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raws])
        raw = b"\n".join(raws)
        place, item, start, piece = self.hits(raw)
        owner = np.searchsorted(ends, place, side="right")
        order = np.lexsort((place, item, owner))
        places: dict[tuple[int, int], list[tuple]] = {}
        for d, k, p in zip(owner[order].tolist(), item[order].tolist(), zip(place[order].tolist(), start[order].tolist(), self.near[piece[order]].tolist())):
            places.setdefault((d, k), []).append(p)
        chars: tuple[int, np.ndarray | None] = -1, None
        for (d, k), found in places.items():
            text, own, spare, best = texts[d], self.items[k], self.budgets[k], None
            at = int(ends[d]) - len(raws[d]) - 1
            if len(raws[d]) > len(text) and chars[0] != d:
                chars = d, np.cumsum((np.frombuffer(raws[d], np.uint8) & 0xC0) != 0x80) - 1
            spans: list[list[int]] = []
            for p, s, (a, z, e) in found:
                p = (int(chars[1][p - at]) if len(raws[d]) > len(text) else p - at) - s
                if z - a < len(own) and nearest(own[a:z], text[max(0, p + a - e) : p + z + e])[0] > e:
                    continue
                low, high = max(0, p - spare), p + len(own) + spare
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                    spans[-1][0] = min(spans[-1][0], low)
                else:
                    spans.append([low, high])
            for low, high in spans:
                if len(own) < self.least:
                    # short items match exactly, between word boundaries
                    while (low := text.find(own, low, high)) >= 0:
                        end = low + len(own)
                        if not (text[low - 1 : low].isalnum() and own[0].isalnum() or text[end : end + 1].isalnum() and own[-1].isalnum()):
                            best = best or (0, end)
                        low += 1
                    continue
                distance, end = nearest(own, text[low:high])
                if distance <= spare and (best is None or distance < best[0]):
                    best = distance, low + end
            if best:
                yield d, k, *best


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> tuple[DataFrame, int]:
    """(id, text, block): the distinct items, dealt by a hash into blocks of about ``most`` characters, and how many blocks there are."""
    items = cut(benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct())
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // most))
    return items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n


_known: dict[tuple, Matcher] = {}


def matcher(shared: Broadcast, rate: float, least: int) -> tuple[list[int | None], Matcher]:
    """The block's ids and its matcher, which a worker builds once for all of its tasks."""
    ids, items = shared.value
    name = (id(items), rate, least)
    if name not in _known:
        _known.clear()
        _known[name] = Matcher(items, rate, least)
    return ids, _known[name]


def passes(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[Broadcast, bool]]:
    """Each block, broadcast while it is in use, and whether it is the only one."""
    items, n = blocks(benchmark, id_col, text_col, most)
    for k in range(n):
        rows = items.where(F.col("block") == k).select("id", "text").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast((rows["id"].to_pylist(), [plain(t) for t in rows["text"].to_pylist()])), n == 1


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08, least: int = 24, block: int = 8_000_000) -> DataFrame:
    """(id, item_id, distance, end): items of ``benchmark`` of which a document holds a passage within the error budget.

    Texts are compared in lower case with white space as single spaces. The budget is ``rate`` edits per character of the item,
    rounded down. An item is split into budget + 1 pieces, of which one must occur exactly; every place of a text is
    looked up among the pieces, and the surroundings of a hit are verified with Myers' bit-parallel distance. The
    distance is the least over the passages found, end the place in the plain text where the passage ends.

    Items shorter than ``least`` characters match exactly, between word boundaries; null or blank ones match nothing. Items with a
    null id match, too. A block of items of about ``block`` characters passes through the driver and is broadcast; a larger benchmark
    takes more passes over the documents, one at a time. Null and empty texts have no match; texts may be of any length. Repeated
    rows each have their matches; a null id is kept. Repeated items count once. An empty table gives none.
    """
    kind = "id long, item_id long, distance int, end int"
    rows, found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), None
    for shared, only in passes(benchmark, item_col, item_text_col, block):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, match = matcher(shared, rate, least)
            for b in batches:
                own = b.column(0).to_pylist()
                out = [(own[d], ids[k], e, end) for d, k, e, end in match(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "item_id", "distance", "end"])

        part = rows.mapInArrow(released(run), kind)
        if not only:
            part = cut(part)
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08, least: int = 24, block: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, as ``matches`` finds them; with one block, nothing is shuffled."""
    columns = docs.columns
    at, names = columns.index(text_col), [f"c{k}" for k in range(len(columns))]
    out = docs.toDF(*names)
    marks = [F.xxhash64(names[at]).alias("_x"), F.crc32(F.col(names[at]).cast("binary")).alias("_y")]
    bad = None
    for shared, only in passes(benchmark, item_col, item_text_col, block):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            _, match = matcher(shared, rate, least)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in match(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        def leaking(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            _, match = matcher(shared, rate, least)
            for b in batches:
                yield b.select([0, 1]).take(pa.array(sorted({d for d, *_ in match(b.column(2).to_pylist())}), pa.int64()))

        if only:
            return out.mapInArrow(clean, out.schema).toDF(*columns)
        part = cut(out.select(*marks, names[at]).mapInArrow(leaking, "_x long, _y long").distinct())
        shared.unpersist()
        bad = part if bad is None else bad.unionByName(part)
    return out.select("*", *marks).join(bad.distinct(), ["_x", "_y"], "left_anti").select(*names).toDF(*columns)


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "distance")
