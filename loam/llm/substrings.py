"""Substring dedup by prefix-partitioned suffix trees over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, released, table

#: Words of an anchor; an anchor is the least of all grams of a window, so equal windows have equal anchors.
GRAM = 18
BASE = 0x9E3779B97F4A7C15
#: Documents in which an anchor may occur before its suffixes are partitioned by their whole window instead.
HOT = 512
#: Segments whose suffix trees are built together.
GROUP = 20_000

U = np.uint64
_powers = {1: np.ones(1, U), -1: np.ones(1, U)}


def _power(sign: int, n: int) -> np.ndarray:
    if len(_powers[sign]) < n:
        step = U(BASE if sign > 0 else pow(BASE, -1, 1 << 64))
        _powers[sign] = np.concatenate((np.ones(1, U), np.cumprod(np.full(max(n, 1 << 16) * 2, step))))
    return _powers[sign][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes: a polynomial, mixed."""
    n = len(hashes)
    if n < width:
        return np.empty(0, U)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(hashes * _power(1, n))))
    return _mix((sums[width:] - sums[:-width]) * _power(-1, n - width + 1))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), U)


class Anchors:
    """The windows of a batch of documents, by the anchor that each has.

    ``doc`` and ``at``: for each anchor occurrence its document and its first window's start there; ``n``: how many
    windows in a row have this anchor; ``gram``: the anchor's hash.
    """

    def __init__(self, docs: list[list[bytes]], width: int, gram: int):
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        ends = np.cumsum(sizes)
        self.words = [w for d in docs for w in d]
        self.first = ends - sizes
        self.hashes = word_hashes(self.words)
        hashed = grams(self.hashes, gram)
        least = (hashed & U(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=U)
        span, done = width - gram + 1, 1
        while done < span:
            step = min(done, span - done)
            least, done = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0], done + step
        starts = np.arange(len(least))
        doc = np.searchsorted(ends, starts, side="right")
        inside = starts + width <= ends[doc] if len(least) else np.zeros(0, bool)
        starts, doc, at = starts[inside], doc[inside], (least[inside] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))) if len(at) else np.zeros(0, np.int64)
        self.doc, self.start, self.n = doc[new], starts[new], np.diff(np.append(new, len(at)))
        self.gram = hashed[at[new]].view(np.int64)
        self.at = self.start - self.first[self.doc] if len(new) else self.start


def scan(docs: DataFrame, width: int) -> DataFrame:
    """(id, x, n_words, sha, anchors): one row for each document, with the distinct anchors of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or b"").split() for t in b.column(2).to_pylist()]
            sha = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            a = Anchors(words, width, min(GRAM, width))
            pair = np.unique(np.rec.fromarrays([a.doc, a.gram])) if len(a.doc) else np.rec.fromarrays([a.doc, a.gram])
            offsets = np.searchsorted(pair.f0, np.arange(len(words) + 1))
            anchors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pair.f1, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, words)), pa.int64()), pa.array(sha, pa.binary()), anchors], ["id", "x", "n_words", "sha", "anchors"])

    return docs.select("id", "x", F.col("text").cast("binary")).mapInArrow(released(run), "id long, x long, n_words long, sha binary, anchors array<long>")


def squeezed(docs: DataFrame) -> DataFrame:
    """(id, x, z): the texts compressed, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press(t or b"") for t in b.column(2).to_pylist()], pa.binary())], ["id", "x", "z"])

    return docs.select("id", "x", F.col("text").cast("binary")).mapInArrow(released(run), "id long, x long, z binary")


def segments(hits: DataFrame, width: int, hot: bool) -> DataFrame:
    """The stretches of text that share an anchor with another document, from (id, x, z, cold, hot).

    Cold anchors: (anchor, id, x, starts, segment), the words of a run of windows with one anchor, once for each distinct
    content. Hot anchors: (anchor, suffix, id, x, starts), the hash of each whole window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate, gram = zstandard.ZstdDecompressor().decompress, min(GRAM, width)
        for b in batches:
            words = [inflate(z).split() for z in b.column(2).to_pylist()]
            a, wanted = Anchors(words, width, gram), b.column(3)
            owner = np.repeat(np.arange(len(words)), np.diff(wanted.offsets.to_numpy()))
            want = set(zip(owner.tolist(), wanted.flatten().to_pylist()))
            take = [k for k, key in enumerate(zip(a.doc.tolist(), a.gram.tolist())) if key in want]
            whole = grams(a.hashes, width).view(np.int64) if hot else None
            found: dict[tuple, list[int]] = {}
            for k in take:
                d, g, s, n, at = int(a.doc[k]), int(a.gram[k]), int(a.start[k]), int(a.n[k]), int(a.at[k])
                if hot:
                    for j, h in enumerate(whole[s : s + n].tolist()):
                        found.setdefault((d, g, h), []).append(at + j)
                else:
                    found.setdefault((d, g, b" ".join(a.words[s : s + n + width - 1])), []).append(at)
            keys = list(found)
            owners = pa.array([d for d, _, _ in keys], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for _, g, _ in keys], pa.int64()), b.column(0).take(owners), b.column(1).take(owners), pa.array(found.values(), pa.list_(pa.int32())), pa.array([v for _, _, v in keys], pa.int64() if hot else pa.binary())],
                ["anchor", "id", "x", "starts", "content"],
            )

    wanted = hits.where(F.size("hot" if hot else "cold") > 0).select("id", "x", "z", "hot" if hot else "cold")
    return wanted.mapInArrow(released(run), f"anchor long, id long, x long, starts array<int>, content {'long' if hot else 'binary'}")


def named(hashes: np.ndarray, width: int) -> np.ndarray:
    """The suffix-tree node at depth ``width`` below which each position's suffix lies.

    Karp-Miller-Rosenberg naming: nodes at depth d and d' of a suffix and of its remainder name the node at depth d + d'.
    """
    node, done = np.unique(hashes, return_inverse=True)[1].astype(np.int64), 1
    while done < width:
        step = min(done, width - done)
        node = np.unique((node[:-step] << 32) | node[step:], return_inverse=True)[1].astype(np.int64)
        done += step
    return node


def subtree(rows: pa.Table, width: int) -> pa.Table:
    """(id, x, lo, hi): maximal runs of words that repeat a document of a smaller id, within one group of prefixes.

    Each distinct segment enters once, with its least id. Internal nodes at depth ``width`` gather the suffixes that agree
    on so many words; a node's least id decides for all suffixes below it.
    """
    ids, contents = rows["id"].to_numpy(), rows["content"].to_pylist()
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(c, len(known)) for c in contents), np.int64, len(contents))
    words = [c.split(b" ") for c in known]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    least = np.full(len(words), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    node = named(word_hashes([w for s in words for w in s]), width)
    windows = sizes - width + 1
    at = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    smallest = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(smallest, node[at], np.repeat(least, windows))
    smallest = smallest[node]
    out = []
    xs, starts = rows["x"].to_pylist(), rows["starts"].to_pylist()
    for k, (w, i) in enumerate(zip(which.tolist(), ids.tolist())):
        repeats = smallest[first[w] : first[w] + windows[w]] < i
        if repeats.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], repeats.view(np.int8), [0]))))
            out += [(i, xs[k], s + a, s + b + width - 1) for s in starts[k] for a, b in edge.reshape(-1, 2).tolist()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], ["id", "x", "lo", "hi"])


def remove(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, x, n_removed, kept): texts without the words in any of their spans, words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for b in batches:
            removed, kept = [], []
            for z, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = inflate(z).split()
                depth = np.zeros(len(words) + 1, np.int64)
                edges = np.array([(s["lo"], s["hi"]) for s in spans])
                np.add.at(depth, edges[:, 0], 1)
                np.add.at(depth, edges[:, 1], -1)
                stay = np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()
                removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[k] for k in stay]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "x", "n_removed", "kept"])

    gathered = spans.groupBy("id", "x").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return texts.join(gathered.hint("shuffle_hash"), ["id", "x"]).select("id", "x", "z", "spans").mapInArrow(released(run), "id long, x long, n_removed long, kept binary")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, spans, texts): every document; the word spans that repeat a document of a smaller id; compressed texts.

    base: (id, x, n_words, sha, first), x being a hash of the text that goes with the id, sha the SHA-256 of the words, and
    first the least id with the same words. spans: (id, x, lo, hi), for documents that are the first of their words; a document
    that is not the first repeats as a whole.

    1. Each window of ``width`` words has as its anchor the least of its grams. Equal windows have equal anchors, so only
       windows whose anchor occurs in two different documents can repeat; nothing else is dropped.
    2. A suffix that starts such a window is partitioned by its prefix up to its anchor's end, a prefix of variable length:
       suffixes with one anchor go to one group together, as the words of a run of windows. Groups are bounded: an anchor
       in over ``HOT`` documents has its prefixes lengthened to the whole window, where one partial aggregate a node is enough.
    3. A suffix tree of each group, down to ``width`` words, gives the nodes whose suffixes are repeats.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("x"), text.alias("text"))
    scanned = cut(scan(rows, width))
    firsts = scanned.groupBy("sha").agg(F.min("id").alias("first"))
    base = cut(scanned.join(firsts, "sha").select("id", "x", "n_words", "sha", "first", F.when(F.col("id") == F.col("first"), F.col("anchors")).alias("anchors")))
    anchors = base.where("anchors is not null").select("id", "x", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("anchor", "n")
    met = anchors.join(shared, "anchor")
    hits = cut(met.groupBy("id", "x").agg(F.collect_set(F.when(F.col("n") <= HOT, F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot")))
    texts = squeezed(rows)
    held = texts.join(hits.hint("shuffle_hash"), ["id", "x"])
    total = hits.agg(F.sum(F.size("cold"))).first()[0] or 0
    buckets = max(1, -(-total // GROUP))
    cold = segments(held, width, False).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    deep = cold.groupBy("bucket").applyInArrow(released(lambda t: subtree(t, width)), "id long, x long, lo int, hi int")
    windows = segments(held, width, True)
    nodes = windows.groupBy("anchor", "content").agg(F.min("id").alias("least"))
    leaves = windows.join(nodes, ["anchor", "content"]).where("id > least").select("id", "x", F.explode("starts").alias("lo"))
    spans = cut(deep.unionByName(leaves.select("id", "x", "lo", (F.col("lo") + width).alias("hi"))))
    return base, spans, texts


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """(id, n_words, n_removed, kept_sha): each document without words in a window that a smaller id's document also has.

    Words are ``[^\\x20\\x09-\\x0D]+``; windows are judged on the input. Null or empty texts have no words; a text of fewer
    than ``width`` words has no window and stays whole. Rows of one id are judged one by one, and only against smaller
    ids. Rows with a null id stay whole, and nothing is removed for their sake. An empty table gives none.
    """
    base, spans, texts = repeats(docs, id_col, text_col, width)
    parts = remove(texts, spans).select("id", "x", "n_removed", F.sha2("kept", 256).alias("kept_sha")).dropDuplicates(["id", "x"])
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= width)
    return base.join(parts, ["id", "x"], "left").select(
        "id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha"),
    )


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept_sha").alias("kept_sha256"))
