"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, join_counted, released, shuffle_width, table

SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 20


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the XXH64 (seed 42) values of all ``width``-word shingles, repeats included, signed.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer words than ``width`` make one shingle; no word gives 0.
    Long texts are taken in blocks that end at white space, so memory is bounded by a block.
    """
    ones, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    text = text or b""
    while at < len(text):
        end = len(text)
        if end - at > BLOCK and (gap := SPACE.search(text, at + BLOCK)):
            end = gap.start()
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) < width:
            carry = words
            continue
        count, more = _ones(words, width)
        ones, n, carry = ones + more, n + count, words[1 - width :] if width > 1 else []
    if not n and carry:
        n, ones = _ones([b" ".join(carry)], 1)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True) if n else 0


def _ones(words: list[bytes], width: int) -> tuple[int, np.ndarray]:
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())])
    bits, total = np.frombuffer(hashes, np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for k in range(0, len(bits), 1 << 15):
        total += np.unpackbits(bits[k : k + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    return len(bits), total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, x, fp bigint) for every row of ``docs``, x being a hash of its text; a null text counts as no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, width) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["id", "x", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("x"), F.col(text_col).cast("binary").alias("text")).mapInArrow(released(run), "id long, x long, fp long")


def balls(fp: str, radius: int):
    """The fingerprints within ``radius`` bits of column ``fp``, as an array column; 65 for radius 1."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(64)}
    flips = [m - (1 << 64) if m >> 63 else m for m in sorted(masks)]
    return F.transform(F.array(*map(F.lit, flips)), lambda m: F.col(fp).bitwiseXOR(m.cast("long")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(id, x, fp bigint, root, component): fingerprints at most ``distance`` bits apart (an even number) are linked.

    Meet in the middle: each distinct fingerprint emits every value within distance / 2 bits of itself. Two fingerprints
    are within ``distance`` exactly if they share such a value. Fingerprints, not documents, are shuffled on the values,
    so a group of copies is one row, and a value collects at most as many rows as a ball has points: no key can be hot.
    Members of a value's group are linked to the group's least fingerprint instead of pairwise, the distance being verified.

    ``root`` names a component by one of its fingerprints, ``component`` by its least id. Null texts count as empty; empty texts
    share fingerprint 0 and are linked with each other. Rows with equal ids are kept, and linked by their own texts only. Null
    ids keep their row and link others; the component is the least non-null id reachable, or null. An empty table gives none.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    fps = cut(fingerprints(docs, id_col, text_col, width))
    reps = cut(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_rows")))
    # few bytes become many rows, so fingerprints are spread over all tasks before they do
    spread = reps.select("fp").repartition(shuffle_width(docs.sparkSession), "fp")
    reach = spread.select("fp", F.explode(balls("fp", distance // 2)).alias("value"))
    met = cut(reach.groupBy("value").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    pairs = met.where("n = 2").select("lo", F.col("hi").alias("fp"))
    # where three or more meet, they are among the points of the value's own ball
    larger = met.where("n > 2").select("lo", F.explode(balls("value", distance // 2)).alias("fp")).join(reps.select("fp"), "fp").where("fp <> lo").select("lo", "fp")
    links = pairs.unionByName(larger).distinct().where(F.bit_count(F.col("fp").bitwiseXOR(F.col("lo"))) <= distance)
    groups_of = components(links.select(F.col("fp").alias("u"), F.col("lo").alias("v"))).toDF("fp", "root")
    rooted = reps.join(groups_of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("fp", "root", "component", "n_rows")
    return join_counted(fps, named, ["fp"], "n_rows").select("id", "x", "fp", "root", "component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
