"""Packing of token sequences by first-fit decreasing over a tournament tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, released, table
from .tokens import encoder


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, crc, tokens): each document's ids and ``end_id``, cut every ``limit`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                out += [(key, a, min(limit, n - a), zlib.crc32(ids[4 * a : 4 * (a + limit)]), n) for a in range(0, n, limit)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 5, ["id", "start", "length", "crc", "tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(released(run), "id long, start long, length long, crc long, tokens long")


def first_fit(lengths: list[int], limit: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, the items being in descending order.

    Leaves of the tree are bins, each inner node holds the largest room below it; the leftmost leaf with room enough is
    found from the root, and the path back up is updated.
    """
    width = 1 << max(0, len(lengths) - 1).bit_length()
    room, out = [limit] * (2 * width), []
    for n in lengths:
        k = 1
        while k < width:
            k *= 2
            if room[k] < n:
                k += 1
        out.append((k - width, limit - room[k]))
        room[k] -= n
        while k > 1:
            k //= 2
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 1, tokenizer: str | None = None, group_rows: int = 4096) -> DataFrame:
    """(id, start, length, crc, tokens, sequence, offset): every piece's place in sequences of at most ``limit`` ids.

    Pieces are dealt at random, by a hash, into groups of about ``group_rows``, and each group is packed by itself, so
    memory and time of a task are bounded whatever the input; a group wastes about half a sequence for being alone. Texts stay where they
    are read; only piece lengths are shuffled. Within a sequence, offsets are gapless from 0.

    A null or empty text is one piece that holds only ``end_id``. Repeated rows are packed as often as they occur. Null ids
    are kept. An empty table gives none.
    """
    cuts = cut(pieces(docs, id_col, text_col, limit, end_id, tokenizer))
    groups = max(1, -(-cuts.count() // group_rows))
    dealt = cuts.withColumn("grp", F.pmod(F.xxhash64("id", "start", "crc", F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending")])
        placed = first_fit(rows["length"].to_pylist(), limit)
        sequence = pa.array(np.array([b for b, _ in placed], np.int64) + (rows["grp"].to_numpy() << 32))
        return rows.drop_columns("grp").append_column("sequence", sequence).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return dealt.groupBy("grp").applyInArrow(released(run), "id long, start long, length long, crc long, tokens long, sequence long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")
