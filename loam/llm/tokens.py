"""Token ids from a public tokenizer file, and exact length histograms."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, released, table

TOKENIZER = "word_bpe_49k.json"


#: Letters and then ASCII punctuation other than the apostrophe, which may begin a contraction.
WORD = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]{0,8})")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids as little-endian 32-bit bytes, equal to those of the tokenizer over the whole text.

    The tokenizer drops white space and never merges across it, so a text is encoded by its pieces between spaces and
    line ends, and the ids of pieces seen before are looked up. A piece of Latin letters with trailing punctuation is two words to the
    tokenizer, and goes straight to its merges; any other piece goes through the whole tokenizer. The table of known
    pieces is bounded, and long pieces are not kept.
    """

    def __init__(self, path: str | None = None, most: int = 500_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer, self.known, self.most, self.longest = Tokenizer.from_file(path), {"": b""}, most, longest
        self.words: dict[str, bytes] = {}
        self.merges, self.letters = self.tokenizer.model.tokenize, _byte_letters()

    def whole(self, pieces: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def new(self, pieces: list[str]) -> dict[str, bytes]:
        out, rest, words = {}, [], self.words
        if len(words) > self.most:
            words.clear()
        for piece in pieces:
            m = WORD.fullmatch(piece) if len(piece) <= self.longest else None
            if m is None or not m[1].isalpha() or max(m[1]) >= "\u0130":
                rest.append(piece)
                continue
            word, tail = m[1].lower(), m[2]
            ids = words.get(word)
            if ids is None:
                ids = words[word] = array("I", [x.id for x in self.merges(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if tail:
                end = words.get(tail)
                if end is None:
                    end = words[tail] = self.whole([tail])[0]
                ids += end
            out[piece] = ids
        if rest:
            out.update(zip(rest, self.whole(rest)))
        return out

    def __call__(self, text: str | None) -> bytes:
        pieces = (text or "").replace("\n", " ").split(" ")
        known = self.known
        if new := list(set(pieces).difference(known)):
            if len(known) + len(new) > self.most:
                known = self.known = {x: known[x] for x in set(pieces) if x in known} | {"": b""}
            extra = self.new(new)
            known.update({k: v for k, v in extra.items() if len(k) <= self.longest})
            if any(len(k) > self.longest for k in new):
                known = known | extra
        return b"".join([known[x] for x in pieces])


@lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, extra: int = 1) -> DataFrame:
    """(length long): encoded length of each row's whole text plus ``extra`` end tokens; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x)) // 4 + extra for x in b.column(0).to_pylist()], pa.int64())], ["length"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), "length long")


def histogram(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, extra: int = 1, block: int = 1024) -> DataFrame:
    """One row for each encoded length that occurs, which answers totals for every context limit exactly.

    length; n_docs of that length; docs_at_least and tokens_at_least: suffix sums over this length and all longer ones;
    total_tokens; truncated_tokens: the corpus' tokens if every document is cut at this length; rank: documents no longer
    than this, over all documents (the quantile that this length is). For a limit between two lengths, the truncated
    total is total_tokens - tokens_at_least + limit * docs_at_least of the next longer row.

    Lengths are counted with a partial sum in each task, so only distinct lengths are shuffled; suffix sums run within
    blocks of ``block`` lengths, offset by the sums of the blocks above. An empty table gives no row.
    """
    counts = cut(lengths(docs, text_col, tokenizer, extra).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")))
    blocked = counts.withColumn("_block", F.floor(F.col("length") / block))
    tokens = F.col("length") * F.col("n_docs")
    sums = blocked.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    above = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select("_block", F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_docs_above"), F.coalesce(F.sum("_tokens").over(above), F.lit(0)).alias("_tokens_above"), F.sum("_docs").over(everything).alias("total_docs"), F.sum("_tokens").over(everything).alias("total_tokens"))
    down = Window.partitionBy("_block").orderBy(F.col("length").desc())
    suffix = blocked.withColumns({"_docs_in": F.sum("n_docs").over(down), "_tokens_in": F.sum(tokens).over(down)}).join(offsets, "_block")
    docs_at_least, tokens_at_least = F.col("_docs_in") + F.col("_docs_above"), F.col("_tokens_in") + F.col("_tokens_above")
    return suffix.select(
        "length",
        "n_docs",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        "total_tokens",
        (F.col("total_tokens") - tokens_at_least + F.col("length") * docs_at_least).alias("truncated_tokens"),
        ((F.col("total_docs") - docs_at_least + F.col("n_docs")) / F.col("total_docs")).alias("rank"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"))
