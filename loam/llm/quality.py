"""Quality classifier: a weak-label model over heuristic labellers, and hashed linear scorers of its posterior labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, released, table

BITS = 18
#: Labelled rows that the stems are mined from and the scorers are fitted on, at most: those of the least hashes. Half as many
#: rows without a label join them for the scorers.
SAMPLE = 8000
#: How often a given label is taken to be wrong. Estimated next to labellers that are not independent, it would grow at the labels' cost.
WRONG = 1e-4
#: Weight of a document without a label where labels are given, in the label model and the scorers (EM-lambda, Nigam et al. 2000).
LIGHT = 0.1
RUNS = re.compile(r"[!#$%&*?~=+]{2,}(?!\S)")
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_~=+/\\"
#: Common English insults.
INSULTS = frozenset("idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown clowns".split())
INSULT_STEMS = frozenset(w[:5] for w in INSULTS)
#: (bad above, good below) of the shares that tell a defect by being high.
LIMITS = {"runs": (0.2, 0.02), "bars": (0.15, 0.02), "repeats": (0.25, 0.05), "capitals": (0.5, 0.2)}


def shares(text: str, words: list[str]) -> dict[str, float]:
    """Shares of a text's words: ending in runs of marks, bars, repeats of the word before, capitals; variety within a hundred words; full stops."""
    n = max(len(words), 1)
    blocks = [words[k : k + 100] for k in range(0, len(words), 100)]
    return {
        "runs": len(RUNS.findall(text)) / n,
        "bars": text.count("|") / n,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "capitals": sum(map(str.isupper, words)) / n,
        "variety": sum(len(set(b)) for b in blocks) / n,
        "stops": text.count(".") / n,
    }


def quality_votes(s: dict[str, float], n: int) -> list[int]:
    """1: bad, 0: good, -1: abstains, for each heuristic labeller.

    Each of the first looks for one defect and abstains where it sees none; the last calls a text good that is far from every limit.
    """
    votes = [1 if s[k] > bad else -1 for k, (bad, _) in LIMITS.items()]
    votes.append(1 if n >= 20 and s["variety"] < 0.35 else -1)
    votes.append(1 if n >= 20 and s["stops"] < 0.005 else -1)
    clean = all(s[k] < good for k, (_, good) in LIMITS.items()) and (n < 20 or s["variety"] > 0.5) and s["stops"] < 0.4
    return [*votes, 0 if clean else -1]


def _bucket(name: str) -> bytes:
    return (xxhash.xxh3_64_intdigest(name) >> (64 - BITS)).to_bytes(4, "little")


def bare(word: str) -> str:
    return word.lower().strip(EDGES)


def stems(words: list[str]) -> set[str]:
    """The first five letters of the words of a text."""
    return {bare(w)[:5] for w in set(words)}


class Features:
    """Hashed features that occur in a text: its words, their first five letters, the marks they end in, and its shares in steps."""

    def __init__(self, most: int = 300_000, longest: int = 64):
        self.known: dict[str, bytes] = {}
        self.most, self.longest = most, longest

    def __call__(self, words: list[str], s: dict[str, float]) -> np.ndarray:
        known, parts = self.known, [_bucket(f"{k}:{min(9, int(10 * v))}:{int(100 * v) if v < 0.05 else ''}") for k, v in s.items()]
        if len(known) > self.most:
            known.clear()
        for w in set(words):
            got = known.get(w)
            if got is None:
                b = bare(w)
                got = _bucket("w:" + b) + _bucket("s:" + b[:5])
                if not w[-1].isalnum():
                    got += _bucket("m:" + w[-3:].lstrip(b))
                if len(w) <= self.longest:
                    known[w] = got
            parts.append(got)
        return np.unique(np.frombuffer(b"".join(parts), "<u4"))


def fit_linear(rows: list[np.ndarray], p: np.ndarray, epochs: int = 4, rate: float = 0.3, lasso: float = 0.0015, ridge: float = 0.1, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the intercept) of a logistic regression on present features, by FTRL-proximal steps.

    Labels are probabilities; the rarer class weighs as much as the other, and a row as ``weights`` say. The lasso, given for each row, leaves most weights at
    zero, so that a long text's many features add no noise.
    """
    z, n, w = (np.zeros((1 << BITS) + 1) for _ in range(3))
    weights = np.ones(len(rows)) if weights is None else weights
    share = min(max(np.average(p, weights=weights), 1e-3), 1 - 1e-3)
    order, lasso = np.random.default_rng(0), max(1.0, lasso * weights.sum())
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = np.append(rows[k], 1 << BITS)
            guess = 1 / (1 + np.exp(-np.clip(w[i].sum(), -30, 30)))
            g = weights[k] * (guess - p[k]) * (p[k] * 0.5 / share + (1 - p[k]) * 0.5 / (1 - share))
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rate
            z[i] += g - step * w[i]
            n[i] += g * g
            small = np.abs(z[i]) <= lasso
            small[-1] = False
            w[i] = np.where(small, 0, -(z[i] - np.sign(z[i]) * lasso * (i < 1 << BITS)) / ((1 + np.sqrt(n[i])) / rate + ridge))
    return w.astype("f4")


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray | None = None, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior of bad, rates, posterior of bad for each pattern), from vote patterns and how often each occurs.

    ``rates[j, c, v]``: how often labeller j gives vote v (0: good, 1: bad, 2: abstains) on class c (1: bad), independently of the
    others given the class (Dawid and Skene 1979). An abstention tells something if its rate differs between the classes. Starts
    from the share of bad votes; a few counts are added to each rate, the more where labeller and class agree. ``gold`` (-1:
    none) is a further labeller, wrong at the rate ``WRONG``; where it abstains it tells nothing, as what has a label is no matter
    of the class. It comes last in ``rates``. Patterns without it weigh ``LIGHT``, unless none has it.
    """
    votes = np.stack([patterns == 0, patterns == 1, patterns < 0], axis=2).astype(float)
    given = votes[:, :, :2].sum((1, 2))
    post = np.where(given > 0, (votes[:, :, 1].sum(1) + 0.02) / (given + 0.2), 0.1)
    extra = np.broadcast_to(np.array([[2.0, 0.5, 1.0], [0.5, 2.0, 1.0]])[:, None], (2, patterns.shape[1], 3))
    if gold is not None:
        votes = np.concatenate([votes, np.stack([gold == 0, gold == 1, np.zeros(len(gold))], axis=1)[:, None].astype(float)], axis=1)
        post = np.where(gold >= 0, gold, post)
        counts = np.where((gold < 0) & (gold >= 0).any(), LIGHT, 1.0) * counts
        extra = np.concatenate([extra, np.full((2, 1, 3), 1e-9)], axis=1)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = (weight[1].sum() + 1) / (weight.sum() + 10)
        rates = np.einsum("cp,pjv->jcv", weight, votes) + extra.transpose(1, 0, 2)
        rates /= rates.sum(2, keepdims=True)
        if gold is not None:
            rates[-1, :, :2] = [[1 - WRONG, WRONG], [WRONG, 1 - WRONG]]
        likely = np.einsum("pjv,jcv->pc", votes, np.log(rates)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(likely[:, 0] - likely[:, 1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(prior), rates, new


def mine(rows: pa.ListArray, toxic: np.ndarray, least: int = 8) -> tuple[frozenset[str], np.ndarray]:
    """The stems that mark toxic rows among labelled ones, in ``least`` of them or more and in next to no other row, and how many each row has."""
    flat, owner = rows.flatten().dictionary_encode(), np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
    codes, names = flat.indices.to_numpy(), flat.dictionary
    hits, other = (np.bincount(codes[toxic[owner] == t], minlength=len(names)) for t in (1, 0))
    marks = (hits >= least) & (other <= 0.004 * hits) & (pc.binary_length(names).to_numpy() > 0)
    return frozenset(names.filter(pa.array(marks)).to_pylist()), np.bincount(owner, marks[codes], len(rows)).astype(np.int64)


def stem_votes(insult: int, n: int) -> list[int]:
    """The toxic labellers' votes: an insult, one or two mined stems, more of them. No two say the same, as labellers should be independent."""
    return [insult, 1 if 0 < n < 3 else -1, 1 if n > 2 else -1]


def toxic_votes(words: list[str], found: set[str], marks: frozenset[str]) -> list[int]:
    """Insults of a fixed list; a few mined stems; several mined stems. Where none is found, all abstain, which tells something, too."""
    insult = not INSULT_STEMS.isdisjoint(found) and any(bare(w) in INSULTS for w in set(words))
    return stem_votes(1 if insult else -1, len(marks & found))


@dataclass
class Model:
    """What scoring needs, and what was estimated: label model accuracies by task."""

    quality: np.ndarray
    toxic: np.ndarray
    accuracies: dict[str, np.ndarray] = field(default_factory=dict)
    priors: dict[str, float] = field(default_factory=dict)


def _examined(docs: DataFrame) -> DataFrame:
    """(id, quality, toxic, votes, insult, stems, features) of sampled rows: labels as given, heuristic votes and hashed features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            votes, insults, starts, found = [], [], [], []
            for t in b.column(3).to_pylist():
                words = (t or "").split()
                s = shares(t or "", words)
                starts.append(sorted(stems(words)))
                votes.append(quality_votes(s, len(words)))
                insults.append(toxic_votes(words, set(starts[-1]), frozenset())[0])
                found.append(features(words, s).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(votes, pa.list_(pa.int32())), pa.array(insults, pa.int32()), pa.array(starts, pa.list_(pa.string())), pa.array(found, pa.binary())], ["id", "quality", "toxic", "votes", "insult", "stems", "features"])

    return docs.select("id", "quality", "toxic", "text").mapInArrow(released(run), "id long, quality int, toxic int, votes array<int>, insult int, stems array<string>, features binary")


def _votes(docs: DataFrame, marks: frozenset[str]) -> DataFrame:
    """(id, quality_votes, toxic_votes): the heuristic votes of each document with words, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, votes = [], ([], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (t or "").split()
                if words:
                    ids.append(i)
                    votes[0].append(",".join(map(str, quality_votes(shares(t, words), len(words)))))
                    votes[1].append(",".join(map(str, toxic_votes(words, stems(words), marks))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(v, pa.string()) for v in votes)], ["id", "quality_votes", "toxic_votes"])

    return docs.select("id", "text").mapInArrow(released(run), "id long, quality_votes string, toxic_votes string")


def _patterns(docs: DataFrame, gold: DataFrame, marks: frozenset[str]) -> DataFrame:
    """(task, pattern, n): how often each pattern of votes, the label at its end, occurs in all documents.

    Votes are joined with the labels, not texts, which stay where they are read.
    """
    known = _votes(docs, marks).join(gold, "id", "left")
    pattern = lambda votes, label: F.concat_ws(",", votes, F.coalesce(label, F.lit(-1)).cast("string"))
    tasks = F.array(F.struct(F.lit("quality").alias("task"), pattern(F.col("quality_votes"), 1 - F.col("quality")).alias("pattern")), F.struct(F.lit("toxic").alias("task"), pattern(F.col("toxic_votes"), F.col("toxic")).alias("pattern")))
    return known.select(F.explode(tasks).alias("t")).groupBy("t.task", "t.pattern").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The label model over all of ``docs`` and the scorers of its posterior labels.

    ``labels`` (the id, quality: 1 good, toxic: 1 toxic, null or missing: unknown) is one more labeller, next to the heuristic
    ones, and calibrates them. Votes are counted by pattern over all documents, of which there are few, and
    expectation-maximisation runs on the counts. Stems are mined from at most ``sample`` labelled rows, those whose ids have the
    least hashes. Scorers are fitted on the posteriors of these and of half as many rows without a label, chosen alike; if there
    are no labels, of ``sample`` rows. Several label rows of an id count as one, the least.

    Null and empty texts have no words and no votes; they weigh in the scorers, if sampled, by their labels alone. Rows with a null id vote,
    unlabelled. Repeated rows count as often as they occur, labels of ids that ``docs`` lacks not at all. Without rows there is
    nothing to fit: all weights are zero.
    """
    gold = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("id is not null").groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    present = rows.where("id is not null").select("id").distinct()
    chosen = cut(gold.join(present, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample))
    others = present.join(gold, "id", "left_anti").orderBy(F.xxhash64("id"), "id")
    others = others.limit(sample if chosen.isEmpty() else sample // 2).withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    # the sample is bounded by its parameter
    known = rows.join(F.broadcast(chosen.unionByName(others)), "id")
    # in an order that doesn't depend on partitions, which the scorers' steps follow
    seen = _examined(known).toArrow().sort_by([("id", "ascending"), ("features", "ascending")])
    features = [np.frombuffer(x, "<u4") for x in seen["features"].to_pylist()]
    value = lambda name: np.array([-1 if x is None else x for x in seen[name].to_pylist()], np.int64)
    quality, toxic = value("quality"), value("toxic")
    marks, n_marks = mine(pa.concat_arrays(seen["stems"].chunks), toxic) if len(seen) else (frozenset(), np.zeros(0, np.int64))
    counted = _patterns(rows, gold, marks).toArrow().to_pylist()
    votes = {"quality": [[*v, -1 if q < 0 else 1 - q] for v, q in zip(seen["votes"].to_pylist(), quality.tolist())], "toxic": []}
    for insult, n, x in zip(seen["insult"].to_pylist(), n_marks.tolist(), toxic.tolist()):
        votes["toxic"].append([*stem_votes(insult, n), x])
    del seen
    model = Model(np.zeros((1 << BITS) + 1, "f4"), np.zeros((1 << BITS) + 1, "f4"))
    for task, given in votes.items():
        patterns = sorted((tuple(map(int, r["pattern"].split(","))), r["n"]) for r in counted if r["task"] == task)
        if not patterns or not given:
            continue
        names = np.array([p for p, _ in patterns])
        model.priors[task], model.accuracies[task], post = expectation_maximisation(names[:, :-1], np.array([n for _, n in patterns], float), names[:, -1])
        of = {p: x for (p, _), x in zip(patterns, post)}
        p = np.array([of.get(tuple(v), model.priors[task]) for v in given])
        labelled = np.array([v[-1] >= 0 for v in given])
        setattr(model, task, fit_linear(features, p, weights=np.where(labelled | ~labelled.any(), 1.0, LIGHT)))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with _bad and _toxic, the scorers' probabilities; null where a text is null or has no words.

    Rows are scored one by one, whole texts, whatever their ids and other columns. An empty table gives none.
    """
    return _scored(docs, model, text_col).toDF(*docs.columns, "_bad", "_toxic")


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """As ``score``, the columns of ``docs`` by number."""
    shared = docs.sparkSession.sparkContext.broadcast((model.quality, model.toxic))
    at = docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(), shared.value
        for b in batches:
            out: list[list] = [[], []]
            for t in b.column(at).to_pylist():
                words = (t or "").split()
                f = features(words, shares(t, words)) if words else None
                for w, to in zip(weights, out):
                    to.append(None if f is None else float(1 / (1 + np.exp(-np.clip(float(w[f].sum(dtype="f8")) + float(w[-1]), -30, 30)))))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.float64()) for x in out)], [*names, "_bad", "_toxic"])

    schema = StructType([*plain.schema, StructField("_bad", DoubleType()), StructField("_toxic", DoubleType())])
    return plain.mapInArrow(released(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bad: float = 0.6, toxic: float = 0.25) -> DataFrame:
    """``docs`` with _bad, _toxic and _kept: whether both scores are below their limits.

    Rows without words (null or empty texts, white space) have null scores and are not kept. Rows are scored one by one:
    repeated rows, null ids and further columns, whatever their names, come back as they are. An empty table gives none.
    """
    scored = _scored(docs, fit(docs, labels, id_col, text_col), text_col)
    kept = F.coalesce((F.col("_bad") < bad) & (F.col("_toxic") < toxic), F.lit(False))
    return scored.withColumn("_kept", kept).toDF(*docs.columns, "_bad", "_toxic", "_kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("_bad", 6).alias("p_low_quality"), F.round("_toxic", 6).alias("p_toxic"), F.col("_kept").alias("kept"))
