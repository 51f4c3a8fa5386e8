"""Quality classifier: Bradley-Terry ranking on preference pairs, cut at a score quantile.

A good document is preferred to a bad one. The probability of the preference is the logistic function of the
difference of their scores, scores are linear in the features, so the fit is logistic regression on feature
differences. The cut is the quantile of the scores at the share of bad documents among all labelled ones.

Every labelled row teaches. Rows are dealt into blocks, and all pairs of good and bad rows of a block are compared; a Newton
step adds up the blocks' gradients and curvatures where they lie, as whole numbers, so their order does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.plans.shared import Shared

from .common import crc_remainder, map_columns, text_bytes

#: Rows of the smaller class in a block, and at most so many of the larger.
FEW, MANY = 64, 1024
STEPS, RIDGE, NEAR = 60, 1e-3, 1e-7
#: Scores that are sorted at once to find the cut, and cells of a histogram of them.
AT_ONCE, CELLS = 10_000, 4096
_UNIT = 2.0**36

_LOWER, _UPPER, _DIGIT, _SPACE = (np.isin(np.arange(256), list(s)) for s in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r"))
_HIGH = np.arange(256) >= 128
_STOP, _ASK, _COMMA, _BANG, _QUOTE = (np.isin(np.arange(256), list(s)) for s in (b".", b"?", b",", b"!", b"\"'"))
_SYMBOL = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH | _STOP | _ASK | _COMMA | _BANG | _QUOTE)
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _ASK, _COMMA, _BANG, _QUOTE, _SYMBOL]).astype(np.float64)
N_FEATURES = 28


def features(text: bytes) -> list[float]:
    """Shares of kinds of bytes, word and line shapes, and repetition, of the whole text."""
    n = len(text)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = _CLASSES @ counts / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    trios = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2) if len(words) > 2 else 1.0
    p = counts[counts > 0] / n
    caps = sum(map(bytes.isupper, words)) / nw
    plain = sum(map(bytes.isalpha, words)) / nw
    marked = sum(1 for w in words if len(w) > 1 and w[-1] == w[-2]) / nw
    return [
        *shares.tolist(), np.log1p(len(words)), np.log1p(len(words)) ** 2 / 10, np.log1p(nl), float(lengths.mean()), float(lengths.std()), float(lengths.max()) ** 0.5, distinct / nw, trios,
        len(set(lines)) / nl, float(np.log1p(len(words) / nl)), float(-(p * np.log(p)).sum()), caps, plain, marked, float(np.log1p(counts.max() / n)), float(distinct < 5), 0.0,
    ]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 is the cut."""
        raw = ((x - self.mean) / self.scale).clip(-6, 6) @ self.weights
        return 1 / (1 + np.exp(-((raw - self.cut) / self.spread).clip(-500, 500)))


def _pairs(w: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Mean loss, gradient and curvature over all pairs of a block, in one row."""
    gap = ((good @ w)[:, None] - (bad @ w)[None, :]).clip(-500, 500)
    miss = 1 / (1 + np.exp(gap))
    bend = miss * (1 - miss)
    cross = good.T @ bend @ bad
    curve = (good * bend.sum(axis=1)[:, None]).T @ good + (bad * bend.sum(axis=0)[:, None]).T @ bad - cross - cross.T
    slope = bad.T @ miss.sum(axis=0) - good.T @ miss.sum(axis=1)
    return np.concatenate([[np.logaddexp(0, -gap).sum()], slope, curve.ravel()]) / gap.size


def _sums(blocks: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    n = len(w)

    def step(batches):
        total, seen = np.zeros(1 + n + n * n, np.int64), 0
        for b in batches:
            for good, bad in zip(b["good"], b["bad"]):
                z = [((np.array(x).reshape(-1, n) - mean) / scale).clip(-6, 6) for x in (good, bad)]
                total += np.rint(_pairs(w, *z) * _UNIT).astype(np.int64)
                seen += 1
        yield {"n": [seen], "sums": [total.tolist()]}

    rows = map_columns(blocks, step, "n long, sums array<long>").collect()
    total = np.array([sum(r["sums"][k] for r in rows) for k in range(1 + n + n * n)], np.float64) / _UNIT / sum(r["n"] for r in rows)
    return total[0], total[1 : n + 1], total[n + 1 :].reshape(n, n)


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(good, bad): features of rows side by side. Each row is in a block; those of the smaller class meet each part of the larger."""
    small = min(counts, key=lambda y: (counts[y], y))
    blocks = max(1, counts[small] // FEW)
    parts = -(-counts[1 - small] // (blocks * MANY))
    key = rows.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)), "row": F.struct("id", "x")})
    large = key.where(F.col("y") != small).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)))
    met = key.where(F.col("y") == small).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    side = lambda y: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("y") == y, F.col("row")))), lambda r: r["x"]))
    both = met.unionByName(large.select(*met.columns)).groupBy("block", "part").agg(side(1).alias("good"), side(0).alias("bad"))
    return both.select("good", "bad").where("size(good) > 0 and size(bad) > 0")


def _at(scores: DataFrame, place: int) -> float:
    """The score at a place (from 0) in ascending order, of all of them: the histogram's cell it lies in is taken for the next one."""
    while True:
        n, low, high = scores.agg(F.count("*"), F.min("raw"), F.max("raw")).first()
        if low == high or n <= AT_ONCE:
            return low if low == high else sorted(r["raw"] for r in scores.collect())[place]
        cell = F.least(F.floor((F.col("raw") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        for r in sorted(scores.groupBy(cell.alias("cell")).count().collect(), key=lambda r: r["cell"]):
            if place < r["count"]:
                scores = scores.where(cell == r["cell"])
                break
            place -= r["count"]


def _short(x) -> np.ndarray:
    """Sums of doubles differ in their last digits from run to run; these go."""
    return np.array([float(f"{v:.6g}") for v in x])


def fit(rows: DataFrame) -> Ranker:
    """Bradley-Terry over all (id, y, x), by Newton steps. One class alone: every score 0.5 and up or below."""
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        good = 1.0 if counts.keys() <= {1} else -1.0
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), -good, 1.0)
    shape = rows.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(N_FEATURES)]).first()
    mean, scale = _short(shape[:N_FEATURES]), np.maximum(_short(shape[N_FEATURES:]), 1e-6)
    blocks = Shared(_blocks(rows, counts))
    w, step, best = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.inf
    for _ in range(STEPS):
        loss, slope, curve = _sums(blocks.df, w + step, mean, scale)
        loss += RIDGE / 2 * float((w + step) @ (w + step))
        if loss <= best:
            w, best = w + step, loss
            step = -np.linalg.solve(curve + RIDGE * np.eye(N_FEATURES), slope + RIDGE * w)
        else:
            step = step / 2
        if np.abs(step).max() < NEAR:
            break
    blocks.drop()
    w = _short(w)

    def scored(batches):
        for b in batches:
            x = np.array(b["x"]).reshape(len(b["x"]), N_FEATURES)
            yield {"raw": (((x - mean) / scale).clip(-6, 6) * w).sum(axis=1).tolist()}

    raw = Shared(map_columns(rows.select("x"), scored, "raw double"))
    cut = (_at(raw.df, counts[0] - 1) + _at(raw.df, counts[0])) / 2
    spread = float(_short([raw.df.agg(F.stddev_pop("raw")).first()[0]])[0])
    raw.drop()
    return Ranker(mean, scale, w, cut, max(spread / 2, 1e-6))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learn=None) -> Ranker:
    """Fit on every labelled row, whole texts; only features leave the place where the texts are.

    Without labels every score is above the cut. Null ids and labels don't teach, of repeated labels the largest counts, and
    rows in ``docs`` that repeat an id each teach; other columns are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    teach = known.where(F.lit(True) if learn is None else learn).groupBy("id").agg(F.max("y").alias("y"))

    def step(batches):
        for b in batches:
            yield {"id": b["id"], "x": [features(t) for t in b["t"]]}

    source = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes("text").alias("t")).where("id is not null")
    rows = Shared(map_columns(source, step, "id long, x array<double>").join(teach, "id").select("id", "y", "x"))
    model = fit(rows.df)
    rows.drop()
    return model


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: 0 to 1, at least 0.5 above the cut.

    Null texts score as empty ones, texts of any length whole; repeated rows and null ids stay, an empty table gives no rows,
    and other columns, whatever their names, are ignored.
    """

    def step(batches):
        for b in batches:
            x = np.array([features(t) for t in b["t"]]).reshape(len(b["t"]), N_FEATURES)
            yield {"id": b["id"], "score": model.scores(x).tolist()}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")), step, "id long, score double")


def keep_good(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, columns as they are, whatever their names.

    Null texts score as empty ones, texts of any length whole; each row is judged by itself, so ids may be null and rows that
    repeat stay or go together; a score of exactly 0.5 stays. An empty table stays empty.
    """

    @F.pandas_udf("double")
    def scored(t):
        return type(t)(model.scores(np.array([features(x) for x in t]).reshape(len(t), N_FEATURES)))

    return docs.where(scored(text_bytes(text_col)) >= 0.5)


def held_out(id_col: str = "doc_id"):
    """Rows that must not teach: crc32 of the id modulo 3 is 1."""
    return crc_remainder(F.col(id_col), 3) == 1
