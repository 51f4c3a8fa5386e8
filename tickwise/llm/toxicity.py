"""Toxicity: subword-bag embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word is itself and its character n-grams, hashed to rows of one embedding table; a document is the mean over
its words of the mean of their rows. Misspelt words that nobody labelled share n-grams with those that were.
Only rows whose n-grams are spread unevenly over the classes (chi-square) are trained, the others stay zero:
a document has a few telling words among hundreds, and the rest would only be learnt by heart.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.plans.shared import materialize

from .common import crc_remainder, map_columns, text_bytes
from .training import labelled_sample

#: Labelled rows of each class that teach, and their longest text.
PER_CLASS, MAX_BYTES = 2500, 60_000
BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 20, 4, 12, 64, 0.3
SHORT, LONG = 3, 8
#: Bytes of a word beyond which its n-grams are taken piece by piece.
LONG_WORD = 10_000
#: Least chi-square of a row that is trained, and the factor that brings shares of a document to the order of one.
UNEVEN, SCALE = 20.0, 30.0
#: Words whose scores a worker remembers; it starts over beyond that.
REMEMBERED = 400_000
_EDGES = b".,;:!?\"'()[]{}<>*#$%&-_"


def subwords(word: bytes) -> list[int]:
    """Rows of a lower-case word and of its 3- to 8-grams of bytes, ends marked, each once.

    Of a very long word no n-gram is held: its rows are marked in a bit map as its pieces pass, so it takes as much memory
    as the table has rows, however long it is.
    """
    w = b"<" + word + b">"
    if len(w) > LONG_WORD:
        seen = np.zeros(BUCKETS, bool)
        seen[crc32(w) & (BUCKETS - 1)] = True
        for n in range(SHORT, LONG + 1):
            for a in range(0, len(w) - n + 1, LONG_WORD):
                seen[[crc32(w[i : i + n]) & (BUCKETS - 1) for i in range(a, min(a + LONG_WORD, len(w) - n + 1))]] = True
        return np.flatnonzero(seen).tolist()
    grams = {w[i : i + n] for n in range(SHORT, LONG + 1) for i in range(len(w) - n + 1)}
    grams.add(w)
    return [crc32(g) & (BUCKETS - 1) for g in grams]


def clean_words(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


@dataclass
class Model:
    """rows: each table row's margin (toxic less clean) after the linear layer; bias: the margin of no words."""

    rows: np.ndarray
    bias: float
    empty: float

    def scorer(self):
        seen: dict[bytes, float] = {}
        rows = self.rows

        def score(text: bytes) -> float:
            words = clean_words(text)
            if not words:
                return self.empty
            total = 0.0
            for w in words:
                s = seen.get(w)
                if s is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    s = seen[w] = float(rows[subwords(w)].mean())
                total += s
            z = min(500.0, max(-500.0, total / len(words) + self.bias))
            return 1 / (1 + np.exp(-z))

        return score


def _bag(text: bytes) -> tuple[list[int], list[float]]:
    """A document's table rows and their weights, which sum to SCALE."""
    counts: dict[bytes, int] = {}
    for w in clean_words(text):
        counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    out: dict[int, float] = {}
    for w, c in counts.items():
        ids = subwords(w)
        share = SCALE * c / n / len(ids)
        for i in ids:
            out[i] = out.get(i, 0.0) + share
    return list(out), list(out.values())


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, base: float) -> Model:
    """Adagrad on table and linear layer together, fixed seed; both classes weigh the same, bias set for the rest.

    With one class alone every score is the share of toxic labels.
    """
    empty = min(max(base, 0.001), 0.499)
    if len(set(y.tolist())) < 2:
        z = float(np.log(empty / (1 - empty)))
        return Model(np.zeros(BUCKETS, np.float32), z, empty)
    rng = np.random.default_rng(11)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_t, seen_l, seen_b = np.full((BUCKETS, 1), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    trained = np.zeros(BUCKETS, bool)
    trained[np.concatenate([ids for ids, _ in bags]).astype(int)] = True
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    target = np.eye(2, dtype=np.float32)[y]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            ids = np.concatenate([bags[i][0] for i in at])
            share = np.concatenate([bags[i][1] for i in at])
            starts = np.cumsum([0, *(len(bags[i][0]) for i in at)])[:-1]
            some = np.array([len(bags[i][0]) > 0 for i in at])
            mean = np.zeros((len(at), DIM), np.float32)
            if len(ids):
                mean[some] = np.add.reduceat(table[ids] * share[:, None], starts[some], axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = ((p - target[at]) * weight[at, None] / len(at)).astype(np.float32)
            g_layer, g_bias, g_mean = mean.T @ d, d.sum(axis=0), d @ layer.T
            if len(ids):
                each = np.repeat(g_mean[some], np.diff([*starts[some], len(ids)]), axis=0) * share[:, None]
                rank = np.argsort(ids, kind="stable")
                own, first = np.unique(ids[rank], return_index=True)
                g = np.add.reduceat(each[rank], first, axis=0)
                seen_t[own] += (g * g).mean(axis=1, keepdims=True)
                table[own] -= RATE * g / np.sqrt(seen_t[own])
            seen_l += g_layer * g_layer
            seen_b += g_bias * g_bias
            layer -= RATE * g_layer / np.sqrt(seen_l)
            bias -= RATE * g_bias / np.sqrt(seen_b)
    rows = (table @ (layer[:, 1] - layer[:, 0])) * SCALE
    return Model(np.where(trained, rows, 0).astype(np.float32), float(bias[1] - bias[0]), empty)


def uneven(counts: list[tuple[int, int, int]], good: int, bad: int) -> list[int]:
    """The rows, of (row, documents, toxic documents), whose share of toxic and of clean documents differ beyond chance."""
    a = np.array(counts, np.float64).reshape(len(counts), 3)
    p, q, both = a[:, 2] / max(1, bad), (a[:, 1] - a[:, 2]) / max(1, good), a[:, 1] / max(1, good + bad)
    chi = (p - q) ** 2 / np.maximum(both * (1 - both) * (1 / max(1, good) + 1 / max(1, bad)), 1e-12)
    return sorted(a[chi >= UNEVEN, 0].astype(int).tolist())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn=None, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of labelled texts. Their bags stay on the executors until the rows to train are chosen."""
    sample, counts = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class, max_bytes)

    def step(batches):
        for b in batches:
            bags = [_bag(t) for t in b["t"]]
            yield {"id": b["id"], "y": b["y"], "ids": [x for x, _ in bags], "shares": [x for _, x in bags]}

    bagged = materialize(map_columns(sample.select("id", "y", text_bytes("t").alias("t")), step, "id long, y int, ids array<int>, shares array<double>"))
    size = {r["y"]: r["count"] for r in bagged.groupBy("y").count().collect()}
    spread = bagged.select("y", F.explode("ids").alias("row")).groupBy("row").agg(F.count("*").alias("n"), F.sum("y").alias("bad")).where("n > 2").collect()
    chosen = set(uneven([(r["row"], r["n"], r["bad"]) for r in spread], size.get(0, 0), size.get(1, 0)))

    def choose(batches):
        for b in batches:
            kept = [[(i, x) for i, x in zip(ids, shares) if i in chosen] for ids, shares in zip(b["ids"], b["shares"])]
            yield {"id": b["id"], "y": b["y"], "ids": [[i for i, _ in k] for k in kept], "shares": [[x for _, x in k] for k in kept]}

    rows = map_columns(bagged, choose, "id long, y int, ids array<int>, shares array<double>").toArrow()
    order = np.lexsort((rows["y"].to_numpy(), rows["id"].to_numpy()))
    ids, shares = rows["ids"].combine_chunks(), rows["shares"].combine_chunks()
    cut, flat_i, flat_s = ids.offsets.to_numpy(), ids.values.to_numpy(), shares.values.to_numpy().astype(np.float32)
    bags = [(flat_i[cut[i] : cut[i + 1]], flat_s[cut[i] : cut[i + 1]]) for i in order]
    return fit(bags, rows["y"].to_numpy()[order].astype(int), counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, 0 to 1. A text without words, or null, scores the share of toxic labels, below 0.5.

    Texts and words of any length count whole; repeated rows and null ids stay, an empty table gives no rows, and other
    columns, whatever their names, are ignored. The model is one float a table row, broadcast; its size does not depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches):
        scorer = shared.value.scorer()
        for b in batches:
            yield {"id": b["id"], "score": [float(scorer(t)) for t in b["t"]]}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")), step, "id long, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that must not teach: crc32 of the id modulo 5 is 0."""
    return crc_remainder(F.col(id_col), 5) == 0
