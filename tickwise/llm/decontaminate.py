"""Benchmark decontamination by pigeonhole edit matching.

A passage that may differ in k edits is cut into k + 1 pieces; one of them must occur untouched. Pieces are found
exactly with one Aho-Corasick automaton, and the text around each hit is verified with Myers' bit-parallel
edit distance. A test item is searched as a whole if short, else as all its passages, one from every word on, so
that a document which quotes a passage of it is found wherever the quote starts.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Words in a passage, edits allowed per character, fewest characters searched.
PASSAGE, EDITS, SHORTEST = 20, 0.06, 25
#: Bytes of benchmark text that one automaton, broadcast to the tasks, may hold; more is searched in blocks. Every
#: word starts a passage with pieces of its own, so the automaton is some hundred times this.
BLOCK_BYTES = 1 << 20


def normal(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


@dataclass(frozen=True)
class Passage:
    item: int
    text: str
    edits: int


def passages(item: int, text: str) -> list[Passage]:
    words = normal(text).split(" ")
    cut = {" ".join(words[a : a + PASSAGE]) for a in range(max(1, len(words) - PASSAGE + 1))}
    return [Passage(item, t, int(len(t) * EDITS)) for t in sorted(cut) if len(t) >= SHORTEST]


def pieces(p: Passage) -> list[tuple[int, str]]:
    """The passage in edits + 1 pieces of near-equal length, with their offsets."""
    n, k = len(p.text), p.edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, p.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def bounded_distance(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance of ``pattern`` to any substring of ``text`` if that is at most ``most``, else None.

    Myers' algorithm: the column of the edit matrix is kept as two bit vectors of vertical steps.
    """
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, now, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(x | up))
        minus = up & x
        if plus & last:
            now += 1
        elif minus & last:
            now -= 1
        if now < best:
            best = now
            if not best:
                break
        plus = (plus << 1) & full  # a match may start anywhere, so the first row costs nothing
        minus = (minus << 1) & full
        y = eq | down
        up = minus | (full & ~(y | plus))
        down = plus & y
    return best if best <= most else None


class Matcher:
    """All pieces of a set of passages in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        self.passages = [p for item, text in items for p in passages(item, text)]
        ends: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.passages):
            for at, piece in pieces(p):
                ends.setdefault(piece, []).append((k, at + len(piece)))
        self.auto = ahocorasick.Automaton()
        for piece, uses in ends.items():
            self.auto.add_word(piece, uses)
        self.auto.make_automaton()
        self.empty = not ends

    def search(self, text: str) -> dict[int, int]:
        """The items that the text holds a passage of, with the least distance over all passages and places."""
        found: dict[int, int] = {}
        if self.empty:
            return found
        text = normal(text)
        tried: set[tuple[int, int]] = set()
        for end, uses in self.auto.iter(text):
            for k, offset in uses:
                p = self.passages[k]
                start = end + 1 - offset
                if found.get(p.item) == 0 or (k, start) in tried:
                    continue
                tried.add((k, start))
                window = text[max(0, start - p.edits) : start + len(p.text) + p.edits]
                d = bounded_distance(p.text, window, p.edits)
                if d is not None and d < found.get(p.item, p.edits + 1 << 20):
                    found[p.item] = d
        return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark in lists of (item, text) of bounded size; one scan finds how many there must be."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("t")).where("item is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for k in range(blocks):
        yield [(r["item"], r["t"]) for r in items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, distance): every document with every test item that it holds a passage of, and the least edit distance.

    Both sides are compared in lower case with white space as single spaces. Null or empty texts hold nothing and
    items below SHORTEST characters, or null, are not searched. Repeated items or rows give the same pair once.
    A benchmark of any size is searched block by block; only a block, of bounded bytes, is broadcast.
    """
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = None
    for block in _blocks(benchmark, item_col, item_text, block_bytes):
        shared = sc.broadcast(block)

        def step(batches, shared=shared):
            matcher = Matcher(shared.value)
            for b in batches:
                hits = [(i, item, d) for i, t in zip(b["id"], b["t"]) for item, d in matcher.search(t).items()]
                yield {"id": [h[0] for h in hits], "item": [h[1] for h in hits], "distance": [h[2] for h in hits]}

        part = map_columns(source, step, "id long, item long, distance int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return source.limit(0).select("id", F.lit(0).cast("long").alias("item"), F.lit(0).alias("distance"))
    return found.groupBy("id", "item").agg(F.min("distance").alias("distance"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage of any test item, columns as they are, without a shuffle.

    Null and empty texts hold nothing and stay; texts of any length are searched whole; each row is judged by itself, so ids
    may be null and rows that repeat stay or go together. Items below SHORTEST characters, or null, are not searched;
    repeated items count once; an empty benchmark keeps all, an empty table stays empty. Columns may have any name.
    """
    sc = docs.sparkSession.sparkContext
    out = docs
    for block in _blocks(benchmark, item_col, item_text, block_bytes):
        shared = sc.broadcast(block)
        held: dict[int, Matcher] = {}

        @F.pandas_udf("boolean")
        def clean(t, shared=shared, held=held):
            if not held:
                held[0] = Matcher(shared.value)
            return t.map(lambda x: not held[0].search(x)).astype(bool)

        out = out.where(clean(F.coalesce(F.col(text_col), F.lit(""))))
    return out
