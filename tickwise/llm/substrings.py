"""Substring dedup: suffix automata of reference shards, and the matching statistics of documents streamed against them.

A window is ``length`` consecutive words. Every window has an anchor, the least hash of its ``gram``-word runs (the
first of equals), so equal windows have equal anchors at equal places. Windows with the same anchor place form a
segment. Segments are dealt to reference shards by anchor: one shard sees every copy of a window, and no other
shard needs to. In a shard, the segments of an anchor are streamed in document order against the suffix
automaton of those before: where the matching statistic reaches ``length``, the window starts earlier too. What is
new is then added to the automaton.

Broadcasting every shard to every document would cost documents times shards; anchors send each segment to
the one shard that can match it. Segments whose anchor occurs once anywhere never travel with their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.plans.shared import Shared, materialize

from .common import map_columns, text_bytes

#: Words of an anchor run, and distinct segments beyond which an anchor's windows are dealt one by one.
GRAM, CROWD = 8, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes that a worker remembers; it starts over beyond that.
REMEMBERED = 400_000


class _Remembered(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return found


class WordHashes:
    """XXH64 of words, remembered up to a bound."""

    def __init__(self):
        self.seen = _Remembered()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))


def segments(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, count): the anchors of all windows, and which windows (starts first .. first + count - 1) each serves."""
    n = len(hashes) - length + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    h = hashes.view(np.uint64)
    run = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        run = run * _ODD + h[j : len(h) - gram + 1 + j]
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(32)
    width = length - gram + 1
    # the least of each width runs and its place by doubling; of equals the first
    least, place, have = run, np.arange(len(run)), 1
    while have < width:
        step = min(have, width - have)
        after = least[step:] < least[:-step]
        place = np.where(after, place[step:], place[:-step])
        least = np.where(after, least[step:], least[:-step])
        have += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    return run[place[first]].view(np.int64), first, count


class Automaton:
    """Suffix automaton of the segments added so far; a state per class of end positions."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def statistics(self, words: list[int]):
        """At each end position, the length of the longest suffix so far that was added before."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            yield size


def _fingerprint(piece: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(piece.tobytes())


def _copies(source: DataFrame) -> DataFrame:
    """Ids of texts that a smaller id has too, byte for byte. Minima pre-aggregate; the join back can be split."""
    hashed = materialize(source.select("id", F.md5("t").alias("md5")))
    first = hashed.groupBy("md5").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(first, "md5").where("id > first").select("id").distinct()


def _repeated_anchors(source: DataFrame, copies: DataFrame, length: int, gram: int) -> tuple[DataFrame, Shared]:
    """(id, anchors): for each document that is no copy, its anchors that other texts have too, or that it has twice.

    With the table of all anchors, which can go once this has been read.
    """

    def anchors(batches):
        hashes = WordHashes()
        for b in batches:
            for i, t in zip(b["id"], b["t"]):
                own, n = np.unique(segments(hashes(t.split()), length, gram)[0], return_counts=True)
                if len(own):
                    text = xxhash.xxh3_64_intdigest(t) - (1 << 63)
                    yield {"anchor": own, "id": np.full(len(own), i), "text": np.full(len(own), text), "n": n.astype(np.int32)}

    held = Shared(map_columns(source, anchors, "anchor long, id long, text long, n int"))
    found = held.df
    spread = found.groupBy("anchor").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.max("n").alias("n"))
    met = found.join(spread.where("a <> b or n > 1").select("anchor"), "anchor")
    return met.groupBy("id").agg(F.collect_set("anchor").alias("anchors")).join(copies, "id", "left_anti"), held


def _pieces(suspects: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments of repeated anchors, each with a fingerprint of its words."""

    def step(batches):
        hashes = WordHashes()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "id", "first", "count", "same")}
            for i, t, wanted in zip(b["id"], b["t"], b["anchors"]):
                h = hashes(t.split())
                a, first, count = segments(h, length, gram)
                for k in np.flatnonzero(np.isin(a, np.array(wanted, np.int64))):
                    end = first[k] + count[k] + length - 1
                    for key, v in zip(out, (int(a[k]), i, int(first[k]), int(count[k]), _fingerprint(h[first[k] : end]))):
                        out[key].append(v)
            yield out

    return map_columns(suspects.select("id", "t", "anchors"), step, "anchor long, id long, first int, count int, same binary")


def _worded(suspects: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (anchor, id, first, count, crowded) with the 64-bit hashes of each segment's words, taken from its text again."""

    def step(batches):
        hashes = WordHashes()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "id", "first", "count", "crowded", "words")}
            for i, t, *own in zip(b["id"], b["t"], b["anchors"], b["firsts"], b["counts"], b["crowds"]):
                h = hashes(t.split())
                for anchor, first, count, crowded in zip(*own):
                    for key, v in zip(out, (anchor, i, first, count, bool(crowded), h[first : first + count + length - 1].tobytes())):
                        out[key].append(v)
            yield out

    lists = {"anchors": "anchor", "firsts": "first", "counts": "count", "crowds": "crowded"}
    mine = wanted.groupBy("id").agg(F.collect_list(F.struct("anchor", "first", "count", F.col("crowded").cast("int").alias("crowded"))).alias("x")).select(F.col("id").alias("__id"), "x")
    one = suspects.select("id", "t").join(mine, F.col("id") == F.col("__id")).select("id", "t", *[F.col(f"x.{c}").alias(name) for name, c in lists.items()])
    return map_columns(one, step, "anchor long, id long, first int, count int, crowded boolean, words binary")


def repeated_windows(suspects: DataFrame, length: int = 20, gram: int = GRAM) -> DataFrame:
    """(id, first, count): runs of window starts whose words also start earlier, in a smaller id or before in the same.

    suspects: (id, t, anchors). Of equal segments only the earliest goes on to the automata, with its words; the
    others start later, window for window. Anchors with one distinct segment need no automaton, so their words stay where
    they are. An anchor with very many different segments (a phrase that a large part of the documents share) is not left
    to one task: its windows are told apart by their own fingerprints.
    """
    pieces = materialize(_pieces(suspects, length, gram))
    place = F.struct("id", "first")
    earliest = materialize(pieces.groupBy("anchor", "same").agg(F.min(F.struct("id", "first", "count")).alias("at"), F.count("*").alias("n")))
    copies = pieces.join(earliest.where("n > 1").select("anchor", "same", "at"), ["anchor", "same"])
    later = copies.where((F.col("id") != F.col("at.id")) | (F.col("first") != F.col("at.first"))).select("id", "first", "count")
    several = earliest.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > CROWD).alias("crowded"))
    wanted = materialize(earliest.join(several, "anchor").select("anchor", "at.id", "at.first", "at.count", "crowded"))
    dealt = materialize(_worded(suspects, wanted, length))
    streamed = _stream(dealt.where("not crowded"), length)
    if wanted.where("crowded").isEmpty():
        return later.unionByName(streamed)
    single = materialize(_windows(dealt.where("crowded"), length))
    first = single.groupBy("key").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1")
    again = single.join(first, "key").where((F.col("id") != F.col("at.id")) | (F.col("first") != F.col("at.first")))
    return later.unionByName(streamed).unionByName(again.select("id", "first", F.lit(1).alias("count")))


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """Each window of the segments by itself, keyed by its words."""

    def step(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("key", "id", "first")}
            for anchor, i, first, count, words in zip(b["anchor"], b["id"], b["first"], b["count"], b["words"]):
                for k in range(count):
                    key = xxhash.xxh3_128_digest(anchor.to_bytes(8, "big", signed=True) + words[8 * k : 8 * (k + length)])
                    for name, v in zip(out, (key, i, first + k)):
                        out[name].append(v)
            yield out

    return map_columns(pieces.select("anchor", "id", "first", "count", "words"), step, "key binary, id long, first int")


def _stream(dealt: DataFrame, length: int) -> DataFrame:
    def step(batches):
        key, auto = None, Automaton()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "first", "count")}
            for k, i, first, words in zip(b["anchor"], b["id"], b["first"], b["words"]):
                if k != key:
                    key, auto = k, Automaton()
                w = np.frombuffer(words, np.int64).tolist()
                starts = [e - length + 1 for e, size in enumerate(auto.statistics(w)) if size >= length]
                run = 0
                for at, s in enumerate(starts):
                    run += 1
                    if at + 1 == len(starts) or starts[at + 1] != s + 1:
                        for name, v in zip(out, (i, first + s - run + 1, run)):
                            out[name].append(v)
                        run = 0
                if len(starts) < len(w) - length + 1:
                    auto.add(w)
            yield out

    parts = max(8, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = dealt.select("anchor", "id", "first", "words").repartition(parts, "anchor").sortWithinPartitions("anchor", "id", "first")
    return map_columns(placed, step, "id long, first int, count int")


def _cut(words: list[bytes], first: list[int], count: list[int], length: int) -> list[bytes]:
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, np.array(first, np.int64), 1)
    np.add.at(steps, np.array(first, np.int64) + np.array(count, np.int64) + length - 1, -1)
    return [w for w, c in zip(words, np.cumsum(steps).tolist()) if not c]


def remove_repeats(docs: DataFrame, length: int = 20, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", finish: Callable[[bytes], str] = bytes.decode) -> DataFrame:
    """(id, n_words, n_removed, kept): every document without the words of windows that start earlier too.

    Windows are judged on the input. ``kept`` is the kept words joined by a space, or what ``finish`` makes of their
    bytes. Null texts have no words, very long ones count whole; texts shorter than a window lose nothing; a document whose
    text a smaller id has too loses all its windows. Rows that repeat an id are taken for one document, each returned by
    itself; rows without an id lose nothing. An empty table gives no rows; other columns, whatever their names, are ignored.
    Texts cross the network once, those with repeated anchors up to three times.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    known = source.where("id is not null")
    copies = materialize(_copies(known))
    wanted, anchors = _repeated_anchors(known, copies, length, gram)
    marked = copies.select("id", F.array().cast("array<long>").alias("anchors"), F.lit(True).alias("copy")).unionByName(wanted.withColumn("copy", F.lit(False)))
    joined = source.join(marked.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select("id", "t", "anchors", F.coalesce("copy", F.lit(False)).alias("copy"))

    def sort_out(batches):
        """Documents that nothing can be removed from, or all, are done; the others keep their text."""
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "t", "anchors", "n_words", "n_removed", "kept")}
            for i, t, repeated, copy in zip(b["id"], b["t"], b["anchors"], b["copy"]):
                words = t.split()
                n = len(words)
                if repeated:
                    row = (i, t, repeated, n, None, None)
                else:
                    gone = n if copy and n >= length else 0
                    row = (i, None, None, n, gone, finish(b"" if gone else b" ".join(words)))
                for key, v in zip(out, row):
                    out[key].append(v)
            yield out

    sorted_out = materialize(map_columns(joined, sort_out, "id long, t binary, anchors array<long>, n_words long, n_removed long, kept string"))
    anchors.drop()
    suspects = sorted_out.where("t is not null")
    gone = repeated_windows(suspects, length, gram).groupBy("id").agg(F.collect_list(F.struct("first", "count")).alias("gone"))
    cut = suspects.select("id", "t").join(gone.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select("id", "t", F.col("gone.first").alias("first"), F.col("gone.count").alias("count"))

    def step(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "n_words", "n_removed", "kept")}
            for i, t, first, count in zip(b["id"], b["t"], b["first"], b["count"]):
                words = t.split()
                kept = _cut(words, first, count, length) if first else words
                for key, v in zip(out, (i, len(words), len(words) - len(kept), finish(b" ".join(kept)))):
                    out[key].append(v)
            yield out

    return sorted_out.where("t is null").select("id", "n_words", "n_removed", "kept").unionByName(map_columns(cut, step, "id long, n_words long, n_removed long, kept string"))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
