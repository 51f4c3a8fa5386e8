"""SimHash near-duplicates, found by the generalised pigeonhole principle.

A fingerprint is one or more 64-bit words. Its bits are dealt into parts, correlated bits together. A query
gives each part a threshold: -1 (skip it) or the radius of a Hamming ball that it probes there. If the
thresholds sum to tau - parts + 1, any fingerprint within tau bits meets at least one of them, so the sum is
fixed and a dynamic programme spends it where the estimated candidates are fewest. Candidates are verified.

``near_duplicates`` links fingerprints. ``keep_one`` asks for a Jaccard similarity of the shingle sets, of which a
fingerprint is only an estimate: the fingerprints find most links, each is verified by its exact similarity, and an
exact search by set prefixes finds those that fingerprints can't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickwise.plans.shared import Shared, materialize, scratch

from .common import fresh, map_columns, text_bytes
from .components import connected_components

SEED = 42
#: Bits at most of a piece of a part; its histogram has 2 ** PIECE cells whatever the data.
PIECE = 8
#: A bucket with more fingerprints than this goes through ball points instead of pairs.
BUCKET = 128


def shingle_digests(text: bytes, n: int) -> bytes:
    """XXH64 digests, big-endian and end to end, of the lower-cased (A-Z) word n-grams, repeats included."""
    words = text.lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist())])


def _majority(raw: np.ndarray) -> int:
    """The bits set in over half of the hashes, a row of eight bytes each, as a signed long."""
    ones = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(raw)).view(">i8")[0])


def fingerprint(text: bytes, n: int, words: int = 1) -> list[int]:
    """Majority bits of the shingle hashes; with several words, each hash counts in the one it is dealt to."""
    raw = np.frombuffer(shingle_digests(text, n), np.uint8).reshape(-1, 8)
    if not len(raw):
        return [0] * words
    if words == 1:
        return [_majority(raw)]
    group = ((raw.view(">u8").ravel().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(words)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group.astype(np.int64), minlength=words)
    ones = np.zeros((words, 64), np.int64)
    some = np.flatnonzero(sizes)
    ones[some] = np.add.reduceat(np.unpackbits(raw[order], axis=1), np.cumsum(sizes)[some] - sizes[some], axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > sizes[:, None], axis=1).view(">i8").ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, words: int = 1) -> DataFrame:
    """(id, fp) for every row; a null or empty text has fingerprint zero."""

    def step(batches):
        for b in batches:
            yield {"id": b["id"], "fp": [fingerprint(t, shingle, words) for t in b["t"]]}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t")), step, "id long, fp array<long>")


def _bits(fps: list[list[int]]) -> np.ndarray:
    """Rows of 0/1, the words' bits from the highest on."""
    a = np.array(fps, dtype=">i8")
    return np.unpackbits(a.view(np.uint8).reshape(len(a), -1), axis=1)


def bit_groups(fps: DataFrame, parts_per_word: int) -> list[list[int]]:
    """Deal the 64 bits of a word into parts: a part takes the bit most correlated with those it has.

    Co-occurrence counts come from all fingerprints, summed in Spark: 2,080 rows reach the driver at any size.
    """
    pairs = np.triu_indices(64)

    def step(batches):
        total, seen = np.zeros((64, 64)), 0
        for b in batches:
            x = _bits(b["fp"]).reshape(-1, 64).astype(np.float32)
            total += x.T @ x
            seen += len(x)
        if seen:
            yield {"cell": [*range(len(pairs[0])), -1], "n": [*map(int, total[pairs]), seen]}

    rows = map_columns(fps.select("fp"), step, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = {r["cell"]: r["n"] for r in rows}
    n = max(1, counts.pop(-1, 1))
    both = np.zeros((64, 64))
    for cell, v in counts.items():
        both[pairs[0][cell], pairs[1][cell]] = both[pairs[1][cell], pairs[0][cell]] = v / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(64)), []
    for k in range(parts_per_word):
        size = 64 // parts_per_word + (k < 64 % parts_per_word)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda j: (round(corr[group, j].mean(), 6), -j))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _value(bits: np.ndarray) -> np.ndarray:
    """The number that each row of bits spells."""
    return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int64))


def _pieces(part: list[int]) -> list[list[int]]:
    n = -(-len(part) // PIECE)
    return [x.tolist() for x in np.array_split(np.array(part), n)]


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64).view(np.int64)


def distance_shares(fps: DataFrame, parts: list[list[int]], most: int) -> tuple[list[list[np.ndarray]], int]:
    """For each piece of each part and each of its values, the share of fingerprints at distance 0 to ``most`` there.

    Exact histograms over all fingerprints, summed in Spark; each has 2 ** PIECE cells at any input size.
    """
    pieces = [(i, j, piece) for i, part in enumerate(parts) for j, piece in enumerate(_pieces(part))]

    def step(batches):
        total = [np.zeros(1 << len(x), np.int64) for _, _, x in pieces]
        for b in batches:
            bits = _bits(b["fp"])
            for k, (_, _, x) in enumerate(pieces):
                total[k] += np.bincount(_value(bits[:, x]), minlength=len(total[k]))
        for k, t in enumerate(total):
            some = np.flatnonzero(t)
            yield {"piece": [k] * len(some), "value": some.tolist(), "n": t[some].tolist()}

    rows = map_columns(fps.select("fp"), step, "piece int, value int, n long").groupBy("piece", "value").agg(F.sum("n").alias("n")).collect()
    counts = [np.zeros(1 << len(x)) for _, _, x in pieces]
    for r in rows:
        counts[r["piece"]][r["value"]] = r["n"]
    n = int(counts[0].sum())
    shares: list[list[np.ndarray]] = [[] for _ in parts]
    for (i, _, x), c in zip(pieces, counts):
        at, apart = np.arange(len(c)), np.zeros((len(c), most + 1))
        for d in range(most + 1):
            for mask in (sum(1 << b for b in m) for m in combinations(range(len(x)), d)):
                apart[:, d] += c[at ^ mask]
        shares[i].append(apart / max(1, n))
    return shares, n


def allocate(costs: np.ndarray, total: int, slack: int = 8) -> np.ndarray:
    """Thresholds (-1 and up) of least cost per row that sum to ``total``. costs: rows x parts x (threshold + 1).

    Dynamic programme over the parts; the running sum stays within ``slack`` of the straight line, a restriction
    of the choice that never breaks the sum.
    """
    n, parts, levels = costs.shape
    line = [round(total * (k + 1) / parts) for k in range(parts)]
    best = np.full((n, 2 * slack + 1), np.inf)
    chosen = np.zeros((parts, n, 2 * slack + 1), np.int8)
    for k in range(parts):
        shift = (line[k] - line[k - 1]) if k else line[0]
        following = np.full_like(best, np.inf)
        for level in range(levels):
            move = level - 1 - shift
            if k:
                src = best
            else:
                src = np.full_like(best, np.inf)
                src[:, slack] = 0
            lo, hi = max(0, move), min(2 * slack + 1, 2 * slack + 1 + move)
            if lo >= hi:
                continue
            cost = src[:, lo - move : hi - move] + costs[:, k, level, None]
            better = cost < following[:, lo:hi]
            following[:, lo:hi] = np.where(better, cost, following[:, lo:hi])
            chosen[k, :, lo:hi][better] = level
        best = following
    at, out = np.full(n, slack), np.zeros((n, parts), np.int64)
    for k in range(parts - 1, -1, -1):
        level = chosen[k, np.arange(n), at]
        out[:, k] = level - 1
        at = at - (level - 1 - ((line[k] - line[k - 1]) if k else line[0]))
    return out


def signatures(reps: DataFrame, parts: list[list[int]], shares: list[list[np.ndarray]], n: int, tau: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The index rows (part value of each fingerprint) and the probe rows (allocated balls): key, rep, fp."""
    balls = [[_masks(len(p), r) for r in range(most + 1)] for p in parts]
    ddl = "key long, rep long, fp long"

    def emit(key: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep), pa.array(fp)], names=["key", "rep", "fp"])

    def chunks(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                c = b.slice(a, 2048)
                fps = c.column(1).to_pylist()
                yield c.column(0).to_numpy(), np.array([f[0] for f in fps], np.int64), _bits(fps)

    def index(batches):
        for rep, fp, bits in chunks(batches):
            for i, part in enumerate(parts):
                yield emit((i << 32) | _value(bits[:, part]), rep, fp)

    def probes(batches):
        for rep, fp, bits in chunks(batches):
            costs = np.zeros((len(rep), len(parts), most + 2))
            for i, part in enumerate(parts):
                near = None
                for piece, share in zip(_pieces(part), shares[i]):
                    d = share[_value(bits[:, piece])]
                    near = d if near is None else np.stack([sum(near[:, a] * d[:, r - a] for a in range(r + 1)) for r in range(most + 1)], axis=1)
                for r in range(most + 1):
                    # a probe row is shuffled and sorted; a candidate is one comparison
                    costs[:, i, r + 1] = 4 * len(balls[i][r]) + n * near[:, : r + 1].sum(axis=1)
            thresholds = allocate(costs, tau - len(parts) + 1)
            for i, part in enumerate(parts):
                value = _value(bits[:, part])
                for r in range(most + 1):
                    if (at := np.flatnonzero(thresholds[:, i] == r)).size:
                        ball = balls[i][r]
                        yield emit(((i << 32) | (value[at][:, None] ^ ball[None, :])).ravel(), np.repeat(rep[at], len(ball)), np.repeat(fp[at], len(ball)))

    source = reps.select("rep", "fp")
    return source.mapInArrow(index, ddl), source.mapInArrow(probes, ddl)


def links(reps: DataFrame, tau: int, parts_per_word: int = 3, most: int = 2) -> DataFrame:
    """Edges (a, b) that connect every pair of distinct one-word fingerprints within ``tau`` bits, and no others.

    reps: (rep, fp), one row per distinct fingerprint. Every pair is a row, but for pairs in a bucket of more than
    BUCKET fingerprints: these are joined through the points of their Hamming balls. A ball of radius tau // 2 and
    one of the rest of tau meet exactly if the pair is within tau, so all that reach a point are linked to the
    first of those near it, and a dense group costs rows in proportion to its members.
    """
    groups = bit_groups(reps, parts_per_word)
    shares, n = distance_shares(reps, groups, most)
    index, probes = (materialize(x) for x in signatures(reps, groups, shares, n, tau, most))
    near = (F.col("q.fp") < F.col("d.fp")) & (F.bit_count(F.col("q.fp").bitwiseXOR(F.col("d.fp"))) <= tau)
    large = materialize(index.groupBy("key").count().where(F.col("count") > BUCKET).select("key"))
    some = not large.isEmpty()
    asking = probes.join(large, "key", "left_anti") if some else probes
    pairs = asking.alias("q").join(index.alias("d"), on=(F.col("q.key") == F.col("d.key")) & near).select(F.col("q.rep").alias("a"), F.col("d.rep").alias("b"))
    if not some:
        return pairs.distinct()
    dense = index.unionByName(probes).join(large, "key", "left_semi").select("rep", "fp").distinct()
    half = tau // 2
    ball = F.lit([int(m) for m in _masks(64, half + tau % 2)])
    points = dense.select("rep", "fp", F.explode(ball).alias("mask")).select("rep", F.col("mask").bitwiseXOR(F.col("fp")).alias("point"), (F.bit_count("mask") > half).alias("far"))
    hubs = points.groupBy("point").agg(F.min(F.when(~F.col("far"), F.col("rep"))).alias("b"), F.count("*").alias("n")).where("b is not null and n > 1")
    met = points.join(hubs, "point").where("rep <> b").select(F.col("rep").alias("a"), "b")
    return pairs.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tau: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row: 64-bit fingerprints link at ``tau`` or fewer differing bits.

    component_id is the smallest id that links reach, itself included. Null and empty texts have fingerprint
    zero and link like any other; repeated ids keep their rows; rows without an id get the component of their
    fingerprint, or null if no row with an id has it; an empty table gives no rows. Extra columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle).select("id", F.col("fp")[0].alias("fp")))
    reps = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    found = links(reps.where("rep is not null").select("rep", F.array("fp").alias("fp")), tau)
    parts = connected_components(found)
    named = reps.join(parts, reps["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("id", "fp", "component_id")


#: Two texts are near copies if their sets of shingles have a Jaccard similarity of NEAR[0] / NEAR[1] or more.
NEAR = (4, 5)
#: Sets that a task holds at a time, and ids of 8 bytes that are broadcast at most; more meet the sets in a shuffle.
SETS, BROADCAST = 512, 4_000_000
#: Rounds that merge dense groups: in buckets of over CROWD sets each is compared with PARTNERS others, drawn anew each round.
#: They go on while a set has over DENSE candidates left on average and one pair in YIELD compared is a link; a round that leaves
#: no more than two rounds compare, and over half of what there was, is the last.
CROWD, PARTNERS, DENSE, ROUNDS, YIELD = 64, 8, 4, 12, 50
#: One set in ASKED tells how many candidates are left.
ASKED = 64
#: One document in SAMPLE tells which shingles are common; at most COMMON of them are broadcast.
SAMPLE, COMMON = 8, 1 << 18


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return np.unique(np.frombuffer(shingle_digests(text, n), ">u8").astype(np.uint64))


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(text_bytes(text_col)))


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(node, id, md5, n, set, same, fp) of every row with an id.

    node is a number for the row; write the result before it is read twice. md5 is the text's; set holds the distinct
    shingle hashes as bytes, n says how many, same is their MD5 and fp their fingerprint.
    """

    def step(batches):
        for b in batches:
            for c in range(0, len(b["t"]), SETS):
                own = {k: v[c : c + SETS] for k, v in b.items()}
                sets = [shingle_set(t, shingle) for t in own.pop("t")]
                raw = [x.tobytes() for x in sets]
                fps = [_majority(x.astype(">u8").view(np.uint8).reshape(-1, 8)) if len(x) else 0 for x in sets]
                yield own | {"n": [len(x) for x in sets], "set": raw, "same": [hashlib.md5(x).digest() for x in raw], "fp": fps}

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"), _text_key(text_col).alias("md5")).where("id is not null")
    numbered = source.withColumn("node", F.monotonically_increasing_id())
    return map_columns(numbered, step, "node long, id long, md5 binary, n int, set binary, same binary, fp long")


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingle hashes of a sample of the sets, ascending, and how often each was met there."""

    def step(batches):
        for b in batches:
            yield {"token": np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in b["set"]]])}

    tokens = map_columns(sets.where(F.pmod(F.xxhash64("same"), F.lit(SAMPLE)) == 0).select("set"), step, "token long")
    found = tokens.groupBy("token").agg(F.count("*").cast("int").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token, n = found["token"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefixes(reps: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """(token, rep, n, at): the shingles of each set that stand first, rare before common, and their places from 1.

    Two sets of the wanted similarity share at least ceil(n * near) of the n shingles of either, so under any one
    order of all shingles they share one among the first n - ceil(n * near) + 1 of both. The order only decides
    how many other sets are met there.
    """
    shared = reps.sparkSession.sparkContext.broadcast(common_shingles(reps))

    def step(batches):
        common, often = shared.value
        for b in batches:
            for c in range(0, len(b["rep"]), 2048):
                tokens, reps, sizes, places = [], [], [], []
                for rep, raw in zip(b["rep"][c : c + 2048], b["set"][c : c + 2048]):
                    x = np.frombuffer(raw, np.uint64)
                    if not len(x):
                        continue
                    first = len(x) + (-len(x) * near[0] // near[1]) + 1
                    if len(common):
                        k = np.minimum(np.searchsorted(common, x), len(common) - 1)
                        x = x[np.argsort(np.where(common[k] == x, often[k], 0), kind="stable")]
                    tokens.append(x[:first].view(np.int64))
                    reps.append(np.full(first, rep))
                    sizes.append(np.full(first, len(x)))
                    places.append(np.arange(1, first + 1))
                if tokens:
                    yield {"token": np.concatenate(tokens), "rep": np.concatenate(reps), "n": np.concatenate(sizes), "at": np.concatenate(places)}

    return map_columns(reps.select("rep", "set"), step, "token long, rep long, n int, at int")


def _possible(x: str, y: str, near: tuple[int, int]):
    """Whether sets that first meet at these places can be near: no shingle before is shared, all after may be."""
    col = lambda name: F.col(name).cast("long")
    most = 1 + F.least(col(f"{x}.n") - col(f"{x}.at"), col(f"{y}.n") - col(f"{y}.at"))
    return most * (near[0] + near[1]) >= (col(f"{x}.n") + col(f"{y}.n")) * near[0]


def verified(pairs: DataFrame, reps: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """The pairs (a, b) whose shingle sets are near, by exact count."""

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the sets are read where Arrow holds them
            a, b, xs, ys = batch.columns
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(v[k].as_buffer(), np.uint64) for v in (xs, ys))
                both = np.intersect1d(x, y, assume_unique=True).size
                if both * (near[0] + near[1]) >= (len(x) + len(y)) * near[0]:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], schema=schema)

    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    # only the sets of the pairs are moved
    own = reps.select("rep", "set").join(few, "rep", "left_semi")
    left, right = own.select(F.col("rep").alias("a"), F.col("set").alias("x")), own.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(step, "a long, b long").distinct()


def _pairs_by_fingerprint(reps: DataFrame, tau: int) -> DataFrame:
    """(a, b), a > b: sets whose fingerprints are equal or, by the pigeonhole search, within ``tau`` bits; enough to connect them."""
    first = materialize(reps.groupBy("fp").agg(F.min("rep").alias("b")))
    equal = reps.select(F.col("rep").alias("a"), "fp").join(first, "fp").where("a <> b").select("a", "b")
    near = links(first.select(F.col("b").alias("rep"), F.array("fp").alias("fp")), tau)
    return equal.unionByName(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def jaccard_links(reps: DataFrame, near: tuple[int, int] = NEAR, tau: int = 2) -> DataFrame:
    """Edges (a, b) between near sets that connect every pair of near sets, and no others. reps: (rep, n, set, fp).

    First come the pairs that the fingerprints' pigeonhole search finds. Sets that share a shingle of their prefixes are
    the only others that can be near; a set meets the two before it and the first of a bucket, which holds groups of near
    copies together by rows in proportion to their size. All these are verified by exact similarity. Where buckets still
    hold sets of different components, rounds of few comparisons a set merge more of them. Then all pairs of a bucket that
    the links leave in different components are verified, so every near pair is linked or connected.
    """
    bucket = W.partitionBy("token").orderBy("n", "rep")
    me = F.struct("rep", "n", "at")
    rows = prefixes(reps, near).select("*", F.lag(me, 1).over(bucket).alias("p1"), F.lag(me, 2).over(bucket).alias("p2"), F.first(me).over(bucket).alias("p0"), F.lead("rep", 1).over(bucket).alias("next"))
    rows = materialize(rows.where("p1 is not null or next is not null").drop("next"))
    star = rows.select(F.struct("rep", "n", "at").alias("x"), F.explode(F.array("p0", "p1", "p2")).alias("y")).where("y is not null and x.rep <> y.rep")
    tried = materialize(_pairs_by_fingerprint(reps, tau).unionByName(_candidates(star, near)).distinct())
    found = materialize(verified(tried, reps, near))
    rows, left = _unsettled(rows.select("token", "rep", "n", "at"), found, near)
    for k in range(ROUNDS):
        if left <= DENSE:
            break
        crowd = rows.join(rows.groupBy("token").count().where(F.col("count") > CROWD).select("token"), "token", "left_semi")
        drawn = W.partitionBy("token").orderBy(F.xxhash64("token", "rep", F.lit(k)), "rep").rowsBetween(-PARTNERS, -1)
        others = crowd.select(F.struct("rep", "n", "at", "c").alias("x"), F.collect_list(F.struct("rep", "n", "at", "c")).over(drawn).alias("ys"))
        met = others.select("x", F.explode(F.filter("ys", lambda y: y["c"] != F.col("x.c"))).alias("y"))
        new = materialize(_candidates(met, near).distinct().join(tried, ["a", "b"], "left_anti"))
        more = materialize(verified(new, reps, near))
        n_new, n_more = new.count(), more.count()
        tried, found = tried.unionByName(new), found.unionByName(more)
        before = left
        if n_more:
            rows, left = _unsettled(rows.drop("c"), found, near)
        if n_more * YIELD <= n_new or before < 2 * left <= 4 * PARTNERS:
            break
    rest = _all_pairs(rows, rows, near).where("x.rep > y.rep").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"))
    return found.unionByName(verified(rest, reps, near))


def _all_pairs(left: DataFrame, right: DataFrame, near: tuple[int, int]) -> DataFrame:
    """Pairs x, y of rows of a bucket that are in different components and can be near."""
    return left.alias("x").join(right.alias("y"), on=(F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & _possible("x", "y", near))


def _candidates(met: DataFrame, near: tuple[int, int]) -> DataFrame:
    """(a, b), a > b, of pairs (x, y) of sets that can be near."""
    return met.where(_possible("x", "y", near)).select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b"))


def _unsettled(rows: DataFrame, links: DataFrame, near: tuple[int, int]) -> tuple[DataFrame, float]:
    """The rows of buckets that hold sets of different components, with the component ``c``, and how many partners a set has there, on average over some."""
    named = materialize(connected_components(links))
    rows = rows.join(named, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
    mixed = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    rows = materialize(rows.join(mixed, "token", "left_semi"))
    some = rows.where(F.pmod(F.xxhash64("rep", F.lit(-1)), F.lit(ASKED)) == 0)
    partners = _all_pairs(some, rows, near).select("x.rep", F.col("y.rep").alias("other")).distinct().count()
    return rows, partners / max(1, some.select("rep").distinct().count())


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, near: tuple[int, int]) -> DataFrame:
    """(node, id, md5, keep) of every row with an id: keep is the (id, node, md5) of the row that stays for its group."""
    sets = materialize(shingle_sets(docs, id_col, text_col, shingle))
    same = materialize(sets.groupBy("same").agg(F.min(F.struct("id", "node", "md5")).alias("at"), F.count("*").alias("n")))
    # copies are mostly few, so this join can leave the sets where they are
    extra = materialize(sets.select("node", "same").join(same.where("n > 1"), "same").where("node <> at.node").select("node"))
    reps = sets.join(extra, "node", "left_anti").select(F.col("node").alias("rep"), "n", "set", "fp")
    parts = connected_components(jaccard_links(reps, near))
    named = materialize(same.join(parts, F.col("at.node") == F.col("node"), "left").select("same", "at", F.coalesce("component", "at.node").alias("component")))
    keep = named.groupBy("component").agg(F.min("at").alias("keep"))
    return sets.select("node", "id", "md5", "same").join(named.join(keep, "component").select("same", "keep"), "same").drop("same")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, near: tuple[int, int] = NEAR) -> DataFrame:
    """(id, component_id) of every row with an id, by shingle sets; the component is its smallest id.

    Texts with equal sets, texts without words among them, are copies; very long texts count whole. Repeated rows stay,
    each its own row; rows of one id with different texts link only if these are near. An empty table gives no rows,
    and other columns, whatever their names, are ignored.
    """
    return _grouped(docs, id_col, text_col, shingle, near).select("id", F.col("keep.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, near: tuple[int, int] = NEAR) -> DataFrame:
    """One row of each group of near copies, that of the smallest id, columns as they are.

    Rows go by id and text, so a row whose id belongs to a copy stays if its own text is no copy; of rows that repeat both
    one stays. Null and empty texts are copies of each other. Rows without an id all stay. Texts of any length
    count whole, ties go to the row that was read first, an empty table stays empty, and other columns may have any name.
    """
    with scratch():
        found = Shared(_grouped(docs, id_col, text_col, shingle, near), result=True).df
    kept = (F.col("id") == F.col("keep.id")) & (F.col("md5") == F.col("keep.md5"))
    gone = found.where(~kept).select("id", "md5").distinct()
    twice = materialize(found.where(kept & (F.col("node") != F.col("keep.node"))).select("id", "md5").distinct())
    mine = docs[id_col].cast("long"), _text_key(text_col)

    def named(rows: DataFrame, how: str, keys: DataFrame) -> DataFrame:
        a, b = fresh(docs.columns, "id", "md5")
        keys = keys.select(F.col("id").alias(a), F.col("md5").alias(b))
        return rows.join(keys, reduce(Column.__and__, [x == F.col(c) for x, c in zip(mine, (a, b))]), how)

    left = named(docs, "left_anti", gone)
    if twice.isEmpty():
        return left
    a, b = fresh(docs.columns, "id", "md5")
    repeated = named(left, "left_semi", twice).withColumns({a: mine[0], b: mine[1]}).dropDuplicates([a, b]).drop(a, b)
    return named(left, "left_anti", twice).unionByName(repeated)
