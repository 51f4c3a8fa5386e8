import random

import numpy as np
import pytest

from tickwise.llm import substrings as S


def brute(docs, length):
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in first:
                gone.update(range(s, s + length))
            else:
                first[key] = (i, s)
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def corpus(seed, small):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(5 if small else 500)] + ["Ö", "x y"]
    passage = [[rnd.choice(vocab) for _ in range(rnd.randint(10, 80))] for _ in range(8)]
    docs = [(900, None), (901, ""), (902, "one two"), (903, " ".join("abc"[k % 3] for k in range(200)))]
    for i in range(60):
        words = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(passage)[:]
            if rnd.random() < 0.5:
                p[rnd.randrange(len(p))] = "edit%d" % i
            words += [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))] + p
        docs.append((i * 7 % 61, " \n".join(words)))
    return docs + [(1000, docs[9][1]), (1001, docs[9][1])]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("crowd", [512, 1])
def test_matches_brute_force(spark, monkeypatch, small, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    docs = corpus(5, small)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, first int")
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in S.remove_repeats(df, length=12, gram=4).collect()}
    assert got == brute(docs, 12)


def test_equal_halves_of_word_hashes_do_not_match(spark, monkeypatch):
    """Words whose hashes agree in the low 32 bits are different words."""
    plain = S.WordHashes.__call__
    monkeypatch.setattr(S, "REMEMBERED", 10_000)
    words = [f"w{k}" for k in range(40)]
    hashes = {w.encode(): h for w, h in zip(words, plain(S.WordHashes(), [w.encode() for w in words]).tolist())}
    auto, one = S.Automaton(), [hashes[w.encode()] for w in words]
    other = one[:]
    other[20] ^= 1 << 40
    auto.add(one)
    assert max(auto.statistics(other)) < 21 and (one[20] & 0xFFFFFFFF) == (other[20] & 0xFFFFFFFF)
    texts = [" ".join(words), " ".join([*words[:20], "else", *words[21:]])]
    got = {r["id"]: r["n_removed"] for r in S.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=12, gram=4).collect()}
    assert got == {0: 0, 1: 39}


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_matches_substrings():
    rnd = random.Random(1)
    auto, texts = S.Automaton(), []
    for _ in range(20):
        t = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 30))]
        got = list(auto.statistics(t))
        want = [max((k for k in range(e + 2) if any(t[e + 1 - k : e + 1] == u[j : j + k] for u in texts for j in range(len(u) - k + 1))), default=0) for e in range(len(t))]
        assert got == want
        auto.add(t)
        texts.append(t)


def test_anchors_are_the_first_least_runs_and_words_hash_in_one_pass(monkeypatch):
    rnd = np.random.default_rng(5)
    for n, length, gram in ((60, 20, 8), (20, 20, 8), (40, 8, 8), (50, 5, 2)):
        h = rnd.integers(0, 3, n)
        run = {s: S.segments(h[s : s + gram], gram, gram)[0].view(np.uint64)[0] for s in range(n - gram + 1)}
        places = [min(range(s, s + length - gram + 1), key=lambda p: (run[p], p)) for s in range(n - length + 1)]
        anchor, first, count = S.segments(h, length, gram)
        assert np.repeat(anchor.view(np.uint64), count).tolist() == [run[p] for p in places]
        assert first.tolist() == [s for s in range(len(places)) if s == 0 or places[s] != places[s - 1]]
    asked = []
    digest = S.xxhash.xxh64_intdigest
    monkeypatch.setattr(S.xxhash, "xxh64_intdigest", lambda w: asked.append(w) or digest(w))
    hashes = S.WordHashes()
    assert hashes([b"a", b"b", b"a"]).tolist() == [digest(w) - (1 << 63) for w in (b"a", b"b", b"a")] and hashes([b"b", b"c"]).tolist()[0] == digest(b"b") - (1 << 63)
    assert asked == [b"a", b"b", b"c"]
