import hashlib
import random

from tickwise.llm import chat


def want(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(t for r, t in v if r == "assistant") for c, v in out.items()}
    return {c: (len(v), digest("".join(f"{r}\n{t}\n" for r, t in v)), len(loss[c]), digest(loss[c])) for c, v in out.items()}


def corpus():
    rnd = random.Random(4)
    words = ["hi", "</s>", "[INST] x [/INST]", "\\", "<|im_end|>\n", "<\\|", "<", "|im_start|>", "é😀", "\n", "", "<<SYS>>", "\\n", "[\\INST]"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    openings = [say(3) for _ in range(3)]
    rows = []
    for c in range(80):
        rows += [(c, 0, "user", openings[c % 3])] + [(c, k, rnd.choice(["user", "assistant", "sys\ntem\\n", None]), rnd.choice([None, say(rnd.randint(0, 6)), "same"])) for k in range(1, rnd.randint(1, 6))]
    rows += [(100 + c, k, "assistant", f"t{k}") for c in range(30) for k in range(3)]
    rows += [(200, k, "user", f"deep {k}") for k in range(3000)] + [(201, None, "user", "x"), (201, 0, "user", "x"), (201, 0, "user", "x")]
    return rows


def test_round_trip(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, leaf string")
    got = {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.formatted(df).collect()}
    assert got == want(rows)
    known = chat.paths(df)
    small = {r["leaf"]: tuple(r) for r in chat.read_back(chat.format_packs(df, known, pack_chars=300)).collect()}
    assert small == {r["leaf"]: tuple(r) for r in chat.read_back(chat.format_packs(df, known)).collect()}


def test_shared_turns_are_written_once(spark):
    rows = [(c, k, "user", f"shared {k}" if k < 2 else f"own {c}") for c in range(5) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.format_packs(df, chat.paths(df)).collect()
    assert len(packs) == 1 and packs[0]["text"].count("shared 0") == 1 and packs[0]["text"].count("own") == 5
    assert sum(p == packs[0]["positions"][2] for p in packs[0]["positions"]) == 5


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_large_tree_is_cut_by_subtree(spark):
    """Packs have only the turns above a cut in common: none below the second turn of these is written more than twice."""
    rows = [(c, 0, "user", "opening " * 30) for c in range(240)] + [(c, 1, "assistant", f"branch {c // 40} " * 20) for c in range(240)] + [(c, 2, "user", f"twig {c // 4} " * 10) for c in range(240)] + [(c, 3, "assistant", f"own {c}") for c in range(240)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = [r["text"] for r in chat.format_packs(df, chat.paths(df), pack_chars=20_000).collect()]
    written = lambda what: sum(p.count("\n" + what) for p in packs)
    assert len(packs) > 5 and sum(p.count("opening opening " * 15) for p in packs) == len(packs)
    assert written("branch ") <= 6 + len(packs) and written("twig ") <= 60 + len(packs) and written("own ") == 240
