"""Chat formatting through a prefix tree.

Conversations that share their first turns share those tokens: a pack is a tree of turns, written depth-first,
each turn once. A turn has the position ids of its place in the conversation and may attend to the intervals
of the pack that its ancestors take up. The loss mask covers assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.plans.shared import materialize

from .common import map_columns

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that some chat template takes for control, escaped inside texts. None has a backslash or n second.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Characters of distinct conversations in a pack. A larger tree is cut between conversations in depth-first order, so two
#: packs have in common the turns above the cut and no others.
PACK = 400_000
#: Turns, and bytes of a turn's digest, by which conversations are put in that order.
DEPTH, HEAD = 48, 4

_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    r"""Doubles backslashes and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: {"n": "\n"}.get(m[1], m[1]), role)


@dataclass
class Turn:
    start: int
    end: int
    parent: int
    position: int
    mask: tuple[int, int]
    ancestors: list[int] = field(default_factory=list)  # interval bounds, start and end in turn


class Pack:
    """One tree: turns are added path by path, then laid out depth-first."""

    def __init__(self):
        self.children: list[dict[bytes, int]] = [{}]
        self.turns: list[tuple[str, str]] = [("", "")]
        self.leaves: dict[bytes, int] = {}

    def walk(self, at: int, key: bytes, role: str, text: str) -> int:
        found = self.children[at].get(key)
        if found is None:
            found = self.children[at][key] = len(self.turns)
            self.turns.append((role, text))
            self.children.append({})
        return found

    def lay_out(self) -> tuple[str, list[Turn], dict[bytes, int]]:
        """The text, its turns in order, and the turn at which each conversation ends."""
        out: list[str] = []
        laid: list[Turn] = []
        place: dict[int, int] = {}
        size = 0
        stack = [(child, -1) for child in reversed(self.children[0].values())]
        while stack:
            node, parent = stack.pop()
            role, text = self.turns[node]
            head, body = OPEN + escape_role(role) + "\n", escape(text)
            above = laid[parent] if parent >= 0 else None
            spans = list(above.ancestors) if above else []
            if above:
                if spans and spans[-1] == above.start:
                    spans[-1] = above.end
                else:
                    spans += [above.start, above.end]
            a = size + len(head)
            mask = (a, a + len(body)) if role == "assistant" else (a, a)
            end = a + len(body) + len(CLOSE)
            laid.append(Turn(size, end, parent, above.position + above.end - above.start if above else 0, mask, spans))
            place[node] = len(laid) - 1
            out += (head, body, CLOSE)
            size = end
            stack += [(child, place[node]) for child in reversed(self.children[node].values())]
        return "".join(out), laid, {leaf: place[node] for leaf, node in self.leaves.items()}


def _chain(role: str, text: str, before: bytes) -> bytes:
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(b"%d:%s%d:%s" % (len(r), r, len(t), t), digest_size=16, key=before).digest()


def paths(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, root, leaf, path, chars) per conversation: digests of its first turn and of all its turns in order.

    path puts together the heads of the digests on the way, so conversations in its order are in depth-first order of
    the tree of turns. The rows of a conversation stream past in order; nothing but the running digest and path is held.
    """

    def step(batches):
        now, some, state = None, False, (b"", b"", b"", 0)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("conv", "root", "leaf", "path", "chars")}
            for conv, role, text in zip(b["conv"], b["role"], b["text"]):
                if some and conv != now:
                    for name, v in zip(out, (now, *state)):
                        out[name].append(v)
                if not some or conv != now:
                    now, some, state = conv, True, (b"", b"", b"", 0)
                key = _chain(role, text, state[1])
                path = state[2] + key[:HEAD] if len(state[2]) < DEPTH * HEAD else state[2]
                state = (state[0] or key, key, path, state[3] + len(role) + len(text) + 24)
            yield out
        if some:
            yield {"conv": [now], "root": [state[0]], "leaf": [state[1]], "path": [state[2]], "chars": [state[3]]}

    return map_columns(_ordered(_rows(conversations, conv_col, turn_col, role_col, text_col), ["conv"]), step, "conv long, root binary, leaf binary, path binary, chars long")


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _ordered(rows: DataFrame, group: list[str]) -> DataFrame:
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *group).sortWithinPartitions(*dict.fromkeys([*group, "conv"]), "turn", "role", "text")


def _cut(one: DataFrame, pack_chars: int) -> DataFrame:
    """(leaf, conv, pack): distinct conversations in depth-first order, cut where a root ends or ``pack_chars`` would be passed.

    A range sort deals them, so a root that most conversations share lies in many tasks; its packs end there, too.
    """

    def step(batches):
        root, size, pack = None, 0, -1
        for b in batches:
            packs = []
            for part, own, chars in zip(b["part"], b["root"], b["chars"]):
                if own != root or size + chars > pack_chars:
                    root, size, pack = own, 0, pack + 1
                size += chars
                packs.append((part << 40) + pack)
            yield {"leaf": b["leaf"], "conv": b["conv"], "pack": packs}

    dealt = one.repartitionByRange("root", "path", "leaf").sortWithinPartitions("root", "path", "leaf").withColumn("part", F.spark_partition_id().cast("long"))
    return materialize(map_columns(dealt.select("leaf", "conv", "root", "chars", "part"), step, "leaf binary, conv long, pack long"))


def format_packs(conversations: DataFrame, known: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack_chars: int = PACK) -> DataFrame:
    """One row a pack: its text and, per turn, start, end, parent, first position id, loss span and ancestor intervals.

    known: paths(). Of conversations with equal turns one is written. ``spans`` are the intervals of all turns end to
    end, ``span_ends`` where each turn's stop; ``leaves`` and ``leaf_turns`` say where each conversation ends.
    A conversation is never cut, however long it is.
    """
    one = known.groupBy("leaf").agg(F.min(F.struct("conv", "root", "path", "chars")).alias("at")).select("leaf", "at.*")
    placed = _cut(one, pack_chars)
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col).join(placed.withColumnRenamed("conv", "__conv"), F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv")

    def step(batches):
        now, pack, at, key, leaf = None, Pack(), 0, b"", None

        def done():
            text, turns, leaves = pack.lay_out()
            ends, spans = [], []
            for t in turns:
                spans += t.ancestors
                ends.append(len(spans))
            return {
                "text": [text], "starts": [[t.start for t in turns]], "ends": [[t.end for t in turns]], "parents": [[t.parent for t in turns]], "positions": [[t.position for t in turns]],
                "mask": [[x for t in turns for x in t.mask]], "spans": [spans], "span_ends": [ends], "leaves": [[k.hex() for k in leaves]], "leaf_turns": [list(leaves.values())],
            }

        for b in batches:
            for own, of, role, text in zip(b["pack"], b["leaf"], b["role"], b["text"]):
                if own != now:
                    if now is not None:
                        pack.leaves[leaf] = at
                        yield done()
                    now, pack, leaf = own, Pack(), None
                if of != leaf:
                    if leaf is not None:
                        pack.leaves[leaf] = at
                    leaf, at, key = of, 0, b""
                key = _chain(role, text, key)
                at = pack.walk(at, key, role, text)
        if now is not None:
            pack.leaves[leaf] = at
            yield done()

    ordered = _ordered(rows, ["pack"])
    return map_columns(ordered.select("pack", "leaf", "role", "text"), step, "text string, starts array<long>, ends array<long>, parents array<long>, positions array<long>, mask array<long>, spans array<long>, span_ends array<long>, leaves array<string>, leaf_turns array<long>")


def read_back(packs: DataFrame) -> DataFrame:
    """(leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its pack alone.

    A conversation is what its last turn may attend to and that turn; position ids must count its characters.
    """

    def step(batches):
        for b in batches:
            for k, text in enumerate(b["text"]):
                starts, ends, parents, positions, mask, spans, cuts = (b[c][k] for c in ("starts", "ends", "parents", "positions", "mask", "spans", "span_ends"))
                out: dict[str, list] = {c: [] for c in ("leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
                for leaf, at in zip(b["leaves"][k], b["leaf_turns"][k]):
                    own = [*spans[cuts[at - 1] if at else 0 : cuts[at]], starts[at], ends[at]]
                    shown = "".join(text[x:y] for x, y in zip(own[::2], own[1::2]))
                    if positions[at] + ends[at] - starts[at] != len(shown):
                        raise ValueError(f"position ids of conversation {leaf} do not count its characters")
                    turns, n = hashlib.sha256(), 0
                    for m in _TURN.finditer(shown):
                        turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                        n += 1
                    path = []
                    while at >= 0:
                        path.append(at)
                        at = parents[at]
                    loss = "".join(unescape(text[mask[2 * t] : mask[2 * t + 1]]) for t in reversed(path))
                    for c, v in zip(out, (leaf, n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown))):
                        out[c].append(v)
                yield out

    return map_columns(packs, step, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv, ...) with the digests of every conversation, read back from the packs.

    Turns go by number, ties by role and then text; null roles and texts are empty, null turns come first, rows without a
    conversation id form one conversation. Repeated rows are turns of their own; texts of any length count whole. An empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    known = materialize(paths(conversations, **columns))
    packs = materialize(format_packs(conversations, known, **columns))
    found = read_back(packs)
    return known.select("conv", F.lower(F.hex("leaf")).alias("leaf")).join(found, "leaf").drop("leaf")
