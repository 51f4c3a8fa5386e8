"""Edit-aware token counts.

A document is kept as blocks of pre-tokens under a segment tree of characters and tokens. An edit finds its
place by the tree's character sums, pre-tokenises the touched region with a little context before it until the
boundaries fall in step with the old ones again, and updates the sums on the way up. The rest is never read.
"""

from __future__ import annotations

import base64

import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Fixed value: the pre-token pattern that the byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in a new block, and how many a block may grow to before it is cut up.
BLOCK, GROWN = 64, 192
#: Pre-tokens whose counts a worker remembers; it starts over beyond that.
REMEMBERED = 300_000
_tokenizers: dict[str, Tokenizer] = {}


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int]):
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(PATTERN).findall
        self.seen: dict[str, int] = {}
        self.encoded = 0

    @staticmethod
    def ranks(lines: list[str]) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token; the characters are added to ``encoded``."""
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for p in set(pieces):
            if p not in seen:
                seen[p] = len(self.encode(p))
        return [seen[p] for p in pieces]


def tokenizer(name: str, lines: list[str]) -> Tokenizer:
    """A worker's tokenizer of a vocabulary, built once."""
    if name not in _tokenizers:
        _tokenizers[name] = Tokenizer(Tokenizer.ranks(lines))
    return _tokenizers[name]


class Tree:
    """Blocks of (text, pre-token lengths, pre-token counts) under sums of characters and tokens."""

    def __init__(self, text: str, tok: Tokenizer):
        self.tok = tok
        self._build(self._blocks(text))

    def _blocks(self, text: str) -> list[tuple[str, list[int], list[int]]]:
        pieces = self.tok.split(text)
        counts = self.tok.counts(pieces)
        out = []
        for a in range(0, len(pieces), BLOCK):
            own = pieces[a : a + BLOCK]
            out.append(("".join(own), list(map(len, own)), counts[a : a + BLOCK]))
        return out

    def _build(self, blocks: list) -> None:
        self.blocks = blocks or [("", [], [])]
        n = self.n = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (text, _, counts) in enumerate(self.blocks):
            self.chars[n + i], self.tokens[n + i] = len(text), sum(counts)
        for i in range(n - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` and where the block starts; the last block for the end of the text."""
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.n, start

    def _set(self, i: int, block: tuple[str, list[int], list[int]]) -> None:
        self.blocks[i] = block
        k = self.n + i
        self.chars[k], self.tokens[k] = len(block[0]), sum(block[2])
        while k > 1:
            k //= 2
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, at: int, drop: int, put: str) -> None:
        """Replaces ``drop`` characters from ``at`` on by ``put``; both are cut to the text.

        A pre-token depends on the text from its start to two characters beyond its end, and on nothing before. So
        boundaries up to two characters before the edit stand, and once a new boundary past the edit is an old
        one, all later ones are.
        """
        size = self.chars[1]
        at = max(0, min(at, size))
        drop = max(0, min(drop, size - at))
        first, start = self.find(at)
        keep = self._boundary(first, at - 2 - start)
        while not keep and first:
            first -= 1
            start -= len(self.blocks[first][0])
            keep = self._boundary(first, at - 2 - start)
        keep_chars = sum(self.blocks[first][1][:keep])
        last, last_start = self.find(at + drop)
        head, tail = self.blocks[first], self.blocks[last]
        base = start + keep_chars
        before = self._between(first, last, start)[keep_chars : at - start]
        after = tail[0][at + drop - last_start :]
        old = set()
        where = last_start
        for n in tail[1]:
            old.add(where)
            where += n
        shift = len(put) - drop
        while True:
            text = before + put + after
            pieces = self.tok.split(text)
            done, where = None, base
            more = last + 1 < len(self.blocks)
            for k, p in enumerate(pieces):
                if where >= at + len(put) and where - shift in old and (not more or where - base <= len(text) - 2):
                    done = k
                    break
                where += len(p)
            if done is not None or not more:
                break
            last += 1
            edge = last_start + len(tail[0])
            last_start, tail = edge, self.blocks[last]
            where = edge
            for n in tail[1]:
                old.add(where)
                where += n
            after += tail[0]
        fresh = pieces if done is None else pieces[:done]
        rest_text, rest_len, rest_n = "", [], []
        if done is not None:
            # the unchanged end of the last block that was looked at
            resume = where - shift
            pos = last_start
            k = 0
            while pos < resume and k < len(tail[1]):
                pos += tail[1][k]
                k += 1
            if resume < last_start:
                # in step before the last block began: take over all from there
                fresh_tail = self._blocks_from(resume, last, last_start)
                rest_text, rest_len, rest_n = fresh_tail
            else:
                rest_text, rest_len, rest_n = tail[0][resume - last_start :], tail[1][k:], tail[2][k:]
        self.tok.encoded += sum(map(len, fresh))
        text = head[0][:keep_chars] + "".join(fresh) + rest_text
        lengths = head[1][:keep] + list(map(len, fresh)) + rest_len
        counts = head[2][:keep] + self.tok.counts(fresh) + rest_n
        if len(lengths) > GROWN:
            cut, pos = [], 0
            for a in range(0, len(lengths), BLOCK):
                own = lengths[a : a + BLOCK]
                cut.append((text[pos : pos + sum(own)], own, counts[a : a + BLOCK]))
                pos += sum(own)
            self._build(self.blocks[:first] + cut + self.blocks[last + 1 :])
            return
        self._set(first, (text, lengths, counts))
        for i in range(first + 1, last + 1):
            self._set(i, ("", [], []))

    def _boundary(self, block: int, most: int) -> int:
        """How many of a block's pre-tokens end at or before ``most`` characters into it."""
        k = pos = 0
        lengths = self.blocks[block][1]
        while k < len(lengths) and pos + lengths[k] <= most:
            pos += lengths[k]
            k += 1
        return k

    def _between(self, first: int, last: int, start: int) -> str:
        return "".join(b[0] for b in self.blocks[first : last + 1])

    def _blocks_from(self, resume: int, last: int, last_start: int) -> tuple[str, list[int], list[int]]:
        """Text, lengths and counts of the old pre-tokens from character ``resume`` to the end of block ``last``."""
        i, start = self.find(resume)
        text, lengths, counts = "", [], []
        for b in range(i, last + 1):
            t, ls, ns = self.blocks[b]
            k = pos = 0
            if b == i:
                while pos < resume - start:
                    pos += ls[k]
                    k += 1
            text, lengths, counts = text + t[pos:], lengths + ls[k:], counts + ns[k:]
        return text, lengths, counts

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(b[0] for b in self.blocks)


def count_edits(docs: DataFrame, edits: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_tokens, n_tokens_after, n_chars_after, encoded_chars): counts before and after each document's edits.

    edits: array of structs (at, drop, put) over the columns of ``docs``, applied in turn; at and drop count
    characters and are cut to the text; a null array, or nulls in it, change nothing there. encoded_chars says how many
    characters were encoded again. Null texts count as empty, very long ones whole; repeated rows stay, an empty table gives
    no rows, and other columns are ignored unless ``edits`` reads them. The vocabulary, a file of the driver (about 1 MB), is
    broadcast. With ``keep_text``, the edited text follows.
    """
    with open(vocabulary, encoding="ascii") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read().splitlines())
    given = F.coalesce(edits, F.array().cast("array<struct<at:long,drop:long,put:string>>"))

    def part(name: str, default) -> Column:
        return F.transform(given, lambda e: F.coalesce(e[name], F.lit(default))).alias(name)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), part("at", 0), part("drop", 0), part("put", ""))

    def step(batches):
        tok = tokenizer(vocabulary, lines.value)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "n_tokens", "n_tokens_after", "n_chars_after", "encoded_chars", "text")}
            for i, t, ats, drops, puts in zip(b["id"], b["t"], b["at"], b["drop"], b["put"]):
                tree = Tree(t, tok)
                before, tok.encoded = tree.total, 0
                for at, drop, put in zip(ats, drops, puts):
                    tree.edit(at, drop, put)
                for k, v in zip(out, (i, before, tree.total, tree.chars[1], tok.encoded, tree.text() if keep_text else None)):
                    out[k].append(v)
            yield out

    found = map_columns(source, step, "id long, n_tokens long, n_tokens_after long, n_chars_after long, encoded_chars long, text string")
    return found if keep_text else found.drop("text")


def sample_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits that follow from the id and the text's length: a replacement, an insertion, a deletion."""
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    at = lambda k: F.when(size > 0, F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), size)).otherwise(0)
    edit = lambda a, drop, put: F.struct(a.cast("long").alias("at"), F.lit(drop).cast("long").alias("drop"), F.lit(put).alias("put"))
    return F.array(edit(at(1), 7, "a new phrase, "), edit(at(2), 0, " don't 42"), edit(at(3), 40, ""))
