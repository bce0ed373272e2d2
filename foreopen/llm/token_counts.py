"""Edit-aware token counts.

A text is cut into units that tokenise by themselves: the pre-tokens from one place where white space follows another
character up to the next such place. Units are gathered into leaves, and a binary tree over the leaves sums their
characters and tokens. An edit finds its leaves by the tree, re-encodes only those (and the leaf before it, where the
edit begins at a border), and updates the sums on their way to the root. A leaf that outgrows its size is divided again.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.llm.common import read, small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
#: White space other than blank and line feed; beside it a cut may not be safe.
ODD = re.compile(r"[^\S \n]")
LEAF = 512
CACHE = 250_000
KEPT = 50_000


class Counter:
    """Token counts of units, with the units met of late kept."""

    def __init__(self, ranks: str = RANKS):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def unit(self, text: str) -> int:
        n = self.new.get(text)
        if n is None:
            n = self.old.get(text)
            if n is None:
                n = self.whole(text)
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[text] = n
        return n

    def leaves(self, text: str, size: int = LEAF) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf. A leaf is at least ``size`` characters of whole units (the last may be less)."""
        chars, tokens = [], []
        n = t = 0
        odd = ODD.search(text) is not None
        get = self.new.get
        for u in units(text) if odd else UNIT.findall(text):
            n += len(u)
            c = get(u)
            if c is None:
                c = self.unit(u)
                get = self.new.get
            t += c
            if n >= size:
                chars.append(n)
                tokens.append(t)
                n = t = 0
        if n:
            chars.append(n)
            tokens.append(t)
        return chars, tokens


def units(text: str) -> list[str]:
    """Units of a text with other white space: a piece that ends in such a character stays with the next."""
    out: list[str] = []
    for u in UNIT.findall(text):
        if out and out[-1][-1].isspace():
            out[-1] += u
        else:
            out.append(u)
    return out


class CountTree:
    """Sums of characters and tokens over leaves: node k has children 2k and 2k + 1, leaves begin at ``width``."""

    def __init__(self, chars: list[int], tokens: list[int], size: int = LEAF):
        self.size = size
        self.width = 1 << max(0, (len(chars) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(chars)] = chars
        self.tokens[self.width : self.width + len(tokens)] = tokens
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with characters for the end), and where it begins."""
        k, begin = 1, 0
        at = min(at, self.chars[1] - 1)
        while k < self.width:
            k *= 2
            if at - begin >= self.chars[k]:
                begin += self.chars[k]
                k += 1
        return k - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.width
        self.chars[k], self.tokens[k] = chars, tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def edit(self, counter: Counter, text: str, start: int, stop: int, new: str) -> tuple[str, int]:
        """The text with [start, stop) replaced, and how many characters were encoded anew."""
        start, stop = max(0, min(start, len(text))), max(0, min(stop, len(text)))
        stop = max(start, stop)
        after = text[:start] + new + text[stop:]
        if not text or not after:
            self.__init__(*counter.leaves(after, self.size), self.size)
            return after, len(after)
        # the characters on both sides of the edit decide whether the leaves' borders are still safe
        first, begin = self.find(max(0, start - 1))
        last, at = self.find(min(len(text) - 1, stop))
        end = at + self.chars[self.width + last]
        grown = len(new) - (stop - start)
        part = after[begin : end + grown]
        if len(part) > 4 * self.size:  # begins and ends where leaves do, so its own leaves may take their place
            chars, tokens = counter.leaves(part, self.size)
            old = [(c, t) for k, (c, t) in enumerate(zip(self.chars[self.width :], self.tokens[self.width :], strict=True)) if c and not first <= k <= last]
            left = sum(c > 0 for c in self.chars[self.width : self.width + first])
            old[left:left] = zip(chars, tokens, strict=True)
            self.__init__([c for c, _ in old], [t for _, t in old], self.size)
            return after, len(part)
        self.put(first, len(part), counter.whole(part))
        for leaf in range(first + 1, last + 1):
            if self.chars[self.width + leaf]:
                self.put(leaf, 0, 0)
        return after, len(part)


_LOADED: dict[str, Counter] = {}


def counter(ranks: str) -> Counter:
    if ranks not in _LOADED:
        _LOADED[ranks] = Counter(ranks)
    return _LOADED[ranks]


def build(docs: DataFrame, ranks: str = RANKS, leaf: int = LEAF, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, leaf_chars array<int>, leaf_tokens array<int>)`` and carried columns: the trees' leaves.

    A null or empty text has no leaf and no token. Repeated rows have a tree each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(ranks)
        for pdf in batches:
            out = pdf[["doc_id", *carry]].copy()
            leaves = [c.leaves(t or "", leaf) for t in pdf["text"]]
            out["n_tokens"] = [sum(t) for _, t in leaves]
            out["leaf_chars"] = [np.array(n, np.int32) for n, _ in leaves]
            out["leaf_tokens"] = [np.array(t, np.int32) for _, t in leaves]
            yield out
        c.old, c.new = {}, dict(itertools.islice(c.new.items(), KEPT))  # the worker may go on to other work

    own = "".join(f"`{c}` {kind[c]}, " for c in ("doc_id", *carry))
    return docs.select("doc_id", "text", *[c for c in carry if c != "text"]).mapInPandas(run, own + "n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>")


EDITED = "n_tokens bigint, edited_tokens bigint, n_chars bigint, encoded_chars bigint, edited_sha256 string"


def apply_edits(trees: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Counts before and after edits; trees: ``build(carry=("text",))`` with ``edits array<struct<start, stop, new>>``.

    Edits apply one after the other, each to the text that the last left; places out of the text are moved to its end,
    null edits change nothing, a null text is empty. ``encoded_chars`` is how many characters were tokenised anew.
    Repeated rows are edited each by itself; other columns are ignored; an empty table gives no rows.
    """
    kind = dict(trees.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(ranks)
        for pdf in batches:
            rows = []
            for i, text, chars, tokens, edits in zip(pdf["doc_id"], pdf["text"], pdf["leaf_chars"], pdf["leaf_tokens"], pdf["edits"], strict=True):
                tree = CountTree(list(map(int, chars)), list(map(int, tokens)))
                text, before, anew = text or "", tree.total, 0
                for e in () if edits is None else edits:
                    text, n = tree.edit(c, text, int(e["start"]), int(e["stop"]), e["new"] or "")
                    anew += n
                rows.append((i, before, tree.total, len(text), anew, hashlib.sha256(text.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "edited_tokens", "n_chars", "encoded_chars", "edited_sha256"])

    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInPandas(run, f"doc_id {kind}, {EDITED}")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's tokens, and its tokens after two edits: 40 characters in its middle replaced, a line put before it."""
    trees = build(read(spark, sf_dir, "documents"), carry=("text",))
    half = F.floor(F.coalesce(F.length("text"), F.lit(0)) / 2).cast("int")
    edit = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(new).alias("new"))
    edits = F.array(edit(half, half + 40, "an edited passage, number 7"), edit(F.lit(0), F.lit(0), "Edited.\n"))
    return apply_edits(trees.withColumn("edits", edits))
