"""SentencePiece encoding and decoding as a max-plus parallel scan.

A sequence of pieces is the encoding of its text if and only if every two neighbours are the encoding of their own
joined text. So encoding is a best path: nodes are pieces at their places in the text, an arc has weight 0 where two
neighbours agree and minus infinity elsewhere, and every place has at most one piece by which a valid path ends there.
A chunk of a giant text yields a transfer matrix over the pieces that can lie across its two borders; matrices combine
by the associative max-plus product; with the border pieces known, every chunk is traced back by itself.
The vocabulary is a public model whose path is a parameter; nothing is trained.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.llm.common import cut, read, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Where a unit begins after another character.
BORDER = re.compile(f"(?<=[^{SPACE}]){SPACE}")
CACHE = 250_000
#: How many units stay known from one task to the next.
KEPT = 50_000
WORDS = 200_000
#: Characters that a chunk knows beyond its borders, and chunks whose matrices one task multiplies.
SPAN = 64
BLOCK = 64
PAIRS = 400_000
NONE = -(1 << 30)


class Pieces:
    """One vocabulary: its pieces, and the pairs of pieces found to agree."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        plain = [i for i in range(n) if i not in self.of_byte and i not in self.control]
        #: When merging makes a piece: at its rank; single characters are there from the start.
        self.rank = {self.text[i]: -model.get_score(i) if len(self.text[i]) > 1 else -1.0 for i in plain}
        self.id = {self.text[i]: i for i in plain}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: Ids of units met of late, and of those met before them.
        self.units: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: The same of words between blanks.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        # a piece that merging never yields lies on no path
        self.vocab = {t for t in self.id if len(t) == 1 or self.merged(t)}
        self.longest = max(map(len, self.vocab), default=1)
        self.safe = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.vocab)
        self.cut = self._units()
        #: The longest piece by its first three characters.
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        #: Bytes of each piece in a decoded text.
        self.raw = [b"" if i in self.control else bytes([self.of_byte[i]]) if i in self.of_byte else self.text[i].replace(SPACE, " ").encode() for i in range(n)]

    def _units(self) -> re.Pattern:
        """Units: parts of a text between characters that no piece has next to each other, so that no piece spans two.

        A unit is a run of marks with the letters after it up to punctuation that no piece joins to letters, or with
        such punctuation up to letters; or else with all that follows. Line feeds are their own where no piece has them.
        """
        letter = re.compile(r"[^\W\d_]")
        pairs = {(a, b) for t in self.vocab for a, b in zip(t, t[1:], strict=False)}
        joined = {c for a, b in pairs for c, d in ((a, b), (b, a)) if letter.match(d)}
        p = re.escape("".join(c for c in string.punctuation if c not in joined))
        n = "" if any("\n" in t for t in self.vocab) else "\n"
        parts = [rf"{SPACE}*[^\W\d_]++(?=[{SPACE}{n}{p}]|$)", rf"{SPACE}*[{p}]++(?=[{SPACE}{n}]|[^\W\d_]|$)" if p else "", f"{SPACE}*[^{SPACE}{n}]+", f"{SPACE}+", f"{n}+" if n else ""]
        return re.compile("|".join(x for x in parts if x))

    def merged(self, text: str) -> bool:
        """Whether merging the best-ranked neighbours, leftmost first, makes the text one piece; notes its last merge."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if at < 0:
                return False
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def agree(self, a: str, b: str) -> bool:
        """Whether merging leaves the border between two pieces alone.

        Undoes the merges on both sides of the border, the latest first. The two parts that then meet at the border
        stood there until the merge just undone; if they merge before that, the pieces never come about.
        """
        row = self.pairs.setdefault(a, {})
        ok = row.get(b)
        if ok is None:
            self.n_pairs += 1
            if self.n_pairs > PAIRS:
                self.pairs, self.n_pairs = {a: row}, 0
                row.clear()
            ok = row[b] = self._agree(a, b)
        return ok

    def _agree(self, x: str, y: str) -> bool:
        rank, halves = self.rank, self.halves
        until, right = float("inf"), False
        while True:
            r = rank.get(x + y)
            if r is not None and (r < until or r == until and right):
                return False
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                until, right, x = rx, False, halves[x][1]
            else:
                until, right, y = ry, True, halves[y][0]

    def forward(self, text: str, start: int, stop: int, last: dict[int, str | None]) -> dict[int, str | None]:
        """For each place up to stop, the piece by which a valid path from the given places ends there.

        last: pieces at the places where a path may begin; a character outside the vocabulary stands alone and
        agrees with all. None marks the start of a text.
        """
        vocab, agree, longest = self.vocab, self.agree, self.longest
        for i in range(start + 1, stop + 1):
            if i in last:
                continue
            for j in range(max(start, i - longest), i):
                if j in last:
                    t = text[j:i]
                    if t in vocab:
                        p = last[j]
                        if p is None or p not in vocab or agree(p, t):
                            last[i] = t
                            break
                    elif i - j == 1 and t not in vocab:
                        last[i] = t
                        break
        return last

    def ids(self, parts: list[str]) -> list[int]:
        out = []
        for t in parts:
            i = self.id.get(t)
            if i is None:
                out += [self.byte[b] for b in t.encode()]
            else:
                out.append(i)
        return out

    def path(self, text: str) -> list[str]:
        """The one path of weight 0 over a short text, depth first and longest piece first.

        A place from which the end can't be reached is passed by from then on: whatever path came there, its last
        piece was the same.
        """
        vocab, agree, reach, n = self.vocab, self.agree, self.reach, len(text)
        parts: list[str] = []
        dead: set[int] = set()
        at, end, before, row = 0, min(n, reach.get(text[:3], 2)), None, None
        while at < n:
            while end > at:
                t = text[at:end]
                if t in vocab:
                    if row is None:
                        if end not in dead:
                            break
                    else:
                        ok = row.get(t)
                        if ok is None:
                            ok = agree(before, t)
                        if ok and end not in dead:
                            break
                elif end == at + 1 and end not in dead:
                    break
                end -= 1
            if end > at:
                parts.append(t)
                at, before = end, t
                end = min(n, at + reach.get(text[at : at + 3], 2))
            else:
                dead.add(at)
                end = at - 1
                at -= len(parts.pop())
                before = parts[-1] if parts else None
            # a character outside the vocabulary agrees with all
            row = self.pairs.setdefault(before, {}) if before in vocab else None
        return parts

    def unit(self, text: str) -> bytes:
        """Ids of a unit as 32-bit numbers."""
        got = self.units.get(text)
        if got is None:
            got = self.old.get(text)
            if got is None:
                got = np.array(self.ids(self.path(text)), "<i4").tobytes()
            if len(self.units) >= CACHE:
                self.old, self.units = self.units, {}
            self.units[text] = got
        return got

    def word(self, text: str, giant: int) -> bytes:
        """Ids of a word with a mark before it."""
        got = self.old_words.get(text)
        if got is None:
            got = self._joined(SPACE + text, giant)
        if len(self.words) >= WORDS:
            self.old_words, self.words = self.words, {}
        if len(text) <= 64:
            self.words[text] = got
        return got

    def encode(self, text: str, giant: int = 4096) -> np.ndarray:
        """Ids of a whole text. Units longer than giant, and vocabularies without units, are scanned in chunks."""
        if not text:
            return np.empty(0, np.int32)
        if not self.safe:
            return np.array(self.scan(marked(text), giant), np.int32)
        words = text.split(" ")
        if SPACE in text or "" in words:  # runs of marks are units of their own
            return np.frombuffer(self._joined(marked(text), giant), "<i4")
        parts = list(map(self.words.get, words))
        if None in parts:
            for k, got in enumerate(parts):
                if got is None:
                    parts[k] = self.word(words[k], giant)
        return np.frombuffer(b"".join(parts), "<i4")

    def _joined(self, text: str, giant: int) -> bytes:
        return b"".join([self.unit(u) if len(u) <= giant else np.array(self.scan(u, giant), "<i4").tobytes() for u in self.cut.findall(text)])

    def trim(self) -> None:
        """Forget all but the units and words met first since the last turnover: those are the frequent ones."""
        self.old, self.old_words = {}, {}
        self.units, self.words = (dict(itertools.islice(x.items(), KEPT)) for x in (self.units, self.words))
        self.pairs, self.n_pairs = {}, 0

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # the scan: a state is (end, piece), a piece across or up to a border; ends are places in the whole text

    def states(self, left: str, right: str, border: int) -> list[tuple[int, str]]:
        """Pieces that begin before the border and end at it or past it, from the text on both sides."""
        near, k = left[-self.longest :] + right[: self.longest], min(len(left), self.longest)
        found = []
        for b in range(max(0, k - self.longest), k):
            for e in range(k, min(len(near), b + self.longest) + 1):
                t = near[b:e]
                if t in self.vocab or e - b == 1:
                    found.append((border + e - k, t))
        return found

    def paths(self, text: str, base: int, stop: int, state: tuple[int, str | None]) -> dict[int, str | None]:
        """Places in [base, base + len(text)) reached from one entry state, up to stop and the pieces across it."""
        end, piece = state
        reach = self.forward(text, end - base, min(stop - base, len(text)), {end - base: piece})
        return {base + i: p for i, p in reach.items()}

    def ends(self, text: str, base: int, stop: int) -> tuple[int, int] | None:
        """The first and last place after base and before stop where a unit begins; None without any.

        No piece lies across such a place and any two pieces agree there, so every path of a chunk goes through both,
        and between them there always is one.
        """
        if not self.safe:
            return None
        found = [m.start() for m in BORDER.finditer(text, 0, min(len(text), 4 * self.longest))]
        first = next((i for i in found if i + base < stop), None) or next((m.start() for m in BORDER.finditer(text, 0, stop - base)), None)
        if not first:
            return None
        last = first
        span = 4 * self.longest
        while True:  # from the chunk's end back
            near = [m.start() for m in BORDER.finditer(text, max(first, stop - base - span), stop - base)]
            if near or stop - base - span <= first:
                last = near[-1] if near else first
                break
            span *= 4
        return base + first, base + last

    def transfer(self, text: str, base: int, stop: int, entries: list, exits: list) -> np.ndarray:
        """Max-plus matrix of a chunk: 0 where a path leads from an entry state to an exit state, NONE elsewhere.

        text begins at base and runs on past stop by the longest piece. Where units begin within the chunk, the matrix
        is the product of one from the entries to the first such place and one from the last of them to the exits.
        """
        ends = self.ends(text, base, stop)
        if ends is None:
            return self._whole(text, base, stop, entries, exits)
        first, last = ends
        enter = [[0 if first in self.paths(text, base, first, e) else NONE] for e in entries]
        leave = self._whole(text[last - base :], last, stop, [(last, None)], exits)
        return product(np.array(enter, np.int64).reshape(len(entries), 1), leave)

    def _whole(self, text: str, base: int, stop: int, entries: list, exits: list) -> np.ndarray:
        out = np.full((len(entries), len(exits)), NONE, np.int64)
        for r, state in enumerate(entries):
            if state[0] > stop:  # a piece longer than the chunk
                row = [0 if x == state else NONE for x in exits]
            else:
                last = self.paths(text, base, stop, state)
                row = [0 if self._leads(last, x, stop, state) else NONE for x in exits]
            out[r] = row
        return out

    def _leads(self, last: dict, exit_: tuple[int, str], stop: int, state: tuple) -> bool:
        end, piece = exit_
        if exit_ == state:
            return True
        if end == stop:
            return last.get(stop) == piece
        begin = end - len(piece)
        if begin not in last:
            return False
        before = last[begin]
        return before is None or before not in self.vocab or piece not in self.vocab or self.agree(before, piece)

    def trace(self, text: str, base: int, stop: int, entry: tuple, exit_: tuple) -> list[int]:
        """Ids after the entry's piece up to the exit's, that included."""
        ends = self.ends(text, base, stop)
        if ends is None:
            return self._back(text, base, stop, entry, exit_)
        first, last = ends
        out = self._back(text, base, first, entry, (first, None))
        out += self.encode(text[first - base + 1 : last - base].replace(SPACE, " ")).tolist()
        return out + self._back(text[last - base :], last, stop, (last, None), exit_)

    def _back(self, text: str, base: int, stop: int, entry: tuple, exit_: tuple) -> list[int]:
        if entry == exit_:
            return []
        last = self.paths(text, base, stop, entry)
        parts, i = [], exit_[0]
        if i > stop:
            parts.append(exit_[1])
            i -= len(exit_[1])
        while i > entry[0]:
            parts.append(last[i])
            i -= len(last[i])
        return self.ids(parts[::-1])

    def scan(self, text: str, chunk: int) -> list[int]:
        """Chunks of one text: transfer matrices, their products, then each chunk's own path."""
        n = len(text)
        borders = [*range(0, n, max(chunk, self.longest)), n]
        states = [[(0, None)], *[self.states(text[max(0, b - self.longest) : b], text[b : b + self.longest], b) for b in borders[1:-1]], [x for x in self.states(text[-self.longest :], "", n)]]
        mats = [self.transfer(text[a : b + self.longest], a, b, states[k], states[k + 1]) for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False))]
        chosen = choose(mats)
        out: list[int] = []
        for k, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
            out += self.trace(text[a : b + self.longest], a, b, states[k][chosen[k]], states[k + 1][chosen[k + 1]])
        return out


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NONE)


def choose(mats: list[np.ndarray], first: int = 0, last: int | None = None) -> list[int]:
    """The border states of the best path between two states, from prefix products forward and single matrices backward."""
    start = np.full((1, len(mats[0])), NONE, np.int64)
    start[0, first] = 0
    prefix = [start]
    for m in mats:
        prefix.append(product(prefix[-1], m))
    at = [int(prefix[-1][0].argmax()) if last is None else last]
    for p, m in zip(prefix[-2::-1], mats[::-1], strict=True):
        at.append(int((p[0] + m[:, at[-1]]).argmax()))
    return at[::-1]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


DIGEST = "n_tokens bigint, n_chars bigint, ids_sha256 string, text_sha256 string"


def digest(p: Pieces, ids: np.ndarray | None) -> tuple:
    """Tokens, characters and digests of ids (little-endian 32-bit) and of the text decoded from them."""
    ids = np.empty(0, np.int32) if ids is None else np.asarray(ids, "<i4")
    text = p.decode(ids.tolist())
    return len(ids), len(text), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _ids(path: str, carry: list[str], digests: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for pdf in batches:
            out = pdf[["doc_id", *carry]].copy()
            ids = (None if t is None else p.encode(t) for t in pdf["text"])
            if digests:
                rows = [digest(p, x) for x in ids]
                for k, name in enumerate(("n_tokens", "n_chars", "ids_sha256", "text_sha256")):
                    out[name] = [r[k] for r in rows]
            else:
                out["ids"] = list(ids)
            yield out
        p.trim()  # the worker may go on to other work

    return run


def _matrices(path: str):
    """Of each chunk row: its transfer matrix over the states that the text on both sides of its borders allows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for pdf in batches:
            cells = []
            for left, text, right, k, end in zip(pdf["left"], pdf["text"], pdf["right"], pdf["k"], pdf["last"], strict=True):
                if p.longest > SPAN:
                    raise ValueError(f"the vocabulary has a piece of {p.longest} characters; chunks know {SPAN} beyond their borders")
                entries, exits = _borders(p, left, text, right, k, end)
                m = p.transfer(text + right[: p.longest], 0, len(text), entries, exits)
                cells.append((m.shape[0], m.shape[1], m.astype(np.int32).tobytes()))
            out = pdf[["row", "k"]].copy()
            out["rows"], out["cols"], out["cells"] = [c[0] for c in cells], [c[1] for c in cells], [c[2] for c in cells]
            yield out

    return run


def _borders(p: Pieces, left: str, text: str, right: str, k: int, end: int):
    entries = [(0, None)] if k == 0 else p.states(left, text + right, 0)
    return entries, p.states((left + text)[-p.longest :], "" if k == end else right, len(text))


def _cells(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(c, np.int32).reshape(r, s).astype(np.int64) for r, s, c in zip(pdf["rows"], pdf["cols"], pdf["cells"], strict=True)]


def _products(pdf: pd.DataFrame) -> pd.DataFrame:
    """One matrix for a block of neighbouring chunks."""
    whole, *rest = _cells(pdf.sort_values("k"))
    for m in rest:
        whole = product(whole, m)
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "block": pdf["block"].iloc[:1], "rows": whole.shape[0], "cols": whole.shape[1], "cells": [whole.astype(np.int32).tobytes()]})


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Border states of a document's blocks."""
    pdf = pdf.sort_values("block")
    at = choose(_cells(pdf))
    return pd.DataFrame({"row": pdf["row"], "block": pdf["block"], "first": at[:-1], "final": at[1:]})


def _within(pdf: pd.DataFrame) -> pd.DataFrame:
    """Border states of a block's chunks, from those of the block."""
    pdf = pdf.sort_values("k")
    at = choose(_cells(pdf), int(pdf["first"].iloc[0]), int(pdf["final"].iloc[0]))
    return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "enter": at[:-1], "leave": at[1:]})


def _traces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for pdf in batches:
            got = []
            for left, text, right, k, end, a, b in zip(pdf["left"], pdf["text"], pdf["right"], pdf["k"], pdf["last"], pdf["enter"], pdf["leave"], strict=True):
                entries, exits = _borders(p, left, text, right, k, end)
                got.append(np.array(p.trace(text + right[: p.longest], 0, len(text), entries[a], exits[b]), np.int32))
            out = pdf[["row", "k"]].copy()
            out["ids"] = got
            yield out
        p.trim()

    return run


def encode(docs: DataFrame, model: str = MODEL, chunk: int = 32_768, carry: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>)`` and the carried columns: the pieces of whole texts, as the model's library gives them.

    With digests, the columns of DIGEST come in the place of the ids, made where the ids are.

    A null text has null ids, an empty one no ids. Texts of over ``chunk`` characters are cut into chunk rows, spread
    over the cluster, and encoded by the scan: matrices are multiplied by blocks of chunks, then the blocks' products; all others are encoded where they are. Repeated rows are encoded each by
    itself; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)
    own = "".join(f"`{c}` {kind[c]}, " for c in ("doc_id", *carry))
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).select("doc_id", *carry, "text").mapInPandas(_ids(model, list(carry), digests), own + (DIGEST if digests else "ids array<int>"))
    big = cut(docs.where(F.length("text") > chunk).select("doc_id", *carry, F.concat(F.lit(SPACE), F.replace(F.col("text"), F.lit(" "), F.lit(SPACE))).alias("text")).withColumn("row", F.expr("uuid()")))
    if big.isEmpty():
        return small
    # one pass over each text, whatever its length; neighbours lend the characters beyond the borders
    pieces_of = big.select("row", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("parts"))
    some = -(-SPAN // chunk)  # chunks that hold the characters lent
    before = lambda k: F.array_join(F.slice("parts", F.greatest(k - some, F.lit(0)) + 1, F.least(k, F.lit(some))), "")
    after = lambda k: F.array_join(F.slice("parts", k + 2, F.lit(some)), "")
    around = lambda x, k: F.struct(k.alias("k"), F.substring(before(k), -SPAN, SPAN).alias("left"), F.substring(after(k), 1, SPAN).alias("right"), x.alias("text"))
    chunks = pieces_of.select("row", (F.size("parts") - 1).alias("last"), F.explode(F.transform("parts", around)).alias("c")).select("row", "c.k", "last", "c.left", "c.right", "c.text")
    chunks = cut(chunks.repartition("row", "k"))
    matrices = cut(chunks.mapInPandas(_matrices(model), "row string, k int, rows int, cols int, cells binary").withColumn("block", F.floor(F.col("k") / BLOCK).cast("int")))
    blocks = matrices.groupBy("row", "block").applyInPandas(_products, "row string, block int, rows int, cols int, cells binary")
    ends = blocks.groupBy("row").applyInPandas(_between, "row string, block int, first int, final int")
    borders = matrices.join(ends, ["row", "block"]).groupBy("row", "block").applyInPandas(_within, "row string, k int, enter int, leave int")
    parts = chunks.join(borders, ["row", "k"]).mapInPandas(_traces(model), "row string, k int, ids array<int>")
    ids = parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole = big.drop("text").join(ids, "row").drop("row")
    if digests:

        def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = pieces(model)
            for pdf in batches:
                rows = [digest(p, x) for x in pdf["ids"]]
                yield pd.concat([pdf[["doc_id", *carry]], pd.DataFrame(rows, columns=["n_tokens", "n_chars", "ids_sha256", "text_sha256"], index=pdf.index)], axis=1)

        whole = whole.mapInPandas(last, own + DIGEST)
    return small.unionByName(whole)


def decode(encoded: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)`` and carried columns; null ids give null, no ids an empty text.

    Bytes that are no UTF-8 come back as U+FFFD. Repeated rows are decoded each by itself; other columns are ignored; an
    empty table gives no rows.
    """
    kind = dict(encoded.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for pdf in batches:
            out = pdf[["doc_id", *carry]].copy()
            out["text"] = [None if x is None else p.decode(x.tolist()) for x in pdf["ids"]]
            yield out

    return encoded.select("doc_id", *carry, "ids").mapInPandas(run, "".join(f"`{c}` {kind[c]}, " for c in ("doc_id", *carry)) + "text string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each whole text, digests of its ids (little-endian 32-bit) and of the text decoded from them."""
    return encode(read(spark, sf_dir, "documents"), digests=True)
