"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed pairs of neighbouring bytes, runs of four characters with letters, capitals and digits each taken as
one, and pairs of neighbouring words known by their lengths and whether they are the same word. A truncated SVD of labelled texts' weighted terms gives the space; the labelled vectors (a bounded number) are
broadcast. Every text's cosine with all of them is computed in blocks; the nearest vote with weights that grow with
their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.llm.common import read, small_batches
from foreopen.llm.langid import held_out

PAIRS = 2048
RUNS = 2048
WORDS = 512
TERMS = PAIRS + RUNS + WORDS
_PLACE = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)


def _kinds() -> np.ndarray:
    """Sixteen kinds of bytes: letters (all bytes of other scripts among them), capitals, digits, blanks, line feeds, marks."""
    kinds = np.zeros(256, np.int64)
    for b in range(128):
        c = chr(b)
        kinds[b] = 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5 if c in ".,'" else 6 + b % 10
    return kinds


_KIND = _kinds()


def terms(text: bytes) -> np.ndarray:
    """Term weights of one whole text, each kind of unit length; zeros for fewer bytes than a term has."""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer(text, np.uint8).astype(np.int64)
    pairs, runs = np.zeros(65536), np.zeros(65536)
    for at in range(0, len(raw) - 1, 1 << 20):
        part = raw[at : at + (1 << 20) + 1]
        pairs += np.bincount(part[:-1] * 256 + part[1:], minlength=65536)
        k = _KIND[raw[at : at + (1 << 20) + 3]]
        if len(k) > 3:
            two = k[:-1] * 16 + k[1:]
            runs += np.bincount(two[:-2] * 256 + two[2:], minlength=65536)
    for first, counts, size in ((0, pairs, PAIRS), (PAIRS, runs, RUNS)):
        folded = np.sqrt(np.bincount(_PLACE, counts, minlength=size))
        norm = np.sqrt((folded**2).sum())
        if norm:
            out[first : first + size] = folded / norm
    words = text.split()
    if len(words) > 1:
        size = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 15)
        same = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, len(words) - 1)
        counts = np.sqrt(np.bincount((same * 16 + size[:-1]) * 16 + size[1:], minlength=WORDS))
        out[PAIRS + RUNS :] = counts / np.sqrt((counts**2).sum())
    return out


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.stack([terms(t) for t in texts]) if texts else np.zeros((0, TERMS), np.float32)


class Votes:
    """Labelled vectors of a latent space, and the vote of the nearest."""

    def __init__(self, texts: list[bytes], labels: list[int], dims: int = 48, nearest: int = 15, power: float = 8.0, seed: int = 11):
        x = matrix(texts)
        df = (x > 0).sum(0)
        self.weight = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
        self.nearest, self.power = nearest, power
        x = x * self.weight
        rng = np.random.default_rng(seed)
        rank = min(dims, *x.shape)
        q = np.linalg.qr(x.T @ (x @ rng.normal(size=(TERMS, rank)).astype(np.float32)))[0]
        for _ in range(3):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        self.axes = np.ascontiguousarray(q.astype(np.float32))
        self.vectors = self.project(x, weighted=True)
        self.labels = np.array(labels, np.float64)
        self.prior = float(self.labels.mean())

    def project(self, x: np.ndarray, weighted: bool = False) -> np.ndarray:
        v = (x if weighted else x * self.weight) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        out = np.empty(len(texts))
        k = min(self.nearest, len(self.labels))
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            sims = self.project(matrix(part)) @ self.vectors.T
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, top, 1), 0).astype(np.float64) ** self.power
            total = w.sum(1)
            vote = (w * self.labels[top]).sum(1) / np.maximum(total, 1e-300)
            vote[(total <= 0) | np.array([not t for t in part])] = self.prior
            out[at : at + block] = vote
        return out


def fit(texts: DataFrame, marks: DataFrame, per_label: int = 1200, max_bytes: int = 1 << 16) -> Votes | None:
    """Votes of ``(key, text)`` with ``(key, quality)``: about ``per_label`` texts of each label; None without any.

    Keys are chosen by hash from the labels alone, so that the texts, which are many, are only filtered by a broadcast of
    at most ``4 * per_label`` keys and never shuffled. Of labels that differ for one key the least counts. Texts of over
    ``max_bytes`` bytes aren't learnt from (they are scored whole, like all others).
    """
    marks = marks.where(F.col("quality").isin(0, 1) & F.col("key").isNotNull()).groupBy("key").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for q, n in counts.items() for x in (q, min(1.0, per_label / n))])
    chance = F.xxhash64(F.lit("quality"), "key").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    picked = marks.where(chance < F.element_at(rate, F.col("quality"))).orderBy("key").limit(4 * per_label)
    usable = texts.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    # of texts that share a key the least counts, so that no more rows come back than keys were picked
    rows = usable.join(F.broadcast(picked), "key").groupBy("key", "quality").agg(F.min(F.col("text").cast("binary")).alias("text")).collect()
    rows.sort(key=lambda r: r["key"])
    return Votes([bytes(r["text"]) for r in rows], [r["quality"] for r in rows]) if rows else None


def judge(docs: DataFrame, votes: Votes | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, score, predicted)`` and carried columns, from whole texts.

    A null or empty text, and every text where nothing was labelled, scores the share of label 1 learnt (0.5 if none).
    Repeated rows score alike; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)
    shared = spark.sparkContext.broadcast(votes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id", *carry]].copy()
            out["score"] = np.full(len(pdf), 0.5) if shared.value is None else np.clip(shared.value.score([t or b"" for t in pdf["raw"]]), 0, 1)
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    own = "".join(f"`{c}` {kind[c]}, " for c in ("doc_id", *carry))
    return docs.select("doc_id", *carry, F.col("text").cast("binary").alias("raw")).mapInPandas(run, own + "score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marks = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("key"), "quality")
    votes = fit(docs.select(F.col("doc_id").alias("key"), "text"), marks)
    return judge(docs, votes).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
