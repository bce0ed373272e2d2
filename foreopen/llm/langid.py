"""Language ID with a byte convolutional network.

Filters of 2, 3 and 4 bytes slide over windows of fixed length; each filter's largest value in the window feeds a
softmax over the languages. The network is trained in numpy on windows of labelled texts. A filter is a table of one
weight for each of its bytes, so that applying it is a few table look-ups; two neighbouring bytes are looked up at once.
A text's windows are averaged by their length in log probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.llm.common import read, small_batches

WIDTHS = (2, 3, 4)
FILTERS = 8
UNKNOWN = "und"


def train(windows: np.ndarray, labels: np.ndarray, n_classes: int, epochs: int = 12, rate: float = 0.08, seed: int = 7) -> dict:
    """Weights from windows (n, length) of bytes and labels (n,). Adagrad; only each filter's winning place learns."""
    rng = np.random.default_rng(seed)
    conv = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for table in conv:
        table[:, 0] = 0  # padding
    dense, bias = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, n_classes)).astype(np.float32), np.zeros(n_classes, np.float32)
    grads = [np.full_like(x, 1e-3) for x in (*conv, dense, bias)]
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            x, y = windows[own], labels[own]
            pooled, places = [], []
            for w, table in zip(WIDTHS, conv, strict=True):
                n = x.shape[1] - w + 1
                values = sum(table[j][x[:, j : j + n]] for j in range(w))
                places.append(values.argmax(1))
                pooled.append(np.take_along_axis(values, places[-1][:, None], 1)[:, 0])
            h = np.concatenate(pooled, 1)
            live = np.maximum(h, 0)
            z = live @ dense + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ dense.T) * (h > 0)
            steps = [np.zeros_like(t) for t in conv]
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(steps[k][j], (np.take_along_axis(x, places[k] + j, 1), np.arange(FILTERS)[None, :]), part)
                steps[k][:, 0] = 0
            for value, g, s in zip((*conv, dense, bias), grads, (*steps, live.T @ p, p.sum(0)), strict=True):
                g += s * s
                value -= rate * s / np.sqrt(g)
    return {"conv": conv, "dense": dense, "bias": bias}


def tables(net: dict) -> tuple[np.ndarray, ...]:
    """The filters over pairs of neighbouring bytes: of 2 bytes, the first two of 3, the first and last two of 4."""
    a, b, c = net["conv"]
    pair = lambda s, t: (s[:, None] + t[None, :]).reshape(65536, FILTERS)
    return pair(a[0], a[1]), pair(b[0], b[1]), b[2], pair(c[0], c[1]), pair(c[2], c[3])


def scores(net: dict, windows: np.ndarray, made: tuple | None = None) -> np.ndarray:
    """Log probabilities (n, classes) of windows (n, length)."""
    two, three, third, four, last = made or tables(net)
    out = []
    for at in range(0, len(windows), 32):
        x = np.ascontiguousarray(windows[at : at + 32].T).astype(np.int32)  # places first: the largest is taken over rows
        pairs = x[:-1] * 256 + x[1:]
        h = [two[pairs].max(0), (three[pairs[:-1]] + third[x[2:]]).max(0), (four[pairs[:-2]] + last[pairs[2:]]).max(0)]
        z = np.maximum(np.concatenate(h, 1), 0) @ net["dense"] + net["bias"]
        z -= z.max(1, keepdims=True)
        out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
    return np.concatenate(out) if out else np.zeros((0, len(net["bias"])), np.float32)


def windows_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts cut into windows, the last padded with zeros: windows, the text of each, its bytes."""
    counts = [max(1, -(-len(t) // length)) for t in texts]
    flat = b"".join(t.ljust(n * length, b"\0") for t, n in zip(texts, counts, strict=True))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int) if texts else np.zeros(0, int)
    sizes = np.minimum(length, np.maximum(1, np.array([len(t) for t in texts], int)[owner] - (np.arange(len(owner)) - first[owner]) * length))
    return np.frombuffer(flat, np.uint8).reshape(-1, length), owner, sizes


def predict(net: dict, langs: list[str], length: int, texts: list[bytes], made: tuple | None = None) -> tuple[list[str], np.ndarray]:
    if not texts:
        return [], np.zeros(0)
    total = np.zeros((len(texts), len(langs)))
    weight = np.zeros(len(texts))
    part: list[bytes] = []
    start = held = 0
    for k, t in enumerate([*texts, None]):
        if part and (t is None or held + len(t) > 1 << 20):
            w, owner, sizes = windows_of(part, length)
            np.add.at(total, owner + start, scores(net, w, made) * sizes[:, None])
            np.add.at(weight, owner + start, sizes)
            part, held, start = [], 0, k
        if t is not None:
            part.append(t)
            held += len(t)
    mean = total / weight[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [langs[i] for i in best], p[np.arange(len(best)), best]


def fit(labelled: DataFrame, length: int = 256, per_class: int = 1500, max_classes: int = 200) -> tuple[dict, list[str]] | None:
    """Train on ``(key, text, lang)``: one window of about per_class texts a language, chosen by hash.

    At most ``per_class * 2 * max_classes`` windows of ``length`` bytes reach the driver; of more than ``max_classes``
    languages the most frequent are learnt, and the others are never predicted. None if nothing is labelled.
    """
    usable = labelled.where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_classes).collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_class / n))])
    chance = (F.xxhash64(F.lit("sample"), "key").bitwiseAND((1 << 30) - 1) / float(1 << 30)).alias("chance")
    picked = usable.where(chance < F.element_at(rate, F.col("lang"))).withColumn("raw", F.col("text").cast("binary"))
    begin = F.pmod(F.xxhash64(F.lit("place"), "key"), F.greatest(F.lit(1), F.octet_length("raw") - length + 1)).cast("int") + 1
    window = F.substring("raw", begin, F.lit(length)).alias("w")
    rows = picked.select("lang", window, chance).orderBy("chance", "lang", "w").limit(2 * per_class * len(counts)).collect()
    langs = sorted(counts)
    rows.sort(key=lambda r: (r["lang"], bytes(r["w"])))
    x = np.frombuffer(b"".join(bytes(r["w"]).ljust(length, b"\0") for r in rows), np.uint8).reshape(-1, length)
    return train(x, np.array([langs.index(r["lang"]) for r in rows]), len(langs)), langs


def identify(docs: DataFrame, model: tuple[dict, list[str]] | None, length: int = 512, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, lang_pred, score)`` and the carried columns, from whole texts.

    A text that is null, empty or without a letter is ``und`` with score 0, and so is every text where there is no
    model. Repeated rows get the same answer each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = None if shared.value is None else tables(shared.value[0])
        for pdf in batches:
            out = pdf[["doc_id", *carry]].copy()
            lang, score = np.full(len(pdf), UNKNOWN, object), np.zeros(len(pdf))
            own = np.flatnonzero(pdf["letters"].to_numpy(bool))
            if made is not None and len(own):
                net, langs = shared.value
                raw = pdf["raw"]
                lang[own], score[own] = predict(net, langs, length, [raw.iloc[i] for i in own], made)
            out["lang_pred"], out["score"] = lang, score
            yield out

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    own = "".join(f"`{c}` {kind[c]}, " for c in ("doc_id", *carry))
    return docs.select("doc_id", *carry, letters.alias("letters"), F.when(letters, F.col("text")).cast("binary").alias("raw")).mapInPandas(run, own + "lang_pred string, score double")


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame) -> tuple[dict, list[str]] | None:
    """A model of the documents that aren't held out; rows without id teach nothing."""
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select(F.col("doc_id").alias("key"), "text", "lang"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
