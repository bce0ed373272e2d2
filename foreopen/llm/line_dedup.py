"""Line dedup with a once-seen and a twice-seen Bloom filter.

Pass 1 reads every text and marks the hashes of its lines in two filters: bits that one document set, and bits that a
second document set again. The filters are sized by the number of lines. Up to a stated size the twice-seen filter is
broadcast, and pass 2 emits only lines whose bits are all twice-seen. A larger one stays divided by hash: each part
meets the hashes that belong to it, and only documents with suspects are read again. Suspects alone are shuffled, counted
exactly by their text, and resolved to the document that keeps them. The filter's size decides how many lines are
suspects, never the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.llm.common import ASCII_SPACE, cut, forget, read, small_batches

SHARDS = 64
#: Filter bits for each line: about one line in a hundred is a suspect by chance.
PER_LINE = 16
LEAST_BITS = 1 << 20


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(ASCII_SPACE).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def positions(h: np.ndarray, bits: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard and two bit positions within the shard of each hash; bits: of one shard, 2**24 at most."""
    return ((h >> np.uint64(48)) % np.uint64(shards)).astype(np.int64), (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)


def layout(filter_bits: int) -> tuple[int, int]:
    """Bits of a shard, and shards, of a filter: SHARDS of them, or as many as 2**24 bits each need."""
    bits = max(8, min(1 << 24, filter_bits // SHARDS))
    return bits, max(SHARDS, filter_bits // bits)


def bits_for(lines: int) -> int:
    """A power of two of at least PER_LINE bits a line."""
    return max(LEAST_BITS, 1 << (PER_LINE * max(1, lines) - 1).bit_length())


def doc_hashes(text: bytes | None, min_chars: int) -> np.ndarray:
    keys = {k for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, min_chars)}
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _mark(min_chars: int, bits: int, shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice, held = np.empty(0, np.uint64), np.empty(0, np.uint64), []

        def fold():
            nonlocal once, twice, held
            h, n = np.unique(np.concatenate([once, *held]), return_counts=True)
            twice, once, held = np.union1d(twice, h[n > 1]), h, []

        size = 0
        for pdf in batches:
            for text in pdf["text"]:
                held.append(doc_hashes(text, min_chars))
                size += len(held[-1])
            if size > 500_000:
                fold()
                size = 0
        fold()
        both = np.concatenate([once, twice])
        again = np.concatenate([np.zeros(len(once), bool), np.ones(len(twice), bool)])
        shard, p, q = positions(both, bits, shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for s in np.unique(shard):
            own = order[ends[s] : ends[s + 1]]
            if len(own):
                a = again[own]
                rows.append((int(s), np.stack([p[own[~a]], q[own[~a]]]).astype(np.uint32).tobytes(), np.stack([p[own[a]], q[own[a]]]).astype(np.uint32).tobytes()))
        yield pd.DataFrame(rows, columns=["shard", "once", "twice"])

    return run


def _merge(bits: int):
    """Filters of a shard from its parts, in a stream: memory is two bit maps for each shard of the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for s, o, t in zip(pdf["shard"], pdf["once"], pdf["twice"], strict=True):
                once, twice = maps.setdefault(s, (np.zeros(bits, bool), np.zeros(bits, bool)))
                o, t = np.frombuffer(o, np.uint32), np.frombuffer(t, np.uint32)
                twice[o[once[o]]] = True
                once[o] = True
                twice[t] = True
        yield pd.DataFrame([(s, zlib.compress(np.packbits(t).tobytes(), 1)) for s, (_, t) in maps.items()], columns=["shard", "twice"])

    return run


def _suspects(shared, min_chars: int, bits: int, shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice = {s: np.frombuffer(zlib.decompress(z), np.uint8) for s, z in shared.value.items()}
        full = np.zeros((shards, bits // 8), np.uint8)
        for s, m in twice.items():
            full[s] = m
        for pdf in batches:
            keys, owner = [], []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = {k for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, min_chars)}
                keys += own
                owner += [i] * len(own)
            if not keys:
                continue
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            shard, p, q = positions(h, bits, shards)
            hit = (full[shard, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & (full[shard, q >> 3] >> (7 - (q & 7)).astype(np.uint8)) & 1
            own = np.flatnonzero(hit)
            yield pd.DataFrame({"doc_id": [owner[i] for i in own], "key": [keys[i] for i in own]})

    return run


def _kept(pdf: pd.DataFrame, carry: list[str], stays) -> pd.DataFrame:
    """Rows with the lines that stay; ``stays(row number, keys)`` tells which."""
    n, gone, kept = [], [], []
    for at, text in enumerate(pdf["text"]):
        lines = (text or b"").split(b"\n")
        stay = stays(at, lines)
        n.append(len(lines))
        gone.append(len(lines) - len(stay))
        kept.append(b"\n".join(stay))
    out = pdf[["doc_id", *carry]].copy()
    out["text"], out["n_lines"], out["n_dropped"] = kept, n, gone
    return out


def _drop(carry: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = [set() if d is None else set(d) for d in pdf["drop"]]
            yield _kept(pdf, carry, lambda at, lines: [x for x in lines if line_key(x) not in bad[at]] if bad[at] else lines)  # noqa: B023

    return run


def _drop_known(shared, carry: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = shared.value
        for pdf in batches:
            ids = [None if pd.isna(i) else i for i in pdf["doc_id"]]

            def stays(at: int, lines: list[bytes]) -> list[bytes]:
                own = ids[at]  # noqa: B023
                return lines if own is None or not keep else [x for x in lines if keep.get(line_key(x), own) == own]

            yield _kept(pdf, carry, stays)

    return run


def _asks(min_chars: int, bits: int, shards: int):
    """The hashes of a batch's lines by shard, as rows of numbers: of the document in the batch, and of the line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [doc_hashes(t, min_chars) for t in pdf["text"]]
            ids = pdf["doc_id"].to_numpy()
            owner = np.repeat(np.arange(len(each)), list(map(len, each)))
            h = np.concatenate([np.empty(0, np.uint64), *each])
            shard = positions(h, bits, shards)[0]
            order = np.argsort(shard, kind="stable")
            found, first = np.unique(shard[order], return_index=True)
            for s, own in zip(found, np.split(order, first[1:]), strict=True):
                yield pd.DataFrame({"shard": [int(s)], "ids": [ids[owner[own]]], "hashes": [h[own].astype("<u8").tobytes()]})

    return run


def _tested(bits: int, shards: int):
    """Suspects ``(doc_id, h)`` of a shard: its filter comes first, then the hashes that ask it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, full = None, np.zeros(0, np.uint8)
        for pdf in batches:
            for s, twice, ids, hashes in zip(pdf["shard"], pdf["twice"], pdf["ids"], pdf["hashes"], strict=True):
                if twice is not None:
                    here, full = s, np.frombuffer(zlib.decompress(twice), np.uint8)
                    continue
                assert s == here
                h = np.frombuffer(hashes, "<u8")
                _, p, q = positions(h, bits, shards)
                hit = (full[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & (full[q >> 3] >> (7 - (q & 7)).astype(np.uint8)) & 1
                own = np.flatnonzero(hit)
                yield pd.DataFrame({"doc_id": np.asarray(ids)[own], "h": h[own].view(np.int64)})

    return run


def _named(min_chars: int):
    """The keys of a document's lines that have one of the hashes suspected of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, hashes in zip(pdf["doc_id"], pdf["text"], pdf["hs"], strict=True):
                wanted = set(np.asarray(hashes, np.int64).view(np.uint64).tolist())
                keys = {k for k in map(line_key, (text or b"").split(b"\n")) if long_enough(k, min_chars)}
                out += [(i, k) for k in keys if xxhash.xxh3_64_intdigest(k) in wanted]
            yield pd.DataFrame(out, columns=["doc_id", "key"])

    return run


def twice_seen(docs: DataFrame, min_chars: int, bits: int, shards: int) -> DataFrame:
    """The twice-seen filter of ``(text binary)`` as ``(shard, twice)``: a compressed bit map for each shard."""
    parts = docs.select("text").mapInPandas(_mark(min_chars, bits, shards), "shard int, once binary, twice binary")
    return parts.repartition(shards, "shard").mapInPandas(_merge(bits), "shard int, twice binary")


def suspects(docs: DataFrame, min_chars: int, filter_bits: int, broadcast_bits: int) -> DataFrame:
    """``(doc_id, key)`` of lines whose bits are all twice-seen, each once a row of ``(doc_id, text binary)``."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    bits, shards = layout(filter_bits)
    filters = twice_seen(docs, min_chars, bits, shards)
    if bits * shards <= broadcast_bits:
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["twice"]) for r in filters.collect()})
        return docs.mapInPandas(_suspects(shared, min_chars, bits, shards), f"doc_id {kind}, key binary")
    asks = docs.mapInPandas(_asks(min_chars, bits, shards), f"shard int, ids array<{kind}>, hashes binary")
    rows = filters.withColumns({"asks": F.lit(False), "ids": F.lit(None).cast(f"array<{kind}>"), "hashes": F.lit(None).cast("binary")})
    rows = rows.unionByName(asks.withColumns({"asks": F.lit(True), "twice": F.lit(None).cast("binary")}))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "asks").select("shard", "twice", "ids", "hashes")
    hit = rows.mapInPandas(_tested(bits, shards), f"doc_id {kind}, h bigint").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    return docs.join(hit, "doc_id").mapInPandas(_named(min_chars), f"doc_id {kind}, key binary")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, filter_bits: int | None = None, broadcast_bits: int = 1 << 29, broadcast_known: int = 1 << 25, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines that repeat in ``min_docs`` documents or more, but for those of the largest doc_id holding them.

    Reads ``doc_id, text`` (and the columns named in carry); returns them with the text that stays, ``n_lines`` (before)
    and ``n_dropped``. A null text counts as one empty line and comes back empty. Rows with equal doc_id are one document.
    A null doc_id is no document to count: its lines stay. Other columns are ignored. An empty table gives no rows.

    The filter has 16 bits a line (or ``filter_bits``) and is broadcast up to ``broadcast_bits``. Lines found to repeat
    are broadcast where they are ``broadcast_known`` bytes at most, and texts aren't shuffled then; else each document
    is joined with the lines it loses. The result is the same either way.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    bytes_of = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *carry)
    own = bytes_of.where("doc_id is not null").select("doc_id", "text")
    if filter_bits is None:
        lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
        filter_bits = bits_for(lines or 0)
    found = cut(suspects(own, min_chars, filter_bits, broadcast_bits))
    known = found.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    # written, so that both sides of the join are plain exchanges, which adaptive execution splits where a line is common
    known = cut(known.select("key", "keep"))
    types = "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in carry)
    schema = f"doc_id {kind}{types}, text binary, n_lines bigint, n_dropped bigint"
    if (known.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0) <= broadcast_known:
        shared = spark.sparkContext.broadcast({bytes(r["key"]): r["keep"] for r in known.collect()})
        forget(found)
        out = bytes_of.mapInPandas(_drop_known(shared, list(carry)), schema)
    else:
        drops = found.join(known, "key").where("doc_id <> keep").groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
        out = bytes_of.join(drops, "doc_id", "left").mapInPandas(_drop(list(carry)), schema)
    return out.withColumn("text", F.col("text").cast("string"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_TRIM = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ORACLE = f"""
with lines as (
  select doc_id, i, line, translate({_TRIM}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents) a) b),
bad as (select k, max(doc_id) as keep from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select l.doc_id, l.i, l.line, b.keep is not null and b.keep <> l.doc_id as gone from lines l left join bad b on l.k = b.k)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
