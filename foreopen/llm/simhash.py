"""SimHash near-dedup through segment popcounts.

A fingerprint is mapped to the bit counts of its 2-bit segments. The Manhattan distance of two such vectors never
exceeds their fingerprints' Hamming distance, so links at 3 bits are near in the grid too: of two halves of the
segments, one differs by 1 at most. Each half's vector is a grid cell; a fingerprint is looked up in its own cell and in
those one step up, which finds each pair in range from one of its ends, and found pairs are verified by exact Hamming
distance inside the join. Equal fingerprints are one node, so copies never meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreopen.llm.common import components, cut, read, small_batches

STEP = 50_000


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, as a signed long; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        hashes = [xxhash.xxh64_intdigest(whole[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        part = np.array(hashes[k : k + STEP], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _fingerprints(width: int, carry: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id", *carry]].copy()
            out["fp"] = [fingerprint(t, width) for t in pdf["raw"]]
            yield out

    return run


def fingerprints(docs: DataFrame, width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp long)`` of whole texts, and carried columns."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)
    own = "".join(f"`{c}` {kind[c]}, " for c in ("doc_id", *carry))
    return docs.select("doc_id", *carry, F.col("text").cast("binary").alias("raw")).mapInPandas(_fingerprints(width, list(carry)), own + "fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints ``(fp long)`` that differ in 3 bits or fewer."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.expr(f"cast({e} & 4294967295 as bigint)").alias("x")) for i, e in enumerate(("fp", "shiftrightunsigned(fp, 32)"))])
    cells = fps.select("fp", F.explode(sides).alias("s")).select("fp", "s.side", F.expr("s.x - (shiftright(s.x, 1) & 1431655765)").alias("cell"))
    up = F.expr("array_compact(transform(sequence(0, 15), i -> if((shiftright(cell, 2 * i) & 3) < 2, cell + shiftleft(1L, 2 * i), null)))")
    asks = cells.select(F.col("fp").alias("other"), "side", F.explode(F.concat(F.array("cell"), up)).alias("cell"))
    near = (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 3)
    pairs = cells.hint("merge").join(asks, (cells["side"] == asks["side"]) & (cells["cell"] == asks["cell"]) & near)
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, root, component_id)`` and carried columns, a row for each row.

    component_id is the smallest doc_id reachable over links of 3 bits or fewer; root is one fingerprint of the group,
    the same for all of its rows. A fingerprint asks 26 cells of each half, and cells fill in proportion to the number
    of fingerprints: about 3.6e-6 N candidates each, checked in the join and never written.

    Null, empty and blank texts have fingerprint 0 and link like any other. A row with null doc_id takes part and gets
    its group's smallest id (null if the group has no id). Repeated rows fall together. Other columns are ignored; an
    empty table gives no rows. Copies meet as one fingerprint; whole texts are read.
    """
    marks = cut(fingerprints(docs, width, carry))
    nodes = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    groups = components(links(nodes.select("fp")))
    rooted = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that a large component's join on its root can be split
    least = cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    return marks.join(cut(rooted.select("fp", "root").join(least, "root")), "fp").select("doc_id", *carry, "fp", "root", "component_id")


def one_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each group of near copies, with all of its columns: the smallest doc_id, nulls after all others.

    Rows of one id with different texts are documents of their own; of rows equal in all columns one stays. A row
    without id stays where its group has no row with one. Texts that are null or blank are one group. An empty table
    gives no rows.
    """
    rest = [c for c in docs.columns if c != "text"]
    digest = F.md5(F.concat_ws("/", F.coalesce(F.md5("text"), F.lit("null")), F.to_json(F.struct(*rest))))
    marked = docs.withColumn("_digest", digest)
    found = near_duplicates(marked.select("doc_id", "text", "_digest"), width, carry=("_digest",))
    # nulls sort first, so that a flag before the id puts them last
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("_digest").alias("_digest"))).alias("m"))
    kept = marked.join(first.select(F.col("m._digest").alias("_digest")).distinct(), "_digest", "left_semi")
    return kept.dropDuplicates(["_digest"]).drop("_digest")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
