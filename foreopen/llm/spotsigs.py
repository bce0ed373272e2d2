"""Document fingerprints: SpotSigs.

A signature is a common word (the anchor) and the next content words after it. A document's fingerprint is the set of
its signatures. Two sets of sizes m <= n can reach Jaccard t only if m >= t * n, so sets are compared within
neighbouring length classes, and only where they share a signature among their rarest ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreopen.llm.common import cut, read, small_batches

#: Anchors: articles and forms of "to be" of four languages.
ANCHORS = frozenset("the a an is was le la les un une est était der die das ein eine ist war el los las una es era".split())
#: Common words that are no content.
COMMON = ANCHORS | frozenset(
    """and of to in that it for on with as by at from be this are or not but he she they we you
    et de des du en que qui dans pour par sur au aux ce se ne pas
    und den dem des zu von mit auf für im sich auch nicht
    y de del que en por con para al lo su se no""".split()
)
WORD = re.compile(r"[^\W_]+")
CHAIN = 2
#: One word in so many is an anchor where no common word is known.
RARE = 3


def signatures(text: str, chain: int = CHAIN) -> list[int]:
    """Sorted 32-bit signature hashes of a text.

    In a text where no known anchor starts a chain (another language, say), one word in ``RARE``, by its hash, is an
    anchor, and all words are content: a changed word changes the few chains through it. A text too short for that
    too gets one signature for its whole word sequence. A text without words has none, so blank texts are all alike.
    """
    words = WORD.findall(text.lower())
    content = [w for w in words if w not in COMMON]
    found, at = set(), 0
    for w in words:
        if w in COMMON:
            if w in ANCHORS and at + chain <= len(content):
                found.add(xxhash.xxh32_intdigest(" ".join((w, *content[at : at + chain])), 0))
        else:
            at += 1
    if not found:
        for at, w in enumerate(words[: max(0, len(words) - chain)]):
            if xxhash.xxh32_intdigest(w, 2) % RARE == 0:
                found.add(xxhash.xxh32_intdigest(" ".join(words[at : at + 1 + chain]), 3))
    if not found and words:
        found.add(xxhash.xxh32_intdigest(" ".join(words), 1))
    return sorted(found)


def as_text(sigs: list[int]) -> str:
    return "".join(f"{x:08x}" for x in sigs)


def likeness(a: list[int], b: list[int], at_least: float = 0.0) -> float:
    """Jaccard of two sets; 1 for two empty ones. 0 without a comparison where lengths rule out at_least."""
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    both = len(set(a).intersection(b))
    return both / (len(a) + len(b) - both)


def edited(text: str, donor: str) -> str:
    """The last half of a text replaced by as much of the donor's beginning, or all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + donor[:n]


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """``(doc_id, sigs array<long>)`` of whole texts; a null text is empty. Other columns are ignored."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sigs": [signatures(t or "", chain) for t in pdf["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, sigs array<bigint>")


def near_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate sets as ``(a, b, likeness)`` between classes of equal fingerprints, and ``(doc_id, class)``.

    A class is named by its smallest doc_id (rows without id are left out). Sets are sorted by rarity of signature; two
    sets of Jaccard t or more share one of their first ``n - ceil(t * n) + 1`` signatures and lie in length classes
    that differ by one at most. Copies are one class, so they never pair up. An empty table gives no rows.
    """
    marks = cut(fingerprints(docs.where("doc_id is not null"), chain))
    classes = cut(marks.groupBy("sigs").agg(F.min("doc_id").alias("class")))
    member = marks.join(classes, "sigs").select("doc_id", "class")
    filled = classes.where(F.size("sigs") > 0)
    spread = filled.select("class", F.explode("sigs").alias("sig"))
    often = spread.groupBy("sig").agg(F.count("*").alias("n"))
    ranked = spread.join(often, "sig").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("r"))
    size = F.size("r")
    band = lambda n: F.floor(F.log(n.cast("double")) / -math.log(threshold) + 1e-9)
    head = ranked.select("class", F.transform("r", lambda x: x["sig"]).alias("s"), size.alias("n"), band(size).alias("band"), F.explode(F.slice(F.transform("r", lambda x: x["sig"]), 1, (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int"))).alias("sig"))
    left = head.select(F.col("class").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = head.select(F.col("class").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"), "sig", "band")
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both / (F.col("na") + F.col("nb") - both)
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9)
    pairs = left.join(right, ["sig", "band"]).where(fits).withColumn("likeness", alike).where(F.col("likeness") >= threshold - 1e-12)
    return pairs.select("a", "b", "likeness").distinct(), member


def _range_of(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted numbers are under x, by two short searches: among every m-th one, then among m."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    under = lambda array: F.aggregate(array, F.lit(0), lambda n, c: n + F.when(c < x, 1).otherwise(0))
    lits = lambda xs: F.array(*[F.lit(float(c)) for c in xs])
    coarse = under(lits([g[0] for g in groups]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * m + under(F.get(F.array(*map(lits, groups)), coarse - 1)))


def with_next(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """``(part, tail, doc_id, h, text)``: rows dealt by ranges of doc_id, each range followed by the next one's first row.

    The ranges are fixed numbers (quantiles of the ids), so that every read deals alike, and only one copy of the texts
    is shuffled. Returns the number of ranges too. Rows of a range are to be read in order of tail, doc_id, h.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(rows.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.2 / parts)))
    rows = rows.withColumn("part", _range_of(F.col("doc_id"), cuts).cast("int"))
    first = {r["part"]: r["m"] for r in rows.groupBy("part").agg(F.min("doc_id").alias("m")).collect()}  # a number for each range
    at = sorted(first)
    before = {p: at[k - 1] for k, p in enumerate(at)}  # the last range is followed by the first row of all
    if not before:
        return rows.select("part", F.lit(False).alias("tail"), "doc_id", "h", "text"), 1
    back = F.create_map(*[F.lit(x) for p, q in before.items() for x in (p, q)])
    heads = rows.where(F.col("doc_id").isin(list(first.values())))
    one = F.row_number().over(Window.partitionBy("part").orderBy("h"))
    heads = heads.withColumn("one", one).where("one = 1")
    tails = heads.select(F.element_at(back, F.col("part")).alias("part"), F.lit(True).alias("tail"), "doc_id", "h", "text")
    return rows.select("part", F.lit(False).alias("tail"), "doc_id", "h", "text").unionByName(tails), len(at)


def _row(doc_id, text: str, donor: str | None, donor_sigs: list[int] | None) -> tuple:
    sigs = signatures(text)
    changed = edited(text, donor or "")
    after = sigs if changed == text else signatures(changed)
    near_next = 0.0 if donor is None else likeness(sigs, donor_sigs if donor_sigs is not None else signatures(donor))
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(sigs), as_text(after), likeness(sigs, after), near_next


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting = None
    for pdf in batches:
        out = []
        for part, tail, doc_id, text in zip(pdf["part"], pdf["tail"], pdf["doc_id"], pdf["text"], strict=True):
            if waiting is not None:
                # ranges are contiguous: each one's last row here is the copy that follows it
                assert waiting[0] == part
                out.append(_row(waiting[1], waiting[2], text, None))
            waiting = None if tail else (part, doc_id, text)
        yield pd.DataFrame(out, columns=list(FIELDS))
    assert waiting is None


def digests(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses; the next document follows in doc_id order.

    Rows of equal doc_id follow each other in order of a hash of their text, as documents of their own. A row without
    id has no next: nothing is put in the place of its last half, and near_next is 0. A null text is empty. A single
    document is its own next. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows, n = with_next(docs, parts)
    main = rows.repartition(n, "part").sortWithinPartitions("part", "tail", "doc_id", "h").select("part", "tail", "doc_id", "text").mapInPandas(_chain, schema)

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_row(i, t or "", None, None) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)], columns=list(FIELDS))

    return main.unionByName(docs.where("doc_id is null").select("doc_id", "text").mapInPandas(alone, schema))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
