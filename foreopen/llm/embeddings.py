"""Embedding near-dedup by NN-descent over cells.

Vectors that lie within half the threshold's angle of a common centre are one cell: all of them link with each other, so
a tight crowd of near copies is counted without forming its pairs. Looser crowds become cells around one vector with
which all others link. Cells (mostly single vectors) are the nodes of a neighbour graph. A first graph comes from random hyperplanes; rounds of neighbours-of-neighbours joins refine it. A cell's list
that is full of cells in reach may hide more: such lists are enlarged, and their joins repeated, until none is full.
Of two cells in reach either all members link, by the triangle inequality, or their members are compared in blocks that
give counts. A bounded sample of vectors is compared with all rows: the measured recall decides on further attempts, and
a result under the target is an error. Equal vectors are one node with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreopen.llm.common import components, cut, forget, read

WINDOW = 192
TILE = 512
#: Cells of one batch are formed among so many rows.
BATCH = 1024
#: Lists of so few rows, those who ask included, are met many at once.
SMALL = 64
#: Angles this near to a limit are decided by comparing members.
MARGIN = 1e-5
EDGE = "u bigint, v bigint, gap double"
BALL = "node bigint, space string, weight bigint, vec array<float>, radius double"


def unit(vectors) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch's rows by their vectors' length, and those at unit length in double precision as one matrix."""
    size = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        own = batch if (size == dim).all() else batch.filter(pa.array(size == dim))
        x = own.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(dim))
        yield own, x / np.linalg.norm(x, axis=1, keepdims=True)


def edges_of(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Edges ``(u, v, gap)`` in pieces, as one batch."""
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["u", "v", "gap"])


def foremost(row: np.ndarray, gap: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least gaps of each row."""
    order = np.lexsort((gap, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def pairs_of(a: tuple, b: tuple, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``(u, v, gap)`` from each row of a to its k nearest rows of b, at cosine ``least`` or more, no farther than worst.

    A side is (node, unit vectors, radius, worst). The gap of two cells is their centres' angle less both radii; an edge
    worse than all that both ends have already is left out.
    """
    node, x, radius, worst = a
    other, y, r2, worst2 = b
    s = x @ y.T
    i, j = np.nonzero((s >= least) & (node[:, None] != other[None, :]))
    gap = angle(s[i, j]) - radius[i] - r2[j]
    use = gap < np.maximum(worst[i], worst2[j])
    i, j, gap = i[use], j[use], gap[use]
    top = foremost(i, gap, k)
    return node[i[top]], other[j[top]], gap[top]


def pairs_of_small(side: tuple, starts: np.ndarray, sizes: np.ndarray, listed: np.ndarray, own: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pairs_of`` for many short lists at once: list g's rows follow starts[g], the first listed[g] of its sizes[g] are the list.

    Those after meet the list; where ``own``, it meets itself too.
    """
    node, x, radius, worst = side
    at = np.arange(sizes.max())
    rows = np.minimum(starts[:, None] + at, (starts + sizes - 1)[:, None])
    to = rows[:, : listed.max()]
    s = x[rows] @ x[to].transpose(0, 2, 1)
    asks = (at < sizes[:, None]) & (own[:, None] | (at >= listed[:, None]))
    g, i, j = np.nonzero((s >= least) & asks[:, :, None] & (at[: to.shape[1]] < listed[:, None])[:, None, :] & (node[rows][:, :, None] != node[to][:, None, :]))
    u, v = rows[g, i], to[g, j]
    gap = angle(s[g, i, j]) - radius[u] - radius[v]
    use = gap < np.maximum(worst[u], worst[v])
    u, v, gap = u[use], v[use], gap[use]
    top = foremost(u, gap, k)
    return node[u[top]], node[v[top]], gap[top]


def side_of(pdf: pd.DataFrame) -> tuple:
    worst = pdf["worst"].to_numpy(float) if "worst" in pdf else np.full(len(pdf), np.inf)
    return pdf["node"].to_numpy(), unit(pdf["vec"]), pdf["radius"].to_numpy(float), np.where(np.isnan(worst), np.inf, worst)


def usable() -> Column:
    """Whether a row can link: label given, every component finite, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))


def in_order(balls: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Every row once a table, dealt and sorted by the sides of random hyperplanes it lies on and one more projection."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for own, x in by_length(batch):
                dim = x.shape[1]
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).normal(size=(dim, tables, bits + 1))
                side = (x @ planes[dim].reshape(dim, -1)).reshape(len(x), tables, bits + 1)
                code = ((side[:, :, :bits] > 0) << np.arange(bits)).sum(2)
                for t in range(tables):
                    more = [pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, t].astype(np.int64)), pa.array(side[:, t, bits])]
                    yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, "t", "code", "place"])

    n = int(balls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = balls.select("node", "space", "weight", "vec", "radius").mapInArrow(keys, f"{BALL}, t int, code bigint, place double")
    return spread.repartitionByRange(n, "space", "t", "code", "place").sortWithinPartitions("space", "t", "code", "place")


def gather(rows: pd.DataFrame, theta: float, tight: bool) -> list[tuple]:
    """Cells of some rows of one space: ``(node, space, weight, vec, radius, members)``.

    The row with the most others in reach goes first. A tight cell holds what lies within theta / 2 of the common mean,
    so that all of its vectors link; a loose one what surely links with all of the first row.
    """
    node, x, radius, _ = side_of(rows)
    weight, vecs, space = rows["weight"].to_numpy(np.int64), rows["vec"].tolist(), rows["space"].iloc[0]
    near = x @ x.T
    near = near >= math.cos(theta) if tight else near >= np.cos(np.clip(theta - MARGIN - radius[:, None] - radius[None, :], 0, math.pi))
    near |= np.eye(len(node), dtype=bool)
    free = np.ones(len(node), bool)
    degree = near.sum(1)
    out = []
    for i in np.argsort(-degree, kind="stable"):
        if not free[i]:
            continue
        own = np.flatnonzero(near[i] & free) if degree[i] > 1 else np.array([i])
        if len(own) > 1:
            centre = (x[own] * weight[own, None]).sum(0).astype(np.float32) if tight else np.asarray(vecs[i], np.float32)
            c = centre.astype(np.float64)
            size = np.linalg.norm(c)
            far = angle(x[own] @ (c / size)) + radius[own] if size else np.full(len(own), np.inf)
            inside = far <= theta / 2 - MARGIN if tight else np.ones(len(own), bool)
            if inside.sum() > 1:
                kept = own[inside]
                free[kept] = False
                out.append((int(node[kept].min()), space, int(weight[kept].sum()), centre, float(far[inside].max()), node[kept]))
            if not free[i]:
                continue
        free[i] = False
        out.append((int(node[i]), space, int(weight[i]), np.asarray(vecs[i], np.float32), float(radius[i]), node[i : i + 1]))
    return out


def cells(nodes: DataFrame, theta: float, bits: int, passes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Cells of the nodes (as nodes with a radius), and ``(member, node)``: which node lies in which cell.

    Each pass forms cells among neighbours in one hyperplane order, then cells of cells in another; the last one forms
    loose ones. The radius is a bound by the triangle inequality. A cell is connected by its own links. Any division
    into such cells gives the same links; passes only make them larger.
    """
    tight = [turn < passes for turn in range(passes + 1)]

    def form(narrow: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["node", "space", "weight", "vec", "radius", "members"]
            for pdf in batches:
                for at in range(0, len(pdf), BATCH):
                    part = pdf.iloc[at : at + BATCH]
                    yield pd.DataFrame([c for _, own in part.groupby("space", sort=False) for c in gather(own, theta, narrow)], columns=names)

        return run

    balls, home = nodes.select("node", "space", "weight", "vec", F.lit(0.0).alias("radius")), None
    for turn, narrow in enumerate(tight):
        made = cut(in_order(balls, 1, bits, seed + turn).select(*[c.split()[0] for c in BALL.split(", ")]).mapInPandas(form(narrow), f"{BALL}, members array<bigint>"))
        step = made.select(F.explode("members").alias("member"), "node")
        home = step if home is None else home.join(step.select(F.col("member").alias("node"), F.col("node").alias("to")), "node").select("member", F.col("to").alias("node"))
        balls = made.drop("members")
    return balls, cut(home)


def first_graph(balls: DataFrame, tables: int, bits: int, k: int, least: float, seed: int) -> DataFrame:
    """Edges among cells that lie next to each other in random hyperplane orders."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for own, x in by_length(batch):
                node, radius, t, space = (own.column(c).to_numpy(zero_copy_only=False) for c in ("node", "radius", "t", "space"))
                found = []
                for at in range(0, len(node), WINDOW // 2):
                    both, old = [c[at : at + WINDOW // 2] for c in (node, x, radius, t, space)], 0
                    if held is not None and held[1].shape[1] == x.shape[1]:
                        both, old = [np.concatenate(c) for c in zip(held, both, strict=True)], len(held[0])
                    held = [c[-(WINDOW // 2) :] for c in both]
                    far = np.full(len(both[0]), np.inf)
                    side = lambda a, b, both=both, far=far: (both[0][a:b], both[1][a:b], both[2][a:b], far[a:b])
                    ends = np.flatnonzero((both[3][1:] != both[3][:-1]) | (both[4][1:] != both[4][:-1])) + 1
                    for a, b in zip([0, *ends], [*ends, len(far)], strict=True):
                        # those held have met each other
                        new = max(a, old)
                        if new < b:
                            found.append(pairs_of(side(new, b), side(a, b), k, least))
                        if a < new < b:
                            found.append(pairs_of(side(a, new), side(new, b), k, least))
                yield from edges_of(found)

    return in_order(balls, tables, bits, seed).select("node", "space", "vec", "radius", "t").mapInArrow(near, EDGE)


def nearest(edges: DataFrame, wide: DataFrame | None, k: int) -> DataFrame:
    """Each cell's best edges, of both directions: k, or as many as its enlarged list ``(node, most)`` holds.

    ``worst`` is a full list's largest gap, null for one that holds more yet.
    """
    edges = edges.select("u", "v", "gap")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "gap")).groupBy("u", "v").agg(F.min("gap").alias("gap"))
    order = Window.partitionBy("u").orderBy("gap", "v")
    ranked = both.withColumn("r", F.row_number().over(order))
    most = F.lit(k)
    if wide is not None:
        ranked, most = ranked.join(wide.withColumnRenamed("node", "u"), "u", "left"), F.coalesce("most", F.lit(k))
    return ranked.where(F.col("r") <= most).select("u", "v", "gap", F.when(F.col("r") == most, F.col("gap")).alias("worst"))


def refine(graph: DataFrame, balls: DataFrame, wide: DataFrame | None, k: int, least: float, asks: DataFrame | None = None) -> DataFrame:
    """One round of neighbours of neighbours: every cell's list meets itself, and those that have the cell in their lists.

    asks ``(via, node)`` takes the place of the latter, and lists don't meet themselves then. Who asks a much-listed
    cell is dealt over several tasks, each with the whole list; a list is met in a stream, whoever asks.
    """

    among = asks is None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for own, x in by_length(batch):
                rows = [own.column(c).to_numpy(zero_copy_only=False) for c in ("via", "part", "asks", "node", "radius", "worst")] + [x]
                if x.shape[1] in held:
                    rows = [np.concatenate(c) for c in zip(held[x.shape[1]], rows, strict=True)]
                via, part = rows[:2]
                whole = int(np.argmax((via == via[-1]) & (part == part[-1])))  # the last list may go on
                held[x.shape[1]] = [c[whole:].copy() for c in rows]
                yield from lists([c[:whole] for c in rows])
        for rows in held.values():
            yield from lists(rows)

    def lists(rows: list) -> Iterator[pa.RecordBatch]:
        via, part, asks, node, radius, worst, x = rows
        if not len(via):
            return
        worst = worst.astype(float)
        whole = (node, x, radius, np.where(np.isnan(worst), np.inf, worst))
        starts = np.concatenate([[0], np.flatnonzero((via[1:] != via[:-1]) | (part[1:] != part[:-1])) + 1])
        sizes = np.diff(np.append(starts, len(via)))
        listed = np.add.reduceat(~asks.astype(bool), starts, dtype=np.int64)
        own = (part[starts] == 0) if among else np.zeros(len(starts), bool)
        used = (listed > 0) & (own | (sizes > listed))
        small = np.flatnonzero(used & (sizes <= SMALL))
        small, found = small[np.argsort(sizes[small], kind="stable")], []
        for at in range(0, len(small), 4 * SMALL):
            g = small[at : at + 4 * SMALL]
            found.append(pairs_of_small(whole, starts[g], sizes[g], listed[g], own[g], k if among else SMALL, least))
        yield from edges_of(found)
        for g in np.flatnonzero(used & (sizes > SMALL)):
            first, middle, end = starts[g], starts[g] + listed[g], starts[g] + sizes[g]
            y = tuple(c[first:middle] for c in whole)
            for at in range(first if own[g] else middle, end, TILE):
                yield from edges_of([pairs_of(tuple(c[at : min(at + TILE, end)] for c in whole), y, k if among else len(y[0]), least)])

    known = balls.select("node", "vec", "radius").join(graph.where("worst is not null").select(F.col("u").alias("node"), "worst"), "node", "left")
    listed = graph.select(F.col("u").alias("via"), F.col("v").alias("node"))
    listed = listed.union(listed.select("via", F.col("via").alias("node")).distinct())
    back = graph.select(F.col("v").alias("via"), F.col("u").alias("node")) if among else asks
    parts = cut(back.groupBy("via").agg(F.ceil(F.count("*") / (4 * TILE)).cast("int").alias("parts")))
    back = back.join(parts, "via").select("via", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"), "node")
    listed = listed.join(parts, "via", "left" if among else "inner").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    rows = listed.select("via", "part", F.lit(False).alias("asks"), "node").union(back).join(known, "node")
    met = rows.select("via", "part", "asks", "node", "vec", "radius", "worst").repartition("via", "part").sortWithinPartitions("via", "part", "asks", "node")
    return nearest(graph.select("u", "v", "gap").unionByName(met.mapInArrow(meet, EDGE)), wide, k)


def enlarge(graph: DataFrame, balls: DataFrame, k: int, least: float, reach: float, rounds: int = 8) -> DataFrame:
    """The graph with every list that is full of cells in reach made four times as long, until no list is full.

    A full list's owner asks some of its neighbours for their whole lists, others every round, until nothing new in
    reach turns up; only then are lists looked over again.
    """
    wide, size = None, F.lit(k)
    near = F.count_if(F.col("gap") <= reach + MARGIN)
    for turn in range(64):
        state = graph.groupBy(F.col("u").alias("node")).agg(F.count("worst").alias("at_end"), F.max("worst").alias("worst"))
        state = state.where((F.col("at_end") > 0) & (F.col("worst") <= reach + MARGIN))
        if wide is not None:
            state, size = state.join(wide, "node", "left"), F.coalesce("most", F.lit(k))
        full = cut(state.select("node", (4 * size).cast("int").alias("more")))
        if full.isEmpty():
            return graph
        wide = cut(full.withColumnRenamed("more", "most") if wide is None else wide.join(full, "node", "full").select("node", F.coalesce("more", "most").alias("most")))
        found = graph.agg(near).first()[0]
        for r in range(rounds):
            own = graph.join(full.select(F.col("node").alias("u")), "u", "left_semi")
            pick = Window.partitionBy("u").orderBy(F.xxhash64(F.lit(turn * rounds + r), "u", "v"))
            asks = own.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= k).select(F.col("v").alias("via"), F.col("u").alias("node"))
            after = cut(refine(graph, balls, wide, k, least, asks))
            forget(graph)
            graph, before = after, found
            found = graph.agg(near).first()[0]
            if found == before:
                break
    raise RuntimeError("neighbour lists did not settle")


def counted(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``(member, a, b, links)`` of cell pairs ``(a, b)``, both directions given, by comparing members in blocks.

    members: ``(member, node, weight, vec)``. A block is at most about TILE members against 4 * TILE others, so that no
    cell is one task's work and only counts come out.
    """
    sizes = cut(members.groupBy("node").agg(F.count("*").alias("n")))
    asked = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").groupBy("b").agg(F.sum("na").alias("asks"))
    plan = cut(asked.join(sizes.withColumnRenamed("node", "b"), "b").select("b", F.ceil(F.col("n") / TILE).cast("int").alias("rows"), F.ceil(F.col("asks") / (4 * TILE)).cast("int").alias("cols")))
    own = members.withColumnRenamed("node", "b").join(plan, "b")
    own = own.select("b", F.pmod(F.xxhash64("member"), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(None).cast("bigint").alias("a"), "member", "weight", "vec")
    ask = pairs.join(members.withColumnRenamed("node", "a"), "a").join(plan, "b")
    ask = ask.select("b", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("member"), F.col("cols")).cast("int").alias("j"), "a", "member", "weight", "vec")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["a"].notna().to_numpy()
        q, own = pdf[asks], pdf[~asks]
        if not len(q) or not len(own):
            return pd.DataFrame({"member": np.empty(0, np.int64), "a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        hit = unit(q["vec"]) @ unit(own["vec"]).T >= threshold
        hit = (hit & (q["member"].to_numpy()[:, None] != own["member"].to_numpy()[None, :])) @ own["weight"].to_numpy(np.int64)
        return pd.DataFrame({"member": q["member"], "a": q["a"].astype("int64"), "b": pdf["b"].iloc[0], "links": hit})[hit > 0]

    return own.unionByName(ask).groupBy("b", "i", "j").applyInPandas(count, "member bigint, a bigint, b bigint, links bigint")


def resolve(graph: DataFrame, balls: DataFrame, home: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``(node, links, component_id)`` of all nodes; links: the weight of other nodes linked directly."""
    theta = math.acos(threshold)
    size = balls.select("node", "radius", "weight")
    near = graph.where(F.col("gap") <= theta + MARGIN).select("u", "v", "gap")
    near = near.union(near.select("v", "u", "gap")).toDF("a", "b", "gap").groupBy("a", "b").agg(F.min("gap").alias("gap"))
    near = near.join(size.toDF("a", "ra", "wa"), "a").join(size.toDF("b", "rb", "wb"), "b")
    # gap: angle less radii; no member's angle is over gap plus twice the radii
    near = cut(near.withColumn("sure", F.col("gap") + 2 * (F.col("ra") + F.col("rb")) <= theta - MARGIN).select("a", "b", "wb", "sure"))
    members = home.join(nodes.select(F.col("node").alias("member"), "weight", "vec"), "member")
    loose = F.col("radius") > theta / 2 - MARGIN / 2
    unsure = near.where(~F.col("sure")).select("a", "b").union(balls.where(loose).select("node", "node"))
    unsure = cut(counted(members, unsure, threshold))
    linked = near.where("sure").select("a", "b").union(unsure.select("a", "b")).distinct()
    roots = components(linked)
    of_cell = near.where("sure").groupBy(F.col("a").alias("node")).agg(F.sum("wb").alias("sure"))
    of_member = unsure.groupBy("member").agg(F.sum("links").alias("more"))
    rooted = cut(balls.select("node", F.when(loose, 0).otherwise(F.col("weight")).alias("whole")).join(of_cell, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    each = cut(home.join(rooted, "node").join(of_member, "member", "left").join(nodes.select(F.col("node").alias("member"), "weight", "least_id"), "member"))
    least = cut(each.groupBy("root").agg(F.min("least_id").alias("component_id")))  # written, so that a large component's join can be split
    links = F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0)) + F.when(F.col("whole") > 0, F.col("whole") - F.col("weight")).otherwise(0)
    return each.join(least, "root").select(F.col("member").alias("node"), links.cast("long").alias("links"), "component_id")


def exact_counts(nodes: DataFrame, sample: list, threshold: float) -> dict[int, int]:
    """Links of a bounded sample of nodes, by comparing them with every row."""
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], r["space"], list(r["vec"])) for r in sample])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = {}
        for node, space, vec in shared.value:
            asked.setdefault(space, []).append((node, vec))
        asked = {s: (np.array([n for n, _ in q]), unit([v for _, v in q])) for s, q in asked.items()}
        for pdf in batches:
            for space, own in pdf.groupby("space"):
                if space in asked:
                    ids, q = asked[space]
                    hit = (q @ unit(own["vec"]).T >= threshold) & (ids[:, None] != own["node"].to_numpy()[None, :])
                    yield pd.DataFrame({"node": ids, "links": hit @ own["weight"].to_numpy()})

    got = nodes.select("node", "space", "weight", "vec").mapInPandas(count, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    return {r["node"]: r["links"] for r in got.collect()}


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    k: int = 12,
    least: float = 0.5,
    tables: int = 12,
    rounds: int = 4,
    audit: int = 256,
    recall: float = 0.999,
    attempts: int = 3,
    passes: int = 2,
    seed: int = 5,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: links between vectors of one label at cosine ``threshold`` or more.

    Rows whose vec_id, label or vector is null, empty, zero or not finite link with nothing (component_id is their own
    vec_id); vectors of different length don't link. Equal vectors link with each other. One row comes back for each
    row: rows that share a vec_id are vectors of their own, whose links are counted each by itself. Other columns are
    ignored; an empty table gives no rows. ``tables`` hyperplane orders are made an attempt; ``audit`` vectors are
    compared with all, and RuntimeError is raised where less than ``recall`` of their links was found in every attempt.
    """
    given = vectors.select("vec_id", "label", "embedding")
    rows = cut(given.where(usable()).select("vec_id", F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("space"), F.col("embedding").cast("array<float>").alias("vec"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")))
    copies = ["space", "h1", "h2"]
    # a key of its own for every vector, fixed by being written
    nodes = cut(rows.groupBy(*copies).agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()))
    n, spaces = nodes.agg(F.count("*"), F.count_distinct("space")).first()
    if n:
        found = _search(nodes, n / spaces, threshold, k, least, tables, rounds, audit, recall, attempts, passes, seed)
        out = rows.select("vec_id", *copies).join(nodes.select("node", "weight", *copies), copies).join(found, "node").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    else:
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    other = given.where(~usable())
    out = out.unionByName(other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _search(nodes, dense, threshold, k, least, tables, rounds, audit, recall, attempts, passes, seed) -> DataFrame:
    theta = math.acos(threshold)
    bits = max(0, min(40, round(math.log2(max(1.0, dense / 64)))))
    balls, home = cells(nodes, theta, max(0, bits - 3), passes, seed + 100)
    graph, share = None, 0.0
    for attempt in range(attempts):
        fresh = nearest(first_graph(balls, tables, bits, k, least, seed + attempt), None, k)
        graph = cut(fresh if graph is None else nearest(graph.unionByName(fresh), None, k))
        for _ in range(rounds):
            after = cut(refine(graph, balls, None, k, least))
            new = after.join(graph, ["u", "v"], "left_anti").count()
            forget(graph)
            graph = after
            if new <= 0.001 * max(1, graph.count()):
                break
        graph = enlarge(graph, balls, k, least, theta)
        found = cut(resolve(graph, balls, home, nodes, threshold))
        share = audited(nodes, found, threshold, audit, seed)
        if share >= recall:
            return found
    raise RuntimeError(f"only {share:.4f} of the sampled vectors' links were found")


def audited(nodes: DataFrame, found: DataFrame, threshold: float, audit: int, seed: int) -> float:
    """The share of a bounded sample's links that were found; half of the sample is of vectors known to have links."""
    by_hash = [F.xxhash64(F.lit(seed), "node"), "node"]
    some = nodes.select("node").orderBy(*by_hash).limit(audit // 2).union(found.where("links > 0").select("node").orderBy(*by_hash).limit(audit // 2)).distinct()
    asked = [r["node"] for r in some.collect()]
    truth = exact_counts(nodes, nodes.where(F.col("node").isin(asked)).select("node", "space", "vec").collect(), threshold)
    own = {r["node"]: r["links"] for r in found.where(F.col("node").isin(asked)).select("node", "links").collect()}
    every = sum(truth.values())
    return sum(min(own.get(x, 0), t) for x, t in truth.items()) / every if every else 1.0


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as node, vec_id as c from embeddings union select l.v, r.c from r join l on l.u = r.node)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e join (select node, min(c) as c from r group by node) m on m.node = e.vec_id
left join (select u, count(*) as n from l group by u) n on n.u = e.vec_id
"""
