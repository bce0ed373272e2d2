"""The operators against brute force, the library they must equal, and held-out labels, on the smallest data."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from foreopen import llm
from foreopen.llm import embeddings, langid, line_dedup, mixing, pieces, quality, simhash, spotsigs, token_counts, urls
from foreopen.llm.common import components
from tests.conftest import same


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, data, duck, name):
    same(llm.queries()[name](spark, data), duck, llm.oracle_sql()[name])


def closure(ids, links):
    low = {i: i for i in ids}
    while True:
        new = {i: min([low[i], *[low[j] for j in links[i]]]) for i in ids}
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("shape", ["chain", "star", "cliques", "random"])
def test_components(spark, shape):
    r = random.Random(3)
    n = 300
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "cliques": [(i, i // 7 * 7) for i in range(n)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(150)]}[shape]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = {i: [] for e in edges for i in e}
    for a, b in edges:
        links[a].append(b)
        links[b].append(a)
    want = closure(list(links), links)
    same_root = {}
    for node, root in got.items():
        assert same_root.setdefault(want[node], root) == root
    assert len(set(same_root.values())) == len(same_root)
    assert set(got) == {i for a, b in edges for i in (a, b) if a != b}


def test_simhash(spark, data, texts):
    def plain(text):
        words = text.encode().lower().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = {r["doc_id"]: r for r in simhash.op4_simhash(spark, data).collect()}
    fps = {i: plain(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    links = {i: [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3] for i in fps}
    assert {i: r["component_id"] for i, r in got.items()} == closure(list(fps), links)


def test_simhash_links_at_every_distance(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for k in range(1, 6):
            fps.add(b ^ sum(1 << x for x in r.sample(range(64), k)))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_line_dedup_small_filter(spark, data, duck):
    """A filter far too small makes every line a suspect and changes nothing."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = line_dedup.dedup_lines(docs, filter_bits=1 << 12)
    same(out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")), duck, line_dedup.ORACLE)


@pytest.mark.parametrize("kw", [{"broadcast_bits": 0}, {"broadcast_known": 0}, {"broadcast_bits": 0, "broadcast_known": 0, "filter_bits": 1 << 12}])
def test_line_dedup_without_broadcasts(spark, data, duck, kw):
    """Filters divided by hash, and known lines joined, give the same result."""
    out = line_dedup.dedup_lines(spark.read.parquet(f"{data}/documents.parquet"), **kw)
    same(out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")), duck, line_dedup.ORACLE)


def test_line_dedup_filter_follows_the_lines():
    assert [line_dedup.bits_for(n) for n in (0, 1 << 16, (1 << 16) + 1, 1 << 30)] == [1 << 20, 1 << 20, 1 << 21, 1 << 34]
    assert line_dedup.layout(1 << 34) == (1 << 24, 1 << 10)


def test_mixing_targets(spark, data):
    rows = mixing.op3_mixing(spark, data).collect()
    again = mixing.op3_mixing(spark, data).collect()
    assert sorted(rows) == sorted(again)
    total = sum(r["size"] for r in rows)
    per = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        s = per.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["taken"]
        s[1] = max(s[1], r["size"])
    assert sum(t for _, t in per) == pytest.approx(1.5 * total)
    for (size, target), (taken, largest) in per.items():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= largest


def test_mixing_reshares(spark):
    x = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(x, 1.5, 2.0, (3, 1, 2)).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx((3015 - 20) / 3) and got[None] == pytest.approx((3015 - 20) * 2 / 3)


def test_embeddings_hot_group(spark):
    """A crowd of near copies, all of its links counted, beside lone pairs and noise."""
    r = np.random.default_rng(1)
    hub = r.normal(size=32)
    crowd = hub + r.normal(size=(400, 32)) * 0.05 * np.linalg.norm(hub) / np.sqrt(32)
    noise = r.normal(size=(400, 32))
    pairs = noise[:50] + r.normal(size=(50, 32)) * 0.01
    x = np.vstack([crowd, noise, pairs, crowd[:30]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {q["vec_id"]: q for q in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.98
    assert [got[i]["n_links"] for i in range(len(x))] == (hit.sum(1) - 1).tolist()
    links = {i: np.flatnonzero(hit[i]).tolist() for i in range(len(x))}
    assert {i: q["component_id"] for i, q in got.items()} == closure(list(links), links)


def near_brute(spark, x, ids=None, **kw):
    """near_duplicates against all pairs: links and components, by row."""
    ids = list(range(len(x))) if ids is None else ids
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x.astype(np.float32), strict=True)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **kw).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.98
    low = closure(list(range(len(x))), {i: np.flatnonzero(hit[i]).tolist() for i in range(len(x))})
    least = {}
    for i, c in low.items():
        least[c] = min(least.get(c, ids[i]), ids[i])
    want = sorted((ids[i], int(hit[i].sum()) - 1, least[c]) for i, c in low.items())
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def crowd(r, centre, n, spread):
    x = centre + r.normal(size=(n, len(centre))) * spread / np.sqrt(len(centre))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def two_centres(r, apart, dim=64):
    a = r.normal(size=dim)
    a /= np.linalg.norm(a)
    b = r.normal(size=dim)
    b -= b @ a * a
    b = a + b / np.linalg.norm(b) * apart
    return a, b / np.linalg.norm(b)


def test_embeddings_crowds_that_touch(spark):
    """Two crowds of 20, all of whose 40 link: lists of 12 fill with their own crowd."""
    r = np.random.default_rng(0)
    a, b = two_centres(r, 0.15)
    x = np.vstack([crowd(r, a, 20, 0.03), crowd(r, b, 20, 0.03)])
    assert (x @ x.T).min() >= 0.985
    near_brute(spark, np.vstack([x, r.normal(size=(60, 64))]))


def test_embeddings_lists_are_enlarged(spark):
    """A loose crowd, whose vectors have about 100 neighbours each but are no clique, and lists of 6."""
    r = np.random.default_rng(4)
    a, b = two_centres(r, 0.1)
    near_brute(spark, np.vstack([crowd(r, a, 90, 0.14), crowd(r, b, 60, 0.14), r.normal(size=(60, 64))]), k=6, passes=1)


def test_embeddings_repeated_ids(spark):
    """Rows of one vec_id with different vectors, or with equal ones, are vectors of their own."""
    r = np.random.default_rng(2)
    x = r.normal(size=(6, 16))
    x[1], x[3] = x[0], x[0] + 0.001
    near_brute(spark, x, ids=[5, 5, 7, 7, 9, 5])


def test_embeddings_fail_under_the_recall(spark, monkeypatch):
    """A search that finds nothing is an error, not a result."""
    monkeypatch.setattr(embeddings, "nearest", lambda edges, wide, k: edges.select("u", "v", "gap").where("false").selectExpr("*", "cast(null as double) as worst"))
    monkeypatch.setattr(embeddings, "BATCH", 1)
    x = np.random.default_rng(3).normal(size=(20, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.vstack([x, x + 0.01]))]
    with pytest.raises(RuntimeError, match="links were found"):
        embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), attempts=1, rounds=1)


def test_gather():
    """Cells: every member within its radius; tight ones link throughout, loose ones with one vector."""
    import math

    import pandas as pd

    r = np.random.default_rng(5)
    a, b = two_centres(r, 0.12)
    x = np.vstack([crowd(r, a, 60, 0.08), crowd(r, b, 60, 0.16), r.normal(size=(30, 64))]).astype(np.float32)
    pdf = pd.DataFrame({"node": range(len(x)), "space": "0", "weight": 1, "vec": list(x), "radius": 0.0})
    u, theta = embeddings.unit(pdf["vec"]), math.acos(0.98)
    for tight in (True, False):
        got = embeddings.gather(pdf, theta, tight)
        assert sorted(n for c in got for n in c[5]) == list(range(len(x)))
        for _, _, weight, vec, radius, members in got:
            c = embeddings.unit([vec])[0]
            assert weight == len(members) and embeddings.angle(u[members] @ c).max() <= radius + 1e-6
            if tight:
                assert (u[members] @ u[members].T >= 0.98 - 1e-12).all()
            else:
                assert any((u[members] @ u[m] >= 0.98 - 1e-12).all() for m in members)


def test_langid_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.op2_langid(spark, data).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_langid_tables_equal_filters():
    r = np.random.default_rng(0)
    x, y = r.integers(1, 256, (40, 64)).astype(np.uint8), r.integers(0, 3, 40)
    net = langid.train(x, y, 3, epochs=2)
    pooled = []
    for w, table in zip(langid.WIDTHS, net["conv"], strict=True):
        pooled.append(sum(table[j][x[:, j : j + 64 - w + 1]] for j in range(w)).max(1))
    z = np.maximum(np.concatenate(pooled, 1), 0) @ net["dense"] + net["bias"]
    z -= z.max(1, keepdims=True)
    assert langid.scores(net, x) == pytest.approx(z - np.log(np.exp(z).sum(1, keepdims=True)), abs=1e-4)


def test_langid_whole_texts(spark, data, texts):
    """The query's language and score of every text against a plain forward pass, window by window."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    net, langs = langid.learn(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), (net, langs)).collect()}
    for i, t in texts.items():
        if not any(ch.isalpha() for ch in t):
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        raw, total, size = t.encode(), np.zeros(len(langs)), 0
        for at in range(0, len(raw), 512):
            part = raw[at : at + 512]
            x = np.frombuffer(part.ljust(512, b"\0"), np.uint8)
            h = np.concatenate([np.maximum(sum(table[j][x[j : 512 - w + 1 + j]] for j in range(w)).max(0), 0) for w, table in zip(langid.WIDTHS, net["conv"], strict=True)])
            z = (h @ net["dense"] + net["bias"]).astype(float)
            z -= z.max()
            total += (z - np.log(np.exp(z).sum())) * len(part)
            size += len(part)
        p = np.exp(total / size - (total / size).max())
        p /= p.sum()
        assert got[i]["score"] == pytest.approx(p.max(), abs=2e-3) and (p.max() - np.sort(p)[-2] < 1e-2 or got[i]["lang_pred"] == langs[int(p.argmax())])


def test_quality_votes(spark, data, texts):
    """The query's score of every text against all labelled vectors, one by one."""
    docs, marks = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    own = marks.where(~langid.held_out(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("key"), "quality")
    votes = quality.fit(docs.select(F.col("doc_id").alias("key"), "text"), own)
    assert len(votes.labels) == own.distinct().count()
    got = {r["doc_id"]: r["score"] for r in quality.op7_quality(spark, data).collect()}
    for i, t in texts.items():
        if not t:
            assert got[i] == pytest.approx(votes.prior)
            continue
        v = (quality.terms(t.encode()).astype(float) * votes.weight) @ votes.axes
        v /= np.linalg.norm(v)
        sims = votes.vectors.astype(float) @ v
        top = np.argsort(-sims)[: votes.nearest]
        w = np.maximum(sims[top], 0) ** votes.power
        assert got[i] == pytest.approx((w * votes.labels[top]).sum() / w.sum(), abs=0.05)  # ties at the last place


def test_urls(spark):
    """The trees: many features split, SQL equals numpy row by row, held-out urls ranked, no single feature suffices."""
    train, held = urls.examples(), urls.examples(1500, seed=99)
    frame = lambda rows: spark.createDataFrame(rows, "url string, label int")
    base, forest, rates, words = urls.trained(frame(train), 20_000, 500)
    used = set()

    def walk(t):
        if not isinstance(t, float):
            used.add(urls.FEATURES[t[0]])
            walk(t[2]), walk(t[3])

    for t in forest:
        walk(t)
    assert len(used) >= 8
    scored = urls.features(frame(held), rates, words).select("label", *urls.FEATURES, F.expr(urls.expression(base, forest)).alias("score")).toPandas()
    x, y = scored[list(urls.FEATURES)].to_numpy(float), scored["label"].to_numpy()
    p = urls.probability(base, forest, x)
    assert scored["score"].to_numpy() == pytest.approx(p, abs=1e-12)
    order = np.argsort(np.argsort(p)) + 1
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9
    for k, name in enumerate(urls.FEATURES):  # the classes overlap in every feature
        a, b = x[y == 1, k], x[y == 0, k]
        assert a.min() <= b.max() and b.min() <= a.max(), name
        best = max(max(((x[:, k] > c) == y).mean(), ((x[:, k] <= c) == y).mean()) for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 200))))
        assert best < ((p > 0.5) == y).mean()
    plain = train[0][0]
    assert urls.host_of is not None and plain.startswith("http")


def test_quality_held_out(spark, data):
    marks = spark.read.parquet(f"{data}/labels.parquet")
    got = quality.op7_quality(spark, data).join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.9


def test_spotsigs(spark, data, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in spotsigs.op9_spotsigs(spark, data).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, d = texts[i], texts[j]
        n = len(t) // 2
        new = t[: len(t) - n] + d[:n]
        a, b, c = (spotsigs.signatures(x) for x in (t, new, d))
        jac = lambda p, q: len(set(p) & set(q)) / len(set(p) | set(q)) if p or q else 1.0
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(new.encode()).hexdigest(), spotsigs.as_text(a), spotsigs.as_text(b))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((jac(a, b), jac(a, c)))


def test_spotsigs_ranges(spark):
    """The two short searches find the range that counting all smaller numbers finds."""
    r = random.Random(8)
    for n in (0, 1, 2, 7, 50):
        cuts = sorted({float(r.randrange(100)) for _ in range(n)})
        got = spark.range(-3, 105).select("id", spotsigs._range_of(F.col("id"), cuts).alias("k")).collect()
        assert all(x["k"] == sum(c < x["id"] for c in cuts) for x in got)


def test_spotsigs_without_anchors():
    """A text of unknown words changes little when one word does."""
    words = [f"q{i * 7919 % 1000}z" for i in range(200)]
    a = spotsigs.signatures(" ".join(words))
    words[50] = "changed"
    b = spotsigs.signatures(" ".join(words))
    assert len(a) > 20 and 0.8 < spotsigs.likeness(a, b) < 1
    assert len(spotsigs.signatures("zwei")) == 1 and spotsigs.signatures("...") == []


def test_spotsigs_pairs(spark, data, texts):
    pairs, member = spotsigs.near_pairs(spark.read.parquet(f"{data}/documents.parquet"), 0.5)
    classes = sorted({r["class"] for r in member.collect()})
    sigs = {i: set(spotsigs.signatures(texts[i])) for i in classes}
    want = {(a, b) for a in classes for b in classes if a < b and sigs[a] and len(sigs[a] & sigs[b]) >= 0.5 * len(sigs[a] | sigs[b])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


def test_pieces(spark, data, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for chunk in (500, 32_768):
        assert {r["doc_id"]: r["ids"] for r in pieces.encode(docs, chunk=chunk).collect()} == {i: sp.encode(t) for i, t in texts.items()}
    got = pieces.op10_pieces(spark, data).collect()
    assert all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)


def test_pieces_without_borders():
    """Chunks in which no unit begins: the whole transfer matrix, and its product's associativity."""
    p, r = pieces.Pieces(), random.Random(2)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for _ in range(60):
        s = "".join(r.choice(["the", "ing", "a", "é", "中", "\n", "xyz", "."]) for _ in range(r.randint(1, 40)))
        for c in (16, 23):
            assert p.scan(pieces.marked(s), c) == sp.encode(s)
    a, b, c = (np.where(np.random.default_rng(k).random((5, 5)) < 0.4, 0, pieces.NONE) for k in range(3))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_pieces_digests(spark, data, texts):
    """Ids and their digests of every whole text, as the library's ids give them."""
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.op10_pieces(spark, data).collect():
        ids = np.array(sp.encode(texts[r["doc_id"]]), "<i4")
        text = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_chars"], r["ids_sha256"]) == (len(ids), len(text), hashlib.sha256(ids.tobytes()).hexdigest())


def test_pieces_in_blocks(spark, monkeypatch):
    """Products of blocks of chunks, in tasks of their own, give the path that one scan gives."""
    r = random.Random(6)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["".join(r.choice(["the", "ing ", "a", "\u00e9", "\u4e2d", "\n", "xyz", ". "]) for _ in range(n)) for n in (900, 1500, 40)]
    monkeypatch.setattr(pieces, "BLOCK", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["ids"] for x in pieces.encode(docs, chunk=100).collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}


def test_token_query(spark, data, texts):
    """The query's edits made plainly, and counted by the library."""
    c = token_counts.Counter()
    for r in token_counts.op6_token_counts(spark, data).collect():
        t = texts[r["doc_id"]]
        half = len(t) // 2
        new = "Edited.\n" + t[:half] + "an edited passage, number 7" + t[half + 40 :]
        assert (r["n_tokens"], r["edited_tokens"], r["n_chars"]) == (c.whole(t), c.whole(new), len(new))
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and r["encoded_chars"] <= min(2 * len(new), len("Edited.\n") + 12 * token_counts.LEAF)


def test_token_leaves_stay_small():
    """After a very long insertion, an edit of one character encodes a few leaves and no more."""
    c = token_counts.Counter()
    text = "one two three " * 200
    tree = token_counts.CountTree(*c.leaves(text))
    text, _ = tree.edit(c, text, 1000, 1000, "some more words here " * 10_000)
    text, n = tree.edit(c, text, 100_000, 100_001, "x")
    assert n <= 8 * token_counts.LEAF and tree.total == c.whole(text) and tree.chars[1] == len(text)


def test_token_edits(texts):
    c, r = token_counts.Counter(), random.Random(4)
    alphabet = ["a", " ", "\n", "  ", "\t", "it's", "é", "\u3000", "12", "!", "\x1c", "\u00a0"]
    samples = [texts[i][:3000] for i in sorted(texts)[:40]] + ["".join(r.choice(alphabet) for _ in range(400)) for _ in range(60)]
    for t in samples:
        for size in (1, 30, 512):
            tree = token_counts.CountTree(*c.leaves(t, size))
            assert tree.total == c.whole(t)
            cur = t
            for _ in range(6):
                a = r.randint(0, len(cur))
                cur, _ = tree.edit(c, cur, a, a + r.randint(0, 50), "".join(r.choice(alphabet) for _ in range(r.randint(0, 12))))
                assert tree.total == c.whole(cur) and tree.chars[1] == len(cur)


def test_pipeline_steps(spark, data, texts):
    """Each stage by itself, on what its predecessor kept, against a plain version."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one = P.language(spark, docs, data).cache()
    kept = {r["doc_id"] for r in one.collect()}
    assert kept <= set(texts) and len(kept) > 0.97 * sum(any(ch.isalpha() for ch in t) for t in texts.values())
    two = P.lines(spark, one, data).cache()
    assert {r["doc_id"] for r in two.collect()} == kept
    three = P.near_copies(spark, two, data).cache()
    mid = {r["doc_id"]: r["text"] for r in two.collect()}
    fps = {i: simhash.fingerprint(t.encode()) & (1 << 64) - 1 for i, t in mid.items()}
    comp = closure(list(fps), {i: [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3] for i in fps})
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(comp.values()))
    four = P.weights(spark, three, data).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    count = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert count == {i: n for i, n in copies.items() if n}
    five = P.encoded(spark, four, data).collect()
    text = {r["doc_id"]: r["text"] for r in four.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(five) == four.count() and all(r["ids"] == sp.encode(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in five)


def test_short_lists_are_met_together():
    """Many short lists at once give the edges that each gives by itself, whatever their sizes and who asks."""
    rng = np.random.default_rng(3)
    sizes = np.array([1, 2, 9, 30, 5, 14])
    listed = np.array([1, 1, 4, 13, 5, 3])
    own = np.array([True, False, True, False, True, True])
    n = int(sizes.sum())
    x = rng.normal(size=(n, 3))
    side = (rng.integers(0, 40, n), x / np.linalg.norm(x, axis=1, keepdims=True), rng.random(n) / 10, np.where(rng.random(n) < 0.5, 0.4, np.inf))
    starts = np.cumsum(sizes) - sizes
    want = []
    for a, size, m, self_too in zip(starts, sizes, listed, own, strict=True):
        cut = lambda lo, hi: tuple(c[lo:hi] for c in side)
        want += list(zip(*(c.tolist() for c in embeddings.pairs_of(cut(a if self_too else a + m, a + size), cut(a, a + m), 3, 0.3)), strict=True))
    got = list(zip(*(c.tolist() for c in embeddings.pairs_of_small(side, starts, sizes, listed, own, 3, 0.3)), strict=True))
    assert len(want) > 30 and [(u, v) for u, v, _ in sorted(got)] == [(u, v) for u, v, _ in sorted(want)]
    assert np.allclose([g for *_, g in sorted(got)], [g for *_, g in sorted(want)])
