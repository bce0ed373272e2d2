"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from foreopen.llm import embeddings, langid, line_dedup, mixing, pieces, quality, simhash, spotsigs, token_counts, urls

LONG = " ".join(f"word{i % 977} the thing" for i in range(30_000))
DOCS = [
    (1, "The cat sat on the mat and looked at the garden wall.\nshared line of more than twenty characters", "en", "a", 1),
    (2, "The cat sat on the mat and looked at the garden wall.\nshared line of more than twenty characters", "en", "a", 1),
    (3, "  SHARED line of more than twenty characters\t\nown line", "en", None, 1),
    (4, None, None, "b", None),
    (5, "", "fr", "b", 0),
    (6, " \n\t ", "fr", "b", 4),
    (7, LONG, "en", "c", len(LONG)),
    (7, LONG, "en", "c", len(LONG)),
    (None, "the lost text is without a number", "en", "a", 3),
    (8, "12345 !!! ???", "de", None, 13),
    (9, "x" * 50_000, "de", "c", 50_000),
    (10, "\u00e9\u4e2d\U0001f600 a\u2581b", "de", "c", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators make or use themselves.
CLASH = ["fp", "root", "node", "part", "h", "size", "target", "ids", "row", "key", "drop", "score", "n_tokens", "sigs", "b1", "copies"]


@pytest.fixture(scope="module")
def docs(spark):
    x = spark.createDataFrame(DOCS, SCHEMA)
    return x.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_line_dedup(docs, none):
    got = rows(line_dedup.dedup_lines(docs))
    assert len(got) == len(DOCS)
    by = {(r["doc_id"]): r for r in got}
    assert (by[1]["n_lines"], by[1]["n_dropped"]) == (2, 1) and by[3]["n_dropped"] == 0 and by[4]["n_lines"] == 1 and by[4]["text"] == ""
    assert by[1]["text"] == "The cat sat on the mat and looked at the garden wall." and by[None]["n_dropped"] == 0 and by[7]["text"] == LONG
    assert rows(line_dedup.dedup_lines(none)) == []


def test_mixing(docs, none):
    got = rows(mixing.mix(docs))
    assert len(got) == len(DOCS) and rows(mixing.mix(none)) == []
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    sizes = {i: len((t or "").split()) for i, t, *_ in DOCS[:-1]}
    assert all(r["size"] == sizes[r["doc_id"]] for r in got if r["doc_id"] != 10)
    assert len({(r["size"], r["taken"]) for r in got if r["doc_id"] == 7}) == 1


def test_simhash(docs, none):
    got = {r["doc_id"]: r for r in rows(simhash.near_duplicates(docs))}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[4]["fp"] == got[5]["fp"] == got[6]["fp"] == 0
    assert got[6]["component_id"] == 4 and got[7]["component_id"] == 7 and got[None]["component_id"] is None
    assert rows(simhash.near_duplicates(none)) == []
    only = docs.where("doc_id is null")
    assert rows(simhash.near_duplicates(only))[0]["component_id"] is None


def test_langid(docs, none):
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    got = {r["doc_id"]: r for r in rows(langid.identify(docs, model))}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 8)) and got[1]["lang_pred"] in ("en", "de", "fr")
    assert rows(langid.identify(none, model)) == [] and langid.fit(none.select(F.col("doc_id").alias("key"), "text", "lang")) is None
    assert all(r["lang_pred"] == "und" for r in rows(langid.identify(docs, None)))


def test_pieces(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for chunk in (32_768, 1000, 7):
        own = docs.where("doc_id not in (7, 9)") if chunk < 1000 else docs
        got = rows(pieces.encode(own, chunk=chunk))
        assert len(got) == own.count()
        for r in got:
            text = next(t for i, t, *_ in DOCS if i == r["doc_id"])
            assert r["ids"] == (None if text is None else sp.encode(text))
    assert rows(pieces.encode(none)) == []
    back = {r["doc_id"]: r["text"] for r in rows(pieces.decode(pieces.encode(docs)))}
    assert all(back[i] == (t.replace("\u2581", " ") if t is not None else None) for i, t, *_ in DOCS)


def test_token_counts(docs, none):
    got = rows(token_counts.build(docs, carry=("text",)))
    c = token_counts.Counter()
    assert all(r["n_tokens"] == c.whole(r["text"] or "") == sum(r["leaf_tokens"]) for r in got) and len(got) == len(DOCS)
    edits = F.when(F.col("doc_id") != 3, F.array(F.struct(F.lit(2).alias("start"), F.lit(10**6).alias("stop"), F.lit("new").alias("new"))))
    done = {r["doc_id"]: r for r in rows(token_counts.apply_edits(token_counts.build(docs, carry=("text",)).withColumn("edits", edits)))}
    assert done[1]["edited_tokens"] == c.whole("Thnew") and done[3]["edited_tokens"] == done[3]["n_tokens"] and done[4]["edited_tokens"] == c.whole("new")
    assert rows(token_counts.build(none)) == []


def test_quality(docs, none):
    texts, marks = docs.select(F.col("doc_id").alias("key"), "text"), docs.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") < 4, 1).when(F.col("doc_id") > 7, 0).alias("quality"))
    votes = quality.fit(texts, marks)
    got = rows(quality.judge(docs, votes))
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert rows(quality.judge(none, votes)) == [] and quality.fit(texts, marks.where("false")) is None
    assert all(r["score"] == 0.5 for r in rows(quality.judge(docs, None)))


def test_spotsigs(docs, none):
    got = rows(spotsigs.digests(docs, parts=3))
    assert len(got) == len(DOCS) and rows(spotsigs.digests(none)) == []
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[4]["n_chars"] == 0 and by[4]["edited_sha256"] == hashlib.sha256(b"").hexdigest() and by[4]["near_next"] == 1.0
    lost = DOCS[8][1]
    assert by[None]["near_next"] == 0 and by[None]["edited_sha256"] == hashlib.sha256(lost[: len(lost) - len(lost) // 2].encode()).hexdigest()
    one = rows(spotsigs.digests(docs.where("doc_id = 1")))
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    pairs, member = spotsigs.near_pairs(docs)
    assert {(r["doc_id"], r["class"]) for r in member.collect()} >= {(1, 1), (2, 1), (5, 4), (6, 4)}
    assert all(r["a"] < r["b"] for r in pairs.collect())
    assert spotsigs.near_pairs(none)[0].count() == 0


def test_urls(spark):
    pages = [(1, "http://A.NET/x"), (2, "http://sub.example.net/en/1?q"), (3, "https://example.com/de/#t"), (4, "http://www.org/fr/a"), (5, None), (6, "no scheme"), (7, "http://example.net?x"), (8, "x://notnet/"), (8, "x://notnet/"), (None, "http://example.com"), (9, "http://" + "a" * 20_000 + ".net/")]
    x = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "length", "tld", "_host")})
    model = urls.fit(spark.createDataFrame(urls.examples(), "url string, label int"))
    got = rows(urls.judge(x, model))
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages)
    assert [(by[i]["rule"], by[i]["verdict"]) for i in (1, 2, 3, 4, 9)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block")]
    assert (by[1]["host"], by[1]["path"]) == ("a.net", "/x") and (by[5]["host"], by[5]["path"]) == ("", "") == (by[6]["host"], by[6]["path"])
    assert by[7]["rule"] is None and by[7]["path"] == "" and by[8]["rule"] is None
    assert rows(urls.judge(x.limit(0), model)) == [] and {r["verdict"] for r in rows(urls.judge(x.where("page_id = 8"), None))} == {"allow"}


def test_embeddings(spark):
    import math

    v = lambda a: [math.cos(a), math.sin(a), 0.0]
    data = [(1, v(0.0), 0), (2, v(0.1), 0), (3, v(0.29), 0), (4, v(0.0), 1), (5, v(0.0), None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [float("nan"), 1.0, 0.0], 0), (9, [None, 1.0, 0.0], 0), (10, [float("inf"), 1.0, 0.0], 0), (11, v(0.0), 0), (12, [1.0, 0.0], 0), (13, [], 0), (None, v(0.0), 0)]
    x = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("node", "space", "root", "u", "v", "links")})
    got = {r["vec_id"]: r for r in rows(embeddings.near_duplicates(x))}
    assert len(got) == len(data)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (1, 2, 3, 4, 11)] == [(2, 1), (3, 1), (1, 1), (0, 4), (2, 1)]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 12, 13))
    assert rows(embeddings.near_duplicates(x.limit(0))) == []


def test_mixing_never_over_the_cap(spark):
    """Documents without words in a source at its cap, and a source of such documents alone."""
    data = [(1, "a b c", "s"), (2, "", "s"), (3, None, "s"), (4, " \n", "s"), (5, "", "t"), (6, "w " * 300, "u")]
    for weights in ((3, 1, 2), (9, 1, 1)):
        got = rows(mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), weights=weights))
        assert len(got) == len(data) and all(0 <= r["copies"] <= 2 for r in got)


def test_one_of_each(spark):
    """Rows without id, rows of one id with other texts, equal rows, blank texts: one of each group, none else lost."""
    a, b, c = ("the first text has these words " * 3, "wholly other words are in the second one " * 3, "a third text about something else again " * 3)
    data = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a, "y"), (None, c, "x"), (None, c, "x"), (None, a, "x"), (3, None, "x"), (4, "", "x"), (None, " ", "x")]
    got = rows(simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string, fp string")))
    assert sorted(((r["doc_id"], r["text"], r["fp"]) for r in got), key=str) == sorted([(1, a, "x"), (1, b, "x"), (None, c, "x"), (3, None, "x")], key=str)
    assert rows(simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_tables_that_are_empty(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    assert rows(pieces.decode(empty("doc_id long, ids array<int>"))) == []
    trees = empty("doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, edits array<struct<start int, stop int, new string>>")
    assert rows(token_counts.apply_edits(trees)) == []
    assert rows(line_dedup.dedup_lines(empty("doc_id long, text string"), broadcast_bits=0, broadcast_known=0)) == []


def test_pipeline(spark, none, data):
    """Exactly the rows that each stage must leave, from null, empty, blank, repeated and long texts."""
    prose = ["The garden of the old house was full of the flowers that the children had planted.", "It is said that the river and the hills were there before any of the towns on the plain.", "She went to the market in the morning and came home with bread, cheese and the newspaper."]
    line = "a line that many of the documents have in common"
    texts = {1: f"{prose[0]} {prose[1]}\n{line}", 2: f"{prose[0]} {prose[1]}\n{line}", 3: f"{prose[2]} {prose[1]}\n{line}", 5: "", 6: " \n\t ", 8: "12345 !!! ???", 9: None}
    made = [(i, t, "en", "s", None) for i, t in texts.items()]
    made += [(None, prose[2], "en", "s", 3), (3, prose[0], "en", None, 1), (3, prose[0], "en", None, 1)]
    start = spark.createDataFrame(made, SCHEMA).select(*P.COLUMNS, F.lit(1).alias("fp"), F.lit(2).alias("size"))
    one = P.language(spark, start, data)
    assert sorted(((r["doc_id"], r["text"]) for r in rows(one)), key=str) == sorted([(i, texts[i]) for i in (1, 2, 3)] + [(None, prose[2]), (3, prose[0]), (3, prose[0])], key=str)
    two = P.lines(spark, one, data)
    first = f"{prose[0]} {prose[1]}"
    want = [(1, first), (2, first), (3, f"{prose[2]} {prose[1]}\n{line}"), (None, prose[2]), (3, prose[0]), (3, prose[0])]
    assert sorted(((r["doc_id"], r["text"]) for r in rows(two)), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in rows(two))
    three = P.near_copies(spark, two, data)
    want = [(1, first), (3, f"{prose[2]} {prose[1]}\n{line}"), (None, prose[2]), (3, prose[0])]
    assert sorted(((r["doc_id"], r["text"]) for r in rows(three)), key=str) == sorted(want, key=str)
    four = rows(P.weights(spark, three, data))
    assert {(r["doc_id"], r["text"]) for r in four} <= set(want) and all(four.count(r) <= 2 for r in four)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    five = rows(P.encoded(spark, three, data))
    assert sorted(r["ids"] for r in five) == sorted(sp.encode(t) for _, t in want) and all(r["n_tokens"] == len(r["ids"]) for r in five)
    x = none
    for k, (_, stage) in enumerate(P.STAGES):
        x = stage(spark, x, data)
        assert rows(x) == [] and (k == len(P.STAGES) - 1 or sorted(x.columns) == sorted(P.COLUMNS))
