"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns for every operator and stage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import ann, bpe, jpeg, langid, mixing, pfor, quality, simhash, toxicity, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, mark string, `order` int, _slot int"
LABELS = "doc_id bigint, quality int, toxic int"


def sentence(seed: int, n: int = 40) -> str:
    return " ".join(f"word{(seed * 7919 + i * i * 31) % 997}" for i in range(n)) + "."


ROWS = [
    *[(i, sentence(i), "en" if i % 2 else "de", f"s{i % 3}", 1, True, "m", 1, 1) for i in range(30)],
    (30, None, None, None, None, None, None, None, None),
    (31, "", "en", "s0", 0, False, "", 0, 0),
    (32, "   \n\t ", "en", "s0", 0, False, "", 0, 0),
    (33, "12 34 !!", "en", None, 0, False, "", 0, 0),
    (34, sentence(5, 200_000), "en", "s1", 0, False, "", 0, 0),
    (35, "x" * 9_000_000, "en", "s1", 0, False, "", 0, 0),
    (36, "日本語 \U0001f600 é\x00z", "xx", "s2", 0, False, "", 0, 0),
    (3, sentence(3), "en", "s0", 1, True, "m", 1, 1),
    (3, sentence(3), "en", "s0", 1, True, "m", 1, 1),
    (4, sentence(77), "en", "s0", 1, True, "m", 1, 1),
    (None, sentence(8), "en", "s0", 1, True, "m", 1, 1),
    (None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, DOCS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(3, 1, 1), (3, None, None), (None, 1, 1), (999, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def test_quality(spark, docs, labels, none):
    model = quality.fit(docs, labels)
    rows = quality.classify(docs, labels, model).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[k].quality_score == 0 and not by[k].kept for k in (30, 31))
    kept = quality.keep(docs, labels, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert quality.classify(none, labels, model).count() == 0
    empty = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.classify(docs.where("doc_id = 1"), labels, empty).collect()} == {1.0}
    assert quality.classify(none, labels).count() == 0


def test_language(spark, docs, none):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for k in (30, 31, 32, 33):
        assert by[k].lang is None and by[k].confidence == 0 and not by[k].accepted
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in rows)
    assert langid.identify(none, model).count() == 0
    assert not langid.identify(docs, langid.fit(none)).where("accepted").count()


def test_toxicity(docs, labels, none):
    rows = toxicity.grade(docs, labels).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[30].expected_severity == by[31].expected_severity
    assert toxicity.grade(none, labels).count() == 0
    assert all(r.expected_severity == 0 and not r.toxic for r in toxicity.grade(docs, labels.limit(0)).collect())


def test_near_copies(docs, none):
    rows = simhash.groups(docs).collect()
    assert len(rows) == len(ROWS)
    nulls = [r for r in rows if r.group_id is None and r.kept]
    assert len(nulls) >= 2
    assert sum(r.kept for r in rows if r.doc_id == 3 and r.group_id == 3) >= 1
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and ids.count(4) == 2  # two texts share the id 4
    assert ids.count(None) == 1  # the null text; the copy of 8 goes
    assert ids.count(30) == 1
    assert simhash.groups(none).count() == 0 and simhash.keep(none).count() == 0


def test_mixing(docs, none):
    slots = mixing.schedule(docs, block_tokens=64).collect()
    assert slots and {r.source for r in slots} <= {"", "s0", "s1", "s2"}
    mixed = mixing.mix(docs, block_tokens=64)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.schedule(none).count() == 0 and mixing.mix(none).count() == 0
    only = mixing.schedule(docs, targets={"s2": 1.0, "absent": 3.0}, block_tokens=64).select("source").distinct().collect()
    assert [r.source for r in only] == ["s2"]


def test_bpe(docs, none):
    back = bpe.decode(bpe.encode(docs))
    rows = back.select("doc_id", "token_ids", "n_tokens", "decoded").collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded or "") for r in rows) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[30].token_ids is None and by[30].n_tokens is None and by[31].token_ids == []
    assert bpe.encode(none).count() == 0
    assert bpe.encode(docs.where("doc_id < 5").repartition(3), stored=False).count() == 8


def test_last_stage_decodes_where_it_places(spark, docs):
    """One Python worker a task once ids are placed; the columns are those of ``decode`` behind ``encode``."""
    two = bpe.decode(bpe.encode(docs))
    one = bpe.encode(docs, back=True)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.token_ids is None, r.token_ids or [], r.n_tokens, r.mark, r.decoded)
    assert one.columns == two.columns and sorted(map(repr, map(key, one.collect()))) == sorted(map(repr, map(key, two.collect())))
    last = corpus_pipeline._tokens(spark, docs, "")
    assert all(r.round_trip for r in last.collect())
    upto = last._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "InArrow" not in upto and "InPandas" not in upto and "EvalPython" not in upto


def test_bpe_notices_another_order(spark):
    """As many distinct words, but others: the checksum tells."""
    import pyarrow as pa

    a, b = (bpe.numbered(pa.array([x], pa.large_string()))[0] for x in ("one two", "two six"))
    sums = [bpe._checksum(bpe._hashes(w), range_) for w in (a, b) for range_ in [np.arange(len(w))]]
    assert sums[0] != sums[1]


def test_packed_ids(docs, none):
    packed = pfor.write_ids(docs)
    back = pfor.read_ids(packed)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.token_ids is None, r.token_ids or [])
    want = sorted(map(key, bpe.encode(docs).collect()))
    rows = back.collect()
    assert len(rows) == len(ROWS)
    assert sorted(map(key, rows)) == want
    assert pfor.write_ids(none).count() == 0


def test_neighbours(spark):
    rows = [(i, [float(i % 5), float(i // 5), 0.0], "x", 1) for i in range(25)]
    rows += [(3, [9.0, 9.0, 9.0], "y", 2), (None, [1.0, 1.0, 1.0], "", 0), (40, None, "", 0), (41, [], "", 0), (42, [1.0, float("nan"), 0.0], "", 0), (43, [1.0], "", 0), (44, [1.0, None, 1.0], "", 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string, distance int")
    found = ann.neighbours(table, k=4).collect()
    ids = {r.vec_id for r in found}
    assert ids == set(range(25)) and all(r.vec_id != r.neighbour_id for r in found)
    assert ann.neighbours(table.limit(0)).count() == 0
    assert ann.neighbours(table.where("vec_id = 7")).count() == 0
    assert ann.neighbours(table.where("vec_id in (7, 8)")).count() == 2


def test_media(spark):
    good = jpeg.render([b"abc" * 500], 2)[0]
    rows = [(1, good, "a"), (2, None, "b"), (3, b"", "c"), (4, good[: len(good) // 2], "d"), (5, b"\xff\xd8junk", "e"), (1, good, "a"), (None, good, "f"), (6, jpeg.render([b"z" * 400_000], 0)[0], "g")]
    table = spark.createDataFrame(rows, "media_id bigint, media binary, status string")
    out = {(r.media_id, i): r for i, r in enumerate(jpeg.describe(table).collect())}
    status = sorted((k[0] or 0, r.status or "") for k, r in out.items())
    assert status == [(0, "ok"), (1, "ok"), (1, "ok"), (2, ""), (3, "corrupt"), (4, "corrupt"), (5, "corrupt"), (6, "ok")]
    assert jpeg.describe(table.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (None, "u", "text")], "page_id bigint, url string, html string")
    assert {r.page_id: r.status for r in jpeg.describe(jpeg.pages_media(pages), "page_id").collect()} == {1: None, 2: "ok", None: "ok"}


def test_urls(spark):
    rows = [
        (1, "http://www.Bad.example/a.html?utm_source=x#f", "", "m"),
        (2, "https://bad.example/a", None, "m"),
        (3, "https://other.example/", '<link href="https://bad.example/a" rel="canonical">', "m"),
        (4, "https://free.example/p", '<meta http-equiv="refresh" content="0; url=//bad.example/a">', "m"),
        (5, "https://fine.example/q?page=2", "<p>", "m"),
        (6, None, "x", "m"), (7, "  ", "x", "m"), (8, "not a url", "", "m"), (None, "https://bad.example/a", "", "m"), (2, "https://bad.example/a", None, "m"),
        (9, "https://fine.example/" + "a" * 100_000, "", "m"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, `group` string")
    rules = spark.createDataFrame([("host", "bad.example", "block"), ("prefix", "https://free.example/p/", "allow"), ("word", None, "block"), ("word", "", "block")], urls.RULES)
    out = urls.decide(pages, rules).collect()
    assert len(out) == len(rows)
    why = {r.page_id: r.reason for r in out}
    assert why == {1: "own", 2: "own", 3: "alias", 4: "allowed", 5: "none", 6: "none", 7: "none", 8: "none", None: "own", 9: "none"}
    kept = urls.keep(pages, rules)
    assert kept.columns == pages.columns and sorted(r.page_id for r in kept.collect()) == [4, 5, 6, 7, 8, 9]
    jump = spark.createDataFrame([("https://fine.example/q?page=2", "https://bad.example/a"), (None, "https://x.example/")], "from_url string, to_url string")
    assert {r.page_id: r.reason for r in urls.decide(pages, rules, jump).collect()}[5] == "alias"
    assert urls.decide(pages.limit(0), rules).count() == 0
    assert not urls.decide(pages, rules.limit(0)).where("blocked").count()


@pytest.mark.parametrize(
    ("page", "html", "want"),
    [
        ("https://h.example/dir/sub/a.html?q=1", '<link rel=canonical href="b.html">', "https://h.example/dir/sub/b.html"),
        ("https://h.example/dir/sub/a", '<link rel=canonical href="./b">', "https://h.example/dir/sub/b"),
        ("https://h.example/dir/sub/a", '<link rel=canonical href="../../../b">', "https://h.example/b"),
        ("https://h.example/dir/sub/a", '<link rel=canonical href="../b?x=1&amp;y=2">', "https://h.example/dir/b?x=1&y=2"),
        ("https://h.example", '<link rel=canonical href="b">', "https://h.example/b"),
        ("https://h.example/a?z=1", '<link rel=canonical href="?page=2">', "https://h.example/a?page=2"),
        ("https://h.example/x/a", '<base href="https://other.example/k/"><link rel=canonical href="b">', "https://other.example/k/b"),
        ("https://h.example/x/a", '<base href="/k/"><link rel=canonical href="b">', "https://h.example/x/b"),
        ("https://h.example/x/a", '<link rel=canonical href="/b"><link rel=canonical href="/c">', "https://h.example/b"),
    ],
)
def test_links_are_resolved(spark, page, html, want):
    rows = urls.page_edges(spark.createDataFrame([(page, html)], "url string, html string")).collect()
    assert want in {r.b for r in rows}


def test_pictures_that_promise_too_much(spark):
    """A header of 65,535 x 65,535 with a few bytes of data is refused before anything is allocated."""
    good = jpeg.render([b"abc" * 50], 0)[0]
    at = good.index(b"\xff\xc0") + 5
    huge = good[:at] + b"\xff\xff\xff\xff" + good[at + 4 :]
    image = jpeg.parse(huge)
    assert (image.status, image.width, image.height) == ("corrupt", 65_535, 65_535)
    assert jpeg.decode([image]) == [None]


def test_pictures_with_tables_of_their_own():
    """Each picture has its own codes, as optimising encoders write them; many more than are held at a time."""
    import random

    rng = random.Random(2)
    pages = [bytes(rng.randrange(32, 127) for _ in range(600)) for _ in range(40)]
    images, want = [], []
    for data in pages:
        y = np.full(640, 32, np.uint8)
        y[:600] = np.frombuffer(data, np.uint8)
        own = [(codes[0], bytes(rng.sample(list(codes[1]), len(codes[1])))) for codes in (jpeg.DC_CODES, jpeg.AC_CODES)]
        images.append(jpeg.parse(jpeg.encode_all([([y.reshape(10, 64)], 64, 10)], [(1, 1)], codes=own)[0]))
        want.append(jpeg.decode([jpeg.parse(jpeg.encode_all([([y.reshape(10, 64)], 64, 10)], [(1, 1)])[0])])[0])
    got = jpeg.decode(images)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    assert len({t for x in images for pair in x.tables for t in pair}) > jpeg.TABLES


def test_pictures_of_other_kinds():
    good = jpeg.render([b"abc" * 50], 0)[0]
    at = good.index(b"\xff\xc0")
    assert jpeg.parse(good[: at + 1] + b"\xc2" + good[at + 2 :]).status == "unsupported"
    assert jpeg.parse(good[: at + 4] + b"\x0c" + good[at + 5 :]).status == "unsupported"


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [float(i // 4), 0.0]) for i in range(16)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.neighbours(table, k=3).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id))
    for i in range(16):
        want = sorted((abs(i // 4 - j // 4), j) for j in range(16) if j != i)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    model = quality.Model(np.ones(1), None, np.array([[1.0, 0.0]] * 4), np.array([1.0, 1.0, 0.0, 0.0]), np.arange(4), 2)
    assert quality._vote(np.array([[1.0, 0.0]]), np.array([-1]), model)[0] == 1.0


def test_pipeline_stages(spark, docs, labels, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == len(ROWS) and not last.where(~F.col("round_trip")).count()


def test_pipeline_end_to_end(spark, docs, labels, tmp_path):
    """The whole run equals the stages applied one by one, and gives tokens of kept documents only."""
    folder = str(tmp_path)
    docs.where("doc_id < 33").write.parquet(f"{folder}/documents.parquet")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    read = spark.read.parquet(f"{folder}/documents.parquet")
    step = read
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, folder).write.parquet(f"{folder}/s{i}")
        step = spark.read.parquet(f"{folder}/s{i}")
    assert sorted((r.doc_id or -1) for r in out) == sorted((r.doc_id or -1) for r in step.collect())
    # in the order of place the documents stand as the schedule has them
    slots = {}
    for r in mixing.schedule(spark.read.parquet(f"{folder}/s2")).where("token_from = 0").collect():
        slots.setdefault(r.doc_id, []).append(r.slot)
    taken, last = {k: sorted(v) for k, v in slots.items()}, -1
    for r in sorted(out, key=lambda r: r.place):
        slot = taken[r.doc_id].pop(0)
        assert slot >= last
        last = slot
    assert all(r.round_trip for r in out)
