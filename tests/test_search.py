from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import dense, evaluation, fusion, lexical
from lexloom.plans import retrieval


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, rng.normal(size=8).tolist(), f"{2000 + i}_a_b", "methods" if i % 2 else "results", 0) for i, t in enumerate(["anoxic biofilter H2S removal", "biogas upgrading with algae", "protein from gas", "H2S and H2S again", None])]
    return spark.createDataFrame(rows, "id long, text string, embedding array<double>, paper_id string, section_canonical string, year int").withColumns({"type": F.lit("text"), "doc_type": F.lit("article")})


def okapi(docs: list[list[str]], query: list[str]) -> list[float]:
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query) for d in docs]


def test_search_many_is_search(spark, chunks):
    spec = retrieval.SearchSpec
    specs = {"a": spec("", [1.0] * 8, 2, scaled=False), "b": spec("", [0.5, -1.0] * 4, 3, only=fusion.ChunkFilter(sections=["methods"]), scaled=False), "c": spec("H2S", [1.0] * 8, 2, hybrid=True, scaled=False), "d": spec("", [1.0] * 8, 4, only=fusion.ChunkFilter(doc_type="book"), scaled=False)}
    got = {(r.qid, r.rank, r.id, round(r.score, 6)) for r in retrieval.search_many(chunks, specs).collect()}
    want = {(q, r.rank, r.id, round(r.score, 6)) for q, s in specs.items() for r in retrieval.search(chunks, s).collect()}
    assert got == want and {q for q, *_ in got} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        retrieval.search_many(chunks, {})


def test_a_batch_has_one_plan_and_a_row_for_each_bad_question(spark, chunks):
    good = ("H2S gas", [1.0] * 8, 2, True, None, None, None, ["methods"], None, None, None, False)
    bad = {
        "no vector": ("gas", None, 2, False),
        "short": ("gas", [1.0], 2, False),
        "nan": ("gas", [float("nan")] * 8, 2, False),
        "no k": ("gas", [1.0] * 8, 0, False),
        "no text": (" ", [1.0] * 8, 2, True),
        None: ("gas", [1.0] * 8, 2, False),
        "twice": ("gas", [1.0] * 8, 2, False),
    }
    rows = [("a", *good), *((q, *x, *[None] * 8) for q, x in bad.items()), ("twice", *bad["no k"], *[None] * 8)]
    got = retrieval.search_batch(chunks, spark.createDataFrame(rows, retrieval.QUESTIONS)).collect()
    wrong = [r for r in got if r.error is not None]
    assert sorted(str(r.qid) for r in wrong) == sorted([*map(str, bad), "twice"]) and all(r.id is None and r["rank"] is None for r in wrong)
    want = retrieval.search(chunks, retrieval.SearchSpec("H2S gas", [1.0] * 8, 2, True, fusion.ChunkFilter(sections=["methods"]), False)).collect()
    assert [(r.id, r["rank"], round(r.score, 9)) for r in got if r.error is None] == [(r.id, r["rank"], round(r.score, 9)) for r in want]
    size = lambda n: len(retrieval.search_batch(chunks, spark.createDataFrame([(f"q{i}", "gas", [float(i + 1)] * 8, 2, i % 2 == 0, None, None, None, None, 1990 + i, None, None, False) for i in range(n)], retrieval.QUESTIONS))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(3) == size(60)
    assert retrieval.search_batch(chunks, spark.createDataFrame([], retrieval.QUESTIONS)).count() == 0
    assert retrieval.search_batch(chunks.where("id < 0"), spark.createDataFrame(rows[:1], retrieval.QUESTIONS)).count() == 0


def test_filters_of_a_batch_are_those_of_one(spark, chunks):
    only = [fusion.ChunkFilter(**k) for k in ({"type": "text"}, {"type": "table"}, {"paper": "2001_A"}, {"paper": "1_A"}, {"paper": ["2001_a_b", "x"]}, {"sections": ["methods", "y"]}, {"year_start": 2002}, {"year_end": 2002}, {"doc_type": "article", "year_start": 2001, "year_end": 2003})]
    specs = {str(i): retrieval.SearchSpec("", [1.0] * 8, 5, only=f, scaled=False) for i, f in enumerate(only)}
    got = {(r.qid, r.id) for r in retrieval.search_many(chunks, specs).collect()}
    assert got == {(str(i), r.id) for i, f in enumerate(only) for r in chunks.where(f.condition()).collect()}


def test_bm25_both_ways(spark, chunks):
    docs = [r.toks for r in lexical.tokenized(chunks, "id", "text").orderBy("id").collect()]
    query = "H2S gas h2s"
    from tests.test_text_ids import python_tokens

    want = {i: pytest.approx(s) for i, s in enumerate(okapi(docs, python_tokens(query))) if s > 0}
    assert {r.id: r.score for r in lexical.bm25_query(chunks, query, "id").collect()} == want
    many = lexical.bm25_scores(chunks, spark.createDataFrame([(7, query), (8, "zzz")], "qid long, query string"), "id")
    assert {r.id: r.score for r in many.collect()} == want
    assert lexical.bm25_query(chunks, "!", "id").count() == 0
    assert lexical.bm25_query(chunks.where("id < 0"), "gas", "id").count() == 0


def test_nearest_many_equals_one(spark, chunks):
    q = chunks.where("id in (1, 3)").select("id", "embedding")
    found = dense.nearest_many(chunks, q, 3, "id", "id").collect()
    for i in (1, 3):
        v = chunks.where(F.col("id") == i).first().embedding
        one = [(r.id, r.distance) for r in dense.nearest(chunks, v, 3, "id", scaled=False).collect()]
        assert [(r.id, r.distance) for r in sorted(found, key=lambda r: r.rank) if r.qid == i] == one
        assert one[0] == (i, 0)
    assert dense.nearest_many(chunks, q.where("id < 0"), 3, "id", "id").count() == 0


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id long, rank int")
    one, two = ({r.id: round(r.score, 12) for r in fusion.rrf(x).collect()} for x in ([a, b], [b, a]))
    assert one == two == {1: round(1 / 61, 12), 2: round(1 / 62 + 1 / 61, 12), 3: round(1 / 62, 12)}


def test_filters(chunks):
    count = lambda **k: chunks.where(fusion.ChunkFilter(**k).condition()).count()
    assert count() == 5 and count(paper="2001_A") == 1 and count(paper=["2001_a_b", "x"]) == 1
    assert count(sections=["methods"]) == 2 and count(year_start=2003) == 2 and count(year_end=2000) == 1
    assert count(doc_type="book") == 0 and count(type="") == 5


def test_null_years(spark):
    rows = spark.createDataFrame([(None, None), (2000, 0.5)], "year int, quality_score double").withColumns({"doi": F.lit("x"), "title": F.lit("t"), "authors": F.lit(None).cast("string"), "journal": F.lit("j")})
    assert rows.where(fusion.export_condition(1990, 2010)).count() == 2
    assert rows.where(fusion.catalogue_condition(year_start=1990, year_end=2010)).count() == 1
    assert rows.where(fusion.export_condition(quality=0.4)).count() == 1
    assert rows.where(fusion.catalogue_condition("T", ["j"], doi="with")).count() == 2
    assert rows.where(fusion.catalogue_condition(doi="without")).count() == 0


@pytest.mark.parametrize("k,least,want", [(4, 2, [("corpus", 1), ("attachment", 2), ("corpus", 3), ("attachment", 9)]), (1, 5, [("attachment", 2)]), (3, 0, [("corpus", 1), ("attachment", 2), ("corpus", 3)])])
def test_dense_fusion(spark, k, least, want):
    corpus = spark.createDataFrame([(1, 0.1), (3, 0.3), (4, 0.4)], "id long, distance double")
    attached = spark.createDataFrame([(2, 0.2), (9, 0.9)], "id long, distance double")
    got = fusion.fuse_dense(corpus, attached, k, least).orderBy("position").collect()
    assert [(r.source, r.id) for r in got] == want


def test_hybrid_fusion_puts_the_quota_first(spark):
    corpus = spark.createDataFrame([(1, 0.03), (3, 0.02)], "id long, score double")
    attached = spark.createDataFrame([(2, 0.9), (9, 0.1)], "id long, distance double")
    got = fusion.fuse_hybrid(corpus, attached, 3, 1).orderBy("position").collect()
    assert [(r.source, r.id) for r in got] == [("attachment", 9), ("corpus", 1), ("corpus", 3)]


def test_search_filters_after_fusing(chunks):
    v = chunks.where("id = 0").first().embedding
    all_ = retrieval.search(chunks, retrieval.SearchSpec("h2s", v, 5, True, scaled=False)).collect()
    some = retrieval.search(chunks, retrieval.SearchSpec("h2s", v, 5, True, fusion.ChunkFilter(sections=["results"]), False)).collect()
    assert [(r.id, r.score) for r in some] == [(r.id, r.score) for r in all_ if r.section_canonical == "results"]
    near = retrieval.search(chunks, retrieval.SearchSpec("", v, 2, scaled=False))
    assert near.first().id == 0
    assert retrieval.deepen(chunks, retrieval.SearchSpec("", v, 2, scaled=False), ["2003_a_b"]).count() == 1
    assert fusion.pool_size(8, 1000, False) == 200 and fusion.pool_size(30, 1000, False) == 300 and fusion.pool_size(8, 1000, True) == 1000


def test_index_care(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    assert dense.integrity(vectors, vectors, True).first().ok
    assert dense.integrity(vectors, vectors.limit(1), False).first().problems == "count,flag"
    with pytest.raises(ValueError, match="norm"):
        dense.assert_integrity(spark.createDataFrame([(1, [3.0, 4.0])], "id long, embedding array<double>"), vectors.limit(1), True)
    gone = vectors.where("id < 0")
    kept, new = dense.incremental(vectors, gone, "id")
    assert kept.count() == 2 and new.count() == 0  # no chunks at all: nothing is pruned
    kept, new = dense.incremental(vectors, spark.createDataFrame([(2,), (3,)], "id long"), "id")
    assert [r.id for r in kept.collect()] == [2] and [r.id for r in new.collect()] == [3]
    kept, new = dense.incremental(vectors, vectors, "id", same_model=False)
    assert kept.count() == 0 and new.count() == 2
    a = spark.createDataFrame([("b", "1"), ("c", "2")], "book_id string, sha256 string")
    kept, new = dense.incremental_by_hash(a, spark.createDataFrame([("b", "1"), ("c", "9")], "book_id string, sha256 string"))
    assert [r.book_id for r in kept.collect()] == ["b"] and [r.book_id for r in new.collect()] == ["c"]


def test_evaluation(spark):
    rankings = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "qid long, item string, position int")
    relevant = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "qid long, item string")
    judged = {r.qid: (r.hit, r.rr, r.first_position) for r in evaluation.judge(rankings, relevant, 8).collect()}
    assert judged == {1: (1, 0.5, 2), 2: (0, 0.0, None), 3: (0, 0.0, None)}
    lines = spark.createDataFrame([("r", 1, 5, None, None), ("r", 2, None, "a", "x"), ("r", 3, None, "b", ""), ("r", 4, 6, "c", "X ")], "review string, seq int, qid long, item string, mark string")
    marked = evaluation.reviewed(lines)
    assert {(r.qid, r.item) for r in marked.collect()} == {(5, "a"), (6, "c")}
    with pytest.raises(ValueError, match="unknown items: c"):
        evaluation.golden(marked, spark.createDataFrame([("a",)], "item string"))


def test_numbering(spark):
    from lexloom.operators.ranking import numbered

    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("v"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"))
    assert {(r.v, r.rank) for r in numbered(rows, [F.col("v")]).collect()} == {(i, i) for i in range(5000)}
    got = numbered(rows, [F.desc("v")], "n", ["g"]).collect()
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: -r.v)
        assert [r.n for r in own] == list(range(len(own)))
    assert numbered(rows.where("id < 0"), [F.col("v")]).count() == 0
    wide = fusion.ranked(rows, [F.col("v"), F.col("id")], fusion.ONE_TASK + 1)
    assert wide.count() == 5000 and fusion.ranked(rows, [F.col("v"), F.col("id")], 3).orderBy("rank").first().v == 0


def test_neighbours_by_blocks(spark, monkeypatch):
    """Blocks of any size give what every pair, held against each other, gives."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (70, 3)).astype(float)  # with ties
    x[x.any(axis=1) == 0] = 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    u = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    d = np.round(((u[:, None] - u[None]) ** 2).sum(axis=2), 6)
    want = {(q, int(i), r + 1) for q in range(70) for r, i in enumerate([i for i in np.lexsort((np.arange(70), d[q])) if i != q][:4])}
    for size in (8 << 20, 8 * 3 * 9):
        monkeypatch.setattr(dense, "PART_BYTES", size)
        found = dense.nearest_many(df, df, 4, drop_self=True)
        assert {(r.qid, r.id, r.rank) for r in found.collect()} == want
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- inverted index ------------------------------------------------------------


@pytest.fixture
def small_stripes(monkeypatch):
    from lexloom.operators import inverted

    monkeypatch.setattr(inverted, "STRIPE", 2)
    monkeypatch.setattr(inverted, "FIRST", 1)
    return inverted


def test_index_equals_scan_through_refreshes(spark, tmp_path, small_stripes):
    import random

    rng = random.Random(2)
    text = lambda: " ".join(rng.choices(["gas", "H2S", "bio-gas", "agua", "x1", "the", "the", "the"], k=rng.randrange(12)))
    rows = {i: text() for i in range(60)}
    rows[7] = None
    index = small_stripes.InvertedIndex(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "H2S gas"), (2, "the the agua"), (3, "zzz"), (4, ""), (5, "biogas x1 bio-gas")], "qid long, query string")

    def check():
        docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        want = lexical.top_by_query(lexical.bm25_scores(docs, asked), 5).collect()
        got = index.top(asked, 5).collect()
        assert sorted((r.qid, r["rank"], r.id, r.score) for r in got) == sorted((r.qid, r["rank"], r.id, r.score) for r in want)
        assert index.integrity().first().ok
        return docs

    assert index.refresh(spark.createDataFrame(list(rows.items()), "doc_id long, text string")) == (60, 0)
    docs = check()
    seq = index.store.manifest()["seq"]
    assert index.refresh(docs.unionByName(docs)) is None and index.store.manifest()["seq"] == seq
    rows |= {100: "gas gas gas", 3: "H2S the", 4: None}
    del rows[9], rows[10]
    assert index.refresh(spark.createDataFrame(list(rows.items()), "doc_id long, text string")) == (3, 4)
    check()
    rows[10] = "agua"
    index.refresh(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    check()
    index.compact()
    check()
    rows.clear()
    index.refresh(spark.createDataFrame([], "doc_id long, text string"))
    assert index.top_one("gas", 3).count() == 0 and index.integrity().first().n_docs == 0


def test_an_index_grows_and_shrinks(spark, tmp_path, small_stripes):
    index = small_stripes.InvertedIndex(spark, str(tmp_path / "index"))
    rows = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    assert index.remove(rows({1: "x"})) is None
    assert index.add(rows({1: "gas", 2: "gas gas"})) == (2, 0)
    assert index.add(rows({2: "H2S", 3: None})) == (2, 1)
    assert index.add(rows({2: "H2S", 3: None})) is None
    assert index.remove(rows({1: None, 9: None})) == (0, 1)
    docs = rows({2: "H2S", 3: None})
    assert [(r.id, r.score) for r in index.top_one("h2s gas", 3).collect()] == [(r.id, round(r.score, 6)) for r in lexical.bm25_query(docs, "h2s gas", "doc_id").collect()]
    row = index.integrity().first()
    assert row.ok and row.n_docs == 2
    assert index.refresh(docs, marks="m") is None and index.marks() == "m"


def test_index_reads_its_terms_only(spark, tmp_path, small_stripes):
    rows = [(i, " ".join(["gas"] * (1 + i % 3) + [f"w{i}"] * (i % 40) + ["rare"] * (i in (5, 90)))) for i in range(120)]
    index = small_stripes.InvertedIndex(spark, str(tmp_path / "index"))
    index.refresh(spark.createDataFrame(rows, "doc_id long, text string"))
    found = index.top_one("rare gas", 2)
    assert [r.id for r in found.orderBy("rank").collect()][0] in (5, 90)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term, [gas,rare])" in plan
    # Of the stripes, those that can't reach the second best aren't scored.
    tables = index.tables()
    asked, few = index._asked(tables, spark.createDataFrame([(0, "rare gas")], "qid int, query string"), "qid", "query")
    bounds = index.bounds(asked, few, tables["postings"])
    best = min(r.score for r in found.collect())
    assert 0 < bounds.where(F.col("bound") >= best - 1e-6).count() < bounds.count() / 4
    # Files of terms in other partitions aren't listed in the scan.
    assert {r.bucket for r in index._of(tables["postings"], few).select("bucket").distinct().collect()} <= {b for b, _ in few}
