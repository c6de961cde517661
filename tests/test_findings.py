"""What a reviewer found on odd inputs and larger tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lexloom.operators import exports
from lexloom.plans import catalog

from test_oracles import rows


def against_sql(spark, tmp_path, name: str, **tables: pd.DataFrame) -> None:
    """Holds a query against its SQL over the given tables."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.to_parquet(f"{tmp_path}/{t}.parquet", index=False)
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), c.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_first_pages_with_headers_of_all_kinds(spark, tmp_path):
    """Lines that begin with four digits, a mail address or another sign of a journal's header, in SQL too."""
    begins = ["4763047826333361 Of thnd enndsh", "of.92@mail6.example.com and", "vol. 7 of", "ISSN 1234 of", "doiñ of", "Palabras clave are", "1 word of", "© all of", "graphical abstract of", "Received : then", "Accepted:", "plain words", "Highlights of", "abstract\nabstract\nof"]
    texts = [f"{b} this text is long enough for a dense line of words. And it has a second sentence which is long as well. Third." for b in begins]
    docs = pd.DataFrame({"doc_id": range(4 * len(texts)), "text": [t for t in texts for _ in range(4)], "lang": ["en", None] * (2 * len(texts)), "source": "s", "n_chars": 1})
    against_sql(spark, tmp_path, "first_pages", documents=docs)


def test_master_index_of_over_999_packages(spark):
    manifests = spark.createDataFrame([("a", p, 1) for p in (999, 1001, 1000, 7)], "category string, package int, n_papers long")
    assert exports.master_index(manifests).first().packages == "007,999,1000,1001"


def test_quality_meets_every_reference_however_many(spark, monkeypatch):
    """The same verdicts and distances where references go into the plan as values and where they are an array."""
    from lexloom.llm import quality

    lines = ["plain words of a text in lower case letters ", "Ein Text, MIT GROSSEN 12 Zeichen! ", "1 2 3 4 5 six 7 8 9 ten 11 12 "]
    rows_ = [(i, lines[i % 3] * 8 + f"word{i}", f"x{i % 9 // 3}{i % 3}") for i in range(27 * 9)]
    rows_ += [(1000 + i, lines[i] * 8, name) for i in range(3) for name in ("x00", None, "other")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string").coalesce(2)
    order = lambda: sorted(map(tuple, quality.judge(docs).collect()))
    want = order()
    monkeypatch.setattr(quality, "MOST_REFERENCES", 2)
    assert order() == want and any(r[-2] is not None for r in want)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_results_are_numbered_over_partitions(spark):
    from lexloom.operators import citations

    papers = spark.range(50).selectExpr("concat('p', id) AS paper_id", "array(named_struct('full', 'Bo Li', 'forename', 'Bo', 'surname', 'Li')) AS authors", "2000 AS year", "'t' AS title", "'' AS doi")
    found = citations.cited(papers.selectExpr("paper_id", "cast(substr(paper_id, 2) AS long) * 3 AS rank"), papers)
    assert sorted((r.rank, r.n) for r in found.collect()) == [(3 * i, i + 1) for i in range(50)]
    assert "windowspecdefinition(rank" not in plan_of(found)


def test_decisions_are_sorted_in_bounded_tasks(spark, monkeypatch):
    from lexloom.operators import dedup

    monkeypatch.setattr(dedup, "TASK_ROWS", 10)
    papers = spark.range(200).selectExpr("concat('d', id div 4) AS doi", "concat('c', id % 2) AS category", "concat('s', id) AS stem", "id AS line_no", "1 AS completeness", "0 AS relevance")
    found = dedup.decide(papers, across=True)
    assert found.count() == 150 and ", 20)" in plan_of(found)


def test_a_cell_of_the_grid_is_one_table(spark):
    import pyarrow as pa

    from lexloom.operators import dense

    own = pa.table({"id": pa.array(range(30), pa.int64()), "v": pa.array([[1.0, float(i)] for i in range(30)]), "passes": pa.array([None] * 30, pa.list_(pa.int32()))})
    asked = pa.table({"qid": pa.array(range(20), pa.int64()), "v": pa.array([[1.0, float(i)] for i in range(20)]), "keep": pa.array([3] * 20), "only": pa.array([None] * 20, pa.int32()), "scaled": pa.array([None] * 20, pa.bool_())})
    found = dense._cell(own, asked, True)
    assert found.num_rows == 60 and found.column("id").num_chunks == 1
    assert found.slice(0, 1).to_pylist()[0]["qid"] == 0 and all(r["qid"] != r["id"] for r in found.to_pylist())


def test_files_of_round_trips_stay_small(spark, tmp_path, monkeypatch):
    """More documents are more files, not larger ones."""
    from lexloom.plans import catalog_files

    docs = pd.DataFrame({"doc_id": range(40), "text": ['a "text"\nof two lines'] * 40, "lang": "en", "source": "s", "n_chars": 1})
    for name, folder in (("jsonl_round_trip", "jsonl"), ("csv_round_trip", "csv")):
        monkeypatch.setattr(catalog_files, "FILE_ROWS", 3)
        at = f"{tmp_path}/{folder}-out"
        monkeypatch.setattr(catalog_files, "fresh_folder", lambda s, n, at=at: at)
        against_sql(spark, tmp_path, name, documents=docs)
        assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at).where("path not like '%_SUCCESS'").count() >= 13


def test_batches_of_the_index_are_bounded(spark, tmp_path):
    from lexloom.operators import ranking
    from lexloom.operators.inverted import InvertedIndex

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    InvertedIndex(spark, str(tmp_path)).refresh(spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == ranking.BATCH_BYTES


def test_tei_reads_the_asked_columns_only(spark, monkeypatch):
    from lexloom.operators import tei

    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>t</title></teiHeader><text><body><div><head>A</head><p>b \n c</p></div></body></text></TEI>'
    docs = spark.createDataFrame([("p", xml), ("q", "<"), ("r", None)], "paper_id string, tei_xml string")
    assert [tuple(r) for r in tei.read_tei(docs, ["markdown"]).collect()] == [("p", "## A\n\nb c")]
    assert tei.read_tei(docs).columns == [c.name for c in spark.createDataFrame([], tei.PARSED).schema]
    whole = tei.parse_tei(xml)
    for name in whole:
        assert tei.parse_tei(xml, {name}) == {name: whole[name]}


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """A bad word of few texts among many is learned wherever it lies; tasks are averaged, long texts are learned whole."""
    import numpy as np
    import pyarrow as pa

    from lexloom.llm import toxicity

    monkeypatch.setattr(toxicity, "TASK_ROWS", 1000)
    filler = "concat_ws(' ', transform(sequence(1, 12), i -> concat('w', char(97 + pmod(hash(id, i), 26)), char(97 + pmod(hash(id, i, 1), 20)))))"
    docs = spark.range(9000).selectExpr("id AS doc_id", f"concat({filler}, CASE WHEN id % 300 = 7 THEN ' horrid' WHEN id % 5 = 0 THEN ' vile' ELSE '' END) AS text", "'en' AS lang", "int(id % 300 = 7 OR id % 5 = 0) AS toxic")
    rows_ = toxicity.labelled(docs, docs)
    assert rows_.count() == docs.where(~toxicity.held_out()).count()  # of both classes, more than 2500 each is allowed
    model = toxicity.fit(docs, docs)
    found = toxicity.score(docs, model).join(docs.select("doc_id", "toxic"), "doc_id").where("held_out")
    assert found.where("predicted <> toxic").count() < 0.01 * found.count()
    texts = pa.array(["good words of a text", "vile horrid words", "", "good words of a text"])
    alone = [float(model.scores(texts.slice(i, 1))[0]) for i in range(4)]
    assert np.allclose(model.scores(texts), alone, atol=1e-6)  # a text's score has nothing of its neighbours in it


def test_long_texts_are_learned_whole():
    import numpy as np
    import pytest

    from lexloom.llm import convnet, toxicity

    rng = np.random.default_rng(3)
    text = rng.integers(0, toxicity.BUCKETS, (500, 2))
    begin = lambda: convnet.Learner.begin(2, toxicity.BUCKETS, 2, dim=8, widths=(1, 2, 3), filters=6, rate=0.01, row_rate=0.1, scale=0.3, rng=np.random.default_rng(1))
    a, b = begin(), begin()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "SLICE", 64)
        short = toxicity.heads(b.net, text)
    a.step([text], np.array([1]), None)
    b.step([short], np.array([1]), None)
    assert len(short[0]) <= 54 and all(np.allclose(x, y, atol=1e-6) for x, y in zip(a.dense(), b.dense(), strict=True)) and all(np.allclose(x, y, atol=1e-6) for x, y in zip(a.net.tables, b.net.tables, strict=True))


DIR = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_papers_are_not_computed_for_other_tables(spark):
    """A filter on what is made of an order's key would be computed for every line of an order, too."""
    for name in ("known_dois", "doi_origins"):
        assert not [x for x in optimized(catalog.queries()[name](spark, DIR)).splitlines() if "Filter" in x and "10.1000_X" in x]


def test_paper_ids_compute_their_parts_once(spark):
    plan = optimized(catalog.queries()["made_ids"](spark, DIR))
    assert plan.count("translate(") <= 4  # accents of a surname and of a title


def test_folders_of_the_scan_are_written_from_one_reading(spark, monkeypatch):
    from lexloom.plans import catalog_files
    from lexloom.sources import writers

    plans, write = [], writers.write_jsonl
    monkeypatch.setattr(catalog_files.writers, "write_jsonl", lambda df, path: (plans.append(plan_of(df)), write(df, path)))
    assert catalog.queries()["corpus_scan"](spark, DIR).count() > 0
    assert len(plans) > 1 and not any("l_orderkey" in p for p in plans)


def test_questions_meet_postings_where_their_documents_are(spark, monkeypatch):
    """A term that all documents have is no task of its own, and scores aren't shuffled; without broadcasts they are the same."""
    from lexloom.operators import lexical

    docs = spark.range(60).selectExpr("id AS doc_id", "concat('common w', id % 7, ' w', id % 11, ' w', id % 5) AS text")
    asked = spark.createDataFrame([(1, "w1 common common"), (2, "w3 w4"), (3, "none")], "qid int, query string")
    scores = lexical.bm25_scores(docs, asked)
    got = sorted((r.qid, r.id, round(r.score, 9)) for r in scores.collect())
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan and "hashpartitioning(id" in plan and len(got) > 60
    monkeypatch.setattr(lexical, "MOST_WEIGHTS", 0)
    assert sorted((r.qid, r.id, round(r.score, 9)) for r in lexical.bm25_scores(docs, asked).collect()) == got


def test_ranks_are_counted_where_candidates_need_them(spark, monkeypatch):
    """A batch's fused results are those of whole rankings, with filters that few pass, many equal scores and texts of no vector."""
    import numpy as np

    from lexloom.operators import blocks
    from lexloom.operators.lexical import bm25_scores
    from lexloom.plans import retrieval

    rng = np.random.default_rng(7)
    n, said = 300, [" ".join(f"w{int(x)}" for x in rng.integers(0, 12, 5)) for _ in range(40)]
    vectors = [None if i % 6 == 5 else [float(x) for x in np.round(rng.normal(size=3), 1)] for i in range(n)]
    rows_ = [(i, said[i % 40], vectors[i], "rare" if i % 97 == 3 else "late" if i > 240 else "common") for i in range(n)]
    chunks = spark.createDataFrame(rows_, "id long, text string, embedding array<double>, section_canonical string").repartition(3)
    kinds = {"a": None, "b": ["rare"], "c": ["late"], "d": ["common", "late"], "e": ["none"]}
    asked = [(q, f"w1 w{i} w{i + 4}", [1.0, float(i), -1.0], 6, True, None, None, None, s, None, None, None, i % 2 == 0) for i, (q, s) in enumerate(kinds.items())]
    questions = spark.createDataFrame(asked, retrieval.QUESTIONS)
    lexical = {(r.qid, r.id): round(r.score, 6) for r in bm25_scores(chunks, questions.selectExpr("qid", "text AS query"), "id").collect()}
    want = set()
    for q, _, v, k, *_, sections, _, _, _, scaled in asked:
        unit = lambda x: np.asarray(x) / np.sqrt((np.asarray(x) ** 2).sum())
        far = sorted((round(float((((np.asarray(x) if scaled else unit(x)) - unit(v)) ** 2).sum()), 6), i) for i, x in enumerate(vectors) if x)
        near = sorted((-s, i) for (o, i), s in lexical.items() if o == q)
        pool = n if sections else 200
        score = {}
        for ranking in (far, near):
            for rank, (_, i) in enumerate(ranking[:pool]):
                score[i] = score.get(i, 0) + 1 / (61 + rank)
        best = sorted((-round(s, 9), i) for i, s in score.items() if not sections or rows_[i][3] in sections)[:k]
        want |= {(q, i, -s, rank) for rank, (s, i) in enumerate(best)}
    rounds, found = [], blocks.candidates
    monkeypatch.setattr(blocks, "candidates", lambda scored, times, kind: (rounds.append(times), found(scored, times, kind))[1])
    for first, size in ((80, 8192), (-11, 40)):
        monkeypatch.setattr(blocks, "FIRST", first)
        monkeypatch.setattr(blocks, "PART_ROWS", size)
        monkeypatch.setattr(blocks, "ROW_DOCS", size // 2)
        monkeypatch.setattr(blocks, "MORE", 3)
        monkeypatch.setattr(blocks, "PART_QUESTIONS", 1024 if first > 0 else 2)
        got = {(r.qid, r.id, r.score, r["rank"]) for r in retrieval.search_batch(chunks, questions).collect()}
        assert got == want
    assert len(rounds) > 3  # one candidate of each ranking is too few


def test_a_dense_batch_tokenizes_nothing(spark, monkeypatch):
    from lexloom.operators import lexical

    monkeypatch.setattr(lexical, "tokens", None)
    assert catalog.queries()["batch_questions"](spark, DIR).count() > 0


def test_the_index_sorts_texts_once_and_no_tokens(spark, tmp_path, monkeypatch):
    from lexloom.operators import inverted

    plans, keep = [], inverted.checkpointed
    monkeypatch.setattr(inverted, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    docs = spark.createDataFrame([(i, f"a b{i % 3}") for i in range(20)] * 2, "doc_id long, text string")
    index = inverted.InvertedIndex(spark, str(tmp_path))
    assert index.refresh(docs) == (20, 0) and index.integrity().first().ok
    built = next(p for p in plans if "term_counts" in p)
    assert built.count("Exchange ") == 1 and not [x for x in built.splitlines() if "Sort [" in x and "toks" in x]


def bytes_under(*folders):
    return sum(os.path.getsize(os.path.join(at, f)) for folder in folders for at, _, files in os.walk(folder.removeprefix("file:")) for f in files)


def index_texts(n):
    words = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in ("a", "e", "ion", "ou") for c in ("ba", "ter", "x", "lich", "te", "s")]
    return [(i, " ".join(words[(i * 7919 + j * j * 31) % len(words)] for j in range(20 + i % 180))) for i in range(n)]


def test_an_index_takes_little_room(spark, tmp_path):
    """Checkpoints of lists of terms and a row for each block took many times the texts' room."""
    from lexloom.operators.inverted import InvertedIndex
    from lexloom.operators.ranking import shared_folder

    rows = index_texts(600)
    docs, shared = spark.createDataFrame(rows, "doc_id long, text string"), shared_folder(spark)
    before, index = bytes_under(shared), InvertedIndex(spark, str(tmp_path))
    index.refresh(docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text"))))
    index.refresh(docs)
    index.compact()
    assert index.integrity().first().ok and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    left = bytes_under(shared) - before
    assert left < 50_000, left  # of what was built in between nothing stays
    own = bytes_under(str(tmp_path / "data" / "forward"), str(tmp_path / "data" / "postings"))
    assert own < 3.2 * sum(len(t) for _, t in rows), own


def test_an_index_is_the_same_however_it_is_dealt(spark, tmp_path, monkeypatch):
    from lexloom.operators import inverted, lexical

    rows = [*index_texts(24), (24, None), (25, ""), (26, "x " * 300), (27, "ñandú αβγ h2s-x1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "baba x tex"), (2, rows[7][1]), (3, "x1 nandu αβγ"), (4, "zzz")], "qid long, query string")
    want = {(r.qid, r["rank"], r.id, r.score) for r in lexical.top_by_query(lexical.bm25_scores(docs, asked), 7).collect()}
    for name, value in (("HELD", 50), ("PART", 20), ("SENT", 10), ("ROW", 2), ("STRIPE", 2), ("FIRST", 1)):
        monkeypatch.setattr(inverted, name, value)
    index = inverted.InvertedIndex(spark, str(tmp_path))
    index.add(docs.withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.lit("baba nothing")).otherwise(F.col("text"))))
    assert index.add(docs) == (7, 7)
    assert {(r.qid, r["rank"], r.id, r.score) for r in index.top(asked, 7).collect()} == want
    index.compact()
    assert {(r.qid, r["rank"], r.id, r.score) for r in index.top(asked, 7).collect()} == want and index.integrity().first().ok


def test_many_questions_shuffle_no_postings_of_their_own(spark, tmp_path, monkeypatch):
    """Postings go to their stripes once, not once for each question; of very many terms too."""
    import re

    from lexloom.operators import inverted, lexical

    rows = index_texts(30)
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in rows[::6]], "qid long, query string")
    want = {(r.qid, r["rank"], r.id, r.score) for r in lexical.top_by_query(lexical.bm25_scores(docs, asked), 4).collect()}
    index = inverted.InvertedIndex(spark, str(tmp_path))
    index.refresh(docs)
    for terms, weights in ((5000, 500_000), (1, 500_000), (1, 1)):
        monkeypatch.setattr(inverted, "MOST_TERMS", terms)
        monkeypatch.setattr(lexical, "MOST_WEIGHTS", weights)
        monkeypatch.setattr(inverted, "MOST_WEIGHTS", weights, raising=False)
        found = index.top(asked, 4)
        assert {(r.qid, r["rank"], r.id, r.score) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert weights == 1 or not re.search(r"Exchange hashpartitioning\(qid#\d+L?, segment#", plan)
