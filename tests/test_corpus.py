"""Chunks, pages, TEI, sources and flows."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.operators import chunking, pages, tei
from lexloom.plans import flows
from lexloom.sources import providers, readers, writers


def words(n: int, start: int = 0) -> str:
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_packing_hands_on_its_tail():
    got = chunking.pack_words(f"{words(6)}\n\n{words(5, 6)}\n\n{words(2, 11)}", target=10, overlap=3)
    assert got == [words(6), f"w3 w4 w5\n\n{words(5, 6)}\n\n{words(2, 11)}"]


def test_long_paragraphs_stand_alone():
    assert chunking.pack_words(words(12), 10, 3) == [words(12)]  # 1.2 targets are still packed
    got = chunking.pack_words(f"{words(2)}\n\n{words(15, 2)}\n\n{words(1, 17)}", 10, 3)
    assert got == [words(2), words(10, 2), words(8, 9), words(1, 16), words(1, 17)]


def test_sql_windows_equal_the_packer(spark):
    texts = ["", " a  b\nc ", words(1020), words(1021), words(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a = {(r.doc_id, r.chunk_index): r.chunk for r in chunking.chunk_windows(rows).collect()}
    b = {(r.doc_id, r.chunk_index): r.chunk for r in chunking.chunk_texts(rows).collect()}
    assert a == b and len(a) == 1 + 1 + 2 + 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), max_size=5), st.integers(5, 30))
def test_pieces_fit_and_lose_nothing(parts, most):
    text = "\n\n".join(parts)
    got = chunking.split_chars(text, most)
    assert all(0 < len(p) <= most for p in got)
    assert "".join("".join(got).split()) == "".join(text.split())


def test_splitting_prefers_lines():
    assert chunking.split_chars("row one\nrow two\n\nx", 10) == ["row one", "row two\n\nx"]
    assert chunking.split_chars("aaaaaaaaaaaa", 5) == ["aaaaa", "aaaaa", "aa"]
    assert chunking.split_chars(None) == []


COVER = "# A title with methods\n\n**Authors:** A. Person\n\n**Year:** 2020\n\n## Results\n\nSome text.\n\n### Details\n\nMore.\n\n## References\n\n[1] x"


def test_sections_and_covers():
    got = chunking.article_pieces(COVER)
    assert [(p["section"], p["section_canonical"], p["section_part"]) for p in got] == [("Results", "results", 1), ("Details", "results", 1)]
    assert got[0]["text"].startswith("**Authors:**") and got[0]["text"].endswith("Some text.")
    assert chunking.cover_residue("no cover") is None
    assert chunking.cover_residue("**Authors:** x\nabc") == 3
    alone = [{"text": "**Authors:** x", "section": "s"}]
    assert chunking.merge_covers(alone) == alone


def test_tables_repeat_their_head():
    body = "\n\n".join(f"| {i} | {'x' * 3000} |" for i in range(5))
    got = chunking.table_pieces([{"title": "T", "table_id": "t1", "header": "## T\n\ncaption", "body": body}])
    assert len(got) > 1 and all(p["text"].startswith("## T\n\ncaption") and len(p["text"]) <= 8000 for p in got)


def test_attachments(spark):
    text = "\n\n".join("p" * 400 for _ in range(4)) + "\n\ntiny"
    got = chunking.pack_chars(text)
    assert got[1].startswith("p" * 150) and chunking.pack_chars("short") == []
    rows = chunking.chunk_attachments(spark.createDataFrame([("f.txt", text)], "file string, text string")).collect()
    assert rows[0].paper_id == "__attachment__" and len(rows) == len(got)


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Odour removal</title></titleStmt>
<sourceDesc><biblStruct><analytic><author><persName><forename>A n a</forename><surname>Nuñez</surname></persName></author>
<author><persName><forename>Ana</forename><surname>Nuñez</surname></persName></author><idno type="DOI">10.1000/x</idno></analytic>
<monogr><title level="j">Journal X</title><imprint><date when="2019-05-01"/></imprint></monogr></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short abstract.</p></abstract></profileDesc></teiHeader>
<text><body><div><head>Introduction</head><p>Hello world.</p><div><head>Sub</head><p>More.</p></div></div>
<figure type="table" xml:id="tab_0"><head>Table 1</head><figDesc>Runs</figDesc><table><row><cell>Exp.</cell><cell>v</cell></row>
<row><cell>1</cell><cell>a</cell></row><row><cell></cell><cell>b</cell></row><row><cell>2</cell><cell>c</cell></row></table></figure></body>
<back><div><listBibl><biblStruct><analytic><title level="a">Ref</title><author><persName><surname>Z</surname></persName></author></analytic><monogr><title level="j">J</title><imprint><date when="2001"/></imprint></monogr></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei():
    got = tei.parse_tei(TEI)
    assert (got["title"], got["doi"], got["journal"], got["year"]) == ("Odour removal", "10.1000/x", "Journal X", 2019)
    assert [a["full"] for a in got["authors"]] == ["Ana Nuñez"]
    assert "## Introduction\n\nHello world.\n\n### Sub\n\nMore." in got["markdown"]
    assert got["tables"][0]["body"] == "| Exp. | v |\n| 1 | a |\n|  | b |\n\n| 2 | c |"
    assert got["references"][0]["title"] == "Ref" and got["references"][0]["year"] == 2001
    assert tei.parse_tei("no xml") is None and tei.parse_tei(None) is None


def test_article_flow(spark):
    rows = spark.createDataFrame([("2019_nunez_odour", TEI), ("bad", "<x")], "paper_id string, tei_xml string")
    before = spark.createDataFrame([("2019_nunez_odour", "Kept title", "", None, 0, None)], "paper_id string, title string, doi string, journal string, year int, authors array<struct<full:string,forename:string,surname:string>>")
    out = flows.process_articles(rows, before)
    paper = out["papers"].first()
    assert (paper.title, paper.doi, paper.year) == ("Kept title", "10.1000/x", 2019)
    chunks = out["chunks"].orderBy("chunk_index").collect()
    assert [c.type for c in chunks][-1] == "table" and [c.chunk_index for c in chunks] == list(range(1, len(chunks) + 1))
    assert chunks[0].year == 2019 and out["references"].count() == 1


def test_books(spark):
    text = ["RUNNING HEAD 1\nPreface words.", "RUNNING HEAD 2\nChapter one be-\ngins here\nand goes on.", "RUNNING HEAD 3\n12\nMore text.", "RUNNING HEAD 4\nAppendix text."]
    page = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(text)], "book_id string, page int, text string")
    toc = spark.createDataFrame([("b", 1, "1. First", 2, 0), ("b", 2, "1.1 Part", 3, 1), ("b", 1, "Appendix", 4, 2)], "book_id string, level int, title string, page int, seq int")
    assert {(r.line, r.n_pages) for r in pages.running_lines(page, "book_id").collect()} == {("running head", 4)}
    out = flows.process_books(page, toc)
    sections = {r.title: r for r in out["sections"].collect()}
    assert set(sections) == {"Front matter", "1. First", "1.1 Part", "Appendix"}
    assert sections["1. First"].text == "Chapter one begins here and goes on." and sections["1. First"].page_end == 2
    assert sections["1.1 Part"].heading_path == "1. First > 1.1 Part" and sections["1.1 Part"].text == "More text."
    assert pages.count_chapters(out["sections"]).first().n_chapters == 2
    chunks = out["chunks"].orderBy("chunk_index").collect()
    assert [c.section for c in chunks] == ["1. First", "1.1 Part", "Appendix"] and chunks[0].doc_type == "book"
    whole = pages.chapters(toc.where("page < 0"), page)
    assert whole.first().title == "b" and whole.count() == 1
    assert flows.book_text(out["sections"]).count() == 1


def test_book_details(spark, value):
    m = value(pages.file_meta(F.lit("2007-Najar_Bio_Engineering")))
    assert (m.year, m.surname, m.title) == (2007, "Najar", "Bio Engineering")
    assert value(pages.file_meta(F.lit("Some-Title"))).title == "Some Title"
    assert value(pages.isbn(F.lit("ISBN-13: 978-3-16-148410-0"))) == "9783161484100"
    assert value(pages.copyright_year(F.lit("© 2011 by"))) == 2011
    assert [(a.surname, a.forename) for a in value(pages.person_names(F.lit("Doe, Jane; John Roe and Z")))] == [("Doe", "Jane"), ("Roe", "John"), ("Z", "")]
    assert value(pages.front_or_back(F.lit("Índice general"))) and not value(pages.front_or_back(F.lit("Indexation strategies")))
    assert value(pages.toc_title(F.lit(" Chapter 1.PDF "))) == "Chapter 1"
    spans = spark.createDataFrame([("b", 1, "x" * 500, 10.0), ("b", 1, "Big", 20.0), ("b", 2, "Mid", 14.0)], "book_id string, page int, text string, size double")
    assert {(r.text, r.level) for r in pages.headings_by_font(spans).collect()} == {("Big", 1), ("Mid", 2)}
    assert value(pages.is_text(F.lit(500), F.lit(5))) and not value(pages.is_text(F.lit(10), F.lit(0)))


def test_links(spark, value):
    assert value(pages.link_score(F.lit("https://x/pdfft?a"), F.lit("Download full text PDF"))) == 29
    assert value(pages.link_score(F.lit("javascript:go()"), F.lit(None).cast("string"))) == -5
    html = '<a href="/a">PDF</a><a class="b" href=\'/x/file.pdf\'>Download PDF</a>'
    rows = spark.createDataFrame([(1, html), (2, '<meta name="citation_pdf_url" content="/m.pdf">' + html), (3, "none"), (4, '<iframe src="/v/pdf/1"></iframe>')], "page_id long, html string")
    assert {(r.page_id, r.href, r.source) for r in pages.pdf_links(rows).collect()} == {(1, "/x/file.pdf", "anchor"), (2, "/m.pdf", "meta"), (4, "/v/pdf/1", "frame")}


def test_jsonl(spark, tmp_path):
    folder = tmp_path / "reviews"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"doi": "10.1/X", "paper_id": "p.pdf", "phase": ""}\nbroken\n\n{"doi": "", "paper_id": "q"}\n')
    assert readers.read_jsonl(spark, str(tmp_path), "doi string, paper_id string").where("paper_id is not null").count() == 2
    kept = readers.read_jsonl(spark, str(tmp_path), "doi string, paper_id string", "keep").cache()
    assert kept.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path), "doi string, paper_id string", "fail").collect()
    rec = readers.read_metadata(spark, str(tmp_path), "doi string, paper_id string").collect()
    assert [(r.line_no, r.stem) for r in rec] == [(1, "p")]
    assert {r.phase for r in readers.read_chunks(spark, str(tmp_path), "phase string, paper_id string").where("paper_id is not null").collect()} == {"reviews"}


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿DOI;Título;Año\n10.1/A;One;2020\n;Two;\n", encoding="utf-8")
    got = readers.read_csv(spark, str(p))
    assert [(r.doi, r.title, r.year) for r in got.orderBy("seq").collect()] == [("10.1/A", "One", "2020"), (None, "Two", None)]
    p.write_text("Title,Year\nx,1\n")
    with pytest.raises(ValueError, match="doi"):
        readers.read_csv(spark, str(p))
    assert readers.find_column(["My DOI here", "x"], ["doi"]) == "My DOI here" and readers.sniff("a\tb\tc,d") == "\t"


def test_files_and_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("héllo".encode())
    assert readers.read_texts(spark, str(tmp_path / "in")).first().text == "héllo"
    (tmp_path / "in/b.xls").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported file"):
        readers.read_texts(spark, str(tmp_path / "in")).collect()
    assert readers.list_files(spark, str(tmp_path / "in"), "*.xls").count() == 1
    t = str(tmp_path / "table")
    writers.write_version(spark.range(1), t)
    writers.write_version(spark.range(2), t)
    assert readers.keyword_table(spark, {"a": ["x", "y", "x"]}).count() == 2
    assert writers.read_version(spark, t).count() == 2 and writers.read_version(spark, t, 1).count() == 1
    writers.append_log(spark.sql("select timestamp'2024-01-02' ts, 1 n"), str(tmp_path / "log"))
    writers.append_log(spark.sql("select timestamp'2024-02-02' ts, 2 n"), str(tmp_path / "log"))
    assert {r.month for r in spark.read.json(str(tmp_path / "log")).collect()} == {"2024-01", "2024-02"}
    writers.write_report({"one": spark.range(1)}, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/one"), header=True).count() == 1


def lengths():
    """An embedder of one number, for texts of up to 900 characters."""

    def embed(texts):
        if any(len(t) > 900 for t in texts):
            raise ValueError("too long")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_providers(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
    embedder = lengths
    rows = spark.createDataFrame([(1, "a"), (2, "b" * 2000), (3, "c" * 9000), (4, None)], "id int, text string")
    got = {r.id: (r.embedding[0], r.embed_truncated) for r in providers.embed(rows, embedder).collect()}
    assert got[1] == (1, False) and got[4] == (0, False) and got[2] == (888, True) and got[3][1]
    found = providers.look_up(spark.createDataFrame([("10.1/A",), ("10.1/a",), ("10.2/b",)], "doi string"), lambda: lambda d: json.dumps({"title": ["T"]}) if d == "10.1/a" else None)
    assert {(r.doi, r.message is None) for r in found.collect()} == {("10.1/a", False), ("10.2/b", True)}
    said = providers.answer(spark.createDataFrame([("x",), ("boom",)], "prompt string"), lambda: lambda p: 1 / 0 if p == "boom" else p.upper())
    assert {(r.prompt, r.answer, r.error) for r in said.collect()} == {("x", "X", None), ("boom", None, "division by zero")}


def test_steps():
    done = []
    ok = flows.run_steps([flows.Step("a", lambda: done.append(1)), flows.Step("b", lambda: 1 / 0), flows.Step("c", lambda: done.append(2))])
    assert ok == ("partial", [("a", "ok"), ("b", "error: division by zero"), ("c", "skipped")]) and done == [1]
    assert flows.run_steps([flows.Step("a", lambda: 1 / 0)])[0] == "error" and flows.run_steps([])[0] == "ok"


def pages_of(total):
    def fetch(query, start, count):
        if query == "busy" and not seen:
            seen.append(1)
            raise providers.Busy(0)
        if query == "down":
            raise OSError
        entries = [{"dc:title": f" T{i} ", "prism:coverDate": "2019-05-01", "citedby-count": i} if i % 10 != 7 else {"error": "x"} for i in range(start, min(total, start + count))]
        return json.dumps({"search-results": {"opensearch:totalResults": str(total), "entry": entries}})

    seen: list[int] = []
    return fetch


def test_literature_search(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
    queries = spark.createDataFrame([("c", "plain"), ("d", "busy")], "category string, query string").coalesce(1)
    got = providers.search_pages(queries, lambda: pages_of(60), most=55, pause=0).collect()
    mine = sorted(r.seq for r in got if r.category == "c")
    assert mine == list(range(54)) and sum(r.category == "d" for r in got) == 54
    assert providers.search_pages(queries, lambda: pages_of(0), pause=0).count() == 0
    with pytest.raises(Exception, match="no page from record 0"):
        providers.search_pages(queries.withColumn("query", F.lit("down")), lambda: pages_of(5), pause=0).collect()
    rows = readers.parse_entries(spark.createDataFrame([(json.dumps({"dc:title": " A ", "prism:coverDate": "2019-05-01", "citedby-count": 7}),), ("no JSON",), (None,)], "entry string")).collect()
    assert [(r.title, r.year, r.cited_by, r.doi) for r in rows] == [("A", "2019", "7", ""), ("", "", "", ""), ("", "", "", "")]
    assert readers.within("a OR b", 2000, 2010, "ar", 30) == "(a OR b) AND PUBYEAR > 1999 AND PUBYEAR < 2011 AND DOCTYPE(ar) AND RECENT(30)" and readers.within("x") == "(x)"


def test_configuration(spark, tmp_path):
    config = {"queries": {"a": ["q1", " "], "b": "q2"}, "categories": {"a": None, "b": {"active": False}, "c": {}}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    (tmp_path / "c.yml").write_text("queries:\n  a: [q1, ' ']\n  b: q2\ncategories:\n  a:\n  b: {active: false}\n  c: {}\n")
    read = readers.read_config(spark, str(tmp_path / "c.json"))
    assert readers.named_queries(read) == [("a", "q1"), ("b", "q2")] and readers.active_categories(read) == ["a", "c"]
    assert readers.active_categories({"categories": ["x"]}) == ["x"] and readers.named_queries({}) == [] == readers.active_categories({})
    pytest.importorskip("yaml")
    assert readers.read_config(spark, str(tmp_path / "c.yml")) == config


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    files = lambda *rows: spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    one, two = files(("a", b"1"), ("b", b"2")), files(("a", b"1"))
    assert writers.write_snapshot(files(), folder, "t0") is None
    assert writers.write_snapshot(one, folder, "t1") == "t1" and writers.write_snapshot(one, folder, "t2") is None
    assert writers.write_snapshot(two, folder, "t3") == "t3"  # a file that went is a change
    assert writers.write_snapshot(files(("a", b"3")), folder, "t4", keep=2) == "t4"
    assert sorted(writers.snapshots(spark, folder)) == ["t3", "t4"]
    got = lambda name: {(r.path, bytes(r.content)) for r in writers.read_snapshot(spark, folder, name).collect()}
    assert got("t3") == {("a", b"1")} and got("t4") == got(None) == {("a", b"3")}
    with pytest.raises(KeyError):
        got("t1")


def test_a_snapshot_writes_new_contents_only(spark, tmp_path):
    from lexloom.sources.store import Store

    folder = str(tmp_path / "snapshots")
    files = lambda d: spark.createDataFrame([(p, bytearray(c.encode())) for p, c in d.items()], "path string, content binary")
    stored = lambda: Store(spark, folder).manifest()["tables"]["contents"]["paths"]
    tree = {f"f{i}": f"text {i % 7}" for i in range(20)}
    writers.write_snapshot(files(tree), folder, "t1", keep=2)
    assert spark.read.parquet(*stored()).count() == 7
    tree["f3"] = "another"
    writers.write_snapshot(files(tree), folder, "t2", keep=2)
    assert len(stored()) == 2 and spark.read.parquet(stored()[-1]).count() == 1
    tree = {f"f{i}": "one of all" for i in range(5)} | {"x": "text 1"}
    writers.write_snapshot(files(tree), folder, "t3", keep=1)  # of the first folder one of seven is still named, of the second none
    assert spark.read.parquet(*stored()).count() == 2
    assert {(r.path, r.content.decode()) for r in writers.read_snapshot(spark, folder).collect()} == set(tree.items())
    assert writers.snapshots(spark, folder) == ["t3"]


def test_flows_of_papers(spark):
    kinds = "name string, doi string, sha256 string, first_page string, pages string"
    page = "A study of biogas in towns\nAbstract\n" + "Biogas from towns is measured over many years and compared with that of farms, with care. " * 2
    batch = spark.createDataFrame([("a", "10.1/a", "h1", page, page), ("b", "10.1/a", "h2", page, page), ("c", None, "h3", "short", None), ("d", "10.1/known", "h4", page, page)], kinds)
    corpus = spark.createDataFrame([("10.1/known", "h9", "known")], "doi string, sha256 string, name string")
    keywords = spark.createDataFrame([("energy", "biogas")], "category string, keyword string")
    got = {r.name: (r.outcome, r.category, r.route) for r in flows.screen_papers(batch, corpus, keywords).collect()}
    assert got == {"a": ("kept", "energy", "energy"), "b": ("duplicate_batch", "energy", "duplicates"), "c": ("kept_no_doi", None, "failed"), "d": ("duplicate_doi", "energy", "duplicates")}
    rows = spark.createDataFrame([("10.1/KNOWN", "t", 0), ("10.1/new", "t", 1), ("10.1/new", "u", 2), ("10.1/bad", "t", 3), (None, "t", 4)], "doi string, title string, seq long")
    blocked, held = spark.createDataFrame([("10.1/bad",)], "doi string"), spark.createDataFrame([], "name string")
    out = flows.project_from_table("mine", rows, corpus, held, blocked)
    assert [(r.doi, r.outcome) for r in out["copies"].collect()] == [("10.1/known", "copied")]
    assert [(r.doi, r.title) for r in out["downloads"].collect()] == [("10.1/new", "t")]
    assert [tuple(r) for r in out["report"].collect()] == [(1, 1)] and out["rows"].count() == 3
    for bad in ("Mine", "energy", ""):
        with pytest.raises(ValueError):
            flows.project_from_table(bad, rows, corpus, held, blocked, reserved=("energy",))
    with pytest.raises(ValueError):
        flows.project_from_table("mine", rows.where("doi IS NULL"), corpus, held, blocked)
    tei = spark.createDataFrame([("x", TEI), ("y", TEI)], "name string, tei_xml string")
    names = lambda *ns: spark.createDataFrame([(n,) for n in ns], "name string")
    tables = flows.process_project("p-1", names("x", "z"), names("x", "y"), tei)
    assert [(r.paper_id, r.project) for r in tables["papers"].collect()] == [("x", "p-1")] and tables["chunks"].where("project = 'p-1'").count() > 0
    with pytest.raises(ValueError):
        flows.process_project("p-1", names(), names("x"), tei)


def test_the_fold_equals_the_loop(spark):
    import random

    rng = random.Random(9)
    piece = lambda: rng.choice(["ab", "c" * rng.randrange(40), " ", "\n", "\n\n", "\n \n", "é漢", "\t", "d e f"])
    texts = [None, "", " \n ", "x" * 95, *("".join(piece() for _ in range(rng.randrange(60))) for _ in range(300))]
    for most in (5, 30):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(r.doc_id, r.piece_index): r.piece for r in chunking.split_long(rows, most=most).collect()}
        assert got == {(i, n): p for i, t in enumerate(texts) for n, p in enumerate(chunking.split_chars(t, most), 1)}
    assert "MapInArrow" not in chunking.split_long(rows)._jdf.queryExecution().toString()


def test_texts_by_an_injected_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é plain".encode())
    (tmp_path / "b.PDF").write_bytes(b"%PDF two pages")
    reader = lambda: lambda content: content.decode()[5:].upper()
    assert {(r.file, r.text) for r in readers.read_texts(spark, str(tmp_path), {"pdf": reader}).collect()} == {("a.txt", "é plain"), ("b.PDF", "TWO PAGES")}
    with pytest.raises(Exception, match="unsupported file"):
        readers.read_texts(spark, str(tmp_path)).collect()
    (tmp_path / "c.doc").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported file"):
        readers.read_texts(spark, str(tmp_path), {"pdf": reader}).collect()


def test_archives(spark):
    from lexloom.operators import exports

    rows = [("a", 1, "x.md", b"one"), ("a", 1, "x.md", b"later"), ("a", 1, "d/é.pdf", None), ("a", 2, "y", b"\x00" * 5000), ("b", 1, None, b"lost")]
    files = spark.createDataFrame(rows, "category string, package int, name string, content binary")
    by = ["category", "package"]
    archives = exports.zipped(files, by)
    assert {(r.category, r.package, r.n_files) for r in archives.collect()} == {("a", 1, 2), ("a", 2, 1)}
    assert {(r.package, r.name, bytes(r.content)) for r in exports.unzipped(archives, by).collect()} == {(1, "x.md", b"later"), (1, "d/é.pdf", b""), (2, "y", b"\x00" * 5000)}
    again = exports.zipped(files.repartition(5), by)
    assert {bytes(r.archive) for r in archives.collect()} == {bytes(r.archive) for r in again.collect()}
    assert exports.zipped(files.where("package > 5"), by).count() == 0
    papers = spark.createDataFrame([("p1", "s1", "k"), ("p2", None, "k"), ("p3", None, "k")], "paper_id string, stable_id string, package string")
    pdfs, texts = spark.createDataFrame([("s1.pdf", b"1"), ("p2.pdf", b"2")], "name string, content binary"), spark.createDataFrame([("p3", "three")], "paper_id string, content string")
    assert {(r.name, bytes(r.content)) for r in exports.paper_files(papers, pdfs, texts).collect()} == {("pdfs/s1.pdf", b"1"), ("pdfs/p2.pdf", b"2"), ("md_clean/p3.clean.md", b"three")}
