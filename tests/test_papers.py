"""Duplicates, registry, validation, metadata, lifecycle, roll-ups, citations, exports, streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexloom.functions import ids
from lexloom.operators import citations, dedup, exports, lifecycle, metadata, registry, rollups, validation
from lexloom.plans import retrieval
from lexloom.streaming import usage

PERSON = "array<struct<full:string,forename:string,surname:string>>"


def people(*names):
    return [Row(full=f, forename=a, surname=b) for f, a, b in names]


# --- duplicates --------------------------------------------------------------


def screen_one_by_one(batch, corpus_dois, corpus_hashes):
    """The loop that the windows replace."""
    kept, out = set(), {}
    for name, doi, sha in sorted(batch):
        if doi and doi in corpus_dois:
            out[name] = "duplicate_doi"
        elif sha in corpus_hashes:
            out[name] = "duplicate_hash"
        elif not doi:
            out[name] = "kept_no_doi"
        elif doi in kept:
            out[name] = "duplicate_batch"
        else:
            kept.add(doi)
            out[name] = "kept"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_screening_equals_the_loop(spark, seed):
    r = random.Random(seed)
    batch = [(f"n{i:02}", r.choice(["", "10.1/a", "10.1/b", "10.1/c"]), r.choice("xyz")) for i in range(20)]
    rows = spark.createDataFrame(batch, "name string, doi string, sha256 string")
    corpus = spark.createDataFrame([("https://doi.org/10.1/A", "q"), ("", "x")], "doi string, sha256 string")
    got = {x.name: x.outcome for x in dedup.screen_batch(rows, corpus).collect()}
    assert got == screen_one_by_one(batch, {"10.1/a"}, {"q", "x"})


def test_keep_choices(spark):
    rows = spark.createDataFrame(
        [("d", "A", "Upper", 1, 9, 0), ("d", "A", "clean", 2, 1, 0), ("d", "B", "b_10_1234_x", 1, 9, 2), ("d", "C", "other", 1, 1, 2), ("", "A", "nodoi", 3, 1, 0), ("e", "A", "one", 4, 1, 0)],
        "doi string, category string, stem string, line_no int, completeness int, relevance int",
    )
    intra = dedup.decide(rows).collect()
    assert [(r.keep_stem, r.remove_stem) for r in intra] == [("clean", "Upper")]
    cross = [(r.duplicate_type, r.keep_category, r.remove_category) for r in dedup.decide(rows, across=True).collect()]
    assert sorted(cross) == [("cross", "A", "B"), ("cross", "A", "C"), ("intra", "A", "A")]  # two are most relevant: clean name, then category
    assert dedup.apply_decisions(rows, dedup.decide(rows)).count() == 5


def test_groups(spark):
    rows = spark.createDataFrame([("A", "1", "A Title: Long", ""), ("A", "2", "a title long", "10.1/x"), ("A", "3", "short", ""), ("A", "4", "short", ""), ("B", "5", "Another title", "10.1/a"), ("B", "6", "Another title", "10.1/b")], "category string, paper_id string, title string, doi string")
    assert [(r.category, r.norm_title, r.n) for r in dedup.title_groups(rows).collect()] == [("A", "a title long", 2)]
    members = spark.createDataFrame([(1, "B_10_1234_x", False, "a", 1), (1, "clean", False, "a", 2), (2, "x", True, "a", 1), (2, "y", True, "a", 2)], "g int, stem string, has_pdf boolean, doi string, seq int")
    assert {(r.g, r.keep, r.risky) for r in dedup.default_keep(members, "g").collect()} == {(1, "clean", False), (2, "x", True)}
    named = dedup.unique_names(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, seq int"), "name", "seq")
    assert sorted(r.unique_name for r in named.collect()) == ["a", "a_2", "b"]


def test_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "10.1/A", "3"), (2, "10.1/A", "n/a"), (3, "", "1"), (4, None, "1")], "seq int, doi string, cited_by string")
    once = dedup.most_cited(rows)
    assert sorted(r.seq for r in once.collect()) == [1, 3, 4] == sorted(r.seq for r in dedup.most_cited(once).collect())
    assert [r.seq for r in dedup.first_doi(rows).collect()] == [1]


def test_prefixes(spark):
    long_ = "a" * 61
    names = spark.createDataFrame([("X y",), (long_ + " more",), ("a" * 30 + "b",)], "name string")
    known = spark.createDataFrame([("x_y",), (long_,), ("a" * 30,)], "known string")
    assert {(r.name, r.known) for r in dedup.matches_by_prefix(names, known).collect()} == {("X y", "x_y"), (long_ + " more", long_)}
    a = spark.createDataFrame([("p", "h1", "10.1/A"), ("q", "h2", "")], "id string, sha256 string, doi string")
    b = spark.createDataFrame([("r", "h2", ""), ("s", "h9", "https://doi.org/10.1/a")], "id string, sha256 string, doi string")
    assert {(r.id, r.other_id, r.by) for r in dedup.same_paper(a, b).collect()} == {("q", "r", "hash"), ("p", "s", "doi")}


# --- registry ------------------------------------------------------------------


@pytest.fixture
def reg(spark):
    rows = [("10.1/A", "pending", "n", "2030-01-01"), ("10.1/b", "downloaded", "", ""), ("10.1/c", "blocked", "", "2020-01-01"), ("10.1/d", "pending", "", "2024-01-01")]
    return registry.shaped(spark.createDataFrame(rows, "doi string, status string, notes string, snooze_until string"))


def by_doi(df):
    return {r.doi: r for r in df.collect()}


def test_upsert(spark, reg):
    new = spark.createDataFrame([(1, " 10.1/a ", "first"), (2, "10.1/A", "last"), (3, "10.1/B", "x"), (4, "10.1/New", "n1"), (5, "10.1/NEW", "n2"), (6, "", "none")], "seq int, doi string, title string").withColumns({"year": F.lit(2020), "category": F.lit("k"), "reason": F.lit("r" * 300)})
    got = by_doi(registry.upsert(reg, new, "2025-01-01"))
    assert set(got) == {"10.1/A", "10.1/b", "10.1/c", "10.1/d", "10.1/New"}
    assert (got["10.1/A"].title, got["10.1/A"].notes, got["10.1/A"].snooze_until, len(got["10.1/A"].reason)) == ("last", "n", "2030-01-01", 200)
    assert got["10.1/b"].title == "" and got["10.1/New"].title == "n2" and got["10.1/New"].status == "pending"
    again = by_doi(registry.upsert(registry.upsert(reg, new, "2025-01-01"), new, "2025-01-01"))
    assert again == got


def test_states(spark, reg):
    dois = spark.createDataFrame([("10.1/a",), ("10.1/C",), ("10.1/zz",)], "doi string")
    assert by_doi(registry.mark_downloaded(reg, dois, "t"))["10.1/A"].status == "downloaded"
    assert by_doi(registry.snooze(reg, dois, "2025-01-01", 2, "later"))["10.1/A"].snooze_until == "2027-01-01"
    assert by_doi(registry.unsnooze(reg, dois))["10.1/A"].snooze_until == ""
    blocked = by_doi(registry.block(reg, dois, "t", "why"))
    assert blocked["10.1/A"].status == "blocked" and blocked["10.1/A"].snooze_until == "2030-01-01" and blocked["10.1/zz"].status == "blocked"
    free = by_doi(registry.unblock(reg, dois, "t"))
    assert free["10.1/c"].status == "pending" and free["10.1/b"].status == "downloaded"
    assert [r.doi for r in registry.active(reg, "2025-01-01").collect()] == ["10.1/d"]
    assert by_doi(registry.reconcile(reg, dois, "t"))["10.1/A"].notes.startswith("reconciliado")
    assert [r.doi for r in registry.blocked_dois(reg).collect()] == ["10.1/c"]
    plan = registry.download_plan(spark.createDataFrame([("10.1/C",), ("10.1/B",), ("10.9/x",)], "doi string"), registry.blocked_dois(reg), reg)
    assert {(r.doi, r.plan) for r in plan.collect()} == {("10.1/C", "blocked"), ("10.1/B", "known"), ("10.9/x", "download")}
    origin = registry.doi_origins(spark.createDataFrame([("10.1/A", "meta")], "doi string, origin string"), spark.createDataFrame([("x [10.1000_b].pdf",), ("n.pdf",)], "name string"))
    assert {(r.doi, r.origin) for r in origin.collect()} == {("10.1/a", "meta"), ("10.1000/b", "x [10.1000_b].pdf")}


# --- validation and metadata ----------------------------------------------------


@pytest.mark.parametrize(
    "code,fields",
    [
        ("title_eq_journal", {"title": "Water  Research", "journal": "water research"}),
        ("title_has_journal_prefix", {"title": "Water Research 12", "journal": "Water Research"}),
        ("authors_glued", {"authors": people(("ViolaCorbellini", "", ""))}),
        ("authors_affiliation", {"authors": people(("Univ 2", "", ""))}),
        ("authors_affiliation", {"authors": people(("Dept of X", "", ""))}),
        ("authors_editors", {"doi": "10.3303/x", "authors": people(("P Varbanov", "", ""), ("J Klemeš", "", ""))}),
        ("year_implausible", {"year": "1700"}),
        ("year_implausible", {"year": None}),
        ("doi_malformed", {"doi": "doi:10.1/x"}),
    ],
)
def test_rules(spark, code, fields):
    base = {"paper_id": "p", "title": "Good", "journal": "J", "doi": "10.1234/x", "year": "2020", "authors": people(("Ann Lee", "Ann", "Lee"))}
    schema = f"paper_id string, title string, journal string, doi string, year string, authors {PERSON}"
    make = lambda f: spark.createDataFrame([tuple((base | f)[k] for k in ("paper_id", "title", "journal", "doi", "year", "authors"))], schema)
    codes = lambda df: df.select(validation.issues(2025).alias("i")).first().i
    assert codes(make({})) == [] and [i.code for i in codes(make(fields))] == [code]


def test_dismissal_comes_first(spark):
    rows = spark.createDataFrame([("p", "T", "J", "bad", "2020", None)], f"paper_id string, title string, journal string, doi string, year string, authors {PERSON}")
    mark = spark.createDataFrame([("p", "doi")], "paper_id string, field string")
    assert validation.validate(rows, 2025).count() == 1 and validation.validate(rows, 2025, mark).count() == 0


def test_lookup(spark):
    schema = f"paper_id string, title string, journal string, doi string, year string, authors {PERSON}"
    rows = spark.createDataFrame(
        [
            ("2020_a", "Removal of hydrogen sulfide", "", "10.1000/a", "2019", people(("Ann Lee", "Ann", "Lee"))),
            ("2021_b", "Journal X", "Journal X", "10.1000/b", "2021", people(("BoRoe", "", ""))),
            ("2018_c", "T", "J", "10.1000/c", "2017", None),
            ("d", "T", "J", "none", "2017", None),
        ],
        schema,
    )
    lookup = spark.createDataFrame(
        [("10.1000/A", "Removal of hydrogen sulphide", "Full", "Abbr", 2020, [("Lee", "Ann")]), ("10.1000/b", "Real title", "Journal Y", "Journal X", None, [("Roe", "Bo")])],
        "doi string, title string, journal string, journal_short string, year int, authors array<struct<family:string,given:string>>",
    )
    got = {r.paper_id: {(i.code, i.severity) for i in r.found} for r in validation.compare(rows, lookup).collect()}
    assert got == {
        "2020_a": {("journal_fill", "medium"), ("year_mismatch", "low")},
        "2021_b": {("title_recover", "high"), ("authors_mismatch", "info")},
        "2018_c": {("crossref_miss", "info"), ("year_mismatch", "medium")},
    }
    side = {r.paper_id for r in validation.sidecar(rows, lookup, 2025, limit=1).collect()}
    assert side == {"2021_b", "2020_a", "d"} or side == {"2018_c", "2021_b", "d"}
    assert validation.first_calls(rows, 2).count() == 2


def test_overrides(spark):
    empty = spark.createDataFrame([], "category string, paper_id string, field string, date string, note string")
    add = lambda o, f, day: validation.dismiss(o, spark.createDataFrame([("c", "p", f, None)], "category string, paper_id string, field string, note string"), day)
    two = add(add(empty, "year", "d1"), "year", "d2")
    assert [(r.field, r.date, r.note) for r in two.collect()] == [("year", "d2", "")]
    with pytest.raises(ValueError):
        add(empty, "abstract", "d")
    renamed = validation.rename_overrides(two, spark.createDataFrame([("p", "q")], "old_id string, new_id string"))
    assert renamed.first().paper_id == "q" and validation.undismiss(two, two).count() == 0


def test_quality_and_merge(spark):
    schema = f"paper_id string, title string, doi string, journal string, year int, authors {PERSON}, abstract string, n_references int"
    rows = spark.createDataFrame([("a", "T", "10.1/x", "J", 2020, people(("A B", "", "")), "x", 9), ("b", " ", None, "", 0, [], "", 0)], schema)
    got = {r.paper_id: (r.quality_score, len(r.warnings)) for r in metadata.with_quality(rows).collect()}
    assert got == {"a": (1.0, 0), "b": (0.1, 6)}
    before = spark.createDataFrame([("b", "Old", None, "OldJ", None, people(("Z", "", "")), None, 0)], schema)
    merged = {r.paper_id: r for r in metadata.keep_filled(rows, before, ["paper_id"]).collect()}
    assert (merged["b"].title, merged["b"].journal, merged["b"].year, merged["a"].title) == ("Old", "OldJ", 0, "T") and merged["b"].authors[0].full == "Z"
    books = spark.createDataFrame([("b", "Book", people(("Y", "", "")), 1999), ("n", "New", None, 2001)], f"paper_id string, title string, authors {PERSON}, year int")
    over = {r.paper_id: r for r in metadata.overlay_books(rows, books).collect()}
    assert over["b"].title == " " and over["b"].year == 1999 and over["n"].title == "New"
    assert {r.paper_id: r.year for r in metadata.year_by_paper(spark.createDataFrame([("a",), ("s",), ("1999_z",)], "paper_id string"), rows.where("paper_id = 'a'").selectExpr("paper_id", "'s' stable_id", "year", "1 line_no")).collect()} == {"a": 2020, "s": 2020, "1999_z": 1999}
    asks = metadata.incomplete(rows.columns)
    assert {r.paper_id for r in rows.where(asks["incomplete"]).collect()} == {"b"}
    assert metadata.catalogue(rows).where("paper_id = 'a'").first().doi_url == "https://doi.org/10.1/x"


def test_doi_ways(spark):
    files = spark.createDataFrame([("A.pdf", "t", ""), ("b c.pdf", "t", ""), ("x.pdf", "My Title!", ""), ("y.pdf", "Listed", ""), ("z [10.1000_q].pdf", "", ""), ("w.pdf", "", "see doi: 10.1000/w."), ("v.pdf", "", "")], "name string, title string, text string")
    manual = spark.createDataFrame([(1, "a.PDF", None, "10.1/n"), (2, "B_C.pdf", None, "10.1/s"), (3, None, "my title", "10.1/t")], "seq int, name string, title string, doi string")
    titles = spark.createDataFrame([(1, "listed", "10.1/l"), (2, "Listed", "10.1/m")], "seq int, title string, doi string")
    got = {r.name: (r.doi, r.doi_source) for r in metadata.doi_by_priority(files, manual, titles).collect()}
    assert got == {"A.pdf": ("10.1/n", "manual_name"), "b c.pdf": ("10.1/s", "manual_stem"), "x.pdf": ("10.1/t", "manual_title"), "y.pdf": ("10.1/l", "csv_title"), "z [10.1000_q].pdf": ("10.1000/q", "filename"), "w.pdf": ("10.1000/w", "text"), "v.pdf": (None, None)}
    assert metadata.title_table(titles).first().conflicting


def test_small_rules(spark, value):
    m = '{"title": ["T"], "container-title": ["J"], "issued": {"date-parts": [[2020]]}, "published-print": {"date-parts": [[2021]]}, "author": [{"family": "Lee", "given": "A"}]}'
    work = metadata.read_work(spark.createDataFrame([("d", m), ("e", "x")], "doi string, message string")).orderBy("doi").collect()
    assert (work[0].year, work[0].journal, work[0].authors[0].family, work[1].title) == (2021, "J", "Lee", None)
    assert value(metadata.lookup_year(F.lit(m), "rename")) == 2020
    assert metadata.skip_rows("15, 181,190-192") == {15, 181, 190, 191, 192}
    route = spark.createDataFrame([("DUPLICATE", "a", 1.0), ("ok", "a", 0.9), ("ok", "a", 0.5), ("ok", "irrelevant", 1.0), ("error", "a", 1.0)], "status string, category string, confidence double")
    assert [r.r for r in route.select(metadata.screening_route().alias("r")).collect()] == ["duplicates", "a", "failed", "failed", "failed"]
    cache = spark.createDataFrame([("2025-01-01",), ("2024-01-01",), ("bad",), (None,)], "ts string")
    assert [r.c for r in cache.select(metadata.cached("2025-01-05", 30).alias("c")).collect()] == [True, False, True, True]
    docs = spark.createDataFrame([(1, "A plant"), (2, "plant wind"), (3, None)], "doc_id int, text string")
    found = metadata.keyword_category(docs, spark.createDataFrame([("p", "PLA"), ("w", "wind")], "category string, keyword string"), "doc_id", F.col("text"))
    assert {(r.doc_id, r.category, r.confidence) for r in found.collect()} == {(1, "p", 1.0), (2, None, 0.0), (3, None, 0.0)}
    adequacy = spark.createDataFrame([(500, 5, 500), (2000, 5, 20000), (2000, 50, 2000), (2000, 5, 2000)], "n_words int, n_pages int, body_words int")
    assert [r.x for r in adequacy.select(metadata.text_adequacy(adequacy.columns).alias("x")).collect()] == ["short_text", "low_ratio", "low_density", None]
    assert value(ids.publisher(F.lit("https://www.MDPI.com/x"))) == "mdpi" and value(ids.pii(F.lit("/pii/s0048969720312345x"))) == "S0048969720312345X"
    got = metadata.provenance(spark.createDataFrame([("10.1/a",), ("10.1/z",)], "doi string"), spark.createDataFrame([("https://doi.org/10.1/A", "unpaywall", "d")], "doi string, method string, date string"))
    assert {(r.doi, r.download_source, r.access_type) for r in got.collect()} == {("10.1/a", "unpaywall", "open_access"), ("10.1/z", "manual", "unknown")}


# --- lifecycle -------------------------------------------------------------------


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame([("A", "p", "p", "/x/p.pdf", "10.1/a"), ("A", "q", "other", "/x/q.pdf", "10.1/b"), ("B", "p", "p", "/y/p.pdf", "10.1/a")], "category string, paper_id string, stable_id string, source_pdf string, doi string")


def test_rename(spark, corpus):
    renames = spark.createDataFrame([("A", "p", "new")], "category string, old_id string, new_id string")
    out = lifecycle.rename({"papers": corpus, "chunks": corpus.select("category", "paper_id")}, renames, "papers")
    assert {(r.category, r.paper_id, r.stable_id, r.source_pdf) for r in out["papers"].collect()} == {("A", "new", "new", "/x/new.pdf"), ("A", "q", "other", "/x/q.pdf"), ("B", "p", "p", "/y/p.pdf")}
    assert out["chunks"].where("paper_id = 'new'").count() == 1
    with pytest.raises(lifecycle.TakenError, match="A/q"):
        lifecycle.rename({"papers": corpus}, spark.createDataFrame([("A", "p", "q")], "category string, old_id string, new_id string"), "papers")


def test_quarantine_round_trip(spark, corpus):
    empty = spark.createDataFrame([], "category string, paper_id string, reason string, deleted_at string")
    stones = lifecycle.quarantine(empty, corpus.where("category = 'A'"), "dup", "now")
    assert lifecycle.visible(corpus, stones).count() == 1 and lifecycle.quarantine(stones, corpus, "again", "later").where("reason = 'dup'").count() == 2
    assert lifecycle.visible(corpus, lifecycle.restore(stones, corpus)).count() == 3
    assert lifecycle.quarantine_list(stones).count() == 2 and lifecycle.purge(corpus, stones).count() == 1
    left = lifecycle.purge_by_doi(corpus, spark.createDataFrame([("https://doi.org/10.1/A",)], "doi string"))
    assert {(r.category, r.paper_id) for r in left.collect()} == {("A", "q"), ("B", "p")}


def test_status_and_merge(spark, corpus):
    names = spark.createDataFrame([("A", "P")], "category string, name string")
    got = {(r.category, r.paper_id): (r.has_pdf, r.complete) for r in lifecycle.status(corpus, pdf=names).collect()}
    assert got == {("A", "p"): (True, True), ("A", "q"): (False, False), ("B", "p"): (False, False)}
    merged = lifecycle.merge_tree(corpus.where("category = 'A'"), corpus.withColumn("stable_id", F.lit("z")), ["category", "paper_id"])
    assert merged.count() == 3 and merged.where("stable_id = 'z'").count() == 1
    patch = spark.createDataFrame([("A", "p", "")], "category string, paper_id string, doi string")
    assert lifecycle.update_fields(corpus, patch).where("category = 'A' and paper_id = 'p'").first().doi == ""
    a, b = spark.createDataFrame([("X y.pdf",), ("z",)], "name string"), spark.createDataFrame([("x_y_pdf",), ("w",)], "name string")
    assert {(r.name, r.missing) for r in lifecycle.mismatches(a, b).collect()} == {("w", "pdf"), ("z", "text")}
    assert lifecycle.processable(a, b).count() == 1 and lifecycle.processable(a, b, b.where("name = 'w'")).count() == 0
    copied = lifecycle.copy_selected(spark.createDataFrame([("10.1/A",), ("10.1/b",), ("10.9/z",)], "doi string"), corpus.withColumn("name", F.col("paper_id")), spark.createDataFrame([("q",)], "name string"))
    assert {(r.doi, r.outcome) for r in copied.collect()} == {("10.1/a", "copied"), ("10.1/b", "existing"), ("10.9/z", "not_found")}
    keep, gone = lifecycle.split_rows(corpus, corpus.where("paper_id = 'q'"), "paper_id")
    assert keep.count() == 2 and gone.count() == 1
    made = corpus.withColumns({"year": F.lit(2020), "title": F.lit("A title"), "authors": F.lit(None).cast(PERSON)})
    assert sorted(r.new_id for r in lifecycle.rename_preview(made).collect()) == ["2020_unknownauthor_title", "2020_unknownauthor_title", "2020_unknownauthor_title_2"]


# --- roll-ups, citations, exports -------------------------------------------------


def test_rollups(spark):
    rows = spark.createDataFrame([("A", "scopus"), ("A", "odd"), ("B", None)], "category string, source_type string")
    assert {(r.category, r.scopus, r.unknown, r.total) for r in rollups.source_pivot(rows, ["scopus"]).collect()} == {("A", 1, 1, 2), ("B", 0, 1, 1)}
    files = spark.sql("select 'A' category, 'pdf' kind, 2 modified union all select 'A', 'index', 1 union all select 'B', 'pdf', 1")
    got = rollups.corpus_manifest(rows.withColumn("quality_score", F.lit(0.1235)), rows.limit(0), files)
    assert {(r.category, r.n_chunks, r.stale) for r in got.collect()} == {("A", 0, True), ("B", 0, False)}
    stats = rollups.download_stats(spark.createDataFrame([("ok", "x"), ("ok", "x"), ("fail", None)], "status string, method string")).collect()
    assert [(r.status, r.method, r.n) for r in stats] == [("ok", "x", 2), ("fail", "none", 1)]
    head = rollups.corpus_header(rows.withColumn("year", F.lit(2020)), spark.createDataFrame([("A", i, f"k{i}") for i in range(8)], "category string, seq int, keyword string"))
    assert head.where("category = 'A'").first().keywords == "k0, k1, k2, k3, k4, k5"


def test_citation_keys(spark, value):
    full = lambda x: F.array(F.struct(F.lit(x).alias("full"), F.lit("").alias("forename"), F.lit("").alias("surname")))
    key = lambda pid, name, year, doi: value(citations.article_key(F.lit(pid), full(name), F.lit(year), F.lit(doi)))
    assert key("x", "AndrePauss", 2020, "10.1/a") == "(Pauss, 2020; 10.1/a)"
    assert key("2019_roe_t", "peter weiland", 0, "") == "(Weiland, 2019)"
    assert key("nothing", "x", 0, "") == "(?, s.f.)"
    assert value(citations.attachment_key(F.lit("2020_roe_x.pdf"), F.lit(""))) == "(Roe, 2020; adjunto)"
    assert value(citations.attachment_key(F.lit("notes.txt"), F.lit(" "))) == "(notes; adjunto)"
    assert value(citations.attachment_key(F.lit(""), F.lit("Mine"))) == "(Mine; adjunto)"
    book = citations.book_key(F.lit("b"), full("Jo Doe"), F.lit(1999), F.lit("Book"), F.lit("14. Cells > 14.1"), F.lit("14.1"), F.lit(3), F.lit(5))
    assert value(book) == "Doe (1999), Book, cap. 14, p. 3-5"


def test_applying_citations(spark):
    context = spark.createDataFrame([(1, 1, "(A, 2020)"), (1, 3, "(B, s.f.; 10.1/b)")], "qid int, n int, cite string")
    answers = spark.createDataFrame([(1, "x [1] [3], y [9][1].\n\n## References\n[1] z"), (2, "no [1]"), (3, None)], "qid int, answer string")
    got = {r.qid: r.answer for r in citations.apply_citations(answers, context).collect()}
    assert got == {1: "x (A, 2020; B, s.f.; 10.1/b), y (A, 2020).", 2: "no [1]", 3: ""}
    orphan = answers.select("qid", citations.orphans("answer", F.array(F.lit(1), F.lit(3))).alias("o")).collect()
    assert {r.qid: r.o for r in orphan} == {1: [9], 2: [], 3: []}
    noted = answers.select(citations.with_orphan_note("answer", F.array(F.lit(9))).alias("x")).first().x
    assert noted.count("[9]") == 2


def test_exports(spark, value):
    rows = spark.createDataFrame([(1, "a", "T{x}", people(("Ann Lee", "Ann", "Lee")), 2020, "J", "10.1/a", "abs"), (2, "b", "U", people(("Bo Lee", "", "")), 2020, "", None, None), (3, "c", "V", None, None, None, None, None)], f"seq int, paper_id string, title string, authors {PERSON}, year int, journal string, doi string, abstract string")
    bib = {r.paper_id: r for r in exports.bibtex(rows).collect()}
    assert [bib[p].bib_key for p in "abc"] == ["Lee2020", "Lee2020a", "XXXX"] and "title    = {Tx}" in bib["a"].entry and "Unknown" in bib["c"].entry
    ris = {r.paper_id: r.entry for r in exports.ris(rows).collect()}
    assert ris["a"].split("\n")[:3] == ["TY  - JOUR", "TI  - T{x}", "AU  - Ann Lee"] and ris["c"].split("\n") == ["TY  - JOUR", "TI  - V", "ER  -", ""]
    assert value(exports.fence(F.lit("a ~~~~ b"))) == "~~~~~" and value(exports.fence(F.lit(""))) == "~~~"
    assert exports.csv_rows(rows).columns == list(exports.CSV_FIELDS)
    chunk = spark.createDataFrame([(1, "a", "S", "results", "text", 0.5, " t ")], "n int, paper_id string, section string, section_canonical string, type string, score double, text string")
    assert "- **DOI:** https://doi.org/10.1/a" in exports.bundle(chunk, rows).first().markdown
    found = exports.find_pdf(spark.createDataFrame([("exact", None), ("z", "st"), ("a" * 25, None), ("no", None)], "paper_id string, stable_id string"), spark.createDataFrame([("Exact.pdf",), ("st.pdf",), ("a" * 20 + "b.pdf",)], "name string"))
    assert {(r.paper_id, r.file) for r in found.collect()} == {("exact", "Exact.pdf"), ("z", "st.pdf"), ("a" * 25, "a" * 20 + "b.pdf")}
    many = spark.range(100).selectExpr("'A' category", "lpad(id, 3, '0') paper_id")
    first = exports.packages(many.where("paper_id < '050'"))
    more = exports.packages(many, first)
    assert {(r.package, r.n_papers) for r in exports.package_manifest(first.unionByName(more), many).collect()} == {(1, 45), (2, 5), (3, 45), (4, 5)}


def test_contexts(spark):
    results = spark.createDataFrame([(0, "2020_roe_x", "one"), (1, "p", "two")], "rank int, paper_id string, text string")
    papers = spark.createDataFrame([("p", people(("Jo Doe", "", "")), 1999, "T", "10.1/p")], f"paper_id string, authors {PERSON}, year int, title string, doi string")
    got = retrieval.numbered_context(results, papers).first()
    assert got.context == "[1] (Roe, 2020)\none\n\n[2] (Doe, 1999; 10.1/p)\ntwo" and got.tokens == got.chars // 4


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:10' ts, 'a' event_type, 1D value, 1L user_id union all select timestamp'2024-01-01 00:20', 'a', 2D, 1L union all select timestamp'2024-01-05', 'b', 1D, 2L").write.parquet(source)
    schema = spark.read.parquet(source).schema
    usage.run_available(usage.usage_windows(usage.event_stream(spark, source, schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.event_type, r.n, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2, 3.0)]
    usage.run_available(usage.sessions(usage.event_stream(spark, source, schema)), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    assert [(r.user_id, r.n) for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == [(1, 2)]
    spark.sql("select timestamp'2024-01-01' ts, 'x' doi union all select timestamp'2024-01-02', 'x'").write.parquet(str(tmp_path / "p"))
    papers = usage.event_stream(spark, str(tmp_path / "p"), spark.read.parquet(str(tmp_path / "p")).schema)
    usage.run_available(usage.first_papers(papers), str(tmp_path / "out3"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "out3")).count() == 1


def test_screening_texts(spark):
    from lexloom.operators import screening

    page = "Journal of X\nA long title of a paper\n\nAbstract\n" + "This is the body of the abstract. " * 5 + "\n\nKeywords: a\n"
    other = "2020\nElsevier\n" + "A dense first line of body text that is long enough to count.\nand more\nIntroduction\nx"
    rows = spark.createDataFrame([("a", page, page), ("b", other, other), ("c", None, None)], "name string, first_page string, pages string")
    got = {r.name: r for r in screening.title_and_abstract(rows).collect()}
    assert got["a"].title == "Journal of X A long title of a paper" and got["a"].abstract.startswith("This is the body") and "Keywords" not in got["a"].abstract
    assert got["b"].abstract == "A dense first line of body text that is long enough to count. and more" and got["c"].title == got["c"].abstract == ""
    sheet = spark.createDataFrame([("old", "", "d0"), ("there", "10.1/t", "d0")], "name string, doi string, added string")
    assert screening.append_missing(sheet, spark.createDataFrame([("old",), ("x",)], "name string"), "d1").count() == 3
    renamed = spark.createDataFrame([("old", "new", "10.1/n"), ("gone", "fresh", "10.1/f"), ("z", "there", "10.1/z")], "original string, new string, doi string")
    assert {tuple(r) for r in screening.update_renamed(sheet, renamed, "d1").collect()} == {("new", "10.1/n", "d0"), ("there", "10.1/t", "d0"), ("fresh", "10.1/f", "d1")}
    value, method = screening.first_success([("one", "a"), ("two", "b")])
    tries = spark.createDataFrame([("", "x"), ("y", "z"), (None, " ")], "a string, b string").select(value.alias("v"), method.alias("m")).collect()
    assert [tuple(r) for r in tries] == [("x", "two"), ("y", "one"), (None, None)]
    models = spark.createDataFrame([(m,) for m in ("models/gemini-2.5-flash", "models/gemini-3.8-flash-lite", "models/gemini-3.8-flash", "models/gemini-3.8-flash-image", "other")], "id string")
    assert [r.name for r in screening.chat_models(models).orderBy("rank").collect()] == ["gemini-3.8-flash", "gemini-3.8-flash-lite", "gemini-2.5-flash"]


def test_unique_names_probe_until_free(spark):
    def named(names):
        rows = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, seq int").repartition(3)
        return [r.unique_name for r in dedup.unique_names(rows, "name", "seq").orderBy("seq").collect()]

    assert named(["a", "a", "a_2", "b", "b"]) == ["a", "a_2", "a_2_2", "b", "b_2"]
    assert named(["a_2", "a", "a", "a"]) == ["a_2", "a", "a_3", "a_4"]
    assert named(["a_2", "a_2", "a", "a"]) == ["a_2", "a_2_2", "a", "a_3"]
    assert named([]) == []
    two = spark.createDataFrame([("x", "a", 1), ("y", "a", 1), ("x", "a", 2)], "g string, name string, seq int")
    assert sorted(r.unique_name for r in dedup.unique_names(two, "name", "seq", ("g",)).collect()) == ["a", "a", "a_2"]


def test_unique_names_equal_the_loop(spark):
    import random

    rng = random.Random(4)
    # Names by chance, and a run of numbers that lies between rows of their name.
    cases = [[rng.choice(["a", "a", "a_2", "a_3", "a_2_2", "a_02", "b", "b_1", "b_2"]) for _ in range(60)] for _ in range(3)]
    cases.append(["a"] * 20 + [f"a_{i}" for i in range(21, 41)] + ["a"] * 20 + ["a_2"] * 3)
    rows = [(g, x, i) for g, names in enumerate(cases) for i, x in enumerate(names)]
    want = []
    for g, names in enumerate(cases):
        taken = set()
        for i, x in enumerate(names):
            free, k = x, 2
            while free in taken:
                free, k = f"{x}_{k}", k + 1
            taken.add(free)
            want.append((g, i, free))
    got = dedup.unique_names(spark.createDataFrame(rows, "g int, name string, seq int").repartition(5), "name", "seq", ("g",))
    assert sorted((r.g, r.seq, r.unique_name) for r in got.collect()) == want


def test_first_rows_by_partial_minima(spark):
    rows = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", None, "y"), ("b", 0, "z")], "k string, n int, v string")
    assert sorted(map(tuple, dedup.least_by(rows, ["k"], [F.col("n")]).collect()), key=str) == [("a", 1, "x"), ("b", None, "y")]


def test_screening_without_dois(spark):
    batch = spark.createDataFrame([("", "h1", "a"), (None, "h2", "b"), ("", "h2", "c"), ("10.1/x", "h3", "d"), ("10.1/X", "h4", "e"), ("10.1/y", None, "f")], "doi string, sha256 string, name string")
    corpus = spark.createDataFrame([("10.1/y", "h1"), (None, None)], "doi string, sha256 string")
    got = {r.name: r.outcome for r in dedup.screen_batch(batch, corpus).collect()}
    assert got == {"a": "duplicate_hash", "b": "kept_no_doi", "c": "kept_no_doi", "d": "kept", "e": "duplicate_batch", "f": "duplicate_doi"}


def test_title_suggestions(spark):
    from lexloom.sources import providers

    class Search:
        def __call__(self, title, n):
            return [f"{title} {i}" for i in range(0 if title == "none" else 5)]

    rows = spark.createDataFrame([("a", "one"), ("b", " "), ("c", None), ("d", "none")], "paper_id string, title string")
    assert sorted(map(tuple, providers.suggest(rows, Search).collect())) == [("a", 1, "one 0"), ("a", 2, "one 1"), ("a", 3, "one 2")]


def test_csv_with_a_mark(spark, tmp_path):
    from lexloom.sources import writers

    writers.write_csv(spark.createDataFrame([("x", 1)], "name string, n int").coalesce(1), str(tmp_path / "c"), mark=True)
    assert next((tmp_path / "c").glob("part-*")).read_bytes() == b"\xef\xbb\xbfname,n\nx,1\n"
