from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import ids, text, vectors


def python_tokens(x: str) -> list[str]:
    folded = "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
    out = []
    for raw in re.findall("[a-z0-9α-ω]+(?:-[a-z0-9α-ω]+)*", folded):
        parts = raw.split("-")
        out += [raw, *(parts if len(parts) > 1 else [])]
        for p in parts:
            s = re.findall("[a-zα-ω]+|[0-9]+", p)
            out += s if len(s) > 1 else []
    return out


CASES = ["Desulfurización y NR-SOB", "H2S, TiO2-Ag", "ÑANDÚ über ÉTÉ", "5 µm", "αβ-γ 2α", "", "-- a--b -c-", "co2-h2s-1"]


def test_tokens(spark):
    got = spark.createDataFrame([(c,) for c in [*CASES, None]], "t string").select(text.tokens("t").alias("x")).collect()
    assert [r.x for r in got] == [python_tokens(c or "") for c in [*CASES, None]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aAbñÉ12-_ .αμ", max_size=30), min_size=1, max_size=5))
def test_tokens_property(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.tokens("t").alias("x")).collect()
    assert [r.x for r in got] == [python_tokens(t) for t in texts]


def test_fold_fully(value):
    assert value(text.fold_fully(F.lit("ﬁn Ångström²"))) == "fin angstrom2"


@pytest.mark.parametrize("sentence,spanish", [("eliminación de azufre en un lavador", True), ("de de de", False), ("removal of sulfur", False), ("año", False), (None, False)])
def test_spanish(value, sentence, spanish):
    assert value(text.looks_spanish(F.lit(sentence).cast("string"))) is spanish


def test_names(value):
    assert value(text.slug(F.lit("Müller & Söhne's  Test-Case"))) == "muller_and_sohnes_test_case"
    assert value(text.stem(F.lit("A. B-C,  d"))) == "a_b_c_d"
    assert value(text.key(F.lit("[10.1/X] Yé"))) == "10_1_x_y"
    assert value(text.short_title(F.lit("The removal of H2S from biogas in a very long title with many more words"))) == "removal_h2s_biogas_very_long_title_many_more"
    assert value(text.short_title(F.lit("of the"))) == "of_the"
    assert value(text.short_title(F.lit(""))) == "untitled"
    assert value(text.file_name(F.lit('a<b>:c  d__e.pdf'))) == "a_b_c_d_e.pdf"
    assert len(value(text.file_name(F.lit("x" * 300 + ".pdf")))) == 180
    assert value(text.section(F.lit("2. Materials and Methods"))) == "methods"
    assert value(text.section(F.lit("Abstract results"))) == "abstract"
    assert value(text.title_key(F.lit("Été: a  (B)!"))) == "été a b"
    assert value(text.norm_space(F.lit("a \t b\r\n\r\n\r\n\r\nc "))) == "a b\n\nc"


@pytest.mark.parametrize(
    "mode,raw,want",
    [
        ("registry", " HTTPS://doi.org/10.1/A ", "https://doi.org/10.1/a"),
        ("corpus", "https://dx.doi.org/10.1000/Ab/", "10.1000/ab"),
        ("plain", "HTTP://DOI.org/10.1000/Ab/", "10.1000/Ab"),
        ("screen", "see https://doi.org/10.1000/Ab", ""),
        ("screen", "https://doi.org/10.1000/Ab", "10.1000/Ab"),
        ("text", "DOI: 10.1000/x129348Abstract", "10.1000/x129348"),
        ("text", "(10.1002/abc-2-Gwithin)", "10.1002/abc-2-G"),
        ("text", "none here", None),
        ("filename", "2020 - A - B [10.1016_j.x.2025.1].pdf", "10.1016/j.x.2025.1"),
        ("filename", "10.1515_znb-1986_1208.pdf", "10.1515/znb-1986_1208"),
        ("filename", "plain.pdf", None),
    ],
)
def test_doi(value, mode, raw, want):
    assert value(ids.doi(F.lit(raw), mode)) == want


def test_years(value):
    assert value(ids.year_in_id(F.lit("x12019a"))) == 2019
    assert value(ids.year_bounded(F.lit("x12019a 2031"))) == 2031
    assert value(ids.year_in_id(F.lit("2045_x"))) is None
    assert value(ids.year_in_text(F.lit("in 1998, or"))) == 1998
    assert value(ids.year_number(F.lit("n/a"))) is None


def test_paper_id(value):
    people = F.array(F.struct(F.lit("Ana Núñez").alias("full"), F.lit("Ana").alias("forename"), F.lit("Núñez").alias("surname")))
    assert value(ids.paper_id(F.lit(2020), people, F.lit("A study of Biogas"))) == "2020_nunez_study_biogas"
    empty = F.expr("cast(array() as array<struct<full:string,forename:string,surname:string>>)")
    assert value(ids.paper_id(F.lit(None).cast("int"), empty, F.lit(None).cast("string"))) == "0000_unknownauthor_untitled"


def test_vectors(value):
    unit = value(vectors.normalize(F.array(F.lit(3.0), F.lit(4.0))))
    assert unit == pytest.approx([0.6, 0.8])
    assert value(vectors.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert value(vectors.squared_distance(F.array(F.lit(1.0)), F.array(F.lit(-1.0)))) == 4.0
