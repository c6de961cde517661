from __future__ import annotations

import difflib
import random

import pytest

from lexloom.functions import blocks


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_ratios_equal_difflib(monkeypatch, at_once):
    """Short and long pairs, with characters that are too frequent to begin a block, all in one batch."""
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    rng = random.Random(6)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [("", ""), ("", "x"), ("x", ""), ("aaaa", "aaaa"), ("ab" * 120, "ba" * 130), ("é漢🎉", "漢🎉é")]
    for _ in range(250):
        letters = rng.choice(["ab", "abcdefgh", "abcé漢🎉 "])
        a = text(rng.randrange(50), letters)
        cut = rng.randrange(len(a) + 1)
        pairs.append((a, a[:cut] + text(rng.randrange(5), letters) + a[cut + rng.randrange(4) :] if rng.random() < 0.7 else text(rng.randrange(50), letters)))
    for _ in range(20 if at_once > 50 else 2):
        a = text(rng.randrange(150, 400), "abcdefghijklmnopqrstuvwxyz    eee")
        pairs.append((a, a[:80] + text(40, "abc xyz") + a[120:] + text(rng.randrange(150), "the ")))
    assert blocks.matching_ratios(*map(list, zip(*pairs, strict=True))).tolist() == [ratio(a, b) for a, b in pairs]
    assert blocks.matching_ratios([], []).tolist() == []


def test_titles_by_ratio(spark):
    from pyspark.sql import functions as F

    from lexloom.operators import validation

    rows = spark.createDataFrame([("a study of gas", "a study of gases"), ("short", "another text of its own"), (None, None), ("same", "same")], "a string, b string")
    got = [r.r for r in rows.select(validation.matching_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got[0] == ratio("a study of gas", "a study of gases") and got[1] < 0.85 and got[2:] == [1.0, 1.0]
