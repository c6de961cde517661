"""Window removal, spelling variants and whitening, each against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import spelling, whitening, windows
from tests.llm.test_llm import CASES, DIR, docs, none  # noqa: F401  (fixtures)

SPACE = re.compile(r"[\x20\x09-\x0D]+")


# --- windows -------------------------------------------------------------------


def slow_removal(rows: list[tuple], window: int) -> list[tuple]:
    """(doc_id, words, spans, kept) by comparing word lists."""
    split = [(i, [w for w in SPACE.split(t or "") if w]) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone, own = set(), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None and (least[key] < i or key in own):
                gone.update(range(k, k + window))
            own.add(key)
        edges = [k for k in range(len(w) + 1) if (k in gone) != (k - 1 in gone)]
        out.append((i, len(w), tuple(zip(edges[::2], edges[1::2], strict=True)), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def removed(df, window: int) -> list[tuple]:
    return sorted(((r.doc_id, r.n_words, tuple((s.start, s.stop) for s in r.spans), r.kept) for r in windows.remove_windows(df, window).collect()), key=repr)


@pytest.mark.parametrize(("batch", "window"), [(1 << 30, 20), (100, 20), (40, 3), (1, 1)])
def test_windows_on_odd_texts(docs, none, batch, window, monkeypatch):  # noqa: F811
    monkeypatch.setattr(windows, "BATCH_BYTES", batch)
    assert removed(docs, window) == slow_removal([(i, t) for i, t, *_ in CASES], window)
    assert windows.remove_windows(none, window).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_windows_property(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(windows, "BATCH_BYTES", 300)
    rows = [(rng.choice([None, 1, 1, 2, 3, 4, 5, 9]), rng.choice([" ", "\n\x0b", "  "]).join(rng.choice(["a", "b", "á", "bb"]) for _ in range(rng.randrange(60)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(df, 4) == slow_removal(rows, 4)


def test_windows_of_very_long_words(spark):
    word = "y" * 300_000
    rows = [(1, f"{word} a b"), (2, f"  {word}\ta  b c" + " " * 200_000), (3, f"{word}x a b")]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), 3) == slow_removal(rows, 3)


def test_a_passage_of_many_documents_is_one_entry_of_a_batch(spark, monkeypatch):
    """Whatever number of documents shares a passage, a slice gets each of its windows once from a batch."""
    passage = " ".join(f"w{i}" for i in range(50))
    texts = pa.table({"doc_id": list(range(500)), "text": [passage] * 500})
    batch = windows.batch_of(texts, 8, 20)
    assert len(batch.at) == 500 * 31 and len(batch.new) == 31
    monkeypatch.setattr(windows, "BATCH_BYTES", 20_000)
    got = windows.remove_windows(spark.range(500).select(F.col("id").alias("doc_id"), F.lit(passage).alias("text")))
    assert sorted((r.doc_id, r.kept) for r in got.collect())[:2] == [(0, passage), (1, "")] and got.where("kept = ''").count() == 499


@pytest.mark.parametrize("window", [1, 2, 7, 20, 33])
def test_window_hashes_are_polynomials(window):
    v = np.random.default_rng(window).integers(0, 1 << 63, 100, np.uint64)
    want = [sum(int(x) * pow(windows._WORD, window - 1 - j, 1 << 64) for j, x in enumerate(v[i : i + window])) % (1 << 64) for i in range(100 - window + 1)]
    assert windows.window_hashes(v, window).tolist() == want
    assert len(windows.window_hashes(v[: window - 1], window)) == 0


# --- spelling ------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    """By the definition: every insertion, deletion and replacement of one letter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def slow_words(rows: list[tuple]) -> Counter:
    out: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            out[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 7 and n >= 2})


def slow_variants(words: dict[str, int], pairs=None) -> dict[str, tuple]:
    of = defaultdict(list)
    for a in words:
        of[a] = [b for b in words if b != a and near(a, b)]
    form = {}
    for a, n in words.items():
        best = min(of[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for a, n in words.items():
        root = a
        while form[root]:
            root = form[root]
        out[a] = n, form[a], root, len(of[a]), words[form[a]] if form[a] else None
    return out


def found(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("size", [1 << 16, 300])
def test_variants_equal_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "PART_ROWS", size)
    rng = random.Random(size)
    words = {"".join(rng.choice("abcáà÷ÀÁ") for _ in range(rng.randint(1, 6))): rng.choice([2, 3, 30, 400, 5000, 60000]) for _ in range(400)}
    words |= {"é" * 60: 5, "é" * 61: 50, "é" * 59 + "y": 500, "y" + "é" * 58 + "z": 6000, "x" * 300: 7, "x" * 301: 70, "x" * 302: 700, "x" * 300 + "yz": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variants(df)) == slow_variants(words)


def test_each_pair_is_found_once():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abqiáé") for _ in range(rng.randint(2, 6))) for _ in range(700)})
    code, ends = spelling.letters(pa.array(words))
    assert "".join(map(chr, code)) == "".join(words)
    for parts in (1, 5):
        got = [tuple(sorted((int(a), int(b)))) for p in range(parts) for q, x in spelling.near_pairs(code, ends, p, parts) for a, b in zip(q, x, strict=True)]
        want = {(i, j) for j, b in enumerate(words) for i, a in enumerate(words[:j]) if near(a, b)}
        assert len(got) == len(want) and set(got) == want


def test_the_trie_spends_one_deficit_and_then_one_surplus():
    counts = np.zeros((5, spelling.LEVELS), np.int64)
    counts[0, [1, 2]] = 1  # a row, without its 1, with a 3 instead, with two more, with a 0 instead
    counts[1, [2]] = 1
    counts[2, [2, 3]] = 1
    counts[3, [2, 3, 4]] = 1
    counts[4, [0, 2]] = 1
    order = np.lexsort(counts.T[::-1])
    trie, at = spelling.Trie(np.zeros(5, np.uint64), counts[order]), {int(o): i for i, o in enumerate(order)}
    lost = np.full(5, 1)
    reached = {int(trie.node[spelling.LEVELS][at[k]]) for k in (1, 2)}
    assert {int(leaf) for _, leaves in trie.search(np.array([at[0]]), lost) for leaf in leaves} == reached


def test_words_of_odd_texts(spark, docs, none):  # noqa: F811
    more = [(i, t) for i in (1, 2, 3) for t in ("Straßenbahn ÀLPHABET×ÉTÉ alphabet's naïveté " * 3, "ABCDEFG abcdefg Āabcdefg漢abcdefgh", None)]
    rows = [(i, t) for i, t, *_ in CASES] + more
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = slow_words(rows)
    assert {r.word: r.n for r in spelling.corpus_words(df).collect()} == dict(want)
    assert found(spelling.variants(spelling.corpus_words(df))) == slow_variants(dict(want))
    assert spelling.variants(spelling.corpus_words(none)).count() == 0
    long = spark.createDataFrame([(1, "z" * 400_000 + " " + "z" * 400_000), (1, "z" * 399_999), (1, "z" * 399_999)], "doc_id long, text string")
    assert spelling.variants(spelling.corpus_words(long, 1 << 40)).where("n_near = 1").count() == 2


def test_roots_of_long_chains(spark):
    words = {"a" * k: 10**k for k in range(1, 12)}
    assert {r.root for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()} == {"a" * 11}


# --- whitening -----------------------------------------------------------------


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for low, high, rows in [(-1000, 5000, 777), (0, 1, 64), (5, 6, 1), (-(10**14), 10**14, 130)]:
        x = rng.integers(low, high + 1, (rows, 5))
        s, p = whitening.scatter(x)
        y = x.astype(object)
        assert s.tolist() == y.sum(axis=0).tolist() and p.tolist() == (y.T @ y).tolist()


def check_whitening(rows: list[tuple], got: list, components: int) -> None:
    kept = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == Counter((i, int(q)) for (i, _), q in zip(kept, (d * d).sum(axis=1), strict=True))
    assert {r.n for r in got} == {n}
    z = np.array([r.whitened for r in got], float)
    assert z.shape == (n, min(components, x.shape[1]))
    assert np.abs(z.T @ z / n - np.eye(z.shape[1])).max() < 1e-9 and np.abs(z.mean(axis=0)).max() < 1e-9
    v = (d.T @ d / n**3).astype(float)
    values = np.sort(np.linalg.eigvalsh(v))[::-1][: z.shape[1]]
    assert np.allclose(got[0].explained, values / np.trace(v), rtol=1e-9)
    assert got[0].identity_error < 1e-9 and len({(tuple(r.explained), r.identity_error) for r in got}) == 1


@pytest.mark.parametrize(("dims", "rows", "scale"), [(3, 200, 1.0), (40, 500, 2.0), (5, 150, 1e9)])
def test_whitening(spark, dims, rows, scale):
    rng = np.random.default_rng(dims)
    data = [(int(i // 2), (scale * rng.normal(size=dims) * (1 + np.arange(dims))).tolist()) for i in range(rows)]
    data += [(None, [1.0] * dims), (7, None), (8, [None] * dims), (9, [float("nan")] * dims), (10, [float("-inf")] + [0.0] * (dims - 1)), (11, [])]
    df = spark.createDataFrame([(i, v, "clash", 0) for i, v in data], "vec_id long, embedding array<double>, n string, deviation int").repartition(3)
    check_whitening(data, whitening.whiten(df).collect(), whitening.COMPONENTS)


def test_whitening_of_hardly_anything(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(df([(1, None)])).count() == 0
    one = whitening.whiten(df([(1, [1.0, 2.0])])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained) for r in one] == [(1, 0, [None, None], [0.0, 0.0])]
    line = whitening.whiten(df([(i, [float(i), -float(i)]) for i in range(4)])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1] is None for r in line) and line[0].identity_error < 1e-9
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30])]):
        with pytest.raises(Exception, match="several lengths|too large"):
            whitening.whiten(df(bad)).count()


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    got = whitening.op13_bitsliced_whitening(spark, DIR).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    from types import SimpleNamespace

    check_whitening(rows, [SimpleNamespace(vec_id=i, n=c[1].n, deviation=c[1].deviation, whitened=[c[k].whitened for k in sorted(c)], explained=[c[k].explained for k in sorted(c)], identity_error=c[1].identity_error) for i, c in by.items()], 32)


# --- SQL -----------------------------------------------------------------------


@pytest.mark.parametrize(("query", "sql"), [(windows.op11_window_dedup, windows.OP11_SQL), (spelling.op12_spelling_variants, spelling.OP12_SQL)])
def test_new_sql(spark, query, sql):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got, want = query(spark, DIR), duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_digests(spark):
    got = windows.op11_window_dedup(spark, DIR).where("n_removed = 0").first()
    text = spark.read.parquet(f"{DIR}/documents.parquet").where(F.col("doc_id") == got.doc_id).first().text
    assert hashlib.sha256(" ".join(w for w in SPACE.split(text) if w).encode()).hexdigest() == got.kept_sha256
