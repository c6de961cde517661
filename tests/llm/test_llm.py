"""The operators for training data, each against brute force, a round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import binary, chat, components, convnet, flac, langid, mixing, packing, quality, registry, simhash, suffix, tokens, toxicity
from lexloom.llm.common import text_bytes
from tests.test_oracles import rows as compared

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, kept string, fp string"
LONG = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder about it all " * 30
CASES = [
    (1, "One short text with a few plain words in it, and then some more of them.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n ", "de", "b"),
    (5, LONG, "en", "a"),
    (5, LONG, "en", "a"),
    (6, LONG + "But this one ends in its own way.", "en", "b"),
    (None, "a text without a number", "fr", "a"),
    (8, "été ñandú 漢字 🎉 <|endoftext|> <|im_start|> x", "es", "b"),
    (9, "x" * 5000, None, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use."""
    return spark.createDataFrame([(i, t, lang, s, 0, "clash", "clash", "clash") for i, t, lang, s in CASES], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -100")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


# --- tokens and packing --------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abÉé'sS.,!*- \n\t1２ßİ漢́<|>endoftext", max_size=40), min_size=1, max_size=4))
def test_ids_equal_the_tokenizer(plain_tokenizer, texts):
    texts = [*texts, "<|endoftext|>a <|STARTOFTEXT|>", "it's 'S we'Re don't"]
    ids, at = tokens.WordTokenizer.shared(tokens.default_path()).encode(pa.array(texts))
    want = [plain_tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plan_places_every_rank_once(histogram):
    slots, fill = packing.plan(histogram, 64), {}
    for length in histogram:
        own = sorted((lo, hi) for n, lo, hi, _, _ in slots if n == length)
        assert own[0][0] == 0 and own[-1][1] == histogram[length] and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    for n, lo, hi, base, offset in slots:
        for i in range(hi - lo):
            fill.setdefault(base + i, []).append((offset, n))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(fill) == list(range(len(fill)))


@pytest.mark.parametrize("n", [1, 511, 512, 513, 2047, 2048, 2049, 9000])
def test_cuts_cover(n):
    at = 0
    for start, length in packing.cut(n):
        assert start == at and 0 < length <= 2048
        at += length
    assert at == n


def check_pieces(rows, docs_rows, tokenizer):
    ids = Counter()
    texts = {}
    for r in docs_rows:
        own = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        texts.setdefault(r.doc_id, own)
        ids[r.doc_id] += len(own)
    by_sequence = {}
    for r in rows:
        own = np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(texts[r.doc_id])
        ids[r.doc_id] -= r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(ids.values())
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    return by_sequence


@pytest.mark.parametrize("pack", [packing.pack, lambda d: binary.read_segments(binary.pack_binary(d, shard_tokens=2000))])
def test_packing(docs, none, plain_tokenizer, pack):
    check_pieces(pack(docs).collect(), docs.collect(), plain_tokenizer)
    assert pack(none).count() == 0


def test_little_padding(sample, plain_tokenizer):
    for pack in (packing.pack, lambda d: binary.read_segments(binary.pack_binary(d))):
        found = check_pieces(pack(sample).collect(), sample.collect(), plain_tokenizer)
        used = sum(n for parts in found.values() for _, n in parts)
        assert used > 0.9 * 2048 * len(found)


def test_binary_files(docs, tmp_path, spark):
    packed = binary.pack_binary(docs)
    binary.write_packed(packed, str(tmp_path / "p"))
    again = spark.read.parquet(str(tmp_path / "p"))
    key = lambda df: sorted(map(str, binary.read_segments(df).collect()))
    assert key(again) == key(packed)
    row = again.first()
    assert len(row.input_ids) == len(row.position_ids) == 4 * 2048 and row.cu_seqlens[0] == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_best_fit(lengths):
    where, offset = binary.best_fit(np.array(lengths, np.int64), 50)
    rooms, order = [], sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for i in order:  # the room taken is always the least that fits
        fits = [r for r in rooms if r >= lengths[i]]
        taken = min(fits) if fits else 50
        assert 50 - offset[i] == taken
        if fits:
            rooms.remove(taken)
        rooms.append(taken - lengths[i])


# --- chat ------------------------------------------------------------------------

TRICKY = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|a <\\\\| <", "", None, "plain\n", "<|", "|>", "漢\U0001f389"]


def test_chat_round_trip(spark):
    rows = [(c, t, r, TRICKY[(c * 3 + t) % len(TRICKY)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "as<|sis\ntant\\n", None])]
    rows += [(3, 2, "assistant", "again"), (None, 1, "assistant", "no number"), (7, None, "user", "null turn first"), (7, 0, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    out = chat.format_chat(turns)
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: chat.parse(r.formatted) for c, r in got.items()} == want
    for c, r in got.items():
        raw = r.formatted.encode()
        assert [chat.unescape(raw[s.start : s.stop].decode()) for s in r.loss_spans] == [x for role, x in want[c] if role == "assistant"]
    digest = {r.conv_id: r for r in chat.read_back(out).collect()}
    for c, said in want.items():
        trained = "".join(x for role, x in said if role == "assistant")
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (digest[c].loss_chars, digest[c].loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    assert chat.format_chat(turns.where("turn > 99")).count() == 0


# --- classifiers -----------------------------------------------------------------


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(0)
    words, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], ["vile", "nasty", "horrid"]
    rows = []
    for i in range(1200):
        text = list(rng.choice(words, 60))
        toxic = i % 5 == 0
        if toxic:
            text[int(rng.integers(60))] = str(rng.choice(bad)) + "."
        rows.append((i, " ".join(text), "en", "a", int(toxic)))
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int").cache()
    model = toxicity.fit(made, made.select("doc_id", "toxic"))
    scored = toxicity.score(made, model).join(made.select("doc_id", "toxic"), "doc_id").where("held_out")
    assert scored.where("predicted = toxic").count() > 0.97 * scored.count()
    far = "vile " + " ".join(["wab"] * 5000)
    assert abs(model.scores(pa.array([far]))[0] - model.scores(pa.array(["wab " * 5000 + "vile"]))[0]) < 0.5
    assert toxicity.score(docs, model).count() == len(CASES) and toxicity.score(none, model).count() == 0
    blank = toxicity.fit(none, made.select("doc_id", "toxic").limit(0))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}


def test_toxicity_forward_pass(spark, sample):
    """Scores against the net's definition, word by word."""
    model = toxicity.fit(sample, spark.read.parquet(f"{DIR}/labels.parquet"))
    texts = [r.text for r in sample.limit(20).collect()] + ["", None, "one"]
    for text, got in zip(texts, model.scores(pa.array(texts)), strict=True):
        ids, _ = toxicity.word_ids(*text_bytes(pa.array([text], pa.string())))
        x = np.concatenate((model.net.tables[0][ids[:, 0]] + model.net.tables[1][ids[:, 1]], np.zeros((4, toxicity.DIM), np.float32)))
        n = max(1, len(ids))
        pooled = np.concatenate([np.max([sum(x[i + j] @ f[j] for j in range(w)) for i in range(n)], axis=0) for w, f in model.net.filters.items()])
        z = np.maximum(pooled + model.net.bias, 0) @ model.net.out + model.net.shift
        assert got == pytest.approx(1 / (1 + np.exp(-(model.slope * (z[1] - z[0]) + model.intercept))), abs=1e-5)


def test_gradients_of_the_soft_maximum():
    rng = np.random.default_rng(0)
    y, size = rng.normal(size=(9, 2)), np.array([4, 5])
    for beta in (0.5, 3.0, None):
        pooled, share = convnet.pool(y, size, beta)
        for i in range(9):
            moved = y.copy()
            moved[i] += 1e-6
            step = (convnet.pool(moved, size, beta)[0] - pooled)[int(i >= 4)] / 1e-6
            assert np.allclose(step, share[i], atol=1e-3)


@pytest.mark.parametrize("rows", [1, 25])
def test_samples_are_bounded_under_repeats(spark, monkeypatch, rows):
    same = spark.range(600).selectExpr("if(id % 2 = 0, 4, 8) AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'en', 'fr') AS lang", "int(id % 2) AS toxic")
    assert toxicity.labelled_sample(same, same, rows).num_rows == 2
    assert langid.labelled_sample(same, rows).num_rows == 2
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 300) AS lang")
    found = langid.labelled_sample(many, rows)
    assert len(set(found.column("lang").to_pylist())) == 300 and found.num_rows <= 300 * rows


def test_toxicity_slices_agree(spark, sample, monkeypatch):
    model = toxicity.fit(sample, spark.read.parquet(f"{DIR}/labels.parquet"))
    texts = sample.limit(60).toArrow().column("text").combine_chunks()
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "SLICE", 97)
    monkeypatch.setattr(toxicity, "HASHED", 500)
    assert np.allclose(model.scores(texts), whole, atol=1e-6)


def test_language(spark, docs, none, sample):
    model = langid.fit(sample)
    found = langid.predict(sample, model).join(sample.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang_pred = lang").count() > 0.95 * found.count()
    odd = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect() if r.doc_id in (2, 3, 4)}
    assert odd == {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)}
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
    body, at = text_bytes(pa.array([sample.first().text[:200]]))
    ids = np.concatenate((langid._CLASS[body[: langid.WINDOW]], np.full(3, langid.PAD)))
    x = model.net.tables[0][ids]
    n = min(len(body), langid.WINDOW)
    pooled = np.concatenate([sum(x[j : n + j] @ model.net.filters[w][j] for j in range(w)).max(axis=0) for w in langid.WIDTHS])
    from lexloom.llm.convnet import softmax

    assert np.allclose(softmax(model.net.logits(pooled[None])), model.probabilities(body[:n], np.array([0, n])), atol=1e-4)


# --- duplicates -------------------------------------------------------------------


def brute_repeats(rows):
    """(removed bytes, spans, digest of what is left) by document, by trying every string."""
    seen, out = {}, []
    for i, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.get(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
        m = np.frombuffer(bytes(gone), np.uint8)
        kept = np.frombuffer(b, np.uint8)[m == 0].tobytes()
        out.append((i, len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m))) == 1).sum()), kept))
    return Counter(out)


def found_repeats(df):
    return Counter((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in df.collect() if r.doc_id is not None)


@pytest.mark.parametrize("batch,cuts", [(200, 4096), (4000, 4096), (1 << 22, 4096), (200, 1), (200, 2)])
def test_repeats_on_odd_texts(docs, none, batch, cuts, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix, "MOST_CUTS", cuts)
    assert found_repeats(suffix.remove_repeats(docs)) == brute_repeats([(r[0], r[1]) for r in CASES])
    assert suffix.remove_repeats(docs).where("doc_id is null").first().kept == b"a text without a number"
    assert suffix.remove_repeats(none).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_repeats_property(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list("abc é"), int(rng.integers(1, 90)))) for _ in range(6)]
    rows = [(int(i), "".join(str(rng.choice(parts)) for _ in range(int(rng.integers(0, 6))))) for i in rng.permutation(14)]
    monkeypatch.setattr(suffix, "BATCH_BYTES", 300)
    monkeypatch.setattr(suffix, "CHUNK", 128)
    assert found_repeats(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_repeats(rows)


@pytest.mark.parametrize("local,shared", [(0, 4096), (1, 2), (3, 4), (64, 1), (64, 4096)])
def test_repeats_at_crowded_anchors(spark, monkeypatch, local, shared):
    rng = np.random.default_rng(local)
    word = lambda n: "".join(rng.choice(list("abcde é"), n))
    line = "all rights reserved by those who wrote this and may be used by anyone at all"
    ends = [word(7) for _ in range(4)]
    rows = [(int(i), word(20) + str(rng.choice(ends)) + line + str(rng.choice(ends)) + word(int(rng.integers(0, 60)))) for i in rng.permutation(60)]
    monkeypatch.setattr(suffix, "MOST_LOCAL", local)
    monkeypatch.setattr(suffix, "MOST_SHARED", shared)
    monkeypatch.setattr(suffix, "BATCH_BYTES", 900)
    assert found_repeats(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_repeats(rows)


def test_crowded_anchors_spread():
    rng = np.random.default_rng(1)
    line = "all rights reserved by those who wrote this and may be used by anyone at all"
    texts = ["".join(rng.choice(list("abcdefgh"), 40)) + line + "".join(rng.choice(list("abcdefgh"), 40)) for _ in range(500)]
    batch = suffix.batch_of(pa.table({"doc_id": range(500), "text": texts}), 16)
    crowd = suffix._sizes(batch) > 64
    _, (shared, _, _), (rows, low, open_) = suffix._looked(batch, np.where(crowd, suffix.CROWDED, suffix.NEW))
    at_anchor = np.bincount(((batch.keys >> np.uint64(32)).astype(int))[batch.key[crowd[batch.key]]], minlength=16)
    hashes, at, dealt = suffix.crowded_windows(rows, low, open_, 16)
    by_window = np.bincount(dealt, minlength=16)
    assert len(rows) >= 500 and not len(shared) and at_anchor.max() > 4 * at_anchor.mean()
    assert by_window.max() < 1.3 * by_window.mean() and len(at) > len(rows) and len(np.unique(hashes, axis=0)) == len(hashes)


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(2)
    rows = np.zeros((40, suffix._ROW), np.uint8)
    rows[:, :-2] = rng.integers(97, 99, (40, suffix._ROW - 2))
    rows[20:] = rows[:20]
    rows[:, -2], rows[:, -1] = suffix.SIDE, suffix.WINDOWS
    want = suffix.repeated_windows(rows, np.arange(40))
    assert (want[20:] == (1 << 31) - 1).all() and not want[:20].any()
    monkeypatch.setattr(suffix, "_VALUES", np.ones_like(suffix._VALUES))
    monkeypatch.setattr(suffix, "_power", lambda n, lane=0: (np.ones(n, np.uint64), np.ones(n, np.uint64)))
    assert (suffix.repeated_windows(rows, np.arange(40)) == want).all()


def test_a_crowded_doc_id_has_several_batches(spark):
    rows = [(5 if i % 3 else i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for steps in (1, 3):
        found = suffix.batch_number(df, [0, 3, 5, 5, 5, 5, 100, 297], steps).collect()
        assert len({r.batch for r in found if r.doc_id == 5}) == 4 * steps
        ranges = sorted({(r.doc_id, r.batch // suffix.SALTS) for r in found})
        assert ranges == sorted(ranges, key=lambda x: x[1]) and len({b for i, b in ranges if i == 5}) == 1
        assert not {b for i, b in ranges if i == 5} & {b for i, b in ranges if i != 5}


def test_levels_stay_few_and_find_the_longest_prefix():
    rng = np.random.default_rng(4)
    make = lambda n: np.sort(np.ascontiguousarray(rng.integers(97, 99, (n, suffix._ROW), np.uint8)).view(f"S{suffix._ROW}").ravel()).view(np.uint8).reshape(n, -1)
    levels, all_rows = suffix.Levels(), []
    for i in range(64):
        all_rows.append(make(10))
        levels.add(all_rows[-1], i, np.arange(10 * i, 10 * i + 10))
    all_rows = np.concatenate(all_rows)
    assert len(levels.levels) <= 7 and sorted(levels.all()[2].tolist()) == list(range(640))
    asked = np.concatenate((make(30), all_rows[200:210]))
    prefix, rank = levels.scan(asked)
    want = np.array([max(suffix.common(all_rows, np.repeat(r[None], 640, axis=0))) for r in asked])
    assert (np.where(want < 8, 0, want) == np.where(prefix < 8, 0, prefix)).all() and rank[30:].tolist() == [20] * 10


def test_strip_keeps_columns(docs):
    out = suffix.strip_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(CASES)
    assert out.where("doc_id = 6").first().text.strip() != "" and out.where("doc_id = 2").first().text is None


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least id reachable over pairs of at most four differing bits."""
    label = dict.fromkeys(prints)
    for i in sorted(prints):
        if label[i] is None:
            todo = [i]
            while todo:
                a = todo.pop()
                if label[a] is None:
                    label[a] = i
                    todo += [b for b in prints if label[b] is None and (prints[a] ^ prints[b]).bit_count() <= 4]
    return label


def test_simhash(docs, none, sample, monkeypatch):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t, _, _ in CASES if i is not None}
    assert {i: f for i, (f, _) in got.items() if i is not None} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: c for i, (_, c) in got.items() if i is not None} == brute_components(prints)
    assert simhash.near_duplicates(none).count() == 0
    rows = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(sample).collect()}
    assert {i: c for i, (_, c) in rows.items()} == brute_components({i: f for i, (f, _) in rows.items()})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1


def test_keep_one_decides_by_row(spark):
    fox, sea, sky = LONG, "waves roll over the wide grey sea and gulls cry all day " * 20, "a sky of high thin cloud turned red before the storm came " * 20
    rows = [(7, fox, "a"), (7, sea, "a"), (None, sky, "a"), (None, sky, "b"), (None, "null ids may hold many different texts, each of them its own " * 9, "a"), (None, fox, "b"), (9, sea, "b"), (9, sea, "b"), (11, "", "a"), (11, "", "a")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t, _ in [rows[0], rows[1], rows[2], rows[4], rows[8]])


@pytest.mark.parametrize("many,block", [(1 << 24, 4096), (0, 4096), (1 << 24, 8), (0, 8)])
def test_links_lose_nothing(spark, monkeypatch, many, block):
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    prints = {}
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            base ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False))
            prints[len(prints)] = base
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in set(prints.values())], "fp long")
    counts = [spark.sparkContext.accumulator(0) for _ in range(3)]
    links = simhash.links(nodes.repartition(2), counts)
    links.count()
    met, chained, close = (c.value for c in counts)
    assert met > chained > close > 0
    roots = {r.node & (1 << 64) - 1: r.root for r in components.components(links, "u", "v").collect()}
    want = brute_components(prints)
    groups = {}
    for i, p in prints.items():
        groups.setdefault(want[i], set()).add(roots.get(p, simhash.signed(p)))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert components.components(links.limit(0), "u", "v").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.lists(st.integers(0, 63), max_size=7, unique=True))
def test_the_chain_never_rejects_a_near_pair(a, bits):
    b = a ^ sum(1 << i for i in bits)
    for length in (5, 7):
        masks, starts = simhash.chain_keys(length)
        meet = np.flatnonzero((np.uint64(a ^ b) & masks) == 0)
        one, other = np.full(len(meet), a, np.uint64), np.full(len(meet), b, np.uint64)
        assert bool(simhash.near(one, other, starts[meet]).any()) == (len(bits) <= 4)


# --- quality, mixing ---------------------------------------------------------------


def brute_quality(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, twice = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), twice, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(docs, none, sample):
    for df in (docs, sample):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in quality.judge(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0
    assert quality.keep_good(sample).columns == sample.columns


@pytest.mark.parametrize("places", [20, 3, 60])
def test_repeated_words_whatever_the_hash(spark, monkeypatch, places):
    """With few bits for places or for the hash the windows themselves decide."""
    monkeypatch.setattr(quality, "PLACES", places)
    rng = np.random.default_rng(places)
    texts = [" ".join(rng.choice(list("abcdef"), int(n))) for n in rng.integers(0, 40, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in df.select("doc_id", quality.repeated_words(F.array_remove(F.split("text", " "), "")).alias("n")).collect()}
    assert got == {i: brute_quality(t)[4] for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [200, 0])
def test_quality_knows_every_language(spark, sample, monkeypatch, most):
    monkeypatch.setattr(quality, "MOST_REFERENCES", most)
    rng = np.random.default_rng(3)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 10)))) for _ in range(200)) + "."
    texts = [(-1 - i, text("абвгдежзиклмнопрстуя"), "ru") for i in range(9)] + [(-11 - i, text("αβγδεζηθικλμνοπ"), "el") for i in range(9)]
    texts += [(-30, text("#*$%&|<>"), "ru"), (-31, "il la que y del por con una para los las el " + " ".join(["el"] * 40 + [text("abcdefghijklmno")]), "it")]
    both = sample.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality.judge(both).collect()}
    assert all(got[i].kept for i in (*range(-9, 0), *range(-19, -10))) and not got[-30].kept
    assert got[-31].word_distance is None
    before = {r.doc_id: r.kept for r in quality.judge(sample).collect()}
    assert {i: r.kept for i, r in got.items() if i >= 0} == before


@pytest.mark.parametrize("most", [200, 0])
def test_quality_of_unnamed_and_misnamed_languages(spark, sample, monkeypatch, most):
    """Clean texts stay whatever they name; junk goes even where it alone, or with few others, names its language."""
    monkeypatch.setattr(quality, "MOST_REFERENCES", most)
    rng = np.random.default_rng(4)
    text = lambda letters, n=300: " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 10)))) for _ in range(n))
    cyrillic, han, latin = "абвгдежзиклмнопрстуя", "的一是不了人我在有他这为之大来以个中上们", "abcdefghilmnoprstuv"
    clean = [(cyrillic, None), (cyrillic, "en"), (cyrillic, "ru"), (han, None), (han, "en"), (han, "zh"), (latin, None), (latin, "pl"), (latin, "xx")]
    junk = [("#*$%&|<>", x) for x in (None, "en", "ru", "xx", "yy")]
    rows = [(-1 - i, text(a), x) for i, (a, x) in enumerate(clean)] + [(-101 - i, text(a), x) for i, (a, x) in enumerate(junk)]
    rows += [(-1000 - i, text(latin, 100), "sv") for i in range(30)] + [(-2000 - i, text(cyrillic, 100), "uk") for i in range(30)] + [(-3000, text("#*$%&|<>"), "sv"), (-3001, text("#*$%&|<>"), "uk"), (-3002, text(cyrillic) + " " + text("#*$%&|<>", 900), "uk")]
    both = sample.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r.kept for r in quality.judge(both).where("doc_id < 0").collect()}
    assert [x for i, x in enumerate(clean) if not got[-1 - i]] == []
    assert [x for i, x in enumerate(junk) if got[-101 - i]] == []
    assert all(got[-1000 - i] and got[-2000 - i] for i in range(30)) and not any(got[i] for i in (-3000, -3001, -3002))
    alone = spark.createDataFrame([(1, text(latin), "en"), (2, text(han), None)], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.judge(alone).collect()] == [True, True]


def test_quality_sql_with_further_references(sample):
    langs = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("l"), F.col("doc_id") % 2)).otherwise(F.col("lang"))
    rows = sample.select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.translate("text", "abcdefghijklmno", "абвгдежзиклмнопа")).otherwise(F.col("text")).alias("text"), langs.alias("lang"))
    want = duckdb.connect()
    want.register("documents", rows.toPandas())
    kept = {r[0]: r[-1] for r in want.execute(quality.OP9_SQL).fetchall()}
    got = {r.doc_id: r.kept for r in quality.judge(rows).collect()}
    assert got == kept and {r.lang for r in rows.select("lang").distinct().collect()} == {"de", "en", "es", "fr", "l0", "l1"}


def test_distance(value):
    p, q = [1.0, 3.0, 0.0], [0.5, 0.0, 0.5]
    a, b = np.array(p) / 4, np.array(q)
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v)
    assert value(quality.distance(F.array(*map(F.lit, p)), q)) == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))


def test_quality_runs_no_python(sample):
    plan = quality.judge(sample)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_mixing(docs, none, sample):
    rate = {r.source: r.rate for r in mixing.rates(sample).collect()}
    sizes = {r.source: r.n for r in sample.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    target = {s: n**0.7 for s, n in sizes.items()}
    assert all(rate[s] == pytest.approx(min(8, target[s] / sum(target.values()) * sum(sizes.values()) / n)) for s, n in sizes.items())
    many = sample.crossJoin(sample.sparkSession.range(60)).withColumn("doc_id", F.col("doc_id") * 60 + F.col("id")).drop("id")
    mean = mixing.replicate(many, mixing.rates(many)).groupBy("source").count().collect()
    rows = {r.source: r["count"] for r in many.groupBy("source").count().collect()}
    again = {r.source: r.rate for r in mixing.rates(many).collect()}
    assert all(abs(r["count"] / rows[r.source] - again[r.source]) < 6 * (again[r.source] / rows[r.source]) ** 0.5 + 0.01 for r in mean)
    named = mixing.rates(docs, {"a": 1.0}).collect()
    assert {r.source for r in named if r.rate > 0} == {"a"}
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none).count() == 0


def test_small_sources_reach_their_weight(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "if(id % 100 = 0, 's', 'b') AS source")
    weights = {"s": 0.5, "b": 0.5}
    assert {r.source: r.rate for r in mixing.rates(rows, weights).collect()} == pytest.approx({"s": 50.0, "b": 50 / 99})
    counts = {r.doc_id: r["count"] for r in mixing.mix(rows, weights).where("source = 's'").groupBy("doc_id").count().collect()}
    assert len(counts) == 40 and abs(sum(counts.values()) - 2000) < 6 * 2000**0.5
    assert 20 < np.var(list(counts.values())) < 110
    u = spark.range(20_000).select(mixing.copies(F.lit(900.0), F.col("id")).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(u[0] - 900) < 6 * (900 / 20_000) ** 0.5 and abs(u[1] / 900 - 1) < 0.1


def test_mix_sql_with_rates_of_many_parts(spark, sample):
    """A small source with a rate over MOST_RATE, null sources and a null id, in SQL too."""
    rows = sample.withColumn("source", F.when(F.col("doc_id") == 3, "tiny").when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise("large")).withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    duck = duckdb.connect()
    duck.register("documents", rows.toPandas().astype({"doc_id": "Int64"}))
    sql = mixing.OP5_SQL.replace(f"pow(chars::DOUBLE, {mixing.TEMPERATURE})", "pow(chars::DOUBLE, 0.0)")
    want = Counter((r[0], r[1], r[2], round(r[3], 6), r[-1]) for r in duck.execute(sql).fetchall())
    whole = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("")) for c in mixing.DOCUMENT)), 256)
    got = mixing.draws(rows, temperature=0.0).select("row.doc_id", "row.source", "_copy", "_rate", whole.alias("h")).collect()
    assert Counter((r.doc_id, r.source, r["_copy"], round(r["_rate"], 6), r.h) for r in got) == want
    assert max(r["_rate"] for r in got) > 5 * mixing.MOST_RATE


def test_the_mix_has_partitions_for_its_text(sample, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_CHARS", 20_000)
    mixed = mixing.mix(sample)
    chars = sample.agg(F.sum(F.length("text"))).first()[0]
    assert abs(mixed.rdd.getNumPartitions() - chars / 20_000) < 2 + 0.02 * chars / 20_000


def test_equal_rows_are_packed_in_many_parts(spark, monkeypatch):
    """Equal pieces of one length are dealt by row, and each has a place of its own."""
    monkeypatch.setattr(packing, "PART_ROWS", 100)
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text")).repartition(4)
    parts = []
    window = packing.Window.partitionBy

    def seen(*by):
        parts.append(by)
        return window(*by)

    monkeypatch.setattr(packing.Window, "partitionBy", seen)
    got = packing.pack(rows).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000 and ("length", "part") in parts
    length = got[0].length
    each = 2048 // length
    assert Counter(Counter(r.sequence_id for r in got).values()) == Counter({each: 3000 // each} | ({3000 % each: 1} if 3000 % each else {}))


def test_samples_have_a_bound_whatever_the_table(spark, monkeypatch):
    """Of too many languages the largest are learned; of very long labelled texts a piece is."""
    monkeypatch.setattr(langid, "MOST_ROWS", 60)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("l"), F.col("id"))).alias("lang"), F.lit("some words here").alias("text"))
    sample = langid.labelled_sample(rows, 400)
    assert len(sample) <= 60 and sample.column("lang").to_pylist().count("big") == 20
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 50)
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    sample = toxicity.labelled_sample(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), 30)
    pieces = set(sample.column("text").to_pylist())
    assert len(sample) == 60 and all(len(p) == 50 and p in text for p in pieces) and len(pieces) > 20


def test_op5_shuffles_texts(spark):
    plan = mixing.op5_poisson_mix(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Sort \[[^\n]*\n[ +-]*RepartitionByExpression[^\n]*\n[ +-]*Project \[doc_id#\d+L, row#\d+, ", plan)  # rows with all their columns
    mixed = mixing.draws(spark.read.parquet(f"{DIR}/documents.parquet"))
    keys = [r._shuffle_key for r in mixed.select("_shuffle_key").collect()]
    assert keys == sorted(keys) and len(keys) > 100


# --- FLAC -------------------------------------------------------------------------


def test_flac_round_trip(docs, none):
    for r in flac.digests(flac.encode_media(docs)).collect():
        texts = {(t or "").encode() for i, t, _, _ in CASES if i == r.doc_id}
        want = [b + bytes(-len(b) % 64 or (64 if not b else 0)) for b in texts]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) in {(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for p in want}
    blocks = flac.pcm_blocks(flac.encode_media(docs.where("doc_id = 9"))).orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0") == b"x" * 5000 and [b.first_sample for b in blocks] == [512 * i for i in range(len(blocks))]
    assert flac.digests(flac.encode_media(none)).count() == 0


def test_flac_damaged_streams(spark):
    good = flac.encode(np.arange(1280, dtype=np.uint8), np.array([0, 640, 1280]))
    bad = bytearray(good[1])
    bad[-3] ^= 1
    rows = [(1, 640, good[0]), (2, 640, bytes(bad)), (3, 640, good[1]), (4, 0, b""), (5, 3, b"abc"), (6, 0, None), (None, 640, good[0])]
    media = spark.createDataFrame([(i, n, None if b is None else bytearray(b)) for i, n, b in rows], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r.doc_id: r for r in flac.digests(media).collect()}
    assert {i for i, r in got.items() if r.payload_bytes == 640} == {1, 3, None}
    assert all(got[i].payload_sha256 is None and got[i].feature is None for i in (2, 4, 5, 6)) and got[2].media_bytes == len(bad) and got[6].media_bytes is None
    blocks = flac.pcm_blocks(media).collect()
    assert {r.doc_id for r in blocks if r.pcm is None} == {2, 4, 5, 6}
    assert b"".join(bytes(r.pcm) for r in sorted((r for r in blocks if r.doc_id == 3), key=lambda r: r.first_sample)) == bytes(range(128, 256)) + bytes(range(256)) * 2


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from(["noise", "ramp", "flat", "tone"]), st.integers(1, 30))
def test_flac_signals(seed, kind, units):
    rng, n = np.random.default_rng(seed), 64 * units
    x = {"noise": rng.integers(0, 256, n), "ramp": np.arange(n) * int(rng.integers(1, 5)) % 256, "flat": np.full(n, int(rng.integers(256))), "tone": 128 + 100 * np.sin(np.arange(n) / 9)}[kind].astype(np.uint8)
    stream = flac.encode(x, np.array([0, n]))
    assert flac.decode(stream)[0][0] == x.tobytes()
    broken = bytearray(stream[0])
    broken[-int(rng.integers(1, 10))] ^= 1 << int(rng.integers(8))
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])


def test_flac_linear_prediction():
    """A hand-made frame with a quantised predictor of order two and two Rice partitions."""
    n, weight, shift = 64, (2, -1), 0
    x = [(i * i // 40) - 60 for i in range(n)]
    residual = [x[i] - ((weight[0] * x[i - 1] + weight[1] * x[i - 2]) >> shift) for i in range(2, n)]
    bits = "0" + format(32 + 1, "06b") + "0" + "".join(format(v & 0xFF, "08b") for v in x[:2]) + format(4, "04b") + format(shift, "05b") + "".join(format(w & 31, "05b") for w in weight)
    bits += "00" + "0001"
    for part in (residual[:30], residual[30:]):
        bits += "0001"
        for r in part:
            u = 2 * r if r >= 0 else -2 * r - 1
            bits += "0" * (u >> 1) + "1" + str(u & 1)
    bits += "0" * (-len(bits) % 8)
    head = flac._header(0, n)
    row = lambda b: np.frombuffer(b, np.uint8)[None]
    frame = head + bytes([int(flac.crc8(row(head))[0])]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += int(flac.crc16(flac._right(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)])))[0]).to_bytes(2, "big")
    got = flac.decode_frames(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), np.array([n]), np.array([0]))
    assert got[0].tolist() == x


class Bits:
    """Bits of a stream, one after another."""

    def __init__(self, data):
        self.all, self.at = "".join(format(b, "08b") for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.all[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        q = self.all.index("1", self.at) - self.at
        self.at += q + 1
        return q


def slow_flac(blob):
    """Samples of an 8-bit mono stream, read bit by bit as the format is described, and the kinds of its subframes."""
    at, last = 4, 0
    while not last:
        last, size = blob[at] >> 7, int.from_bytes(blob[at + 1 : at + 4], "big")
        if not blob[at] & 127:
            total = int.from_bytes(blob[at + 14 : at + 22], "big") & (1 << 36) - 1
        at += 4 + size
    bits, out, kinds = Bits(blob[at:]), [], []
    while len(out) < total:
        assert bits.take(16) == 0xFFF8
        code, rate, _ = bits.take(4), bits.take(4), bits.take(8)
        lead = bits.take(8)
        bits.take(8 * max(0, len(format(lead, "08b").split("0")[0]) - 1))
        n = bits.take(8) + 1 if code == 6 else bits.take(16) + 1 if code == 7 else 192 if code == 1 else 256 << (code - 8)
        bits.take(16 if rate == 12 else 8)
        kind = bits.take(8) >> 1
        kinds.append(kind)
        if kind < 2:
            x = [bits.signed(8)] * n if kind == 0 else [bits.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [bits.signed(8) for _ in range(order)]
            weight, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None, 0
            if kind >= 32:
                precision, shift = bits.take(4) + 1, bits.take(5)
                weight = [bits.signed(precision) for _ in range(order)]
            width, parts = 4 + bits.take(2), 1 << bits.take(4)
            for part in range(parts):
                k = bits.take(width)
                plain = bits.take(5) if k == (1 << width) - 1 else None
                for _ in range(n // parts - (order if part == 0 else 0)):
                    if plain is None:
                        u = bits.unary() << k | bits.take(k)
                        r = u >> 1 if u % 2 == 0 else -(u + 1) // 2
                    else:
                        r = bits.signed(plain)
                    x.append(r + (sum(w * v for w, v in zip(weight, x[::-1])) >> shift))
        out += x
        bits.at += -bits.at % 8 + 16
    return bytes(v + 128 for v in out), kinds


def test_flac_streams_bit_by_bit(docs):
    """The encoder's streams, read by a plain reader of the format; linear predictors are among them."""
    seen = set()
    for r in flac.encode_media(docs).collect():
        payload, kinds = slow_flac(bytes(r.media))
        assert payload == flac.decode([bytes(r.media)])[0][0] and payload.rstrip(b"\0") in {(t or "").encode() for _, t, _, _ in CASES}
        seen |= set(kinds)
    rng = np.random.default_rng(5)
    tone = (128 + 60 * np.sin(np.arange(2048) / 7) + rng.normal(0, 3, 2048)).astype(np.uint8)
    payload, kinds = slow_flac(flac.encode(tone, np.array([0, 2048]))[0])
    assert payload == tone.tobytes() and 31 + flac.LPC_ORDER in kinds
    noise = rng.integers(0, 256, 640).astype(np.uint8)
    payload, kinds = slow_flac(flac.encode(noise, np.array([0, 640]))[0])
    assert payload == noise.tobytes() and kinds == [1, 1]


@pytest.mark.parametrize("block", [16, 512, 1024, 4608])
def test_flac_block_sizes(block):
    """Streams don't depend on what else is in a batch, whatever the size of frames."""
    rng = np.random.default_rng(block)
    parts = [rng.integers(90, 122, 64 * int(u)).astype(np.uint8) for u in (1, 40, 200)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    streams = flac.encode(np.concatenate(parts), offsets, block)
    for part, stream in zip(parts, streams, strict=True):
        assert slow_flac(stream)[0] == part.tobytes() and flac.encode(part, np.array([0, len(part)]), block) == [stream]
        payload, points = flac.decode([stream])[0]
        assert payload == part.tobytes() and points["sample"].tolist() == list(range(0, len(part), block))
    assert [p for p, _ in flac.decode(streams)] == [p.tobytes() for p in parts]


def foreign_flac(x, size, rng, escape):
    """A stream of other habits: no seek table, blocks of 192, eight Rice partitions, escapes, a rate beside the header."""
    out = b""
    row = lambda b: np.frombuffer(b, np.uint8)[None]
    for number, a in enumerate(range(0, len(x), size)):
        v = x[a : a + size]
        n, parts = len(v), 8 if len(v) % 8 == 0 and len(v) > 16 else 1
        bits = format((8 + 1) << 1, "08b") + format(v[0] & 255, "08b") + "01" + format(parts.bit_length() - 1, "04b")
        residual = [v[i] - v[i - 1] for i in range(1, n)]
        for part in range(parts):
            own = residual[max(0, part * n // parts - 1) : (part + 1) * n // parts - 1]
            if escape(part):
                width = 0 if not any(own) else 10
                bits += "11111" + format(width, "05b") + "".join(format(r & 1023, "010b") for r in own if width)
            else:
                bits += "00011"
                for r in own:
                    u = 2 * r if r >= 0 else -2 * r - 1
                    bits += "0" * (u >> 3) + "1" + format(u & 7, "03b")
        bits += "0" * (-len(bits) % 8)
        head = b"\xff\xf8" + (bytes([0x1C, 0]) + flac._number(number) if n == 192 else bytes([0x6C, 2]) + flac._number(number) + bytes([n - 1])) + bytes([8])
        frame = head + bytes([int(flac.crc8(row(head))[0])]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out += frame + int(flac.crc16(flac._right(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)])))[0]).to_bytes(2, "big")
    digest = hashlib.md5(bytes(v & 255 for v in x)).digest()
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + digest
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + out


@pytest.mark.parametrize("escape", [lambda p: False, lambda p: p % 2 == 1, lambda p: True])
def test_flac_foreign_streams(escape):
    rng = np.random.default_rng(3)
    x = [int(v) for v in np.clip(np.cumsum(rng.integers(-9, 10, 500)), -128, 127)] + [5] * 130
    stream = foreign_flac(x, 192, rng, escape)
    want = bytes(v + 128 for v in x)
    payload, points = flac.decode([stream])[0]
    assert payload == want == slow_flac(stream)[0] and points["sample"].tolist() == [0, 192, 384, 576]
    mixed = flac.decode([flac.encode(np.arange(128, dtype=np.uint8), np.array([0, 128]))[0], stream])
    assert mixed[0][0] == bytes(range(128)) and mixed[1][0] == want
    assert flac.decode_each([stream[:-1], stream])[0] is None


# --- queries and pipeline ------------------------------------------------------------


def test_registered_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, DIR).toPandas(), c.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and compared(got) == compared(want), name


def test_pipeline(spark, docs, sample):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "sequence_packing"]
    now = sample
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, DIR)
        assert now.columns == sample.columns
        if name == "quality_rules":
            bad = {r.doc_id for r in quality.judge(before).where("not kept").collect()}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()} == bad
        if name == "near_duplicates":
            c = {r.doc_id: r.component_id for r in simhash.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in now.collect()) == sorted(set(c.values()))
        if name == "repeated_passages":
            want = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in brute_repeats([(r.doc_id, r.text) for r in before.collect()])}
            assert {r.doc_id: r.text for r in now.collect()} == want
    assert corpus_pipeline.run(spark, DIR).count() > 0
    for _, stage in corpus_pipeline.STAGES:  # odd rows and no rows go through
        stage(spark, docs, DIR).count()
        assert stage(spark, docs.where("doc_id < -9"), DIR).count() == 0


def test_no_switch_by_size_changes_the_pipeline(spark, docs, sample, monkeypatch):
    """Every stage gives the same rows with the switches of small and of large inputs, and however its rows lie in partitions."""
    rows = sample.unionByName(docs.select(*sample.columns)).where("length(text) < 3000 OR text IS NULL").limit(150)
    rows = spark.createDataFrame(rows.collect(), rows.schema)

    def results(n: int) -> dict[str, list[str]]:
        return {name: sorted(map(str, stage(spark, rows.repartition(n), DIR).collect())) for name, stage in corpus_pipeline.STAGES}

    want = results(3)
    assert all(want.values())
    for module, name, value in [(quality, "MOST_REFERENCES", 0), (simhash, "MANY", 0), (simhash, "BLOCK", 4), (simhash, "MOST_BROADCAST", 0), (mixing, "MOST_BROADCAST", 0), (mixing, "TASK_CHARS", 20_000), (packing, "PART_ROWS", 3), (packing, "AT_ONCE", 2), (suffix, "BATCH_BYTES", 20_000), (suffix, "SLICE_BYTES", 20_000), (suffix, "TASK_BYTES", 20_000), (suffix, "MOST_CUTS", 2), (suffix, "MOST_LOCAL", 1), (suffix, "MOST_SHARED", 2)]:
        assert hasattr(module, name)
        monkeypatch.setattr(module, name, value)
    got = results(5)
    assert {n: got[n] == want[n] for n in want} == dict.fromkeys(want, True)
