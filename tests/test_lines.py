"""Files split by bytes, against whole files read in one piece."""

from __future__ import annotations

import csv
import random

import pytest

from lexloom.sources import lines, readers


@pytest.fixture(params=[30, 1 << 20])
def small_blocks(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "1")
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def slow_records(text: str) -> list[tuple[int, str]]:
    out, start, held, odd = [], 1, [], 0
    rows = text.split("\n")
    if rows[-1] == "":
        rows.pop()
    for n, line in enumerate(rows, 1):
        if not held:
            start = n
        held.append(line)
        odd ^= line.count('"') & 1
        if not odd:
            out.append((start, "\n".join(held)))
            held = []
    return out + ([(start, "\n".join(held))] if held else [])


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_lines_and_records_have_their_numbers(spark, tmp_path, small_blocks, monkeypatch, most):
    monkeypatch.setattr(lines, "MOST_BLOCKS", most)
    rng = random.Random(7)
    texts = {f"f{i}.txt": "\n".join("".join(rng.choice(['a', 'é"', '"', ' b', ',', "\r", "漢"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(40))) for i in range(6)}
    texts |= {"empty.txt": "", "one.txt": "\n", "long.txt": 'x"' + "y" * 300 + "\n\n" + "z" * 200 + '"\nend\n'}
    (tmp_path / "deep").mkdir()
    for name, text in texts.items():
        (tmp_path / ("deep" if name == "f1.txt" else ".") / name).write_text(text, newline="")
    whole = lambda text: text.split("\n")[: -1 if text.endswith("\n") or not text else None]
    name = lambda r: r.path.rpartition("/")[2]
    found = lines.numbered(spark, str(tmp_path))
    assert sorted((name(r), r.line_no, r.line) for r in found.collect()) == sorted((n, i, x) for n, t in texts.items() for i, x in enumerate(whole(t), 1))
    assert sorted((name(r), r.line_no, r.record) for r in lines.records(spark, str(tmp_path)).collect()) == sorted((n, i, x) for n, t in texts.items() for i, x in slow_records(t))
    if small_blocks == 30:
        assert found.rdd.getNumPartitions() > len(texts) or most == 0


def test_one_file_is_many_tasks(spark, tmp_path, small_blocks):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"doi": "10.1/{i}", "paper_id": "P {i}"}}\n' if i % 5 else "not json\n" for i in range(500)))
    got = readers.read_metadata(spark, str(tmp_path), "doi string, paper_id string")
    assert sorted((r.line_no, r.doi) for r in got.collect()) == [(i + 1, f"10.1/{i}") for i in range(500) if i % 5]
    assert (got.rdd.getNumPartitions() > 100) == (small_blocks == 30)


def test_csv_with_line_ends_within_quotes(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    rows = [[f"10.1/{i}", rng.choice(['plain', 'two\nlines', 'a "quoted"; word', 'x\n\n"y"\n', '', 'é;漢'])] for i in range(60)]
    p = tmp_path / "t.csv"
    with open(p, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f, delimiter=";", lineterminator="\n")
        out.writerow(["DOI", "Título"])
        starts = []
        for r in rows:
            f.flush()
            starts.append(p.read_bytes().count(b"\n") + 1)
            out.writerow(r)
    got = readers.read_csv(spark, str(p)).collect()
    assert sorted((r.seq, r.doi, r.title or "") for r in got) == sorted((n, *r) for n, r in zip(starts, rows, strict=True))
    with pytest.raises(ValueError, match="no column for title"):
        readers.read_csv(spark, str(p), {"doi": ["doi"], "title": ["nothing"]})
