"""Exact repeats of 50 bytes across documents, by a logarithmic family of sparse suffix arrays.

Documents form batches by ranges of doc_id. A batch's suffix array is sparse: it holds the
suffixes at anchors, the least hashed 20-byte string of each 50-byte window, so that equal windows
have equal anchors. Neighbouring windows with one anchor are one entry. Entries are in the order
of their suffixes' bytes, and of the bytes before the anchor, backwards, where suffixes are equal.

First the batches tell each other, by short hashes, which anchors they have: what no other batch
has is nobody's repeat. The entries of the rest are dealt with all their bytes, by anchor, to
slices of the index. In a slice each new batch's array is merge-scanned against the levels of
earlier batches, with the longest common prefix at each place, and levels of like size merge, so
that there are few of them however many batches came. An entry whose whole bytes a level holds is a
repeat; where only its anchor is common, its windows are held against each other, byte by byte.

An anchor with very many different entries is crowded: all batches deal the 128-bit hashes of its
windows, each for itself, so that no slice gets more than its share of them. Answers come back as
places in the batch, which then cuts them out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import spread, table, text_bytes, tidy_group

MATCH, ANCHOR = 50, 20
SIDE = MATCH - ANCHOR
WINDOWS = SIDE + 1
#: Bytes of text in a batch and in a slice of the index, about.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 32 << 20
#: Bytes of text behind a task, at most, about.
TASK_BYTES = 128 << 20
#: Cuts between batches that the driver holds; beyond them, equal steps of doc_id split each range further.
MOST_CUTS = 4096
#: Different entries of one anchor in a batch, and of all batches in a slice, beyond which it is crowded.
MOST_LOCAL, MOST_SHARED = 64, 4096
#: Entries whose windows are hashed or compared at once.
AT_ONCE = 4096
#: Windows whose anchors are found at once.
CHUNK = 1 << 18
#: Batches of one range of doc_id: a doc_id with very many rows has several.
SALTS = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)
_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_VALUES = np.random.default_rng(23).integers(1, (1 << 64) - 1, (2, 256), np.uint64)
#: An entry's bytes: from its anchor on, before its anchor backwards, and the numbers of its windows before the anchor and in all.
_ROW = MATCH + SIDE + 2
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    if lane not in _powers or len(_powers[lane][0]) < n:
        size = max(n, CHUNK + 2 * MATCH)
        make = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64))), dtype=np.uint64)
        _powers[lane] = make(_BASES[lane]), make(pow(_BASES[lane], -1, 1 << 64))
    return _powers[lane]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


@dataclass
class Batch:
    """The entries of a batch, in the order of its texts."""

    body: np.ndarray
    offsets: np.ndarray
    anchor: np.ndarray
    low: np.ndarray  # the first and last window of each entry
    high: np.ndarray
    content: np.ndarray  # a hash of all its bytes
    rank: np.ndarray  # of its document, by doc_id
    keys: np.ndarray  # slice and short hash of each different anchor, ascending
    key: np.ndarray  # place of each entry's anchor in keys


def _entries(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, low, high, anchor hash, content hash) of all entries of consecutive texts."""
    inside = np.ones(len(body), bool)
    n = np.minimum(np.diff(offsets), MATCH - 1)
    inside[np.repeat(offsets[1:] - n, n) + spread(n)] = False
    parts = []
    for c in range(0, len(body), CHUNK):
        windows = inside[c : c + CHUNK]
        if not windows.any():
            continue
        part = body[c : c + CHUNK + MATCH]
        power, inverse = _power(len(part))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[0][part] * power[: len(part)], dtype=np.uint64)))
        m = len(part) - ANCHOR + 1
        if m < WINDOWS:
            continue
        h = _mix((total[ANCHOR:] - total[:m]) * inverse[:m])
        least = (h & ~_POSITION) | np.arange(m, dtype=np.uint64)
        step = 1
        while step * 2 <= WINDOWS:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < WINDOWS:
            least = np.minimum(least[: len(least) - (WINDOWS - step)], least[WINDOWS - step :])
        at = np.flatnonzero(windows[: len(least)])
        anchor = (least[at] & _POSITION).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        low, high = at[begin], at[np.concatenate((begin[1:], [len(at)])) - 1]
        a = anchor[begin]
        content = _mix((total[high + MATCH] - total[low]) * inverse[low] + (high - low).astype(np.uint64))
        parts.append((a + c, low + c, high + c, h[a], content))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def batch_of(texts: pa.Table, slices: int) -> Batch:
    """Of rows in the order of doc_id."""
    body, offsets = text_bytes(texts.column("text"))
    anchor, low, high, h, content = _entries(body, offsets)
    ids = np.asarray(texts.column("doc_id"))
    rank = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))[np.searchsorted(offsets, low, "right") - 1] if len(low) else low
    keys, key = np.unique(((h % np.uint64(slices)) << np.uint64(32)) | (h >> np.uint64(32)), return_inverse=True)
    return Batch(body, offsets, anchor, low, high, content, rank, keys, key)


def _order(texts: pa.Table) -> pa.Table:
    """Rows by doc_id; of one doc_id by text, so that places in a batch mean the same in every task."""
    return texts.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _rows(batch: Batch, entries: np.ndarray) -> np.ndarray:
    """The bytes of entries; bytes that none of an entry's windows covers are 0."""
    out = np.zeros((len(entries), _ROW), np.uint8)
    for i in range(0, len(entries), AT_ONCE):
        part = entries[i : i + AT_ONCE]
        low, high, a = batch.low[part], batch.high[part], batch.anchor[part]
        right, left = a[:, None] + np.arange(MATCH), a[:, None] - 1 - np.arange(SIDE)
        row = out[i : i + AT_ONCE]
        row[:, :MATCH] = np.where(right < high[:, None] + MATCH, batch.body[np.minimum(right, len(batch.body) - 1)], 0)
        row[:, MATCH:-2] = np.where(left >= low[:, None], batch.body[np.maximum(left, 0)], 0)
        row[:, -2], row[:, -1] = a - low, high - low + 1
    return out


def _sortable(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{_ROW}").ravel()


def common(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each two rows."""
    differ = one != other
    out = differ.argmax(axis=1)
    out[~differ.any(axis=1)] = _ROW
    return out


def _full(rows: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << rows[:, -1].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)


def _straight(rows: np.ndarray) -> np.ndarray:
    return np.concatenate((rows[:, MATCH:-2][:, ::-1], rows[:, :MATCH]), axis=1)


def window_hashes(rows: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, number in its row) of each window of each row."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    n = MATCH + SIDE
    power, inverse = _power(n + 1, lane)
    for i in range(0, len(rows), AT_ONCE):
        part = rows[i : i + AT_ONCE]
        # From the anchor out, no byte beyond a row's own windows is ever read.
        total = np.concatenate((np.zeros((len(part), 1), np.uint64), np.cumsum(_VALUES[lane][_straight(part)] * power[:n], axis=1, dtype=np.uint64)), axis=1)
        before, count = part[:, -2].astype(np.int64), part[:, -1].astype(np.int64)
        row = np.repeat(np.arange(len(part)), count)
        nth = spread(count)
        start = SIDE - before[row] + nth
        parts.append(((total[row, start + MATCH] - total[row, start]) * inverse[start], row + i, nth))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _classes(h: np.ndarray, rows: np.ndarray, row: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A number for each window, the same for the same bytes and for no others; the hash is a guide only."""
    _, first, cls, size = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    text = np.lib.stride_tricks.sliding_window_view(_straight(rows), MATCH, axis=1)
    start = SIDE - rows[row, -2].astype(np.int64) + nth
    many = np.flatnonzero(size[cls] > 1)
    wrong = [np.zeros(0, np.int64)]
    for i in range(0, len(many), AT_ONCE * 8):
        at = many[i : i + AT_ONCE * 8]
        lead = first[cls[at]]
        wrong.append(cls[at[(text[row[at], start[at]] != text[row[lead], start[lead]]).any(axis=1)]])
    wrong = np.flatnonzero(np.isin(cls, np.concatenate(wrong)))
    if len(wrong):  # one hash, several strings
        cls[wrong] = len(size) + np.unique(np.ascontiguousarray(text[row[wrong], start[wrong]]).view(f"S{MATCH}").ravel(), return_inverse=True)[1]
    return cls


def _later(cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows come with a lesser rank too."""
    out = np.zeros(len(cls), bool)
    if len(cls):
        order = np.lexsort((rank, cls))
        cls, rank = cls[order], rank[order]
        new = np.concatenate(([True], cls[1:] != cls[:-1]))
        out[order] = rank > rank[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def repeated_windows(rows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A bit for each window of each row that a row of lesser rank has too; bit 0 is the first window."""
    out = np.zeros(len(rows), np.uint32)
    if len(rows):
        h, row, nth = window_hashes(rows)
        hit = _later(_classes(h, rows, row, nth), rank[row])
        np.bitwise_or.at(out, row[hit], np.uint32(1) << nth[hit].astype(np.uint32))
    return out


def repeated_by_anchor(rows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``repeated_windows`` of sorted rows, some anchors at a time; anchors of a single rank have none."""
    out = np.zeros(len(rows), np.uint32)
    if not len(rows):
        return out
    begin = np.flatnonzero(np.concatenate(([True], common(rows[1:], rows[:-1]) < ANCHOR)))
    several = np.minimum.reduceat(rank, begin) != np.maximum.reduceat(rank, begin)
    size = np.diff(np.concatenate((begin, [len(rows)])))[several]
    begin = begin[several]
    part = np.cumsum(size) // AT_ONCE
    for p in np.unique(part):
        own = part == p
        at = np.repeat(begin[own], size[own]) + spread(size[own])
        out[at] = repeated_windows(rows[at], rank[at])
    return out


class Levels:
    """Sorted arrays of entries that grow geometrically."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _heads(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)

    def scan(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(longest prefix that each row has in common with a level's row, rank of a level's row that equals it)."""
        best, rank = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max)
        heads, keys = self._heads(rows), _sortable(rows)
        for head, level, ranks, _ in self.levels:
            first, last = np.searchsorted(head, heads), np.searchsorted(head, heads, "right")
            at = np.flatnonzero((last > first) & (best < _ROW))
            place = first[at]
            several = np.flatnonzero(last[at] - place > 1)
            place[several] = np.searchsorted(_sortable(level), keys[at[several]])
            for beside in (place, place - 1):  # nothing has more in common with a row than its neighbours
                near = np.clip(beside, 0, len(level) - 1)
                own = common(level[near], rows[at])
                rank[at] = np.where(own == _ROW, ranks[near], rank[at])
                best[at] = np.maximum(best[at], own)
        return best, rank

    def add(self, rows: np.ndarray, rank: int, ids: np.ndarray) -> None:
        """Of a batch whose rows are sorted."""
        level = self._heads(rows), rows, np.full(len(rows), rank, np.int64), ids
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = self._merged(self.levels.pop(), level)
        self.levels.append(level)

    @staticmethod
    def _merged(*levels: tuple) -> tuple:
        parts = [np.concatenate(x) for x in zip(*levels, strict=True)]
        order = np.argsort(_sortable(parts[1]), kind="stable")  # runs in order merge in one pass
        return tuple(x[order] for x in parts)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, ranks, ids) of all levels as one sorted array."""
        none = np.zeros(0, np.uint64), np.zeros((0, _ROW), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._merged(none, *self.levels)[1:]


NEW, SHARED, CROWDED = 0, 1, 2


def _sizes(batch: Batch) -> np.ndarray:
    """How many different entries each anchor has, up to 255."""
    order = np.lexsort((batch.content, batch.key))
    key, content = batch.key[order], batch.content[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    return np.minimum(np.bincount(key[new], minlength=len(batch.keys)), 255)


def _meet(rows: pa.Table, local: int, shared: int) -> pa.Table:
    """One slice: which anchors of each batch other batches have, and which are crowded."""
    blobs = rows.column("anchors").to_pylist()
    counts = [len(x) // 5 for x in blobs]
    key = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(blobs, counts, strict=True)])
    size = np.concatenate([np.frombuffer(x, np.uint8, n, 4 * n) for x, n in zip(blobs, counts, strict=True)])
    _, which, batches = np.unique(key, return_inverse=True, return_counts=True)
    many = (np.bincount(which, size) > shared) | (np.bincount(which, size > local) > 0)
    answer = np.where(batches < 2, NEW, np.where(many, CROWDED, SHARED)).astype(np.uint8)[which]
    ends = np.cumsum(counts)
    parts = [answer[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
    return pa.table([rows.column("batch"), rows.column("slice"), pa.array(parts, pa.binary())], ["batch", "slice", "answer"])


def _looked(batch: Batch, answer: np.ndarray) -> tuple:
    """What a batch finds by itself, and what it asks: ((places, bits) of repeats, (rows, places, anchors) of shared entries in suffix order, (rows, places, open windows) of crowded ones)."""
    state = answer[batch.key]
    alone = np.bincount(batch.key, minlength=len(batch.keys)) < 2
    asked = np.flatnonzero((state != NEW) | ~alone[batch.key])
    rows, rank = _rows(batch, asked), batch.rank[asked]
    order = np.argsort(_sortable(rows), kind="stable")  # the suffix array; of equal entries the least document is first
    rows, rank, asked = rows[order], rank[order], asked[order]
    first = np.flatnonzero(np.concatenate(([True], common(rows[1:], rows[:-1]) < _ROW))) if len(rows) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(rows)]))))
    least = rank[first]
    bits = repeated_by_anchor(rows[first], least)
    full = _full(rows)
    mark = np.where(rank > least[group], full, bits[group])
    hit, asks = np.flatnonzero(mark), mark != full
    ask = lambda kind: np.flatnonzero(asks & (state[asked] == kind))
    shared, crowd = ask(SHARED), ask(CROWDED)
    return (batch.low[asked[hit]], mark[hit]), (rows[shared], batch.low[asked[shared]], batch.key[asked[shared]]), (rows[crowd], batch.low[asked[crowd]], ~mark[crowd] & full[crowd])


def crowded_windows(rows: np.ndarray, low: np.ndarray, open_: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit hashes, places, slices) of the windows of rows that ``open_`` has bits for, by slice."""
    one, row, nth = window_hashes(rows)
    two = window_hashes(rows, 1)[0]
    live = np.flatnonzero((open_[row] >> nth.astype(np.uint32)) & np.uint32(1))
    slice_ = (_mix(one[live]) % np.uint64(slices)).astype(np.int64)
    live = live[np.argsort(slice_, kind="stable")]
    return np.stack((one[live], two[live]), axis=1), low[row[live]] + nth[live], np.sort(slice_)


def _scan(rows: pa.Table, slices: int) -> pa.Table:
    """One slice of the index: which windows of each batch the batches before it have.

    In slices below 0 the windows of crowded anchors come as hashes; from ``slices`` on come the
    repeats that a batch found by itself, on their way back to it.
    """
    which = rows.column("slice")[0].as_py()
    if which >= slices:
        return rows.select(["batch", "at", "rows"]).rename_columns(["batch", "at", "bits"])
    rows = rows.sort_by("batch")
    batches, blobs = rows.column("batch").to_pylist(), rows.column("rows").to_pylist()
    if which < 0:
        hashes = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in blobs]
        h, rank = np.concatenate(hashes), np.repeat(np.array(batches, np.int64) // SALTS, [len(x) for x in hashes])
        order = np.lexsort((h[:, 1], h[:, 0]))
        cls = np.empty(len(h), np.int64)
        cls[order] = np.cumsum(np.concatenate(([True], (h[order[1:]] != h[order[:-1]]).any(axis=1)))) - 1
        ends = np.cumsum([len(x) for x in hashes])[:-1]
        marks = np.split(_later(cls, rank).astype(np.uint32), ends)
    else:
        levels, marks, seen, n = Levels(), [], [], 0
        for batch, blob in zip(batches, blobs, strict=True):
            own, rank = np.frombuffer(blob, np.uint8).reshape(-1, _ROW), batch // SALTS
            prefix, known = levels.scan(own)
            repeat = (prefix == _ROW) & (known < rank)
            new = np.flatnonzero(~repeat)
            seen.append((new, np.arange(n, n + len(new))))
            marks.append(np.where(repeat, _full(own), np.uint32(0)))
            if len(new):
                levels.add(own[new], rank, seen[-1][1])
            n += len(new)
        all_rows, ranks, ids = levels.all()
        bits = np.zeros(n, np.uint32)
        bits[ids] = repeated_by_anchor(all_rows, ranks)
        for mark, (new, own) in zip(marks, seen, strict=True):
            mark[new] = bits[own]
    hits = [np.flatnonzero(m) for m in marks]
    at = [np.frombuffer(x, "<u4")[hit].tobytes() for x, hit in zip(rows.column("at").to_pylist(), hits, strict=True)]
    found = [m[hit].astype("<u4").tobytes() for m, hit in zip(marks, hits, strict=True)]
    return pa.table([rows.column("batch"), pa.array(at, pa.binary()), pa.array(found, pa.binary())], ["batch", "at", "bits"])


def _by_slice(slice_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(slice_):
        return
    begin = np.flatnonzero(np.concatenate(([True], slice_[1:] != slice_[:-1])))
    for a, b in zip(begin, [*begin[1:], len(slice_)], strict=True):
        yield int(slice_[a]), int(a), int(b)


def _starts(hits: pa.Table) -> np.ndarray:
    """First bytes of all repeated windows of a batch, ascending."""
    at = np.frombuffer(b"".join(hits.column("at").to_pylist()), "<u4").astype(np.int64)
    bits = np.frombuffer(b"".join(hits.column("bits").to_pylist()), "<u4")
    row, nth = np.nonzero((bits[:, None] >> np.arange(WINDOWS, dtype=np.uint32)) & np.uint32(1))
    return np.sort(at[row] + nth)


def _spans(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last + 1) of the maximal runs of bytes that windows at ``starts`` cover."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    owner = np.searchsorted(offsets, starts, "right") - 1
    new = np.concatenate(([True], (starts[1:] > starts[:-1] + MATCH) | (owner[1:] != owner[:-1])))
    begin = np.flatnonzero(new)
    last = starts[np.concatenate((begin[1:], [len(starts)])) - 1] + MATCH
    return owner[begin], starts[begin], last


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the bytes left) of every row.

    A byte goes if a 50-byte string that covers it also starts in a row of lesser doc_id. Texts
    under 50 bytes, null and empty ones stay as they are. Rows of one doc_id are not repeats of
    each other, and a row without doc_id neither loses bytes nor takes them from others. An
    empty table gives no rows. Other columns are not read.
    """
    return _without_repeats(docs)


def _without_repeats(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """The same, with the columns that ``carry`` names as carry_…, so that no name clashes; ``as_text``: kept as a string, without cut characters."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    known = plain.where(F.col("doc_id").isNotNull())
    size = known.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    batches = max(1, min(int(size.rows), -(-int(size.bytes or 0) // BATCH_BYTES)))
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size.bytes or 0) // SLICE_BYTES))
    ranges = min(batches, MOST_CUTS)
    cuts = known.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    number = batch_number(known, [size.low, *cuts, size.high], -(-batches // ranges))
    most_local, most_shared = MOST_LOCAL, MOST_SHARED
    kinds = {f.name: f.dataType for f in plain.schema.fields}
    carried = [f"carry_{c}" for c in carry]

    def index(texts: pa.Table) -> pa.Table:
        batch, which = batch_of(_order(texts), slices), texts.column("batch")[0].as_py()
        sizes, slice_ = _sizes(batch), (batch.keys >> np.uint64(32)).astype(np.int64)
        rows = [(s, batch.keys[a:b].astype("<u4").tobytes() + sizes[a:b].astype(np.uint8).tobytes()) for s, a, b in _by_slice(slice_)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([which] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "batch", "anchors"])

    def meet(rows: pa.Table) -> pa.Table:
        return _meet(rows, most_local, most_shared)

    def look(texts: pa.Table, answers: pa.Table) -> pa.Table:
        batch, which = batch_of(_order(texts), slices), texts.column("batch")[0].as_py()
        answer = np.frombuffer(b"".join(answers.sort_by("slice").column("answer").to_pylist()), np.uint8)
        (low, mark), (shared, at, anchor), crowd = _looked(batch, answer)
        rows = [(slices + which, mark.astype("<u4").tobytes(), low.astype("<u4").tobytes())] if len(low) else []
        dealt = (batch.keys[anchor] >> np.uint64(32)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")  # within a slice the suffix order stays
        shared, at = shared[order], at[order]
        rows += [(s, shared[a:b].tobytes(), at[a:b].astype("<u4").tobytes()) for s, a, b in _by_slice(dealt[order])]
        hashes, at, dealt = crowded_windows(*crowd, slices)
        rows += [(s - slices, hashes[a:b].astype("<u8").tobytes(), at[a:b].astype("<u4").tobytes()) for s, a, b in _by_slice(dealt)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([which] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "batch", "rows", "at"])

    def scan(rows: pa.Table) -> pa.Table:
        return _scan(rows, slices)

    def cut(texts: pa.Table, hits: pa.Table) -> pa.Table:
        texts = _order(texts)
        body, offsets = text_bytes(texts.column("text"))
        owner, first, last = _spans(_starts(hits), offsets)
        blob, at = body.tobytes(), np.searchsorted(owner, np.arange(len(offsets)))
        kept, spans = [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = list(zip(first[at[i] : at[i + 1]].tolist(), last[at[i] : at[i + 1]].tolist(), strict=True))
            edges = [a, *(x for s in own for x in s), b]
            kept.append(b"".join(blob[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"start": x - a, "stop": y - a} for x, y in own])
        left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        made = [texts.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(SPAN)), left]
        return pa.table([*made, *(texts.column(c) for c in carried)], ["doc_id", "n_bytes", "spans", "kept", *carried])

    tasks = -(-int(size.bytes or 0) // TASK_BYTES)

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        """As many tasks as the text asks for, where the session's number is too small."""
        return rows.repartition(tasks, by) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows

    by_batch = dealt(number, "batch").groupBy("batch")
    anchors = by_batch.applyInArrow(tidy_group(index), "slice long, batch long, anchors binary")
    answers = dealt(anchors, "slice").groupBy("slice").applyInArrow(tidy_group(meet), "batch long, slice long, answer binary")
    entries = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(tidy_group(look), "slice long, batch long, rows binary, at binary")
    hits = dealt(entries, "slice").groupBy("slice").applyInArrow(tidy_group(scan), "batch long, at binary, bits binary")
    fields = f"doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept {'string' if as_text else 'binary'}"
    out = by_batch.cogroup(hits.groupBy("batch")).applyInArrow(tidy_group(cut), ", ".join([fields, *(f"`{c}` {kinds[c].simpleString()}" for c in carried)]))
    whole = plain.where(F.col("doc_id").isNull()).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start: long, stop: long>>").alias("spans"), F.col("text").cast("string" if as_text else "binary").alias("kept"), *carried)
    return out.unionByName(whole)


def batch_number(docs: DataFrame, edges: list[float], steps: int) -> DataFrame:
    """``docs`` with the number of their batch; ``batch // SALTS`` is that of its range of doc_id.

    Ranges lie between ``edges``, each in ``steps`` equal parts; later ids have no lesser numbers.
    A doc_id that is several edges has a range of its own, which as many batches share by text.
    """
    if len(edges) == 2 and steps == 1:
        return docs.withColumn("batch", F.lit(0).cast("long"))
    from pyspark.ml.feature import Bucketizer

    inner, crowd = edges[1:-1], {}
    for e in inner:
        crowd[e] = crowd.get(e, 0) + 1
    crowd = {e: n for e, n in crowd.items() if n > 1}
    bounds = sorted({*inner, *(e + 1 for e in crowd)})
    if not bounds:
        found = docs.withColumn("_batch", F.lit(0))
    else:
        splits = [-float("inf"), *bounds, float("inf")]
        found = Bucketizer(splits=splits, inputCol="_id", outputCol="_batch").transform(docs.withColumn("_id", F.col("doc_id").cast("double"))).drop("_id")
    number = F.col("_batch").cast("int")
    salts = F.get(F.array(F.lit(1), *(F.lit(min(crowd.get(e, 1), SALTS)) for e in bounds)), number)
    if steps > 1:
        whole = F.array(*(F.lit(float(e)) for e in [edges[0], *bounds, edges[-1]]))
        low, high = F.get(whole, number), F.get(whole, number + 1)
        share = (F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0))
        part = F.when(salts > 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor(share * steps).cast("int"))))
        number = number * steps + part
        salts = F.when(salts > 1, F.least(salts * steps, F.lit(SALTS))).otherwise(salts)
    salt = F.pmod(F.xxhash64("text"), salts.cast("long"))
    return found.withColumn("batch", number.cast("long") * SALTS + salt).drop("_batch")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` in their columns with repeats removed from text; n_chars, where there is one, follows.

    A character that is cut through goes with the bytes that went. A null text stays null, with its
    n_chars; rows without doc_id stay as they are, repeated rows are treated each for itself, and
    an empty table gives no rows.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    null = "".join(["no_text", *docs.columns])  # a name that no column has
    found = _without_repeats(docs.withColumn(null, F.col("text").isNull()), (*rest, null), as_text=True)
    kinds = dict(docs.dtypes)
    new = {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.when(~F.col(f"carry_{null}"), F.col("kept"))}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col(f"carry_{null}"), F.col("carry_n_chars")).otherwise(F.length("kept").cast(kinds["n_chars"]))
    return found.select(*(new.get(c, F.col(f"carry_{c}")).alias(c) for c in docs.columns))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p - 1, {2 * MATCH}) AS s FROM (SELECT *, unnest(range(1, length(h) // 2 - {MATCH - 2})) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM w JOIN m USING (s) WHERE doc_id > least),
g AS (SELECT r, p, sum(CASE WHEN p <= before + {MATCH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
span AS (SELECT r, min(p) AS a, max(p) + {MATCH} AS b FROM g GROUP BY r, k),
gap AS (SELECT r, a, b, lag(b, 1, 1) OVER (PARTITION BY r ORDER BY a) AS since FROM span),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last - 1) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
