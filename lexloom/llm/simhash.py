"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is a ring of eight 8-bit segments. Where two fingerprints differ in at most four
bits, some start on the ring has a chain of segments whose cumulative differences stay within
l * 4 / 8 after every l segments. So the first segment is equal, of the next two at most one
differs, of the next four at most two: a chain of five leaves three segments equal, in one of
five ways. Fingerprints meet under the equal segments of such a start (40 keys of 24 bits; in
large corpora chains of seven, with 32 bits). A pair that meets must then show the chain itself,
segment by segment from that start, and stops at the first broken budget; only pairs with a
whole chain, which is shorter than the ring, have all bits counted.

Equal fingerprints are one node, and each bucket gives a spanning forest of its links, never all
pairs. A crowded bucket is dealt in blocks, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_batches, checkpointed, join_hot, spread, table, text_bytes, tidy
from lexloom.llm.components import components

SHINGLE, SEED = 4, 42
SEGMENTS, MOST_BITS = 8, 4
#: The most differences after 1, 2, ... segments of a chain, and the segments of a chain that a pair must show.
BUDGET = [n * MOST_BITS // SEGMENTS for n in range(1, SEGMENTS + 1)]
CHAIN = 6
#: Fingerprints from which on keys come from chains of seven segments; results are the same.
MANY = 1 << 24
#: Members of a bucket that meet in one task; a bucket with more is dealt in blocks of so many.
BLOCK = 4096
#: Crowded buckets that go to all tasks; more of them join by key.
MOST_BROADCAST = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LANES = np.uint64(0x0001000100010001)
#: Shingles summed in 16-bit lanes at once.
_RUN = 60_000


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 hashes of all shingles, how many each text has)."""
    space = _SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    after = np.concatenate(([True], space))[:-1] | edge[:-1]
    keep = ~(space & after)
    plain = np.where(space, np.uint8(32), _LOWER[body])[keep]
    offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    letter = plain != 32
    edge = np.zeros(len(plain) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(letter & (np.concatenate(([True], ~letter[:-1])) | edge[:-1]))
    until = np.flatnonzero(letter & (np.concatenate((~letter[1:], [True])) | edge[1:])) + 1
    at = np.searchsorted(first, offsets)
    words = np.diff(at)
    n = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    begin = np.repeat(at[:-1], n) + spread(n)
    last = begin + np.repeat(np.minimum(words, SHINGLE), n) - 1
    blob, digest = plain.tobytes(), xxhash.xxh64_intdigest
    begin, last = first[begin], until[last]
    out = np.empty(len(begin), np.uint64)
    for i in range(0, len(out), _RUN):  # Python numbers take much more room than their array
        ends = zip(begin[i : i + _RUN].tolist(), last[i : i + _RUN].tolist(), strict=True)
        out[i : i + _RUN] = np.fromiter((digest(blob[a:b], SEED) for a, b in ends), np.uint64)
    return out, n


def fingerprints(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A bit is set where it is set in over half the hashes of a text; no hashes give zero."""
    out = np.zeros(len(n), np.uint64)
    own = np.flatnonzero(n)
    if not len(own):
        return out
    start = np.cumsum(n)[own] - n[own]
    runs = -(-n[own] // _RUN)
    cuts = np.repeat(start, runs) + spread(runs) * _RUN
    group = np.cumsum(runs) - runs
    for shift in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        for lane in range(4):
            count = np.add.reduceat((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF), group)
            out[own] |= (2 * count > n[own].astype(np.uint64)).astype(np.uint64) << np.uint64(16 * lane + shift)
    return out


def fingerprinted(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and ``row`` where it is given; null and empty texts have fingerprint zero."""
    bounded_batches(docs.sparkSession)
    rest = [] if row is None else [row.alias("row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp = fingerprints(*shingle_hashes(*text_bytes(batch.column("text"))))
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return docs.select(F.col("doc_id").cast("long"), *rest, F.col("text").cast("string")).mapInArrow(tidy(run), f"doc_id long, {'row long, ' if rest else ''}fp long")


def chain_keys(length: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks of the segments that a viable chain leaves equal, (masks, starts) the starts of such chains)."""
    starts: dict[int, list[int]] = {}
    for differ in combinations(range(length), BUDGET[length - 1]):
        if any(sum(d < n for d in differ) > BUDGET[n - 1] for n in range(1, length + 1)):
            continue
        for start in range(SEGMENTS):
            equal = sum(0xFF << (8 * ((start + i) % SEGMENTS)) for i in range(length) if i not in differ)
            starts.setdefault(equal, []).append(start)
    most = max(map(len, starts.values()))
    return np.array(list(starts), np.uint64), np.array([x + x[:1] * (most - len(x)) for x in starts.values()])


def viable(differ: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which differences show a whole chain from one of their ``starts``; each stops at its first broken budget."""
    out = np.zeros(len(differ), bool)
    for start in np.broadcast_to(starts, (len(differ), starts.shape[-1])).T:
        live = np.flatnonzero(~out)
        total = np.zeros(len(live), np.uint8)
        for n in range(CHAIN):
            shift = (8 * ((start[live] + n) % SEGMENTS)).astype(np.uint64)
            total = total + np.bitwise_count((differ[live] >> shift) & np.uint64(0xFF))
            whole = total <= BUDGET[n]
            live, total = live[whole], total[whole]
        out[live] = True
    return out


def near(one: np.ndarray, other: np.ndarray, starts: np.ndarray, tally: list[int] | None = None) -> np.ndarray:
    """Which pairs show a chain and differ in at most four bits; ``tally`` counts pairs, those with a chain, those near."""
    differ = one ^ other
    at = np.flatnonzero(viable(differ, starts))
    close = at[np.bitwise_count(differ[at]) <= MOST_BITS]
    if tally is not None:
        tally[:] = [a + b for a, b in zip(tally, (len(differ), len(at), len(close)), strict=True)]
    out = np.zeros(len(differ), bool)
    out[close] = True
    return out


def forest(members: np.ndarray, starts: np.ndarray, tally: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is near in a bucket of different fingerprints; one less than members at most."""
    links = []
    while len(members) > 1:
        waiting, members = [members[0]], members[1:]
        while waiting and len(members):
            one = waiting.pop()
            close = near(np.full(len(members), one), members, starts, tally)
            links += [(int(one), int(x)) for x in members[close]]
            waiting += list(members[close])
            members = members[~close]
    return links


def crowded(nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """(choice, key, n) of the buckets that may have more than BLOCK members.

    Each partition names the keys that it has many of, so a bucket that no row names has at most
    BLOCK members (or 4 a partition and half a BLOCK, where partitions are very many).
    """
    least = max(4, BLOCK // (2 * max(1, nodes.rdd.getNumPartitions())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = np.concatenate([np.zeros(0, np.int64), *(np.asarray(b.column("fp")) for b in batches)]).view(np.uint64)
        for choice, mask in enumerate(masks):
            key = np.sort(fp & mask)
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate((begin, [len(key)])))
            many = np.flatnonzero(size >= least)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(many), choice, np.int32)), pa.array(key[begin[many]].view(np.int64)), pa.array(size[many])], ["choice", "key", "n"])

    named = nodes.select("fp").mapInArrow(tidy(run), "choice int, key long, n long")
    return named.groupBy("choice", "key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK // 2)


def links(nodes: DataFrame, counts: list[Accumulator] | None = None) -> DataFrame:
    """Links between different fingerprints, enough to connect all that are at most four bits apart.

    ``counts``: three accumulators for the pairs that met, those that showed a chain, and those near.
    """
    masks, starts = chain_keys(5 if nodes.count() <= MANY else 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = [0, 0, 0]

        def emit(choice: np.ndarray, fp: np.ndarray, new: np.ndarray):
            begin = np.flatnonzero(new)
            size = np.diff(np.concatenate((begin, [len(fp)])))
            two = begin[size == 2]
            two = two[near(fp[two], fp[two + 1], starts[choice[two]], tally)] if len(two) else two
            out = [np.stack((fp[two], fp[two + 1]), axis=1)]
            for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if found := forest(fp[b : b + n], starts[choice[b]], tally):
                    out.append(np.array(found, np.uint64))
            out = np.concatenate(out).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], ["u", "v"])

        held_choice, held_pair, held = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            held_choice = np.concatenate((held_choice, np.asarray(batch.column("choice"))))
            held_pair = np.concatenate((held_pair, np.asarray(batch.column("blocks"))))
            held = np.concatenate((held, np.asarray(batch.column("fp")).view(np.uint64)))
            if not len(held):
                continue
            key = held & masks[held_choice]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (held_choice[1:] != held_choice[:-1]) | (held_pair[1:] != held_pair[:-1])))
            last = int(np.flatnonzero(new)[-1])
            yield emit(held_choice[:last], held[:last], new[:last])
            held_choice, held_pair, held = held_choice[last:], held_pair[last:], held[last:]
        if len(held):
            yield emit(held_choice, held, np.concatenate(([True], np.zeros(len(held) - 1, bool))))
        for counter, n in zip(counts or [], tally, strict=False):
            counter.add(n)

    mask = F.array(*(F.lit(signed(int(m))) for m in masks))
    keyed = nodes.select("fp", F.posexplode(mask).alias("choice", "mask")).select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    many = checkpointed(crowded(nodes, masks))
    n_many = many.count()
    if n_many:
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        keyed = keyed.join(F.broadcast(many) if n_many <= MOST_BROADCAST else many, ["choice", "key"], "left").withColumn("of", F.coalesce(blocks, F.lit(1)))
        own, other = F.pmod(F.xxhash64("fp"), F.col("of")), F.col("other")
        keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
        keyed = keyed.select("choice", "key", "fp", (F.least(own, other) * F.col("of") + F.greatest(own, other)).alias("blocks"))
    else:
        keyed = keyed.withColumn("blocks", F.lit(0).cast("long"))
    dealt = keyed.repartition("choice", "key", "blocks").sortWithinPartitions("choice", "key", "blocks")
    return dealt.select("choice", "blocks", "fp").mapInArrow(tidy(run), "u long, v long").distinct()


def rooted(prints: DataFrame, least: Column) -> DataFrame:
    """(fp, n, least, root) of every different fingerprint: its rows, the least of ``least``, and its component."""
    nodes = checkpointed(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(least).alias("least")))
    roots = components(links(nodes.select("fp")), "u", "v")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Texts without words share fingerprint zero, which links like any other. Equal texts are one
    component; component_id is its least non-null doc_id. An empty table gives no rows, repeated
    rows one each, and other columns are not read.
    """
    prints = checkpointed(fingerprinted(docs))
    nodes = checkpointed(rooted(prints, F.col("doc_id")))
    ids = checkpointed(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    known = checkpointed(join_hot(nodes.select("root", "fp", F.col("n").alias("rows")), ids, "root").select("fp", "component_id", F.col("rows").alias("n")))
    found = join_hot(prints, known, "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, in the columns of ``docs``: that of the least doc_id.

    Rows decide, not ids: of different rows with one doc_id, that of the least hash over all
    columns stands for their group, and different texts under one doc_id, or without any, stay
    apart. A row without doc_id is kept where no row of its group has one.
    """
    names = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    row = F.xxhash64(*(docs[c] for c, kind in names.items() if "map<" not in kind and kind != "variant"))
    prints = checkpointed(fingerprinted(docs, row))
    nodes = rooted(prints, F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    least = nodes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_kept_id"), F.col("least.row").alias("_kept_row"))
    rows = prints.groupBy("doc_id", "row").agg(F.count("*").alias("_kept_n"))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("row") == F.col("_kept_row"))
    kept = checkpointed(rows.join(least, same).select("_kept_id", "_kept_row", "_kept_n"))

    def rows_of(chosen: DataFrame) -> DataFrame:
        return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["_kept_id"]) & (row == chosen["_kept_row"]), "left_semi")

    repeated = kept.where("_kept_n > 1")
    if not repeated.limit(1).count():
        return rows_of(kept)
    once = rows_of(repeated).withColumn("_kept_row", row).dropDuplicates(["doc_id", "_kept_row"]).drop("_kept_row")
    return rows_of(kept.where("_kept_n = 1")).unionByName(once)


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
