"""Best-fit packing by the configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fit one sequence; the program covers all pieces with as few
configurations as it can. It is solved by multiplicative weights: each length has a price, a knapsack table
(dynamic programming over the capacity) prices the best configuration, configurations within ``SLACK`` of the
best are drawn from the table by the demand that is left, and prices of lengths that they cover too little rise.
Any prices give a lower bound (their worth of all pieces by the best configuration's), which is kept. The average
of the rounds is rounded to whole configurations as far as the demand allows, and what remains is placed by best fit,
longest first, into the room of the configurations and into new ones. Where that isn't near the bound, the program is
solved again for what the first rounding left, ``PHASES`` times at most, and the shortest plan is taken. Equal
configurations are one entry with a count, so all this knows only lengths and counts: its work is bounded by the
capacity, not by the corpus.

Tokens are made once: tasks encode whole texts, cut long ones, number the pieces of each length as they come,
and write them without their ids (or with them, if asked). Counts by task and length give each piece its place
among all of its length by a running sum, and its place tells its configuration, sequence and offset: a search in
a table whose size is bounded by the capacity (``bound_of_blocks``), so it goes to all tasks.

Defined cases: a null text is an empty one (the end id alone); rows with equal ids are packed each on its own;
an empty table gives none; further columns are not read. Draws are seeded, but which of equally long pieces lie
together follows from the files' parts.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared, unit_encoder

MAX_TOKENS = 2048
PHASES = 6
ROUNDS = 16
#: No further phase where a plan is above the bound by this share at most.
NEAR = 0.001
#: Configurations drawn in a round.
DRAWN = 256
#: How far below the best a configuration may be, as a share of it.
SLACK = 0.0005
#: Step of the prices.
STEP = 0.05
RANK_BITS = 44
#: Bytes of ids after which pieces leave Python.
HELD_BYTES = 1 << 20

Group = tuple[int, tuple[tuple[int, int], ...]]  # times, (length, how many of it) in their order


def bound_of_blocks(max_tokens: int) -> int:
    """Rows of the table that tells sequences, at most: configurations by the lengths one may hold. Distinct lengths
    within one sequence are at most the square root of twice its capacity."""
    return (PHASES * ROUNDS * DRAWN + 3 * max_tokens) * int((2 * max_tokens) ** 0.5 + 1)


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest worth of pieces (any number of each length) by capacity from 0 on."""
    worth = np.zeros(capacity + 1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        k = fit[room]
        worth[room] = max(worth[room - 1], (prices[:k] + worth[room - lengths[:k]]).max())
    return worth


def draw(worth: np.ndarray, prices: np.ndarray, lengths: np.ndarray, demand: np.ndarray, rng: np.random.Generator, drawn: int = DRAWN) -> list[list[int]]:
    """Configurations (indices of lengths) worth at least (1 - SLACK) of the best, each piece drawn by demand
    among those that keep the rest within that."""
    room = np.full(drawn, len(worth) - 1)
    slack = np.full(drawn, SLACK * worth[-1])
    out: list[list[int]] = [[] for _ in range(drawn)]
    live = np.arange(drawn)
    while len(live):
        left = room[live][:, None] - lengths[None, :]
        after = np.where(left >= 0, worth[np.maximum(left, 0)] + prices, -np.inf)
        best = worth[room[live]]
        chance = np.where(after >= (best - slack[live])[:, None], demand, 0.0).cumsum(1)
        going = chance[:, -1] > 0
        live, after, best, chance = live[going], after[going], best[going], chance[going]
        if not len(live):
            break
        pick = np.minimum((chance <= rng.random(len(live))[:, None] * chance[:, -1:]).sum(1), len(lengths) - 1)
        slack[live] -= best - after[np.arange(len(live)), pick]
        room[live] -= lengths[pick]
        for k, j in zip(live.tolist(), pick.tolist(), strict=True):
            out[k].append(j)
        live = live[room[live] >= lengths[0]]
    return out


def solved(lengths: np.ndarray, demand: np.ndarray, capacity: int, rng: np.random.Generator, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional configurations (indices of ascending lengths), and the lower bound that the prices prove."""
    prices, need = lengths / capacity, demand.astype(float)
    covered, bound, goal = np.zeros(len(lengths)), 0.0, float((lengths * need).sum() / capacity)
    found: dict[tuple[int, ...], float] = defaultdict(float)
    for k in range(rounds):
        worth = knapsack(prices, lengths, capacity)
        bound = max(bound, float((prices * need).sum() / worth[-1]))
        wanted = need * np.clip(2 - covered / max(k, 1) / need, 0.05, 2)
        use = np.zeros(len(lengths))
        for chosen in draw(worth, prices, lengths, wanted, rng):
            found[tuple(sorted(chosen, reverse=True))] += goal / DRAWN / rounds
            np.add.at(use, chosen, goal / DRAWN)
        covered += use
        prices = prices * np.exp(STEP * (1 - np.minimum(use / need, 4)))
    return found, bound


def rounded(found: dict[tuple[int, ...], float], left: np.ndarray) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Whole configurations (times, indices), largest first, with what was cut off carried to the next; ``left`` is
    lessened, and bounds them."""
    carried = 0.0
    for chosen, amount in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        carried += amount
        times = int(carried)
        carried -= times
        index, count = np.unique(chosen, return_counts=True)
        times = min(times, int((left[index] // count).min()))
        if times:
            left[index] -= times * count
            yield times, chosen


def best_fit(groups: list[Group], left: Iterable[tuple[int, int]], capacity: int) -> list[Group]:
    """``groups`` filled with ``left`` (length, count) by best fit, longest first. Equal sequences are handled at
    once: the tightest that takes a piece takes all it can of that length."""
    by_room: dict[int, list[Group]] = defaultdict(list)
    for g in groups:
        by_room[capacity - sum(n * k for n, k in g[1])].append(g)
    rooms = sorted(by_room)

    def put(room: int, g: Group) -> None:
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append(g)

    for length, count in sorted(left, reverse=True):
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, (times, held) = capacity, (-(-count // (capacity // length)), ())
            else:
                room = rooms[at]
                times, held = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            each = room // length
            full = min(times, count // each)
            count -= full * each
            if full:
                put(room - each * length, (full, (*held, (length, each))))
            if full < times and count:
                put(room - count * length, (1, (*held, (length, count))))
                full, count = full + 1, 0
            if full < times:
                put(room, (times - full, held))
    return [g for at in sorted(by_room) for g in by_room[at]]


def planned(histogram: dict[int, int], capacity: int = MAX_TOKENS) -> tuple[list[Group], float]:
    """Groups of equal sequences that hold exactly ``histogram`` (length: count), and a lower bound of their number."""
    whole = histogram.get(capacity, 0)
    lengths = np.array(sorted(n for n, k in histogram.items() if n < capacity and k), np.int64)
    groups: list[Group] = [(whole, ((capacity, 1),))] if whole else []
    if not len(lengths):
        return groups, float(whole)
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    rng, least, plan, shortest = np.random.default_rng(11), 0.0, groups, 0
    for phase in range(PHASES):
        has = np.flatnonzero(left)
        if not len(has):
            break
        found, bound = solved(lengths[has], left[has], capacity, rng)
        rest = left[has]
        for times, chosen in rounded(found, rest):
            held = sorted(Counter(lengths[has[list(chosen)]].tolist()).items(), reverse=True)
            groups.append((times, tuple(held)))
        left[has] = rest
        whole_plan = best_fit(groups, zip(lengths.tolist(), left.tolist(), strict=True), capacity)
        total = sum(times for times, _ in whole_plan)
        least = whole + bound if phase == 0 else least
        if phase == 0 or total < shortest:
            plan, shortest = whole_plan, total
        if shortest <= least * (1 + NEAR) + 1:
            break
    return plan, least


def blocks(groups: list[Group]) -> np.ndarray:
    """Rows (key, each, sequence, offset) in order of key: length and first place among the pieces of that length."""
    rows, next_place, sequence = [], Counter(), 0
    for times, held in groups:
        at = 0
        for length, each in held:
            rows.append((length << RANK_BITS | next_place[length], each, sequence, at))
            next_place[length] += times * each
            at += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(df: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """part, place, doc_id, piece, start, length, ids_crc32 (and ids): the ids of each text and ``end_id``, cut where
    they are longer than ``max_tokens`` (the first piece is the shorter one). place counts the pieces of one length in
    a part; it holds only for this reading, so write the result before using it twice."""
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"part long, place long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = unit_encoder.load(tokenizer), TaskContext.get().partitionId(), Counter()
        names = [x.split(" ")[0] for x in schema.split(", ")]

        def made(rows: list[tuple], packed: list[bytes]) -> pa.RecordBatch:
            place, owner, piece, start, length, crc = zip(*rows, strict=True) if rows else [[]] * 6
            columns = [pa.array([part] * len(rows), pa.int64()), pa.array(place, pa.int64()), pa.array(owner, batch.schema.types[0]), pa.array(piece, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            if ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(length, np.int64))]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4"))))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            rows, packed, held = [], [], 0
            for owner, found in zip(batch.column(0).to_pylist(), own.batches(t.as_py() for t in batch.column(1)), strict=True):
                raw, total = np.append(found.astype("<u4"), np.uint32(end_id)).tobytes(), len(found) + 1
                first = (total - 1) % max_tokens + 1
                for k, stop in enumerate(range(first, total + 1, max_tokens)):
                    start = 0 if k == 0 else stop - max_tokens
                    cut = raw[4 * start : 4 * stop]
                    rows.append((seen[stop - start], owner, k, start, stop - start, zlib.crc32(cut)))
                    seen[stop - start] += 1
                    if ids:
                        packed.append(cut)
                held += len(raw)
                if held >= HELD_BYTES:
                    yield made(rows, packed)
                    rows, packed, held = [], [], 0
            yield made(rows, packed)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def placed(cut: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Written ``pieces`` with sequence_id and offset in place of part and place."""
    counts = shared.written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    table = blocks(planned(histogram, max_tokens)[0])
    if len(table) > bound_of_blocks(max_tokens):
        raise AssertionError("more blocks than their bound")
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    names = [c for c in cut.columns if c not in ("part", "place")]
    rows = cut.join(base.hint("merge"), ["part", "length"]).select(*names, (F.col("base") + F.col("place")).alias("rank"))
    schema = rows.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, each, sequence, offset = table.T
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << RANK_BITS | rank, "right") - 1
            k = rank - (key[at] & ((1 << RANK_BITS) - 1))
            columns = [batch.column(c) for c in names]
            columns += [pa.array(sequence[at] + k // each[at], pa.int64()), pa.array(offset[at] + k % each[at] * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)


def packed(df: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row for each piece."""
    return placed(shared.written(pieces(df, tokenizer, max_tokens, end_id, doc_id, text, ids), "pieces"), max_tokens)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, ids, lengths: whole sequences of ``packed`` rows that hold their ids. A sequence is bounded."""
    by = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("held"))
    return by.select("sequence_id", F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"), F.transform("held", lambda x: x["length"]).alias("lengths"))
