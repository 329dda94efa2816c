"""Clusters of breakpoints: neighbours in both positions, their components, and what a cluster shows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.steps import discard, written
from . import tiles
from .components import connected

EPS = 250
KEYS = ("sample", "chrom_a", "chrom_b", "strand_a", "strand_b")


def _keys(strands: bool) -> list[str]:
    return list(KEYS if strands else KEYS[:3])


def band_edges(calls: DataFrame, eps: int = EPS, strands: bool = True) -> DataFrame:
    """a, b (call_seq, a < b): pairs of one key whose ends are both within ``eps``. Calls lie in cells of both ends, so
    what is compared doesn't grow with the calls that share one end only. A call looks into its own cell and into those
    after it (right, above, and both corners at the right) that it is near enough to; cells are twice as wide as ``eps``,
    so it looks into two or three. The join is on equal values, cells first, as they tell rows apart soonest when sorted.
    Calls of one cell meet once, by their order, so a pair comes once without another shuffle."""
    w, keys = 2 * (eps + 1), _keys(strands)
    side = calls.select(*keys, "call_seq", "pos_a", "pos_b")
    cell = {c: F.floor(F.col(f"pos_{c}") / w) for c in "ab"}
    after = {c: F.col(f"pos_{c}") - cell[c] * w for c in "ab"}

    def reaches(c: str, step: int) -> Column:
        return F.lit(True) if step == 0 else after[c] < eps if step < 0 else after[c] >= w - eps

    cells = [
        F.when(reaches("a", x) & reaches("b", y), F.struct((cell["a"] + x).alias("cell_a"), (cell["b"] + y).alias("cell_b"), F.lit(x != 0 or y != 0).alias("next")))
        for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))
    ]
    left = side.select(*keys, F.col("call_seq").alias("s"), F.col("pos_a").alias("pa"), F.col("pos_b").alias("pb"), F.explode(F.array(*cells)).alias("of")).filter("of is not null")
    right = side.withColumns({f"cell_{c}": cell[c] for c in "ab"})
    near = (F.abs(F.col("pa") - F.col("pos_a")) <= eps) & (F.abs(F.col("pb") - F.col("pos_b")) <= eps)
    pairs = left.select(*keys, "s", "pa", "pb", "of.*").join(right, ["cell_a", "cell_b", *keys]).filter(near & (F.col("next") | (F.col("s") < F.col("call_seq"))))
    return pairs.select(F.least("s", "call_seq").alias("a"), F.greatest("s", "call_seq").alias("b"))


def _label(key: np.ndarray, a: np.ndarray, b: np.ndarray, seq: np.ndarray, eps: int) -> np.ndarray:
    """The least seq of each row's component."""
    return tiles.least_of_components(len(key), *tiles.near_links(key, a, b, eps), seq)


def _in_tiles(batches: Iterator[pa.RecordBatch], eps: int) -> Iterator[pa.RecordBatch]:
    """Boxes of whole tiles with their label, and whether boxes alone don't tell if a box is near the one to the right and
    above (up), or below (down)."""
    for table, tile in tiles.whole_tiles(batches):
        at = {c: table[c].to_numpy() for c in ("pos_a", "pos_b", "seq", "low_a", "high_a", "low_b", "high_b")}
        (x, y), doubt = tiles.box_links(tile, at, eps)
        label = tiles.least_of_components(len(tile), x, y, at["seq"])
        table = table.drop_columns(["tile_a", "tile_b"]).append_column("label", pa.array(label, pa.int64()))
        for name, (i, j) in zip(("up", "down"), doubt, strict=True):
            open_ = np.zeros(len(tile), bool)
            open_[i[label[i] != label[j]]] = True
            table = table.append_column(name, pa.array(open_))
        yield from table.to_batches()


def _met(batches: Iterator[pa.RecordBatch], eps: int) -> Iterator[pa.RecordBatch]:
    """The pairs of cells (as tiles, whose rows of seq 0 are the one cell's places and of seq 1 the other's) that are near."""
    for table, tile in tiles.whole_tiles(batches):
        side = table["seq"].to_numpy()
        met = np.flatnonzero((_label(tile, table["pos_a"].to_numpy(), table["pos_b"].to_numpy(), side, eps) == 0) & (side == 1))
        _, first = np.unique(tile[met], return_index=True)
        yield from table.select([tiles.KEY, "tile_a", "tile_b"]).take(pa.array(met[first])).to_batches()


def _corner_links(labels: DataFrame, places: DataFrame, eps: int) -> DataFrame:
    """a, b: labels of cells that touch at a corner, are in doubt by their boxes and are near by their places."""
    rise = F.explode(F.array_compact(F.array(F.when(F.col("up"), F.lit(1).cast("long")), F.when(F.col("down"), F.lit(-1).cast("long")))))
    doubt = labels.filter("up or down").select(*CELL, rise.alias("rise")).distinct()
    pair = [F.col("cell_a").alias("tile_a"), (2 * F.col("cell_b") + (F.col("rise") > 0).cast("long")).alias("tile_b")]
    sides = F.explode(F.array(*[F.struct((F.col("cell_a") + k).alias("cell_a"), (F.col("cell_b") + k * F.col("rise")).alias("cell_b"), F.lit(k).cast("long").alias("seq")) for k in (0, 1)]))
    sides = written(doubt.select(tiles.KEY, *pair, sides.alias("s")).select(tiles.KEY, "tile_a", "tile_b", "s.*"), "corners")
    rows = _with_cells(places.drop("seq"), eps).join(sides, CELL).select(tiles.KEY, "tile_a", "tile_b", "pos_a", "pos_b", "seq").distinct()
    near = tiles.sorted_tiles(rows).mapInArrow(lambda batches: _met(batches, eps), rows.select(tiles.KEY, "tile_a", "tile_b").schema)
    ends = near.join(sides, [tiles.KEY, "tile_a", "tile_b"]).join(labels.filter("home").select(*CELL, "label"), CELL)
    return ends.groupBy(tiles.KEY, "tile_a", "tile_b").agg(F.min("label").alias("a"), F.max("label").alias("b")).select("a", "b")


CELL = [tiles.KEY, "cell_a", "cell_b"]


def _with_cells(rows: DataFrame, eps: int) -> DataFrame:
    """``rows`` with their cells: as wide as two positions of one cell may be apart."""
    return rows.withColumns({f"cell_{s}": F.floor(F.col(f"pos_{s}") / (eps + 1)) for s in "ab"})


def clustered(calls: DataFrame, eps: int = EPS, strands: bool = True, min_samples: int = 1, points_a_tile: int | None = None) -> DataFrame:
    """``calls`` with cluster_id, the least call_seq of its component.

    Calls of one cell are near each other, so a cell is one row, with the box around its places, however many calls it
    holds. Boxes of cells that share a side tell exactly whether they are near; where cells touch at a corner only,
    their boxes leave a doubt and nothing else ties them, their places are compared (``_corner_links``). Each tile of
    cells is labelled on its own, with the rim it shares with its neighbours (see ``tiles``), so what a task holds is
    bounded by the tile, however long an island or many a key's calls are. A cell of a rim has a label in each tile;
    star steps join those labels, and only those. Calls find their cluster by cell: where calls are dense, Spark
    broadcasts the cells, and calls aren't shuffled. A call without a position is a cluster of its own.
    """
    keyed = tiles.keyed(calls, _keys(strands))
    places = tiles.placed(written(keyed.select(tiles.KEY, *[F.col(f"pos_{s}").cast("long").alias(f"pos_{s}") for s in "ab"], F.col("call_seq").alias("seq")), "places"))
    ends = [f(f"pos_{s}").alias(f"{n}_{s}") for s in "ab" for f, n in ((F.min, "low"), (F.max, "high"))]
    boxes = written(_with_cells(places, eps).groupBy(*CELL).agg(F.min("seq").alias("seq"), *ends), "boxes").withColumnsRenamed({"cell_a": "pos_a", "cell_b": "pos_b"})
    w = tiles.width(boxes, 1, points_a_tile)
    rows = tiles.tiled(boxes, 1, w)
    told = {"label": F.lit(0).cast("long"), "up": F.lit(True), "down": F.lit(True)}
    schema = rows.drop("tile_a", "tile_b").withColumns(told).schema
    labels = written(rows.mapInArrow(lambda batches: _in_tiles(batches, eps), schema), "labels").withColumnsRenamed({"pos_a": "cell_a", "pos_b": "cell_b"})
    ties = labels.filter("rim and seq <> label").select(F.col("seq").alias("a"), F.col("label").alias("b"))
    if not labels.filter("up or down").isEmpty():
        ties = ties.union(_corner_links(labels, places, eps))
    roots = connected(ties, lambda d: written(d, "ties"), discard).withColumnRenamed("node", "label")
    found = labels.filter("home").join(roots, "label", "left").withColumn("cluster_id", F.coalesce("root", "label"))
    cells = written(found.select(*CELL, "cluster_id"), "cells")
    out = _with_cells(keyed, eps).join(cells, CELL, "left").select(*calls.columns, F.coalesce("cluster_id", "call_seq").alias("cluster_id"))
    if min_samples > 1:
        large = out.groupBy("cluster_id").agg(F.count("*").alias("members")).filter(F.col("members") >= min_samples)
        out = out.join(large.select("cluster_id"), "cluster_id", "left_semi")
    return out


#: What is known of a place in the greedy mode. LATE is taken, maybe by an earlier seed than is known yet.
OPEN, SEED, TAKEN, LATE = 0, 1, 2, 3


def _greedy(tile: np.ndarray, rows: list[list[int]], window: int, owners: bool) -> list[tuple[int, int]]:
    """state and owner of each row (a, b, seq, state, owner, home; by tile and seq). A seed is at least a window from the
    seeds before it, so a cell of that width holds one seed at most."""
    side, out, now = max(window, 1), [], -1
    seeds: dict[tuple[int, int], tuple[int, int, int]] = {}
    waiting: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, (a, b, seq, state, known, home) in zip(tile.tolist(), rows, strict=True):
        if k != now:
            seeds, waiting, now = {}, {}, k
        x, y, owner = a // side, b // side, None
        if state == SEED:
            seeds[x, y] = a, b, seq
        elif home and state == (LATE if owners else OPEN):
            cells = [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
            near = [s for c in cells if (s := seeds.get(c)) and abs(s[0] - a) <= window and abs(s[1] - b) <= window]
            wait = any(abs(p - a) <= window and abs(q - b) <= window for c in cells for p, q in waiting.get(c, ()))
            if near:
                state, owner = LATE if wait else TAKEN, min(s[2] for s in near)
            elif not wait:
                state, seeds[x, y] = SEED, (a, b, seq)
        if state == OPEN:
            waiting.setdefault((x, y), []).append((a, b))
        out.append((state, known if owner is None else owner))
    return out


def grid_clustered(calls: DataFrame, window: int = EPS, points_a_tile: int | None = None) -> DataFrame:
    """Greedy grid clusters: in input order, a call that isn't taken takes all free calls of its key within
    ``window`` in both ends, so a call belongs to the first seed near it, and a seed has no earlier seed near.

    The order is kept by rounds over tiles: a task settles, in order, each place whose earlier near places are
    settled, with the rim around its tile as the round before left it; what waits for a neighbouring tile waits
    for the next round. The first place that is open is settled in every round, and most are in the first. Later rounds
    read only tiles with open places (and their rims), and the last one only tiles with places whose owner isn't sure.
    Calls of one place go where its first call goes.
    """
    keyed = tiles.keyed(calls, list(KEYS))
    state = tiles.placed(written(tiles.points(keyed).withColumns({"state": F.lit(OPEN), "owner": F.col("seq")}), "places"))
    w, schema = tiles.width(state, window, points_a_tile), state.schema

    def step(owners: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, tile in tiles.whole_tiles(batches):
                rows = list(zip(*(table[c].to_pylist() for c in ("pos_a", "pos_b", "seq", "state", "owner", "home")), strict=True))
                found, owner = zip(*_greedy(tile, rows, window, owners), strict=True)
                table = table.set_column(table.column_names.index("state"), "state", pa.array(found, pa.int32())).set_column(table.column_names.index("owner"), "owner", pa.array(owner, pa.int64()))
                yield from table.filter(table["home"]).select(schema.names).to_batches()

        return run

    tile, place = [tiles.KEY, "tile_a", "tile_b"], [tiles.KEY, "pos_a", "pos_b"]

    def of_state(rows: DataFrame, which: int) -> DataFrame:
        return written(tiles.by_home(rows.filter(F.col("state") == which), w).select(*tile).distinct(), "tiles")

    def without(rows: DataFrame, which: DataFrame) -> DataFrame:
        return tiles.by_home(rows, w).join(which, tile, "left_anti").select(schema.names)

    settled = written(tiles.tiled(state, window, w, around=True).mapInArrow(step(False), schema), "settled")
    discard(state)
    parts, copies, left = [], None, of_state(settled, OPEN)
    while not left.isEmpty():
        parts.append(without(settled, left) if copies is None else written(without(settled, left), "parts"))
        before = copies
        if before is None:
            copies = written(tiles.tiled(settled, window, w, around=True, only=left), "copies")
        else:
            new = settled.select(*place, F.col("state").alias("new_state"), F.col("owner").alias("new_owner"))
            copies = before.join(left, tile, "left_semi").join(new, place, "left")
            copies = copies.withColumns({"state": F.coalesce("new_state", "state"), "owner": F.coalesce("new_owner", "owner")}).select(before.columns)
            copies = written(copies, "copies")
            discard(before)
        settled = written(tiles.sorted_tiles(copies).mapInArrow(step(False), schema), "settled")
        left = of_state(settled, OPEN)
    state = reduce(DataFrame.union, [*parts, settled])
    late = of_state(state, LATE)
    owned = tiles.tiled(state, window, w, around=True, only=late).mapInArrow(step(True), schema)
    found = without(state, late).union(owned).select(*place, F.col("owner").alias("cluster_id"))
    return keyed.join(found, [tiles.KEY, "pos_a", "pos_b"], "left").select(*calls.columns, F.coalesce("cluster_id", "call_seq").alias("cluster_id"))


def clusters(rows: DataFrame) -> DataFrame:
    """One row for each cluster: the upper median member by position, the callers, the evidence.

    Evidence is the maximum of each kind over the members, not a sum. Members are listed (member_record_ids) where
    ``rows`` have a record_id: drop it where nobody reads the list, which is as long as the calls are many.
    """
    listed = "record_id" in rows.columns
    floor0 = lambda c: F.greatest(F.max(c), F.lit(0)).cast("long").alias(c)
    member = F.struct("pos_a", "pos_b", "call_seq", "chrom_a", "strand_a", "chrom_b", "strand_b", "sv_type", *["record_id"] * listed)
    out = rows.groupBy("cluster_id").agg(
        F.min("sample").alias("sample"), F.min("call_seq").alias("first_seq"), F.sort_array(F.collect_list(member)).alias("members"),
        F.sort_array(F.collect_set("caller")).alias("callers_supporting"), *map(floor0, ("split_reads", "discordant_pairs", "assembly_contigs", "soft_clips")),
        F.max("vaf").alias("vaf"), F.max("raw_qual").alias("raw_qual_max"), F.bool_or("precise").alias("precise"), F.bool_or("filter_pass").alias("any_pass"),
    )
    median = F.element_at("members", (F.floor(F.size("members") / 2) + 1).cast("int"))
    out = out.withColumn("rep", median)
    kinds = sum(((F.col(c) > 0).cast("long") for c in ("discordant_pairs", "assembly_contigs", "soft_clips")), (F.col("split_reads") > 0).cast("long"))
    return out.select(
        "cluster_id", "sample", "first_seq", *[F.col(f"rep.{c}").alias(c) for c in ("chrom_a", "pos_a", "strand_a", "chrom_b", "pos_b", "strand_b", "sv_type")],
        F.size("callers_supporting").cast("long").alias("n_callers"), "callers_supporting", kinds.alias("n_evidence_types"),
        "split_reads", "discordant_pairs", "assembly_contigs", "soft_clips", "vaf", "raw_qual_max", "precise", "any_pass",
        *[F.transform("members", lambda m: m["record_id"]).alias("member_record_ids")] * listed, F.size("members").cast("long").alias("n_members"),
    )


def with_members(calls: DataFrame, of: DataFrame) -> DataFrame:
    """``calls`` with the member_record_ids that ``of`` has by cluster_id. Lists are the bulk of a call, so they stay
    where they were written while the other columns go through joins and orders, and are joined once."""
    return calls.join(of.select("cluster_id", "member_record_ids"), "cluster_id", "left").select(*calls.columns, "member_record_ids")


def appended(flags: Column, when: Column, flag: str) -> Column:
    """``flags`` with ``flag`` at its end if ``when`` holds and it isn't there yet."""
    return F.when(when & ~F.array_contains(flags, flag), F.array_append(flags, F.lit(flag))).otherwise(flags)
