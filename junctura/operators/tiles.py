"""Near points of a plane by square tiles: a tile's task holds the tile's own points and a rim of its neighbours'.

Calls at one place of one key are one point, so a place that holds many calls costs one row. Tiles are as wide
as their points allow: the widest of ``WIDTHS`` of which no tile holds more than ``POINTS_A_TILE`` points, else
``LEAST`` times the distance, of which a tile can't hold more than the square of that many places, however many
calls there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "cluster_key"
WIDTHS = (1 << 20, 1 << 17, 1 << 14)
LEAST = 4
POINTS_A_TILE = 200_000
ROWS_AT_ONCE = 200_000
#: Point pairs of two cells that are compared at once.
PAIRS_AT_ONCE = 1 << 20


def keyed(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.withColumn(KEY, F.concat_ws("\t", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]))


def points(calls: DataFrame) -> DataFrame:
    """KEY, pos_a, pos_b, seq: each place once, with its first call. To be written before ``placed``: a filter here would
    have the ends worked out again for each of its parts."""
    return calls.groupBy(KEY, F.col("pos_a").cast("long").alias("pos_a"), F.col("pos_b").cast("long").alias("pos_b")).agg(F.min("call_seq").alias("seq"))


def placed(rows: DataFrame) -> DataFrame:
    """``points`` that are places: a call without a position has none."""
    return rows.filter("pos_a is not null and pos_b is not null")


def width(rows: DataFrame, distance: int, most: int | None = None) -> int:
    """The tiles' width for these (written) points."""
    most = POINTS_A_TILE if most is None else most
    least = max(LEAST * distance, 1)
    for w in (w for w in WIDTHS if w >= least):
        tiles = rows.groupBy(KEY, F.floor(F.col("pos_a") / w), F.floor(F.col("pos_b") / w)).agg(F.count("*").alias("n"))
        if tiles.filter(F.col("n") > most).isEmpty():
            return w
    return least


def by_home(rows: DataFrame, w: int) -> DataFrame:
    """``rows`` with the tile in which each lies."""
    return rows.withColumns({f"tile_{c}": F.floor(F.col(f"pos_{c}") / w) for c in "ab"})


def tiled(rows: DataFrame, distance: int, w: int, around: bool = False, only: DataFrame | None = None) -> DataFrame:
    """``rows`` by tile (tile_a, tile_b), sorted by tile and then by seq, with a copy in each tile of whose rim they
    are part (home is false there); rim tells whether a point has copies. Rims are at the right and at the top of a
    tile, or all ``around`` it. ``only``: the tiles that are wanted."""
    at = {c: F.floor(F.col(f"pos_{c}") / w) for c in "ab"}
    off = {c: F.col(f"pos_{c}") - at[c] * w for c in "ab"}

    def there(c: str, step: int) -> Column:
        return F.lit(True) if step == 0 else off[c] < distance if step < 0 else off[c] >= w - distance

    steps = (0, -1, 1) if around else (0, -1)
    places = [
        F.when(there("a", x) & there("b", y), F.struct((at["a"] + x).alias("tile_a"), (at["b"] + y).alias("tile_b"), F.lit(x == y == 0).alias("home")))
        for x in steps for y in steps
    ]
    out = rows.withColumn("places", F.array_compact(F.array(*places)))
    out = out.select(*rows.columns, (F.size("places") > 1).alias("rim"), F.explode("places").alias("place")).select(*rows.columns, "rim", "place.*")
    return sorted_tiles(out if only is None else out.join(only, [KEY, "tile_a", "tile_b"], "left_semi"))


def sorted_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition(KEY, "tile_a", "tile_b").sortWithinPartitions(KEY, "tile_a", "tile_b", "seq")


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tiles, some at a time, and the number of each row's tile in its table."""

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in (KEY, "tile_a", "tile_b"):
            of = table[c].combine_chunks()
            new[1:] |= pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    held, n, wanted = [], 0, ROWS_AT_ONCE
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < wanted:
            continue
        table = pa.Table.from_batches(held)
        tile = numbered(table)
        cut = int(np.searchsorted(tile, tile[-1]))
        if cut:
            yield table.slice(0, cut), tile[:cut]
            held, n, wanted = table.slice(cut).to_batches(), table.num_rows - cut, ROWS_AT_ONCE
        else:
            wanted = 2 * n
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def near_links(group: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect exactly what lies within ``distance`` in both a and b in one group.

    Rows meet in cells half as wide as the distance: those of one cell are near each other, so each is tied to the
    cell's first, and two cells need one near pair at most."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side = max(distance // 2, 1)
    reach = (distance - 1) // side + 1 if distance else 0
    _, group = np.unique(group, return_inverse=True)

    def cell(of: np.ndarray) -> np.ndarray:
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, of)
        return (of - least[group]) // side

    x, y = cell(a), cell(b)
    stride, rows_of = int(y.max()) + 2 * reach + 1, int(x.max()) + 2 * reach + 1
    code = (group * rows_of + x) * stride + y
    order = np.argsort(code, kind="stable")
    cells, first, count = np.unique(code[order], return_index=True, return_counts=True)
    lead = np.repeat(first, count)
    same = lead != np.arange(len(order))
    out = [(order[lead[same]], order[same])]
    a, b = a[order], b[order]
    low_a, high_a, low_b, high_b = (f.reduceat(v, first) for v in (a, b) for f in (np.minimum, np.maximum))
    met = []
    for dx in range(reach + 1):
        for dy in range(-reach if dx else 1, reach + 1):
            there = np.searchsorted(cells, cells + dx * stride + dy)
            there[there == len(cells)] = 0
            i = np.flatnonzero(cells[there] == cells + dx * stride + dy)
            met.append((i, there[i]))
    i, j = (np.concatenate([m[k] for m in met]) if met else np.zeros(0, np.int64) for k in (0, 1))
    apart = lambda lo, hi: np.maximum(lo[j] - hi[i], lo[i] - hi[j])
    may = (apart(low_a, high_a) <= distance) & (apart(low_b, high_b) <= distance)
    i, j = i[may], j[may]
    # Outermost points of both cells are compared first; where they tie all cells together, little else is left.
    outer = [first + f for f in _outermost(a, b, first, count)]
    tied = np.zeros(len(i), bool)
    for s in outer:
        for t in outer:
            near = ~tied & (np.abs(a[s[i]] - a[t[j]]) <= distance) & (np.abs(b[s[i]] - b[t[j]]) <= distance)
            out.append((order[s[i[near]]], order[t[j[near]]]))
            tied |= near
    of = least_of_components(len(cells), i[tied], j[tied], np.arange(len(cells)))
    rest = ~tied & (of[i] != of[j])
    i, j = i[rest], j[rest]
    large = count[i] * count[j] > PAIRS_AT_ONCE
    for k in np.flatnonzero(large):
        out += _first_near(a, b, order, (first[i[k]], count[i[k]]), (first[j[k]], count[j[k]]), distance)
    i, j = i[~large], j[~large]
    pairs = count[i] * count[j]
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(pairs) // PAIRS_AT_ONCE)) + 1) if len(i) else []:
        n = pairs[part]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        right = np.repeat(count[j[part]], n)
        s, t = np.repeat(first[i[part]], n) + k // right, np.repeat(first[j[part]], n) + k % right
        near = (np.abs(a[s] - a[t]) <= distance) & (np.abs(b[s] - b[t]) <= distance)
        _, one = np.unique(np.repeat(np.arange(len(part)), n)[near], return_index=True)
        out.append((order[s[near][one]], order[t[near][one]]))
    return np.concatenate([s for s, _ in out]), np.concatenate([t for _, t in out])


Links = tuple[np.ndarray, np.ndarray]


def _beside(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[tuple[int, int], Links]:
    """By step (dx, dy), the cells and those that lie there from them. A cell of a group comes once."""
    x, y = x - x.min(), y - y.min() + 1
    stride = int(y.max()) + 2
    code = (group * (int(x.max()) + 2) + x) * stride + y
    order = np.argsort(code)
    of, out = code[order], {}
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        there = np.searchsorted(of, of + dx * stride + dy)
        there[there == len(of)] = 0
        i = np.flatnonzero(of[there] == of + dx * stride + dy)
        out[dx, dy] = order[i], order[there[i]]
    return out


def box_links(group: np.ndarray, at: dict[str, np.ndarray], distance: int) -> tuple[Links, list[Links]]:
    """Pairs of rows (cells, ``distance`` + 1 wide, of one group) that hold near points, and the pairs in doubt: to the right
    and above, to the right and below. at: pos_a, pos_b (the cell), low and high (the box around its points).

    Points of cells that share a side are near in the other direction anyway, so their boxes decide. At a corner both
    directions count: boxes decide where they are apart, or where one direction is near for all points.
    """
    if not len(group):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return none, [none, none]
    sure, doubt = [], []
    for (dx, dy), (i, j) in _beside(group, at["pos_a"], at["pos_b"]).items():
        below, above = (i, j) if dy >= 0 else (j, i)
        gap = [at["low_a"][j] - at["high_a"][i] if dx else np.zeros(len(i), np.int64), at["low_b"][above] - at["high_b"][below] if dy else np.zeros(len(i), np.int64)]
        may = (gap[0] <= distance) & (gap[1] <= distance)
        if dx and dy:
            told = (at["high_a"][j] - at["low_a"][i] <= distance) | (at["high_b"][above] - at["low_b"][below] <= distance)
            doubt.append((i[may & ~told], j[may & ~told]))
            may &= told
        sure.append((i[may], j[may]))
    return (np.concatenate([i for i, _ in sure]), np.concatenate([j for _, j in sure])), doubt


def _outermost(a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """For each cell the place, in the cell, of its least and greatest point by a and by b."""
    cell = np.repeat(np.arange(len(first)), count)
    out = []
    for value in (a, b):
        by = np.lexsort((value, cell))
        out += [by[first] - first, by[first + count - 1] - first]
    return out


def _first_near(a: np.ndarray, b: np.ndarray, order: np.ndarray, left: tuple[int, int], right: tuple[int, int], distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """One near pair of two large cells, or none."""
    others = np.arange(right[0], right[0] + right[1])
    step = max(PAIRS_AT_ONCE // right[1], 1)
    for at in range(left[0], left[0] + left[1], step):
        own = np.arange(at, min(at + step, left[0] + left[1]))
        near = (np.abs(a[own][:, None] - a[others]) <= distance) & (np.abs(b[own][:, None] - b[others]) <= distance)
        if near.any():
            s, t = np.unravel_index(int(near.argmax()), near.shape)
            return [(order[own[s : s + 1]], order[others[t : t + 1]])]
    return []


def least_of_components(n: int, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the least value of its component under the links x, y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, value)
    return least[label]
