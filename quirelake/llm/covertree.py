"""Embedding near-duplicates by dual traversal of cover trees.

Distinct vectors, scaled to length one, are dealt to cells by the nearest of the pivots, of
which there are as many as cells are wanted, up to ``PIVOT_BYTES`` in all; only a cell that
still holds too many is cut by hash into blocks. Each block becomes a
cover tree: nested levels of centres whose radii halve (2, 1, 1/2, ...), every point within
a level's radius of its centre, and each centre also a centre on all lower levels; levels
with nearly as many nodes as the next one are left out. Every
node knows the true distance to its farthest point. Two trees (or one with itself) are
traversed level by level together: a pair of nodes is dropped when the centre distance less
both covering radii exceeds the threshold's distance, taken whole when the distance plus
both radii is within it, and opened otherwise; pairs of points that are left are decided by
their cosine in double precision. Pairs of cells are dropped by the same bound on pivots.

How it is distributed: blocks that follow one another make groups, whose number follows
the cores and, beyond ``GROUP`` vectors each, the input. The task of a pair of groups gets
every block once, however many partners it has there; a block goes only to groups that
have a block of a near cell, found from a few numbers for each pivot, not from a list of
pairs. So vectors are copied as often as there are near groups, not cells. A task returns
a row for each of its vectors with a link (a count and one link of a spanning forest),
never a row for each pair, and keeps no more than BLOCK links before it thins them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import durable, python_batches, runs, working
from quirelake.llm.simhash import _forest, _grouped

#: Vectors of a block, and bytes of all pivots, at most about; pivots by which the others are ordered.
CELL, PIVOT_BYTES, ORDERING = 4096, 1 << 25, 64
#: Vectors of a group, at most and at least about, and bytes of its vectors at most.
GROUP, LEAST_GROUP, GROUP_BYTES = 1 << 15, 1 << 10, 1 << 27
#: Tasks for the pairs of groups, at most.
MOST_TASKS = 100_000
#: Links kept before they are thinned to a forest, and pairs of points compared by their own rows at once.
BLOCK, GATHERED = 1 << 20, 1 << 15
FINEST = 2.0**-8
#: Nodes of a level for each one of the next level, at most, in the trees that are traversed.
THIN = 0.8
#: Coordinates of the products that sort out pairs (of the others only the length is used), and the share of the pairs that may be left by them.
SHORT, LEFT = 32, 1 / 64
#: Products taken at once.
STRIP = 1 << 20
#: Room for rounding in distance bounds.
SLACK = 1e-9


@dataclass
class CoverTree:
    """Levels from the root down; the last level has every point as a node of radius 0."""

    points: np.ndarray  # unit vectors
    centre: list[np.ndarray]  # of each level: the point of each node
    parent: list[np.ndarray]  # of each level: the node's parent on the level above
    radius: list[np.ndarray]  # of each level: largest distance from the centre to a point below

    @property
    def depth(self) -> int:
        return len(self.centre)

    def thinned(self) -> CoverTree:
        """The tree without the levels that have nearly as many nodes as the next one left: to open these would spare few pairs."""
        kept = [self.depth - 1]
        for k in range(self.depth - 2, -1, -1):
            if len(self.centre[k]) <= THIN * len(self.centre[kept[-1]]):
                kept.append(k)
        kept.reverse()
        parent = [np.zeros(len(self.centre[kept[0]]), np.int64)]
        for above, k in zip(kept, kept[1:]):
            up = self.parent[k]
            for between in range(k - 1, above, -1):
                up = self.parent[between][up]
            parent.append(up)
        return CoverTree(self.points, [self.centre[k] for k in kept], parent, [self.radius[k] for k in kept])

    def to_bytes(self) -> bytes:
        """The levels, without the points."""
        sizes = np.array([self.depth, *map(len, self.centre)], np.int64)
        return b"".join(x.tobytes() for x in (sizes, *self.centre, *self.parent, *self.radius))

    @classmethod
    def from_bytes(cls, points: np.ndarray, data: bytes) -> CoverTree:
        depth = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, depth, 8)
        flat = np.frombuffer(data, np.int64, offset=8 * (depth + 1))
        parts = np.split(flat, np.cumsum(np.tile(sizes, 3))[:-1])
        return cls(points, parts[:depth], parts[depth : 2 * depth], [p.view(np.float64) for p in parts[2 * depth :]])


def _covered(points: np.ndarray, rest: np.ndarray, first: int, reach: float) -> Iterator[tuple[int, np.ndarray]]:
    """Centres for the points ``rest``, each the first one that no centre before it has within ``reach``, with the points that it takes; ``first`` is the first centre."""
    rest = np.concatenate([[first], rest[rest != first]])
    own, free = points[rest], np.ones(len(rest), bool)
    rows, low = max(1, STRIP // len(rest)), 0
    while low < len(rest):
        asked = low + np.flatnonzero(free[low:])[:rows]
        if not len(asked):
            return
        near = own[asked] @ own[asked[0] :].T >= 1.0 - 0.5 * reach * reach
        left = free[asked[0] :]
        for k, i in enumerate((asked - asked[0]).tolist()):
            if left[i]:
                took = near[k] & left
                took[i] = True
                left[took] = False
                yield int(rest[asked[k]]), rest[asked[0] :][took]
        low = int(asked[-1]) + 1


def build(points: np.ndarray) -> CoverTree:
    """A cover tree of unit vectors, built from the root down."""
    n = len(points)
    owner = np.zeros(n, np.int64)  # node of each point on the current level
    centre, parent, radius = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
    reach = 2.0
    while True:
        gap = points - points[centre[-1][owner]]
        far = np.zeros(len(centre[-1]))
        np.maximum.at(far, owner, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        radius.append(far)
        if len(centre[-1]) == n:
            break
        reach /= 2
        if reach < FINEST or not (far > 0).any():  # what is left lies together: every point is a node
            centre.append(np.arange(n))
            parent.append(owner)
            radius.append(np.zeros(n))
            break
        order = np.argsort(owner, kind="stable")
        many = np.bincount(owner, minlength=len(centre[-1]))
        ends = np.cumsum(many)
        one = np.flatnonzero(many == 1)  # such nodes stay as they are
        new_centre, new_parent = centre[-1][one].tolist(), one.tolist()
        new_owner = np.empty(n, np.int64)
        new_owner[centre[-1][one]] = np.arange(len(one))
        for node in np.flatnonzero(many > 1).tolist():
            end = int(ends[node])
            for at, near in _covered(points, order[end - int(many[node]) : end], int(centre[-1][node]), reach):  # nested: the node's own centre comes first
                new_owner[near] = len(new_centre)
                new_centre.append(at)
                new_parent.append(node)
        centre.append(np.array(new_centre))
        parent.append(np.array(new_parent))
        owner = new_owner
    return CoverTree(points, centre, parent, radius)


class _Below:
    """Points under each node of a level."""

    def __init__(self, tree: CoverTree, level: int):
        at = np.arange(len(tree.centre[-1]))
        for k in range(tree.depth - 1, level, -1):
            at = tree.parent[k][at]
        self.points = tree.centre[-1][np.argsort(at, kind="stable")]
        self.ends = np.cumsum(np.bincount(at, minlength=len(tree.centre[level])))

    def __getitem__(self, node: int) -> np.ndarray:
        return self.points[self.ends[node - 1] if node else 0 : self.ends[node]]


def _points_below(tree: CoverTree, level: int) -> list[np.ndarray]:
    """Points under each node of a level."""
    below = _Below(tree, level)
    return [below[node] for node in range(len(below.ends))]


def _product(starts_a: np.ndarray, list_a: np.ndarray, starts_b: np.ndarray, list_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of a[i] with children of b[i], for each i."""
    na, nb = starts_a[a + 1] - starts_a[a], starts_b[b + 1] - starts_b[b]
    n = na * nb
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(nb, n)
    return list_a[np.repeat(starts_a[a], n) + at // width], list_b[np.repeat(starts_b[b], n) + at % width]


def dual_traversal(left: CoverTree, right: CoverTree, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Links between the points of two trees as (points of left, points of right, whole).

    Not whole: the i-th of one links with the i-th of the other. Whole: every one of the
    first links with every one of the second, each pair given once. With ``same`` both
    are one tree; each pair is given once in one order, and no point with itself.
    """
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    depth = max(left.depth, right.depth)
    level = lambda t, k: min(k, t.depth - 1)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)  # open pairs of nodes on the level above
    for k in range(depth):
        la, lb = level(left, k), level(right, k)
        last = k == depth - 1
        ca, cb = left.centre[la], right.centre[lb]
        ra, rb = left.radius[la], right.radius[lb]
        up_a = left.parent[la] if 0 < k < left.depth else np.zeros(len(ca), np.int64) if not k else np.arange(len(ca))
        up_b = right.parent[lb] if 0 < k < right.depth else np.zeros(len(cb), np.int64) if not k else np.arange(len(cb))
        keep_a, keep_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y, dots in _near_children(left.points[ca], right.points[cb], ra, rb, up_a, up_b, a, b, reach, same):
            if last:
                hit = dots >= cosine
                if same:
                    hit &= x < y
                if hit.any():
                    yield ca[x[hit]], cb[y[hit]], False
                continue
            span = ra[x] + rb[y]
            inside = (span > 0) & (np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots)) + span < reach - SLACK)
            if same:
                inside &= x != y
            if inside.any():
                below_a, below_b = _Below(left, la), _Below(right, lb)
                for i, j in zip(x[inside].tolist(), y[inside].tolist()):
                    yield below_a[i], below_b[j], True
            keep_a.append(x[~inside])
            keep_b.append(y[~inside])
        a, b = np.concatenate(keep_a), np.concatenate(keep_b)
        if not len(a):
            return


def _near_children(pa_: np.ndarray, pb: np.ndarray, ra: np.ndarray, rb: np.ndarray, up_a: np.ndarray, up_b: np.ndarray, a: np.ndarray, b: np.ndarray, reach: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, dot product) of the nodes x under a[i] and y under b[i] whose bound allows a link; of one tree, x <= y only.

    Where the open pairs are a fair share of all pairs, products are taken as matrices and
    masked by the open pairs above; where they are few, pair by pair.
    """
    na, nb = np.bincount(up_a, minlength=int(a.max()) + 1), np.bincount(up_b, minlength=int(b.max()) + 1)
    total = int((na[a] * nb[b]).sum())
    if total > 0.02 * len(pa_) * len(pb):
        open_ = np.zeros((len(na), len(nb)), bool)
        open_[a, b] = True
        if same:
            open_ |= open_.T
        every = bool(open_.all())
        # A distance d is within the bound if 1 - d * d / 2, the product, is 1 - (r + limit)**2 / 2 at least, r being a row's
        # radius: so r and limit are taken into the products, and each row has one least value.
        limit_b = reach + SLACK + rb
        least = 1.0 - 0.5 * ra * ra
        # Products in single precision leave out only what is beyond the bound by more than their error.
        least -= 2.0**-22 * (pa_.shape[1] + 3) * (1.0 + (ra + 0.5 * limit_b.max()) * limit_b.max())
        least = least.astype(np.float32)[:, None]

        def sides(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
            tails = [[np.linalg.norm(p[:, coordinates:], axis=1)] if coordinates < p.shape[1] else [] for p in (pa_, pb)]
            x = np.column_stack([pa_[:, :coordinates], *tails[0], ra, np.ones(len(pa_))])
            return x.astype(np.float32), np.column_stack([pb[:, :coordinates], *tails[1], limit_b, 0.5 * limit_b * limit_b]).astype(np.float32).T.copy()

        # The product of two tails is that of their lengths at most.
        coordinates = SHORT if 2 * SHORT <= pa_.shape[1] else pa_.shape[1]
        short_a, short_b = sides(coordinates)
        rows = max(1, STRIP // max(1, len(pb)))
        low = 0
        while low < len(pa_):
            part, start = slice(low, low + rows), low if same else 0  # of one tree, what is below the diagonal is left out
            at_once = np.flatnonzero(short_a[part] @ short_b[:, start:] >= least[part])
            if coordinates < pa_.shape[1] and len(at_once) > LEFT * min(rows, len(pa_) - low) * (len(pb) - start):
                coordinates = pa_.shape[1]  # these vectors differ in their tails
                short_a, short_b = sides(coordinates)
                continue
            x, y = np.divmod(at_once, len(pb) - start)
            x, y = x + low, y + start
            if not every:
                kept = open_[up_a[x], up_b[y]]
                x, y = x[kept], y[kept]
            if same:
                one = x <= y
                x, y = x[one], y[one]
            for at in range(0, len(x), GATHERED):
                i, j = x[at : at + GATHERED], y[at : at + GATHERED]
                dots = np.einsum("ij,ij->i", pa_[i], pb[j])
                within = dots >= 1.0 - 0.5 * (limit_b[j] + ra[i]) ** 2
                yield i[within], j[within], dots[within]
            low += rows
        return
    starts_a, order_a = np.concatenate([[0], np.cumsum(na)]), np.argsort(up_a, kind="stable")
    starts_b, order_b = np.concatenate([[0], np.cumsum(nb)]), np.argsort(up_b, kind="stable")
    ends = np.cumsum(na[a] * nb[b])
    at = 0
    while at < len(a):  # as many open pairs as open into about GATHERED
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GATHERED, "right")))
        x, y = _product(starts_a, order_a, starts_b, order_b, a[at:upto], b[at:upto])
        at = upto
        if same:  # an open pair of two nodes stands for both orders
            pairs = np.unique(np.minimum(x, y) * len(pb) + np.maximum(x, y))
            x, y = pairs // len(pb), pairs % len(pb)
        for k in range(0, len(x), GATHERED):
            i, j = x[k : k + GATHERED], y[k : k + GATHERED]
            dots = np.einsum("ij,ij->i", pa_[i], pb[j])
            near = dots >= 1.0 - 0.5 * (reach + SLACK + ra[i] + rb[j]) ** 2
            yield i[near], j[near], dots[near]


def links_of(left: CoverTree, right: CoverTree, nodes_l: np.ndarray, nodes_r: np.ndarray, weights_l: np.ndarray, weights_r: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight of each point of left and right, and links (node, node) that connect what is linked."""
    got_l, got_r = np.zeros(len(left.points), np.int64), np.zeros(len(right.points), np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    kept = 0
    for x, y, whole in dual_traversal(left, right, cosine, same):
        if whole:
            got_l[x] += weights_r[y].sum()
            got_r[y] += weights_l[x].sum()
            held += [(nodes_l[x], np.full(len(x), nodes_r[y[0]])), (np.full(len(y), nodes_l[x[0]]), nodes_r[y])]
        else:
            np.add.at(got_l, x, weights_r[y])
            np.add.at(got_r, y, weights_l[x])
            held.append((nodes_l[x], nodes_r[y]))
        kept += len(held[-1][0])
        if kept > BLOCK:
            held, kept = [_forest(*map(np.concatenate, zip(*held)))], 0
    none = np.zeros(0, np.int64)
    a, b = _forest(*map(np.concatenate, zip(*held))) if held else (none, none)
    return got_l, got_r, a, b


# --- Spark -----------------------------------------------------------------------------


def unit_vectors(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows scaled to length one in double precision, whatever their magnitude: the largest part is brought to one first."""
    v = np.asarray(flat, np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Plan:
    """Cells and groups of cells: a few numbers for each pivot, of which there are PIVOT_BYTES at most."""

    pivots: dict[int, np.ndarray]  # by length of the vectors: their unit vectors
    offset: dict[int, int]  # by length: number of the first pivot
    cuts: np.ndarray  # of each pivot: blocks of its cell
    start: np.ndarray  # of each pivot: vectors in the cells before it
    size: np.ndarray  # of each pivot: vectors in its cell
    radius: np.ndarray  # of each pivot: distance to the farthest vector in its cell
    group: int  # vectors of a group
    reach: float

    def group_of(self, cell: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return (self.start[cell] + cut * self.size[cell] // self.cuts[cell]) // self.group

    def near(self, cell: int, dim: int) -> np.ndarray:
        """Pivots of the cells that may hold a vector linked with one of ``cell``: a row of the covering-radius bound."""
        low, mine = self.offset[dim], self.pivots[dim]
        gap = np.linalg.norm(mine - mine[cell - low], axis=1)
        other = low + np.arange(len(mine))
        return other[(gap - self.radius[other] - self.radius[cell] <= self.reach + SLACK) & (self.size[other] > 0)]

    def groups_near(self, cell: int, dim: int) -> np.ndarray:
        """Groups that have a block of a near cell."""
        near = self.near(cell, dim)
        first, last = self.group_of(near, np.zeros(len(near), np.int64)), self.group_of(near, self.cuts[near] - 1)
        return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist())]))


def nearest(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each vector, some vectors at a time."""
    rows = max(1, (1 << 22) // len(pivots))
    return np.concatenate([(v[low : low + rows] @ pivots.T).argmax(axis=1) for low in range(0, len(v), rows)])


def in_order(pivots: np.ndarray) -> np.ndarray:
    """Pivots with those beside each other that lie about the same one of a few: cells that are near stand together, so a block goes to few groups."""
    few = pivots[:: -(-len(pivots) // ORDERING)]
    return pivots[np.argsort(nearest(pivots, few), kind="stable")]


def _to_cells(pivots: dict[int, np.ndarray], offset: dict[int, int], cuts: np.ndarray):
    """Rows ``dim, node, copies, vector`` with the number of the nearest pivot, a cut of its cell by hash, and the distance to the pivot."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
                v = unit_vectors(_flat(rows.column(3)), dim)
                p = pivots[dim]
                near = nearest(v, p)
                gap = np.linalg.norm(v - p[near], axis=1)
                cell = near + offset[dim]
                cut = (rows.column(1).to_numpy().view(np.uint64) % cuts[cell].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cut), pa.array(gap), *rows.columns], names=["cell", "cut", "gap", *batch.schema.names])

    return step


BLOCK_ROW = "unit long, part long, cell long, cut long, dim int, vectors binary, wide boolean, nodes binary, copies binary, levels binary"


def _blocks(plan: Plan):
    """Rows in the order of ``block`` become one row a block and unit that it is needed in: its vectors and its cover tree."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches):
            cell, cut, dim = (t[c][0].as_py() for c in ("cell", "cut", "dim"))
            flat = _flat(t["vector"].combine_chunks())
            wide = bool((flat.astype(np.float32).astype(np.float64) != flat).any())
            tree = build(unit_vectors(flat, dim)).thinned()
            mine = int(plan.group_of(np.array([cell]), np.array([cut]))[0])
            groups = plan.groups_near(cell, dim)
            low, high = np.minimum(groups, mine), np.maximum(groups, mine)
            row = [cell, cut, dim, (flat if wide else flat.astype(np.float32)).tobytes(), wide, t["node"].to_numpy().tobytes(), t["copies"].to_numpy().tobytes(), tree.to_bytes()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            for a, b in zip(low.tolist(), high.tolist()):
                head = [pa.array([(a << 31) | b]), pa.array([mine])]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array([x], k) for x, k in zip(row, kinds)]], names=[f.split()[0] for f in BLOCK_ROW.split(", ")])

    return step


def _unit_links(plan: Plan, cosine: float):
    """Rows ``node, n, other`` of the links between the blocks of a unit's two groups (or within its one group): linked weights, and links that connect what is linked."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("covertree")
        for unit, t in runs(batches):
            low, high = unit >> 31, unit & ((1 << 31) - 1)
            held = []
            for r in t.sort_by([("cell", "ascending"), ("cut", "ascending")]).to_pylist():
                flat = np.frombuffer(r["vectors"], np.float64 if r["wide"] else np.float32)
                tree = CoverTree.from_bytes(unit_vectors(flat, r["dim"]), r["levels"])
                held.append((r["part"], r["cell"], r["dim"], tree, np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["copies"], np.int64)))
            near = {cell: set(plan.near(cell, dim).tolist()) for _, cell, dim, *_ in held}
            for i, (part, cell, dim, left, ln, lw) in enumerate(held):
                for j, (part_j, cell_j, dim_j, right, rn, rw) in enumerate(held):
                    # Each pair of blocks once: by the order of the groups, or of the blocks in one group.
                    if dim != dim_j or cell_j not in near[cell] or not ((part, part_j) == (low, high) and (low != high or i <= j)):
                        continue
                    gl, gr, node, root = links_of(left, right, ln, rn, lw, rw, cosine, i == j)
                    first = np.concatenate([ln[gl > 0], rn[gr > 0], node])
                    n = np.concatenate([gl[gl > 0], gr[gr > 0], np.zeros(len(node), np.int64)])
                    other = pa.array(np.concatenate([np.zeros(len(first) - len(node), np.int64), root]), mask=np.arange(len(first)) < len(first) - len(node))
                    yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(n), other], names=["node", "n", "other"])

    return step


def _planned(distinct: DataFrame, n: int, reach: float, cell: int) -> tuple[Plan, DataFrame]:
    """The plan for ``n`` distinct vectors (dim, node, copies, vector), and their rows with cell, cut and gap."""
    spark = distinct.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    dims = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}  # a row a length
    room = max(1, min(GROUP, GROUP_BYTES // (8 * max(dims))))
    groups = max(-(-n // room), min(-(-n // LEAST_GROUP), ceil(sqrt(2 * tasks))))
    group = -(-n // groups)
    cell = max(1, min(cell, group))
    draw = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 31))
    most = {d: max(1.0, PIVOT_BYTES / (8 * d) * c / n) for d, c in dims.items()}  # pivots of a length: its share of the bytes
    wanted = spark.createDataFrame([(d, float((1 << 31) * min(most[d], c / cell) / c)) for d, c in dims.items()], "dim int, least double")
    first = distinct.groupBy("dim").agg(F.min_by("vector", draw).alias("vector")).withColumn("draw", F.lit(-1).cast("long"))
    drawn = distinct.join(F.broadcast(wanted), "dim").where(draw < F.col("least")).select("dim", "vector", draw.alias("draw"))
    rows = drawn.unionByName(first).select("dim", "vector").toArrow()  # about PIVOT_BYTES and a row a length
    pivots = {d: in_order(np.unique(unit_vectors(_flat(rows.filter(pc.field("dim") == d)["vector"].combine_chunks()), d), axis=0)) for d in dims}
    schema = "cell long, cut long, gap double, dim int, node long, copies long, vector array<double>"
    ordered = distinct.select("dim", "node", "copies", "vector")

    def offsets() -> tuple[dict[int, int], int]:
        starts = np.cumsum([0, *(len(pivots[d]) for d in sorted(dims))]).tolist()
        return dict(zip(sorted(dims), starts)), starts[-1]

    # A bunch that no pivot was drawn from lies far from all of them: such vectors give further pivots.
    offset, total = offsets()
    gaps = ordered.mapInArrow(_to_cells(pivots, offset, np.ones(total, np.int64)), schema)
    far = gaps.join(F.broadcast(gaps.groupBy("dim").agg(F.percentile_approx("gap", 0.5).alias("middle"))), "dim").where((F.col("gap") > 2 * F.col("middle")) & (F.col("gap") > reach))
    some = {r["dim"]: r["count"] for r in far.groupBy("dim").count().collect()}  # a row a length
    if some:
        share = {d: min(1.0, max(64.0, 8 * c / cell) / c, PIVOT_BYTES / (8 * d) / c) for d, c in some.items()}
        wanted = spark.createDataFrame([(d, float((1 << 31) * x)) for d, x in share.items()], "dim int, least double")
        more = far.join(F.broadcast(wanted), "dim").where(draw < F.col("least")).select("dim", "vector").toArrow()
        for d in some:
            found = unit_vectors(_flat(more.filter(pc.field("dim") == d)["vector"].combine_chunks()), d)
            pivots[d] = in_order(np.unique(np.concatenate([pivots[d], found]), axis=0))
        offset, total = offsets()
    size, radius = np.zeros(total, np.int64), np.zeros(total)
    for r in ordered.mapInArrow(_to_cells(pivots, offset, np.ones(total, np.int64)), schema).groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).toArrow().to_pylist():  # a row a pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["gap"]
    cuts = np.maximum(1, -(-size // cell))
    plan = Plan(pivots, offset, cuts, np.cumsum(size) - size, size, radius, group, reach)
    return plan, ordered.mapInArrow(_to_cells(pivots, offset, cuts), schema)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, cell: int = CELL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept``: one row for each row of ``vectors``.

    Rows link when the cosine of their vectors is ``cosine`` or more in double precision,
    whatever their magnitude. Vectors that are null, empty or zero, or hold null or
    non-finite parts link with nothing, and none links with one of another length. Equal
    vectors link with each other; repeated rows stay and count. Two vectors are taken for
    one if their 64-bit hashes agree. A row with a null id is kept apart like a vector that
    links with nothing. Ids keep their type. Other columns are ignored whatever their
    names. An empty table gives an empty result.
    """
    python_batches(vectors.sparkSession)
    v = F.col("vector")
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    base = base.withColumn("node", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.transform(v, lambda x: x + F.lit(0.0)))))  # no negative zeros
    rows = durable(base.select("id", "node"))
    distinct = durable(base.where("node IS NOT NULL").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")))
    n = distinct.count()
    alone = rows.where("node IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    plan, dealt = _planned(distinct, n, float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))), cell)
    ordered = dealt.select((F.col("cell") * F.lit(1 << 31) + F.col("cut")).alias("block"), "cell", "cut", "dim", "node", "copies", "vector")
    units = ordered.repartition("block").sortWithinPartitions("block", "node").mapInArrow(_blocks(plan), BLOCK_ROW)
    groups = -(-n // plan.group)
    tasks = min(MOST_TASKS, groups * (groups + 1) // 2)
    found = durable(units.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(_unit_links(plan, cosine), "node long, n long, other long"))
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    named = _grouped(rows.where("node IS NOT NULL"), lambda _: found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    weights = distinct.select("node", "copies").join(counts, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return named.join(weights, "node").select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")).unionByName(alone)
