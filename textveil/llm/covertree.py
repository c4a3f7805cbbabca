"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length 1, where a cosine of ``threshold`` is a distance ``tau``.  A top
level of centres, fitted on a bounded sample, parts all rows into cells whose covering radius is
measured on every row.  Cells in tree order fill blocks of bounded size; two blocks are never
compared if all their cells lie further apart than their radii and ``tau``.  In each block one
cover tree is built, once: nested nets with halving radii and measured covering radii.  Each
remaining pair of blocks is one task, which goes down both trees at once: a pair of nodes is
dropped if its bound says that no pair of members links, counted whole if the bound says that all
do, and else gives way to the pairs of its children.  Centres are compared in single precision on
the first principal axes, which never overstates a distance; what that leaves is decided in
double precision.  Tasks give counts of links and a spanning forest, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, sized, stored
from .components import connected_components
from .hashing import ranges

#: Least and largest number of rows of a block, rows that fit the top level, and centres of it.
LEAST, BLOCK, SAMPLE, MAX_CELLS = 1024, 32_768, 8192, 1024
#: Radii of the nets, each half of the one before.
RADII = [2.0, 1.0, 0.5, 0.25, 0.125]
#: Pairs of nodes of up to LEAF * LEAF pairs of members are compared member by member.
LEAF = 8
#: Nodes a side of the pairs that are bounded at once, and pairs that are checked at once.
TILE, PAIRS = 1024, 65_536
#: What rounding may add to a squared distance in single precision, and to a distance in double precision.
SLACK32, SLACK = 1e-4, 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, one by one."""
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true values of a matrix."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the centre nearest to each point, and its distance; tile by tile."""
    best, value = np.zeros(len(points), np.int64), np.full(len(points), -9.0, np.float32)
    for low in range(0, len(points), 4 * TILE):
        for left in range(0, len(centers), TILE):
            m = points[low : low + 4 * TILE] @ centers[left : left + TILE].T
            k = m.argmax(axis=1)
            v = m[np.arange(len(m)), k]
            better = v > value[low : low + len(m)]
            best[low : low + len(m)][better], value[low : low + len(m)][better] = k[better] + left, v[better]
    return best, np.sqrt(np.maximum(2 - 2 * value, 0))


def greedy_net(points: np.ndarray, radius: float, most: int | None = None) -> np.ndarray:
    """Positions of points of which no two are within ``radius`` and which cover the others (if ``most`` allows)."""
    cosine = np.float32(1 - radius * radius / 2)
    out: list[int] = []
    todo = np.arange(len(points))
    while len(todo) and (most is None or len(out) < most):
        head, rest = todo[:512], todo[512:]
        near = points[head] @ points[head].T >= cosine
        free, new = np.ones(len(head), bool), []
        for i in range(len(head)):
            if free[i]:
                new.append(i)
                free &= ~near[i]
        out += head[new].tolist()
        if len(rest):
            rest = np.concatenate([r[~(points[r] @ points[head[new]].T >= cosine).any(axis=1)] for r in np.array_split(rest, -(-len(rest) // (8 * TILE)))])
        todo = rest
    return np.array(out[:most], np.int64)


class CoverTree:
    """Nested nets over unit vectors: ``paths[i]`` are the centres of point i, from the root to the finest net.

    Points are put in tree order, so that every node is a run of points and of nodes below it.
    ``levels`` has for each net, in that order: centres, first member (and one more entry), first
    child (likewise) and covering radii measured on all members.
    """

    def __init__(self, points: np.ndarray, paths: np.ndarray | None = None):
        self.paths = self._build(points) if paths is None else paths
        self.order = np.lexsort(self.paths.T[::-1])
        place = np.empty(len(points), np.int64)
        place[self.order] = np.arange(len(points))
        self.points, ranked = points[self.order], self.paths[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        firsts = []
        new = np.zeros(len(points), bool)
        new[0] = True
        for k in range(ranked.shape[1]):
            new[1:] |= ranked[1:, k] != ranked[:-1, k]
            firsts.append(np.flatnonzero(new))
        # Below the finest net every point is a node of its own.
        firsts.append(np.arange(len(points)))
        for k, first in enumerate(firsts):
            center = place[ranked[first, k]] if k < ranked.shape[1] else first
            size = np.diff(np.append(first, len(points)))
            reach = np.maximum.reduceat(_gap(self.points, self.points[np.repeat(center, size)]), first)
            child = np.append(np.searchsorted(firsts[k + 1], first), len(firsts[k + 1])) if k + 1 < len(firsts) else first
            self.levels.append((center, np.append(first, len(points)), child, reach))

    @staticmethod
    def _build(points: np.ndarray) -> np.ndarray:
        x = points.astype(np.float32)
        paths = np.zeros((len(x), len(RADII)), np.int64)
        centers, own, gap = np.zeros(1, np.int64), np.zeros(len(x), np.int64), np.sqrt(np.maximum(2 - 2 * (x @ x[0]), 0))
        for k, radius in enumerate(RADII[1:], 1):
            # What the centre above doesn't cover, another may; what none covers gets new ones.
            far = np.flatnonzero(gap > radius)
            if len(far):
                if len(centers) > 1:
                    near, d = _nearest(x[far], x[centers])
                    hit = d <= radius
                    own[far[hit]], gap[far[hit]], far = centers[near[hit]], d[hit], far[~hit]
                new = far[greedy_net(x[far], radius)] if len(far) else far
                if len(new):
                    near, d = _nearest(x[far], x[new])
                    own[far], gap[far] = new[near], d
                    own[new], gap[new] = new, 0
                    centers = np.append(centers, new)
            paths[:, k] = own
        # The path of a point is that of its finest centre, so that the nets nest.
        for k in range(len(RADII) - 2, 0, -1):
            paths[:, k] = paths[paths[:, k + 1], k]
        return paths


class _Links:
    """Links of each point so far (copies counted), and labels that join what is linked."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.count, self.label = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.copies[j])
        np.add.at(self.count, j, self.copies[i])
        self.join(i, j)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.label[i], self.label[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def join_hits(self, p: np.ndarray, q: np.ndarray, hit: np.ndarray) -> None:
        """Join p[i] and q[j] wherever ``hit``: the first of each row and column, then what still lies apart."""
        rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        self.join(p[rows], q[hit[rows].argmax(axis=1)])
        self.join(p[hit[:, columns].argmax(axis=0)], q[columns])
        x, y = self.label[p[rows]], self.label[q[columns]]
        if x.min() != x.max() or y.min() != y.max() or x[0] != y[0]:
            i, j = np.nonzero(hit)
            self.join(p[i], q[j])

    def all_of(self, a: slice, b: slice) -> None:
        """Every point of one run with every point of the other; the same run: among themselves."""
        if a == b:
            self.count[a] += self.copies[a].sum() - self.copies[a]
        else:
            self.count[a] += self.copies[b].sum()
            self.count[b] += self.copies[a].sum()
        ends = np.r_[a, b]
        self.join(ends[:-1], ends[1:])


def dual_traversal(a: CoverTree, b: CoverTree | None, axes: np.ndarray, threshold: float, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each point of both trees, in tree order, and a label of what is joined; ``b`` None: within ``a``.

    ``axes``: rotation whose first columns bound distances from below.  ``copies`` in tree order.
    """
    own, shift = b is None, 0 if b is None else len(a.points)
    b = a if own else b
    tau = math.sqrt(2 - 2 * threshold)
    links = _Links(copies)
    pre = [(t.points @ axes).astype(np.float32) for t in (a, b)]

    def decide(p: np.ndarray, q: np.ndarray, near: np.ndarray) -> None:
        """Points p against points q where ``near`` says so, in double precision."""
        if np.count_nonzero(near) * 16 > near.size:
            hit = near & (a.points[p] @ b.points[q].T >= threshold)
            if not hit.any():
                return
            ones = hit.astype(float)
            links.count[p] += (ones @ copies[q + shift]).astype(np.int64)
            links.count[q + shift] += (copies[p] @ ones).astype(np.int64)
            links.join_hits(p, q + shift, hit)
            return
        i, j = _places(near)
        check(p[i], q[j])

    def check(i: np.ndarray, j: np.ndarray) -> None:
        for low in range(0, len(i), PAIRS):
            x, y = i[low : low + PAIRS], j[low : low + PAIRS]
            ok = np.einsum("ij,ij->i", a.points[x], b.points[y]) >= threshold
            if ok.any():
                links.pairs(x[ok], y[ok] + shift)

    def visit(level: int, x: np.ndarray, y: np.ndarray, same: bool) -> None:
        """Pairs of nodes x of a and y of b; ``same``: x and y are the same nodes of one tree."""
        for low in range(0, len(x), TILE):
            for left in range(low if same else 0, len(y), TILE):
                tile(level, x[low : low + TILE], y[left : left + TILE], same and low == left)

    def bounded(x: np.ndarray, y: np.ndarray, s: np.ndarray | float, t: np.ndarray | float) -> np.ndarray:
        """Where (s + t)^2 is no less than the squared distance of x and y on the first axes: one product."""
        u, w, one = pre[0][x], pre[1][y], np.ones
        left = np.column_stack([2 * u, s * s - np.einsum("ij,ij->i", u, u), s * one(len(x)), one(len(x))]).astype(np.float32)
        right = np.column_stack([w, one(len(y)), 2 * t * one(len(y)), t * t - np.einsum("ij,ij->i", w, w)]).astype(np.float32)
        return left @ right.T >= -SLACK32

    def tile(level: int, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        ca, fa, ka, ra = a.levels[level]
        cb, fb, kb, rb = b.levels[level]
        near = bounded(ca[p], cb[q], ra[p] + tau, rb[q])
        if not near.any():
            return
        na, nb = fa[p + 1] - fa[p], fb[q + 1] - fb[q]
        one, other = na == 1, nb == 1
        if same:
            near = np.triu(near, 1)
            within(level, p[~one])
        # Nodes of one point each need no tree.
        alone = np.logical_and.outer(one, other)
        decide(ca[p], cb[q], near & alone)
        near &= ~alone
        big = near & (np.multiply.outer(na, nb) > LEAF * LEAF) if na.max() * nb.max() > LEAF * LEAF else np.zeros((1, 1), bool)
        i, j = _places(big)
        for k in range(0, len(i), PAIRS):
            m, n = p[i[k : k + PAIRS]], q[j[k : k + PAIRS]]
            d, r = _gap(a.points[ca[m]], b.points[cb[n]]), ra[m] + rb[n]
            every = d + r <= tau - SLACK
            for x, y in zip(m[every].tolist(), n[every].tolist(), strict=True):
                links.all_of(slice(fa[x], fa[x + 1]), slice(fb[y] + shift, fb[y + 1] + shift))
            some = ~every & (d <= r + tau + SLACK)
            for x, y in zip(m[some].tolist(), n[some].tolist(), strict=True):
                visit(level + 1, np.arange(ka[x], ka[x + 1]), np.arange(kb[y], kb[y + 1]), False)
        small = near & ~big
        if not small.any():
            return
        rows, columns = np.flatnonzero(small.any(axis=1)), np.flatnonzero(small.any(axis=0))
        if np.count_nonzero(small) * 64 > small.size:
            # Members of small nodes, by the bound for points.
            x, y = ranges(fa[p[rows]], na[rows]), ranges(fb[q[columns]], nb[columns])
            ox, oy = np.repeat(rows, na[rows]), np.repeat(columns, nb[columns])
            for low in range(0, len(x), TILE):
                for left in range(0, len(y), TILE):
                    u, w = slice(low, low + TILE), slice(left, left + TILE)
                    decide(x[u], y[w], bounded(x[u], y[w], tau, np.zeros(1)) & small[np.ix_(ox[u], oy[w])])
            return
        i, j = _places(small)
        for k in range(0, len(i), PAIRS // LEAF):
            m, n = i[k : k + PAIRS // LEAF], j[k : k + PAIRS // LEAF]
            f = ranges(np.zeros(len(m), np.int64), na[m] * nb[n])
            pair = np.repeat(np.arange(len(m)), na[m] * nb[n])
            check(fa[p[m]][pair] + f // nb[n][pair], fb[q[n]][pair] + f % nb[n][pair])

    def within(level: int, nodes: np.ndarray) -> None:
        """Pairs inside each of these nodes."""
        _, first, child, reach = a.levels[level]
        for m in nodes.tolist():
            if 2 * reach[m] <= tau - SLACK:
                links.all_of(slice(first[m], first[m + 1]), slice(first[m], first[m + 1]))
            elif first[m + 1] - first[m] <= LEAF:
                x, y = np.triu_indices(first[m + 1] - first[m], 1)
                check(first[m] + x, first[m] + y)
            else:
                visit(level + 1, np.arange(child[m], child[m + 1]), np.arange(child[m], child[m + 1]), True)

    visit(0, np.arange(1), np.arange(1), own)
    return links.count, links.label


def _vectors(column: pd.Series) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1))


def _plant(pdf: pd.DataFrame) -> pd.DataFrame:
    """Builds the tree of a block: its rows in tree order, each with the places of its centres."""
    tree = CoverTree(_vectors(pdf["v"]))
    out = pdf.iloc[tree.order].drop(columns=["h1", "h2"])
    place = np.empty(len(pdf), np.int32)
    place[tree.order] = np.arange(len(pdf), dtype=np.int32)
    return out.assign(place=np.arange(len(pdf), dtype=np.int32), path=list(place[tree.paths[tree.order]]))[["block", "place", "node", "copies", "v", "path"]]


def _job(threshold: float, axes: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [g.sort_values("place") for _, g in pdf.groupby("block")]
        if len(sides) == 1 and pdf["pair"].iloc[0]:
            return pd.DataFrame({"a": [], "b": [], "kind": []}).astype("int64")
        trees = [CoverTree(_vectors(g["v"]), np.stack(g["path"].to_numpy()).astype(np.int64)) for g in sides]
        whole = pd.concat([g.iloc[t.order] for g, t in zip(sides, trees, strict=True)])
        # Vectors of another dimension than the sample's are compared as they are.
        turn = axes if len(axes) == trees[0].points.shape[1] else np.eye(trees[0].points.shape[1])
        count, label = dual_traversal(trees[0], trees[1] if len(trees) > 1 else None, turn, threshold, whole["copies"].to_numpy())
        ids, hit, joined = whole["node"].to_numpy(), np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
        return pd.concat([pd.DataFrame({"a": ids[hit], "b": count[hit], "kind": 0}), pd.DataFrame({"a": ids[joined], "b": ids[label[joined]], "kind": 1})]).astype("int64")

    return run


def top_level(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` centres of the sample, in tree order: nested greedy nets with halving radii, the last cut short."""
    x = sample.astype(np.float32)
    centers, path = np.zeros(1, np.int64), np.zeros((1, 0), np.int64)
    for radius in RADII[1:]:
        _, gap = _nearest(x, x[centers])
        far = np.flatnonzero(gap > radius)
        new = far[greedy_net(x[far], radius, most - len(centers))] if len(far) and len(centers) < most else far[:0]
        up = _nearest(x[new], x[centers])[0] if len(new) else new
        path = np.column_stack([np.concatenate([path, path[up]]), np.arange(len(path) + len(new)), np.concatenate([np.arange(len(path)), up])])[:, [*range(path.shape[1]), path.shape[1] + 1]]
        centers = np.append(centers, new)
    return sample[centers[np.lexsort(np.column_stack([path, np.arange(len(path))]).T[::-1])]]


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their cosine in double precision is ``threshold`` or more (over 0).  Null or
    empty ones, those of length zero and those with null or non-finite components link with
    nothing, nor do vectors of different dimensions.  Equal vectors are compared once and counted
    as many times as they occur.  ``component_id`` is the smallest id that links lead to.  Rows
    that repeat an id are rows of their own; a null id takes part in the links of others; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, *dict.fromkeys([vec_id, embedding]))
    rows = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    # Two hashes together name a vector.
    rows = rows.withColumn("good", good).withColumns({"h1": F.when(F.col("good"), F.xxhash64("v")), "h2": F.when(F.col("good"), F.xxhash64(F.lit(9), "v"))})
    classes = rows.where("good").groupBy("h1", "h2", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "v", "copies", "first_id", F.size("v").alias("dim")), "vectors")
    n = classes.count()
    top = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = top.dim if top else 0
    share = min(1.0, SAMPLE / max(n, 1))
    fitted = classes.where((F.col("dim") == dim) & (F.pmod("h2", F.lit(1 << 20)) < int(math.ceil(share * (1 << 20))))).orderBy("h1", "h2").select("v").toPandas()["v"]
    # Blocks: enough of them that their pairs keep all cores busy, of a size that a task holds.
    block = min(BLOCK, max(LEAST, -(-n // (2 + math.isqrt(2 * spark.sparkContext.defaultParallelism)))))
    center, axes = np.zeros((0, dim)), np.zeros((0, 0))
    if len(fitted):
        sample = unit(np.stack(fitted.to_numpy()).astype(np.float64))
        center = top_level(sample, max(1, min(MAX_CELLS, n // 64)))
        axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, : min(dim, max(32, dim // 4))]

    @F.pandas_udf("cell int, gap double, bytes binary")
    def place(v: pd.Series) -> pd.DataFrame:
        cell, gap = np.full(len(v), -1, np.int32), np.zeros(len(v))
        at = np.flatnonzero(v.map(len).to_numpy() == dim)
        if len(at) and len(center):
            x = unit(np.stack(v.to_numpy()[at]))
            cell[at] = _nearest(x.astype(np.float32), center.astype(np.float32))[0]
            gap[at] = _gap(x, center[cell[at]])
        return pd.DataFrame({"cell": cell, "gap": gap, "bytes": [x.astype(np.float64).tobytes() for x in v]})

    # Vectors of other dimensions are cells of their own, by dimension, that nothing bounds.
    placed = classes.withColumn("p", place("v")).select("node", "h1", "h2", "copies", F.when(F.col("p.cell") < 0, -F.col("dim")).otherwise(F.col("p.cell")).alias("cell"), "p.gap", F.col("p.bytes").alias("v"))
    placed = stored(placed, "cells")
    # At most MAX_CELLS cells and one for each other dimension come to the driver; cells in tree order fill blocks.
    about = sorted(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect(), key=lambda r: r.cell)
    first, parts, members, used, blocks = [], [], [], block, 0
    for r in about:
        many = -(-r.n // block)
        if many > 1 or r.cell < 0 or used + r.n > block or (members and members[-1][0] < 0):
            first.append(blocks)
            blocks += many
            used = r.n if many == 1 and r.cell >= 0 else block
        else:
            first.append(blocks - 1)
            used += r.n
        parts.append(many)
        members.append((r.cell, r.r))
    cells = np.array([m[0] for m in members], np.int64)
    tau = math.sqrt(2 - 2 * threshold)
    near = np.zeros((len(cells), len(cells)), bool)
    main = np.flatnonzero(cells >= 0)
    if len(main):
        c, reach = center[cells[main]], np.array([members[k][1] for k in main])
        near[np.ix_(main, main)] = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) <= reach[:, None] + reach[None, :] + tau + 1e-6
    np.fill_diagonal(near, True)
    met = sorted({(min(i, j), max(i, j)) for x, y in zip(*np.nonzero(near), strict=True) for i in range(first[x], first[x] + parts[x]) for j in range(first[y], first[y] + parts[y])})
    seats = spark.createDataFrame([(int(x), f, p) for x, f, p in zip(cells, first, parts, strict=True)], "cell int, first int, parts int")
    ends = spark.createDataFrame([(i, k, i != j) for k, (i, j) in enumerate(met)] + [(j, k, True) for k, (i, j) in enumerate(met) if i != j], "block int, job int, pair boolean")
    blocked = placed.join(F.broadcast(seats), "cell").select("h1", "h2", "node", "copies", "v", (F.col("first") + F.pmod(F.xxhash64("h1", F.lit(9)), F.col("parts"))).cast("int").alias("block"))
    trees = blocked.groupBy("block").applyInPandas(_plant, "block int, place int, node bigint, copies bigint, v binary, path array<int>")
    jobs = stored(trees, "trees").join(sized(ends), "block").repartition(max(1, min(4 * len(met), 20_000)), "job")
    found = stored(jobs.groupBy("job").applyInPandas(_job(threshold, axes), "a bigint, b bigint, kind bigint"), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    parts_ = connected_components(found.where("kind = 1").select("a", "b"))
    whole = classes.select("node", "h1", "h2", "copies", "first_id").join(parts_, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    smallest = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    whole = whole.join(smallest, "component").select("h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "h1", "h2").join(whole, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
