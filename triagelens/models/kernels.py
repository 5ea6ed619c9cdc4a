"""Array work done inside Spark tasks: growing trees, distances, feature maps."""

from __future__ import annotations

import heapq
import zlib

import numpy as np

EULER = 0.5772156649015329


def average_path(n):
    """Mean depth of an unsuccessful search in a random tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + EULER
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random splits until points are alone, equal, or the depth limit is met.

    Rows: (node, feature, threshold, left, right, length); feature -1 is a leaf,
    whose length is its depth plus the expected depth of what it still holds.
    """
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    rows: list[tuple] = []
    todo = [(0, points, 0)]
    size = 1
    while todo:
        node, part, depth = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(open_features):
            rows.append((node, -1, 0.0, -1, -1, float(depth + average_path(len(part)))))
            continue
        feature = int(rng.choice(open_features))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        rows.append((node, feature, threshold, size, size + 1, 0.0))
        todo += [(size, part[goes_left], depth + 1), (size + 1, part[~goes_left], depth + 1)]
        size += 2
    return rows


def mean_path(points: np.ndarray, trees: list[dict], depth: int) -> np.ndarray:
    """Mean leaf length of each point over the trees, all points level by level.

    A leaf leads to itself, so every point takes ``depth`` steps.  Points are taken some
    at a time, which stay in the processor's cache while they go through all trees.
    """
    total = np.zeros(len(points))
    # the children of a node lie side by side: right, left
    sides = [np.stack([tree["right"], tree["left"]], axis=1).ravel() for tree in trees]
    for start in range(0, len(points), 2048):
        part = np.ascontiguousarray(points[start : start + 2048])
        values, first = part.ravel(), np.arange(len(part)) * part.shape[1]
        for tree, side in zip(trees, sides):
            at = np.zeros(len(part), dtype=np.int64)
            for _ in range(depth):
                left = values.take(first + tree["feature"].take(at)) <= tree["threshold"].take(at)
                at = side.take(2 * at + left)
            total[start : start + 2048] += tree["length"].take(at)
    return total / max(len(trees), 1)


def nearest(points: np.ndarray, reference: np.ndarray, k: int, skip_self: int | None = None):
    """Distances and indices of the ``k`` nearest reference rows.

    With ``skip_self`` the points are reference rows from that index on, and a
    point is not its own neighbour.
    """
    square = (points**2).sum(axis=1)[:, None] + (reference**2).sum(axis=1)[None, :] - 2 * points @ reference.T
    if skip_self is not None:
        square[np.arange(len(points)), skip_self + np.arange(len(points))] = np.inf
    k = min(k, square.shape[1] - (skip_self is not None))
    found = np.argpartition(square, k - 1, axis=1)[:, :k]
    distance = np.sqrt(np.maximum(np.take_along_axis(square, found, axis=1), 0))
    order = np.argsort(distance, axis=1, kind="stable")
    return np.take_along_axis(distance, order, axis=1), np.take_along_axis(found, order, axis=1)


def reach_density(distance: np.ndarray, neighbour: np.ndarray, k_distance: np.ndarray) -> np.ndarray:
    reach = np.maximum(distance, k_distance[neighbour])
    return 1.0 / (reach.mean(axis=1) + 1e-10)


def outlier_factor(points: np.ndarray, reference: np.ndarray, k: int, k_distance, density) -> np.ndarray:
    distance, neighbour = nearest(points, reference, k)
    return density[neighbour].mean(axis=1) / reach_density(distance, neighbour, k_distance)


def fourier_map(points: np.ndarray, weights: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phase)) * np.cos(points @ weights + phase)


def nearer(best, limit, rows, points, ids, others, other_ids, copies, k: int) -> np.ndarray:
    """Takes those of ``others`` that are among the ``k`` nearest of the points at ``rows`` into ``best``:
    distances, ids and copies of the nearest so far, nearest first, of equal distances the smaller id.

    ``limit`` says how far each point looks.  A point does not count itself: the row of its id
    has one copy less.  The product of matrices only picks rows, with room for its rounding;
    distances are taken from the differences, so equal rows are at 0.  Gives the points
    for which something was found.
    """
    centre = others.mean(axis=0)
    a, b = points[rows] - centre, others - centre
    far, size = (a**2).sum(axis=1), (b**2).sum(axis=1)
    square = far[:, None] + size[None, :] - 2 * a @ b.T
    bound = limit[rows] ** 2
    if len(others) > k + 1:  # the row itself may be one of them
        wide = np.flatnonzero(np.isinf(bound))
        bound[wide] = np.partition(square[wide], k, axis=1)[:, k]
    at, other = np.nonzero(square <= (bound * (1 + 1e-9) + 1e-9 + 1e-12 * (far + size.max()))[:, None])
    row = rows[at]
    distance = np.sqrt(((points[row] - others[other]) ** 2).sum(axis=1))
    taken = copies[other] - (ids[row] == other_ids[other])
    held = (taken > 0) & (distance <= limit[row])
    row, other, distance, taken = row[held], other[held], distance[held], taken[held]
    found = np.unique(row)
    if not len(found):
        return found
    parts = [np.concatenate([old[found].ravel(), new]) for old, new in zip(best, (distance, other_ids[other], taken))]
    row = np.concatenate([np.repeat(found, k), row])
    order = np.lexsort((parts[1], parts[0], row))
    row = row[order]
    first = order[np.arange(len(row)) - np.searchsorted(row, row) < k]  # k of every point, as it held so many
    for old, new in zip(best, parts):
        old[found] = new[first].reshape(-1, k)
    return found


def reach_of(best, k: int) -> np.ndarray:
    """How far the ``k`` nearest rows known so far reach, copies counted; infinite if there are fewer."""
    distance, _, copies = best
    held = np.cumsum(np.where(np.isfinite(distance), copies, 0), axis=1)
    enough = held >= k
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
    return np.where(enough.any(axis=1), distance[np.arange(len(distance)), at], np.inf)


def neighbour_rows(ids: np.ndarray, best, k: int) -> dict[str, np.ndarray]:
    """The ``k`` nearest of each point as rows, copies counted: which is the last, and how far it is, in every row."""
    distance, neighbours, copies = best
    before = np.cumsum(copies, axis=1) - copies
    times = np.where(np.isfinite(distance), np.clip(k - before, 0, copies), 0)
    row, column = np.nonzero(times)
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    place = np.flatnonzero(last)
    reach = np.repeat(distance[row[place], column[place]], np.diff(place, prepend=-1))
    return {
        "point": ids[row], "neighbour": neighbours[row, column], "distance": distance[row, column], "times": times[row, column],
        "last": last, "k_distance": reach,
    }


def pack(ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> bytes:
    """Ids, copies and vectors of a block as one text of bytes, the vectors dimension by dimension."""
    parts = np.asarray(ids, np.int64), np.asarray(copies, np.int64), np.ascontiguousarray(vectors.T, dtype=float)
    return zlib.compress(b"".join(x.tobytes() for x in parts), 1)


def unpack(packed: bytes, n: int):
    """What ``pack`` was given, for a block of ``n`` points."""
    data = zlib.decompress(packed)
    ids, copies = np.frombuffer(data, np.int64, 2 * n).reshape(2, n)
    return ids, copies, np.ascontiguousarray(np.frombuffer(data, float, offset=16 * n).reshape(-1, n).T)


def matrix(vectors) -> np.ndarray:
    """Rows of an Arrow list column, all of the same length."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def parted(points: np.ndarray):
    """A plane between two clusters of the points: rows with ``row @ normal <= at`` are on its first side.

    Two means, begun on both sides of the mean across the longest direction, of 1,024 rows at most.
    """
    part = np.nan_to_num(points[:: -(-len(points) // 1024)])
    centred = part - part.mean(axis=0)
    normal = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    at = float(part.mean(axis=0) @ normal)
    for _ in range(6):
        side = part @ normal <= at
        if side.all() or not side.any():
            break
        first, second = part[side].mean(axis=0), part[~side].mean(axis=0)
        normal, at = second - first, float((second - first) @ (second + first)) / 2
    return normal, at


def sides(points: np.ndarray, spare: int):
    """The first side of a plane between two clusters, and the plane.

    A side may have less than an eighth of the rows as long as there are ``spare`` such cuts, which
    part far rows from others; without, the plane is moved to the middle row.
    """
    normal, at = parted(points)
    key = points @ normal
    side = key <= at
    if not 0 < side.sum() < len(side) or (uneven(side) and spare <= 0):
        at = float(np.median(key))
        side = key <= at
    return side, normal, at, key


def uneven(side: np.ndarray) -> bool:
    return not len(side) <= 8 * side.sum() <= 7 * len(side)


def grow_cells(sample: np.ndarray, cells: int) -> dict[str, np.ndarray]:
    """A tree of planes that cut space into ``cells`` cells, the fullest cell of the sample first.

    A child below 0 is a cell, numbered from -1 down so that neighbouring cells have neighbouring numbers.
    """
    nodes = [[np.zeros(sample.shape[1]), 0.0, -1, -1]]  # one that has no plane leads to cell 0
    heap, done, number, spare = [(-len(sample), 0, None, sample)], [], 0, cells // 4
    while heap and len(heap) + len(done) < cells:
        _, _, link, part = heapq.heappop(heap)
        side, normal, at, _ = sides(part, spare)
        spare -= uneven(side)
        if side.all() or not side.any():
            done.append(link)
            continue
        if link is None:
            node, nodes[0] = 0, [normal, at, -1, -1]
        else:
            node = len(nodes)
            nodes.append([normal, at, -1, -1])
            nodes[link[0]][link[1]] = node
        for child, rows in ((2, part[side]), (3, part[~side])):
            number += 1
            heapq.heappush(heap, (-len(rows), number, (node, child), rows))
    todo, cell = [(0, 3), (0, 2)], 0
    if len(nodes) == 1 and not nodes[0][0].any():
        todo = []
    while todo:
        node, child = todo.pop()
        if nodes[node][child] < 0:
            nodes[node][child] = -1 - cell
            cell += 1
        else:
            todo += [(nodes[node][child], 3), (nodes[node][child], 2)]
    normal, at, left, right = zip(*nodes)
    return {"normal": np.array(normal), "at": np.array(at), "left": np.array(left), "right": np.array(right)}


def cell_of(points: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Number of the cell that each row lies in."""
    at = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    while len(rows):
        node = at[rows]
        left = np.einsum("ij,ij->i", points[rows], tree["normal"][node]) <= tree["at"][node]
        at[rows] = np.where(left, tree["left"][node], tree["right"][node])
        rows = rows[at[rows] >= 0]
    return -1 - at


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of the points in leaves of ``size`` at most, neighbouring leaves one after another.

    Rows that are far from all others of a leaf, which would make its box wide, are cut off, as
    often as there are twice as many leaves as full ones.
    """
    done, todo, spare = [], [np.arange(len(points))], 2 * -(-len(points) // size)
    while todo:
        rows = todo.pop()
        part = points[rows]
        if len(rows) <= size and (len(rows) < 8 or spare <= 0):
            done.append(rows)
            continue
        side, _, _, key = sides(part, spare)
        if len(rows) <= size:
            most = part[side if 2 * side.sum() >= len(side) else ~side]
            if not uneven(side) or 2 * diagonal(most) >= diagonal(part):
                done.append(rows)
                continue
        elif uneven(side) and spare <= 0:  # many equal keys
            side = np.zeros(len(rows), bool)
            side[np.argsort(key, kind="stable")[: len(rows) // 2]] = True
        if side.all() or not side.any():
            side = np.arange(len(rows)) < len(rows) // 2
        spare -= uneven(side)
        todo += [rows[~side], rows[side]]
    return done


def diagonal(points: np.ndarray) -> float:
    return float(np.sqrt(((points.max(axis=0) - points.min(axis=0)) ** 2).sum()))


def gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far each point is from a box."""
    away = points - points.clip(low, high)
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def gap_of_boxes(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """How far a box is from each of several."""
    return np.sqrt((np.maximum(np.maximum(lows - high, low - highs), 0) ** 2).sum(axis=1))


def box_reach(points: np.ndarray, lows: np.ndarray, highs: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """A bound for the distance to the ``k``-th row from boxes alone: so many rows lie in those
    whose far corners are nearest.  ``k`` has one to spare for the row itself."""
    reach = np.full(len(points), np.inf)
    for i, point in enumerate(points):
        far = np.sqrt((np.maximum(np.abs(point - lows), np.abs(highs - point)) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        enough = np.cumsum(count[order]) > k
        if enough.any():
            reach[i] = far[order[enough.argmax()]]
    return reach


def boxes_within(points: np.ndarray, reach: np.ndarray, cells: dict[str, np.ndarray], boxes: dict[str, np.ndarray]):
    """Places and least distances of the boxes that may hold rows within ``reach`` of a point; those of
    a cell lie one after another, from ``start`` to ``end``, and only near cells are looked into."""
    limit = reach * (1 + 1e-9) + 1e-9
    low, high, most = points.min(axis=0), points.max(axis=0), limit.max()
    near = np.flatnonzero(gap_of_boxes(low, high, cells["low"], cells["high"]) <= most)
    at = np.concatenate([np.arange(cells["start"][c], cells["end"][c]) for c in near] or [np.zeros(0, int)])
    at = at[gap_of_boxes(low, high, boxes["low"][at], boxes["high"][at]) <= most]
    held, least = [], []
    for place in at:
        away = gap(points, boxes["low"][place], boxes["high"][place])
        within = away <= limit
        if within.any():
            held.append(int(place))
            least.append(float(away[within].min()))
    return held, least


def add_to_bins(mapped: np.ndarray, projected: np.ndarray, reach: float, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds every row to the count and the sum of its bin; bins cut the span from -reach to reach."""
    bins = np.clip(((projected + reach) / (2 * reach) * len(counts)).astype(int), 0, len(counts) - 1)
    order = np.argsort(bins, kind="stable")
    held, starts = np.unique(bins[order], return_index=True)
    counts += np.bincount(bins, minlength=len(counts))
    sums[held] += np.add.reduceat(mapped[order], starts, axis=0)


def mean_of_lowest(counts: np.ndarray, sums: np.ndarray, share: float) -> np.ndarray:
    """Mean over the lowest ``share`` of rows, from counts and sums of ascending bins."""
    wanted = share * counts.sum()
    before = np.cumsum(counts) - counts
    taken = np.clip(wanted - before, 0, counts)
    return (taken / counts) @ sums / wanted
