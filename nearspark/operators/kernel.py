"""Exact nearest rows of one query block within one reference block (numpy, runs inside Spark tasks).

Both blocks are bounded by the caller. The reference block is arranged into small leaves with bounding boxes, so
most leaves are never looked at when the data has few dimensions. Skipping a leaf is exact, not approximate: a gap
to a box is rounded the same way as a difference to a row inside it and both are summed in the same order, so the
bound can never exceed the distance it stands for.

Where one axis keeps rows apart, a query's neighbours stand next to it in the order of that axis: it is compared with a
strip of rows there first, and is done if the rows next to the strip are too far along that axis alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF_ROWS = 256
TILE_LEAVES = 8
RUN_ROWS = 2048  # rows of wanted blocks that are compared at once, with so many queries:
CHUNK_ROWS_BLOCKS = 512
STEP_ROWS = 4096  # rows that are moved to single precision at once
DIRECT_DIMS = 8  # up to here distances are summed directly; beyond, a matrix product screens the pairs first
# queries handled together: few where they are far apart, many where the matrix product does the work
CHUNK_ROWS_SPARSE, CHUNK_ROWS_DENSE, CHUNK_ROWS_WIDE = 32, 128, 256
STRIPS = (32, 128)  # rows of a strip, at least 4 k; the next one only where the last one was enough for most queries
STRIP_PAIRS = 1 << 16  # pairs that are compared at once

NO_ID = np.iinfo(np.int64).max


@dataclass
class Shelf:
    """Reference rows ordered by leaf, with one box per leaf."""

    x: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    norms: np.ndarray
    strips: tuple | None = None  # the widest axis, and columns and ids in its order; made on first use


@dataclass
class Best:
    """The k nearest rows found so far for every query, nearest first; unused slots hold an infinite distance."""

    dist: np.ndarray
    ids: np.ndarray
    codes: np.ndarray

    @classmethod
    def empty(cls, rows: int, k: int) -> Best:
        return cls(np.full((rows, k), np.inf), np.full((rows, k), NO_ID), np.zeros((rows, k), dtype=np.int64))


def squared_sum(diff: np.ndarray) -> np.ndarray:
    """Sum of squares over the last axis, added left to right as the SQL expression does."""
    total = np.zeros(diff.shape[:-1])
    for j in range(diff.shape[-1]):
        total += diff[..., j] * diff[..., j]
    return total


def leaf_order(x: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Order rows so that runs of at most ``leaf_rows`` are close together; return the order and the run starts."""
    order = np.arange(len(x))
    starts = []
    pending = [(0, len(x))]
    while pending:
        a, b = pending.pop()
        if b - a <= leaf_rows:
            starts.append(a)
            continue
        part = x[order[a:b]]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
        pending += [(a + half, b), (a, a + half)]
    return order, np.array(sorted(starts) + [len(x)])


def build_shelf(x: np.ndarray, ids: np.ndarray, codes: np.ndarray | None = None) -> Shelf:
    codes = np.zeros(len(ids), dtype=np.int64) if codes is None else codes
    if len(x) == 0:
        none = np.empty((0, x.shape[1]))
        return Shelf(x, ids, codes, np.array([0]), none, none, np.empty(0))
    order, starts = leaf_order(x, LEAF_ROWS)
    x = np.ascontiguousarray(x[order])
    lo = np.minimum.reduceat(x, starts[:-1], axis=0)
    hi = np.maximum.reduceat(x, starts[:-1], axis=0)
    return Shelf(x, ids[order], codes[order], starts, lo, hi, squared_sum(x))


def find_nearest(
    x: np.ndarray,
    qids: np.ndarray,
    shelf: Shelf,
    k: int,
    skip_self: bool = False,
    best: Best | None = None,
    within: np.ndarray | None = None,
) -> Best:
    """Update ``best`` with the rows of ``shelf``; ``within`` is a known upper bound of the k-th distance per query."""
    fresh = best is None
    best = Best.empty(len(x), k) if fresh else best
    if len(x) == 0 or len(shelf.ids) == 0:
        return best
    within = np.full(len(x), np.inf) if within is None else within
    if fresh and x.shape[1] <= DIRECT_DIMS:
        rest, within = _search_strips(x, qids, shelf, k, skip_self, best, within)
    else:
        rest = np.arange(len(x))
    if not len(rest):
        return best
    dense = CHUNK_ROWS_DENSE if 4 * len(rest) >= len(shelf.ids) else CHUNK_ROWS_SPARSE
    order, starts = leaf_order(x[rest], dense if x.shape[1] <= DIRECT_DIMS else CHUNK_ROWS_WIDE)
    for a, b in zip(starts[:-1], starts[1:]):
        chunk = rest[order[a:b]]
        q_lo, q_hi = x[chunk].min(axis=0), x[chunk].max(axis=0)
        near = squared_sum(np.maximum(np.maximum(shelf.lo - q_hi, q_lo - shelf.hi), 0.0))
        visit = np.argsort(near, kind="stable")
        at, width = 0, 1
        while at < len(visit):
            limit = np.minimum(best.dist[chunk, -1], within[chunk])
            leaves = visit[at : at + width]
            leaves = leaves[near[leaves] <= limit.max()]
            if len(leaves) == 0:
                break
            rows = chunk[limit >= near[leaves[0]]]
            cols = np.concatenate([np.arange(shelf.starts[i], shelf.starts[i + 1]) for i in leaves])
            _scan_tile(x, qids, shelf, rows, cols, k, skip_self, best, within)
            at, width = at + width, min(2 * width, TILE_LEAVES)
    return best


def _search_strips(x, qids, shelf: Shelf, k: int, skip_self: bool, best: Best, within: np.ndarray):
    """Put the lists of all queries that a strip is enough for into ``best``; return the others, and bounds of the k-th distance.

    A row outside the strip is at least as far as the one next to it along the axis, and sums of squares are rounded alike.
    """
    if shelf.strips is None:
        axis = int(np.argmax(shelf.x.max(axis=0) - shelf.x.min(axis=0)))
        order = np.argsort(shelf.x[:, axis], kind="stable")
        shelf.strips = axis, np.ascontiguousarray(shelf.x[order].T), shelf.ids[order], shelf.codes[order]
    axis, columns, ids, codes = shelf.strips
    n, within = len(ids), within.copy()
    ends = np.concatenate([[-np.inf], columns[axis], [np.inf]])
    rest = np.argsort(x[:, axis], kind="stable")
    for width in STRIPS:
        width = min(n, max(width, 4 * k))
        views = [np.lib.stride_tricks.sliding_window_view(c, width) for c in (*columns, ids)]
        left, step = [rest[:0]], max(1, STRIP_PAIRS // width)
        for a in range(0, len(rest), step):
            rows = rest[a : a + step]
            at = x[rows, axis]
            first = np.clip(np.searchsorted(columns[axis], at) - width // 2, 0, n - width)
            dist = np.zeros((len(rows), width))
            for j, view in enumerate(views[:-1]):
                diff = x[rows, j, None] - view[first]
                diff *= diff
                dist += diff
            own = views[-1][first] == qids[rows, None] if skip_self else None
            seen = np.where(own, np.inf, dist) if skip_self else dist
            kth = np.partition(seen, k - 1, axis=1)[:, k - 1] if width >= k else np.full(len(rows), np.inf)
            within[rows] = limit = np.minimum(within[rows], kth)
            gap = np.minimum(at - ends[first], ends[first + width + 1] - at)
            done = (gap * gap > limit) | (width == n)
            hit = (dist <= limit[:, None]) & done[:, None]
            if skip_self:
                hit &= ~own
            r, c = np.divmod(np.flatnonzero(hit), width)
            place = first[r] + c
            _merge(best, rows, r, dist[r, c], ids[place], codes[place], k)
            left.append(rows[~done])
        before, rest = len(rest), np.concatenate(left)
        if 2 * len(rest) > before:
            break
    return np.sort(rest), within


@dataclass
class Screen:
    """Both sides of a comparison in single precision, around the middle of the reference rows and scaled, so that nothing overflows.

    The product of a row of ``q`` and a row of ``t`` is their squared distance less ``q_norms``. It only screens the pairs: those
    that may be near enough are measured again in double precision.
    """

    q: np.ndarray
    t: np.ndarray
    q_norms: np.ndarray
    slack: np.ndarray
    scale: float
    dist: np.ndarray  # room for the pairs that are compared at once

    @classmethod
    def of(cls, x: np.ndarray, shelf: Shelf) -> Screen | None:
        """None where the numbers are too large or too small to be scaled."""
        top = max(x.max(), -x.min(), shelf.x.max(), -shelf.x.min())
        if not 1e-100 < top < 1e100:
            return None
        middle, scale = shelf.x.mean(axis=0), 2.0 ** -np.frexp(top)[1]
        q, q_norms = _single(x, middle, scale)
        t, t_norms = _single(shelf.x, middle, scale)
        q[:, :-1] *= -2.0
        q[:, -1], t[:, -1] = 1.0, t_norms
        # far above the rounding error of single precision, so no true neighbour is screened out; the last term is for underflow
        slack = 16 * (x.shape[1] + 4) * np.finfo(np.float32).eps * (q_norms + t_norms.max()) + 1e-35
        return cls(q, t, q_norms, slack, scale * scale, np.empty(CHUNK_ROWS_BLOCKS * RUN_ROWS, np.float32))

    def near(self, rows: np.ndarray, cols: slice, limit: np.ndarray, need: int):
        """Positions of the pairs within the limits; None if too many are left, which double precision may tell apart."""
        t = self.t[cols]
        dist = self.dist[: len(rows) * len(t)].reshape(len(rows), len(t))
        np.matmul(self.q[rows], t.T, out=dist)
        hit = _within(dist, np.minimum(limit * self.scale, 1e30) - self.q_norms[rows], self.slack[rows], need)
        return np.divmod(hit, dist.shape[1]) if len(hit) <= 8 * need * len(rows) else None


def _single(rows: np.ndarray, middle: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Moved and scaled rows in single precision, with room for one more column, and their squared norms."""
    out, norms = np.empty((len(rows), rows.shape[1] + 1), np.float32), np.empty(len(rows))
    for a in range(0, len(rows), STEP_ROWS):
        part = (rows[a : a + STEP_ROWS] - middle) * scale
        out[a : a + STEP_ROWS, :-1] = part
        norms[a : a + STEP_ROWS] = np.einsum("ij,ij->i", part, part)
    return out, norms


def find_in_blocks(x, qids, shelf: Shelf, bits: np.ndarray, k: int, skip_self: bool, within: np.ndarray) -> Best:
    """The k nearest rows of every query among the blocks that it wants; the runs of ``shelf`` are blocks, ``bits`` is packed.

    Blocks that mostly the same queries want are compared together; a pair that is not wanted is left out of the lists.
    """
    best = Best.empty(len(x), k)
    starts, a = shelf.starts, 0
    wide = len(x) > 0 and len(shelf.ids) > 0 and x.shape[1] > DIRECT_DIMS
    screen = Screen.of(x, shelf) if wide else None
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + RUN_ROWS, side="right")) - 1)
        wanted = np.unpackbits(bits[:, a // 8 : -(-b // 8)], axis=1)[:, a % 8 : a % 8 + b - a].astype(bool)
        sizes = np.diff(starts[a : b + 1])
        rows = np.flatnonzero(wanted.any(axis=1))
        if 2 * (wanted.sum(axis=0) * sizes).sum() >= len(rows) * sizes.sum():
            runs = [(0, b - a, rows)]
        else:
            runs = [(i, i + 1, np.flatnonzero(wanted[:, i])) for i in range(b - a)]
        for first, last, rows in runs:
            mask = None if last == first + 1 else (wanted, np.repeat(np.arange(b - a), sizes), starts[a])
            for at in range(0, len(rows), CHUNK_ROWS_BLOCKS):
                for col in range(starts[a + first], starts[a + last], RUN_ROWS):
                    cols = slice(col, min(col + RUN_ROWS, starts[a + last]))
                    _scan_tile(x, qids, shelf, rows[at : at + CHUNK_ROWS_BLOCKS], cols, k, skip_self, best, within, mask, screen)
        a = b
    return best


def _within(dist: np.ndarray, limit: np.ndarray, slack, need: int) -> np.ndarray:
    """Flat positions of the pairs whose screened distance is not clearly above the limit of their row, nor above its ``need`` nearest."""
    hit = dist <= (limit + slack).astype(dist.dtype)[:, None]
    if dist.shape[1] > 2 * need and np.count_nonzero(hit) > 4 * need * len(dist):
        limit = np.minimum(limit, np.partition(dist, need - 1, axis=1)[:, need - 1] + slack)
        hit = dist <= (limit + slack).astype(dist.dtype)[:, None]
    return _true_places(hit.ravel())


def _true_places(flags: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of mostly false flags: eight at a time first."""
    whole = len(flags) & -8
    at = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    at = (at[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flags[at]], whole + np.flatnonzero(flags[whole:])])


def _scan_tile(x, qids, shelf, rows, cols, k, skip_self, best, within, mask=None, screen=None) -> None:
    """``cols`` is a slice or an array of positions."""
    need = k + 1 if skip_self else k
    limit = np.minimum(best.dist[rows, -1], within[rows])
    found, dist = screen.near(rows, cols, limit, need) if screen is not None else None, None
    if found is None:
        q, t = x[rows], shelf.x[cols]
        if x.shape[1] <= DIRECT_DIMS:
            q_columns, t_columns = np.ascontiguousarray(q.T), np.ascontiguousarray(t.T)
            dist = np.subtract.outer(q_columns[0], t_columns[0])
            dist *= dist
            diff = np.empty_like(dist)
            for j in range(1, x.shape[1]):
                np.subtract.outer(q_columns[j], t_columns[j], out=diff)
                diff *= diff
                dist += diff
            hit = _within(dist, limit, 0.0, need)
        else:
            q_norm, t_norm = squared_sum(q), shelf.norms[cols]
            # the distance less the query's own norm, which is taken off the limits instead of being added to every pair
            near = (-2.0 * q) @ t.T
            near += t_norm[None, :]
            # far above the rounding error of the product form, so no true neighbour is screened out
            slack = 16 * (x.shape[1] + 4) * np.finfo(float).eps * (q_norm + t_norm.max())
            hit = _within(near, limit - q_norm, slack, need)
        found = np.divmod(hit, len(t))
    r, c = found
    place = c + cols.start if isinstance(cols, slice) else cols[c]
    if mask is not None:
        wanted, block, start = mask
        held = wanted[rows[r], block[place - start]]
        r, c, place = r[held], c[held], place[held]
    if skip_self:
        other = qids[rows[r]] != shelf.ids[place]
        r, c, place = r[other], c[other], place[other]
    exact = dist[r, c] if dist is not None else squared_sum(x[rows[r]] - shelf.x[place])
    # equal distances are common among copies: those that lose the tie by id need not be sorted in
    ids, last, last_id = shelf.ids[place], best.dist[rows[r], -1], best.ids[rows[r], -1]
    wins = (exact < last) | ((exact == last) & (ids < last_id))
    if wins.any():
        _merge(best, rows, r[wins], exact[wins], ids[wins], shelf.codes[place[wins]], k)


def _merge(best: Best, rows, r, dist, ids, codes, k) -> None:
    """Put the candidates of tile row ``r`` into the k-lists, ordered by distance and then id."""
    local = np.unique(r)
    touched = rows[local]
    row = np.concatenate([np.repeat(np.arange(len(local)), k), np.searchsorted(local, r)])
    dist = np.concatenate([best.dist[touched].ravel(), dist])
    ids = np.concatenate([best.ids[touched].ravel(), ids])
    codes = np.concatenate([best.codes[touched].ravel(), codes])
    order = np.lexsort((ids, dist, row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(local)))[row]
    keep = rank < k
    order, row, rank = order[keep], touched[row[keep]], rank[keep]
    best.dist[row, rank] = dist[order]
    best.ids[row, rank] = ids[order]
    best.codes[row, rank] = codes[order]
