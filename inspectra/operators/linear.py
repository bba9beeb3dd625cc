"""Logistic regressions of a whole search at once (M18): one scan per iteration for all penalties, C and folds.

Minimises ``sum of w_i log-loss_i + R(b) / C`` with R the L1 norm or half the
squared L2 norm, the intercept not penalised.  An iteration is one pass over
the rows: tasks add up objective, gradient and Hessian of every model, over one
design that all models share (``_Base``); the driver takes a Newton step for each (for L1 the quadratic model plus the
penalty is minimised by coordinate descent with steps inside the signs it finds), halved while it doesn't improve.
What reaches the driver depends on the number of models and slots alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prepare import Preparation

TOLERANCE = 1e-9
MAX_PASSES = 100
#: Rows whose products are formed at once.
CHUNK = 8192
#: Sweeps over the coordinates of L1 models between two steps along all places that are not 0.
SWEEPS = 5


def rows_of(batch) -> tuple[np.ndarray, np.ndarray]:
    """(nums, cats) matrices of a batch or table with these two list columns."""
    def flat(name):
        c = batch.column(name)
        return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten().to_numpy(zero_copy_only=False)
    n = batch.num_rows
    return flat("nums").astype(float).reshape(n, -1), flat("cats").astype(np.int64).reshape(n, -1)


def sum_arrays(parts: DataFrame, size: int, shape) -> dict:
    """{key: element-wise sum} of (key int, data binary of float64): one streaming adder per key."""

    def add(batches):
        held: dict = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(blob.as_buffer(), np.float64)
                held[k] = held[k] + x if k in held else x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["key", "data"])

    got = parts.repartition("key").mapInArrow(add, "key int, data binary").toArrow().to_pydict()
    found = {k: np.frombuffer(b, np.float64).reshape(shape).copy() for k, b in zip(got["key"], got["data"])}
    return {k: found[k] if k in found else np.zeros([max(n, 0) for n in shape]) for k in range(size)}


def _steps(beta, g, h, lam, l1):
    """Newton directions of several models at ``beta`` (models x size); place 0 is the intercept."""
    penalty = np.repeat(np.asarray(lam, float)[:, None], beta.shape[1], axis=1)
    penalty[:, 0] = 0.0
    out = np.zeros_like(beta)
    for i in np.flatnonzero(~l1):
        out[i] = -np.linalg.solve(h[i] + np.diag(penalty[i] + 1e-10), g[i] + penalty[i] * beta[i])
    todo = np.flatnonzero(l1)
    z, grad = beta[todo].copy(), g[todo].copy()  # grad: of the quadratic models at z
    hess = h[todo].transpose(2, 0, 1).copy()  # a coordinate's column of every model side by side
    scale = np.stack([hess[j, :, j] for j in range(beta.shape[1])])
    able = scale > 1e-12
    scale = np.where(able, scale, 1.0)
    shrink = penalty[todo].T / scale
    for sweep in range(1, 1001):  # a sweep goes over the coordinates of all models that still move
        if not len(todo):
            break
        moved = np.zeros(len(todo))
        for j in range(z.shape[1]):
            raw = z[:, j] - grad[:, j] / scale[j]
            d = (raw - np.clip(raw, -shrink[j], shrink[j]) - z[:, j]) * able[j]
            if d.any():
                grad += hess[j] * d[:, None]
                z[:, j] += d
                np.maximum(moved, np.abs(d), out=moved)
        out[todo] = z - beta[todo]
        on = moved >= 1e-12
        if not on.all():
            todo, z, grad = todo[on], z[on], grad[on]
            hess, scale, able, shrink = hess[:, on], scale[:, on], able[:, on], shrink[:, on]
        if sweep % SWEEPS == 0:
            for m, i in enumerate(todo):
                z[m], grad[m] = _settled(z[m], grad[m], h[i], penalty[i], able[:, m])
    return out


def _settled(z, grad, h, penalty, able):
    """(z, gradient) at the minimum over the places that are not 0, none of which changes its sign.

    Where inputs depend on each other, sweeps of single coordinates crawl along
    the flat directions; this goes to the end of them.  A place that comes to 0
    on the way stays there, and the sweeps free it again if it should be.
    """
    z, grad = z.copy(), grad.copy()
    for _ in range(len(z)):
        on = np.flatnonzero(able & ((z != 0) | (penalty == 0)))
        free = penalty[on] == 0
        down = -(grad[on] + penalty[on] * np.sign(z[on]))
        values, vectors = np.linalg.eigh(h[np.ix_(on, on)])
        along, steep = vectors.T @ down, values > 1e-11 * values[-1]
        flat = vectors[:, ~steep] @ along[~steep]
        # flat directions first: there the penalty alone decides, up to the first place that comes to 0
        d = flat if np.abs(flat).max(initial=0) > 1e-9 * max(1.0, penalty.max()) else vectors[:, steep] @ (along[steep] / values[steep])
        move, slope = h[:, on] @ d, down @ d
        bend = move[on] @ d
        with np.errstate(divide="ignore", invalid="ignore"):
            ends = np.where(~free & (z[on] * d < 0), -z[on] / d, np.inf)
            t = slope / bend if bend > 0 else np.inf
        first = int(np.argmin(ends))
        if not slope > 0 or not np.isfinite(min(t, ends[first])):
            break
        t, ended = min(t, ends[first]), ends[first] <= t
        z[on] += t * d
        grad += t * move
        if ended:
            z[on[first]] = 0.0
        elif d is not flat:
            break
    return z, grad


def _sums(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of the rows of ``x`` that have them)."""
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    return own, np.add.reduceat(x[order], first, axis=0)


class _Base:
    """One design that all views share: what a view's model needs is a linear map of sums over it.

    Its columns are 1, the numbers about the last view's means (0 where one is
    missing), who misses them, and the codes of the categories.  A view's
    imputation, scaling and slots are the matrix ``maps[view]`` (columns x slots),
    so a row is coded once and its products are formed once for all models.
    """

    def __init__(self, prep: Preparation, views: list[int]):
        self.pivot, self.scale = prep.views[-1].means, prep.views[-1].deviations
        n, wide = len(prep.numeric), [len(v) + 2 for v in prep.values]  # codes from -1 on
        self.first = (1 + 2 * n + np.cumsum([0, *wide])).tolist()
        self.n, self.size, self.maps = n, self.first[-1], {}
        for v in views:
            view, t = prep.views[v], np.zeros((self.size, prep.width + 1))
            t[0, 0] = 1.0
            i = np.arange(n)
            t[0, 1 + i] = (self.pivot - view.means) / view.deviations
            t[1 + i, 1 + i] = self.scale / view.deviations
            t[1 + n + i, 1 + i] = (view.medians - self.pivot) / view.deviations
            base = 1 + n
            for k, values in enumerate(prep.values):
                for code in range(-1, len(values) + 1):
                    slot = view.slots[k][view.modes[k] if code < 0 else code]
                    if slot >= 0:
                        t[self.first[k] + code + 1, base + slot] = 1.0
                base += len(values) + 1
            self.maps[v] = t

    def rows(self, nums: np.ndarray, cats: np.ndarray):
        """(order, dense columns, their places, first row of each run of equal codes, places of the codes of each run)."""
        order = np.lexsort(cats.T) if cats.shape[1] else np.arange(len(nums))
        nums, cats = nums[order], cats[order]
        missing = np.isnan(nums)
        some = np.flatnonzero(missing.any(axis=0))
        z = np.where(missing, 0.0, (nums - self.pivot) / self.scale)
        dense = np.concatenate([np.ones((len(nums), 1)), z, missing[:, some].astype(float)], axis=1)
        places = np.concatenate([np.arange(1 + self.n), 1 + self.n + some]).astype(int)
        starts = np.concatenate([[0], np.flatnonzero((cats[1:] != cats[:-1]).any(axis=1)) + 1])
        return order, dense, places, starts, cats[starts] + 1 + np.array(self.first[:-1], int)


def fit(rows: DataFrame, prep: Preparation, points: list[tuple[float, str]], views: list[int]) -> dict:
    """{(view, point number): coefficients, the intercept first} over ``rows`` (fold, label, nums, cats).

    A view learns from the rows outside its fold, with its own class weights.
    """
    size = prep.width + 1
    beta = np.zeros((len(views), len(points), size))
    trial, value = beta.copy(), np.full(beta.shape[:2], np.inf)
    move, part, open_ = np.zeros_like(beta), np.ones(beta.shape[:2]), np.ones(beta.shape[:2], bool)
    width = 1 + size + size * size
    src = rows.select("fold", "label", "nums", "cats")
    for _ in range(MAX_PASSES):
        held = rows.sparkSession.sparkContext.broadcast((trial, open_.copy()))

        def run(batches, held=held):
            at, todo = held.value
            which = np.argwhere(todo)  # the open models: (view, point)
            base, many = _Base(prep, [views[i] for i in np.unique(which[:, 0])]), len(which)
            maps = [base.maps[views[i]] for i, _ in which]
            beta = np.stack([t @ at[i, j] for t, (i, j) in zip(maps, which)], axis=1)
            own = np.array([views[i] for i, _ in which])
            weight = np.array([prep.views[v].weights for v in own]).T
            loss, grad, hess = np.zeros(many), np.zeros((base.size, many)), np.zeros((base.size, base.size, many))
            for batch in batches:
                for at_row in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at_row, CHUNK)
                    order, dense, places, starts, codes = base.rows(*rows_of(part))
                    fold, label = (part.column(c).to_numpy()[order] for c in ("fold", "label"))
                    y = label.astype(float)[:, None]
                    w = weight[label] * (fold[:, None] != own)
                    lengths = np.diff(np.append(starts, len(order)))
                    eta = dense @ beta[places] + np.repeat(beta[codes].sum(axis=1), lengths, axis=0)
                    e = np.exp(-np.abs(eta))
                    p = np.where(eta >= 0, 1.0, e) / (1 + e)
                    loss += (w * (np.log1p(e) + np.maximum(eta, 0) - y * eta)).sum(axis=0)
                    r, h = w * (p - y), w * p * (1 - p)
                    grad[places] += dense.T @ r
                    a, b = np.triu_indices(dense.shape[1])
                    turned = np.ascontiguousarray(dense.T)
                    hess[places[a], places[b]] += np.concatenate([x * turned[i:] for i, x in enumerate(turned)]) @ h
                    of_run = np.add.reduceat(r, starts, axis=0)
                    cross = np.stack([dense[i:i + n].T @ h[i:i + n] for i, n in zip(starts, lengths)])  # runs x dense x models
                    for k in range(codes.shape[1]):
                        u, found = _sums(codes[:, k], of_run)
                        grad[u] += found
                        u, found = _sums(codes[:, k], cross)
                        hess[places[None, :], u[:, None]] += found
                        for m in range(k, codes.shape[1]):
                            u, found = _sums(codes[:, k] * base.size + codes[:, m], cross[:, 0])
                            hess[u // base.size, u % base.size] += found
            total = np.zeros((len(views), len(points), width))
            for m, (t, (i, j)) in enumerate(zip(maps, which)):
                up = hess[:, :, m]
                total[i, j, 0], total[i, j, 1:size + 1] = loss[m], t.T @ grad[:, m]
                total[i, j, size + 1:] = (t.T @ (up + np.triu(up, 1).T) @ t).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(views)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["key", "data"])

        sums = sum_arrays(src.mapInArrow(run, "key int, data binary"), len(views), (len(points), width))
        held.unpersist()
        better = []
        for i in range(len(views)):
            for j in np.flatnonzero(open_[i]):
                c, penalty = points[j]
                l1, lam, b = penalty == "l1", 1 / c, trial[i, j]
                f = sums[i][j, 0] + lam * (np.abs(b[1:]).sum() if l1 else 0.5 * (b[1:] ** 2).sum())
                if f <= value[i, j] + 1e-12 * abs(f):
                    beta[i, j], value[i, j], part[i, j] = b, f, 1.0
                    better.append((i, j))
                else:
                    part[i, j] /= 2
                    open_[i, j] = part[i, j] > 1e-9
        if better:
            i, j = np.array(better).T
            found = np.stack([sums[a][b] for a, b in better])
            move[i, j] = _steps(beta[i, j], found[:, 1:size + 1], found[:, size + 1:].reshape(-1, size, size),
                                [1 / points[b][0] for b in j], np.array([points[b][1] == "l1" for b in j]))
            open_[i, j] = np.abs(move[i, j]).max(axis=1) > TOLERANCE
        trial = beta + part[:, :, None] * move
        if not open_.any():
            break
    return {(v, j): beta[i, j] for i, v in enumerate(views) for j in range(len(points))}
