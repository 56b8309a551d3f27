"""Solve (kappa R + D) x = D y on one rectangular grid, inside a task.

R = T'T with T the graph Laplacian of the grid, D diagonal. Two neighbouring lines of the longer axis form one block, which
makes the system block tridiagonal; the recursion below costs (cells along the long axis) x (cells along the short)^3.
Leading array axis: one entry per kappa.
"""

from __future__ import annotations

import numpy as np


def _degree(n: int) -> np.ndarray:
    degree = np.full(n, 2.0)
    degree[0] -= 1
    degree[-1] -= 1
    return degree


def _structure_blocks(n_short: int, n_long: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Diagonal blocks of R and the blocks below them, two lines to a block."""
    eye = np.eye(n_short)
    line = np.diag(_degree(n_short)) - np.eye(n_short, k=1) - np.eye(n_short, k=-1)
    degree = _degree(n_long)

    def entry(row: int, col: int) -> np.ndarray:
        gap = abs(row - col)
        if gap == 0:
            inner = line + degree[row] * eye
            return inner @ inner + degree[row] * eye
        if gap == 1:
            return -(2 * line + (degree[row] + degree[col]) * eye)
        return eye if gap == 2 else np.zeros_like(eye)

    pairs = [range(k, min(k + 2, n_long)) for k in range(0, n_long, 2)]
    diagonal = [np.block([[entry(r, c) for c in p] for r in p]) for p in pairs]
    below = [np.block([[entry(r, c) for c in p] for r in q]) for p, q in zip(pairs, pairs[1:])]
    return diagonal, below


def laplacian(field: np.ndarray) -> np.ndarray:
    """T v along the last two axes."""
    out = np.zeros_like(field)
    for axis in (-1, -2):
        step = np.diff(field, axis=axis)
        pad = [(0, 0)] * field.ndim
        pad[axis] = (1, 1)
        step = np.pad(step, pad)
        out -= np.diff(step, axis=axis)
    return out


def _solve_batch(y: np.ndarray, weight: np.ndarray, kappa: np.ndarray, noise: np.ndarray | None, variance: bool):
    n_long, n_short = y.shape
    size = np.maximum(kappa, 1.0)
    diagonal, below = _structure_blocks(n_short, n_long)
    ends = np.cumsum([0] + [d.shape[0] for d in diagonal])
    part = lambda a, k: a.reshape(*a.shape[:-2], -1)[..., ends[k] : ends[k + 1]]
    ratio = (kappa / size)[:, None, None]
    scaled_weight = weight[None] / size[:, None, None]
    right = scaled_weight * y[None]

    inverse, gain, carried, lower = [], [], [], []
    log_det = y.size * np.log(size)
    for k, block in enumerate(diagonal):
        pivot = ratio * block
        rows = np.arange(block.shape[0])
        pivot[:, rows, rows] += part(scaled_weight, k)
        vector = part(right, k)
        if k:
            coupling = ratio * below[k - 1]
            pivot = pivot - coupling @ gain[-1]
            vector = vector - np.einsum("kji,kj->ki", gain[-1], carried[-1])
        root = np.linalg.cholesky(pivot)
        dense = np.linalg.inv(pivot)
        inverse.append((dense + np.swapaxes(dense, 1, 2)) / 2)
        lower.append(root if noise is not None else None)
        carried.append(vector)
        log_det = log_det + 2 * np.log(np.diagonal(root, axis1=1, axis2=2)).sum(axis=1)
        if k + 1 < len(diagonal):
            gain.append(inverse[-1] @ np.swapaxes(ratio * below[k], 1, 2))

    count = len(diagonal)
    mean, spread, draw = [None] * count, [None] * count, [None] * count
    full = None
    for k in reversed(range(count)):
        mean[k] = np.einsum("kij,kj->ki", inverse[k], carried[k])
        if noise is not None:
            z = part(noise, k) / np.sqrt(size)[:, None]
            draw[k] = np.linalg.solve(np.swapaxes(lower[k], 1, 2), z[..., None])[..., 0]
        if k + 1 < count:
            mean[k] = mean[k] - np.einsum("kij,kj->ki", gain[k], mean[k + 1])
            if noise is not None:
                draw[k] = draw[k] - np.einsum("kij,kj->ki", gain[k], draw[k + 1])
        if variance:
            full = inverse[k] if k + 1 == count else inverse[k] + gain[k] @ full @ np.swapaxes(gain[k], 1, 2)
            spread[k] = np.diagonal(full, axis1=1, axis2=2) / size[:, None]
    shape = (len(kappa), n_long, n_short)
    join = lambda blocks: np.concatenate(blocks, axis=1).reshape(shape)
    mean = join(mean)
    return mean, join(spread) if variance else None, log_det, mean + join(draw) if noise is not None else None


def solve(y, weight, kappa, noise=None, variance=True, batch_bytes=128 * 1024 * 1024):
    """Posterior mean and variance fields for every kappa.

    ``y`` and ``weight`` are (n_j, n_i) arrays; a missing cell has weight 0. Returns a dict of arrays whose leading axis
    follows ``kappa``: mean, var, log_det (of kappa R + D), roughness (mean' R mean), misfit ((mean - y)' D (mean - y)) and,
    when ``noise`` (standard normal, one field per kappa) is given, draw. A kappa whose factorisation fails gives NaN.
    """
    kappa = np.asarray(kappa, dtype=float)
    turned = y.shape[1] > y.shape[0]
    turn = (lambda a: np.swapaxes(a, -1, -2)) if turned else (lambda a: a)
    y, weight = turn(np.where(weight > 0, y, 0.0)), turn(weight)
    noise = None if noise is None else turn(noise)

    # blocks kept per kappa: inverse, gain and (for draws) root, each (cells) x (2 short lines)
    per_kappa = 8 * 3 * y.size * 2 * y.shape[1]
    step = max(1, int(batch_bytes // per_kappa))
    parts = []
    for first in range(0, len(kappa), step):
        chunk = slice(first, first + step)
        try:
            parts.append(_solve_batch(y, weight, kappa[chunk], None if noise is None else noise[chunk], variance))
        except np.linalg.LinAlgError:
            for k in range(first, min(first + step, len(kappa))):
                one = slice(k, k + 1)
                try:
                    parts.append(_solve_batch(y, weight, kappa[one], None if noise is None else noise[one], variance))
                except np.linalg.LinAlgError:
                    nothing = np.full((1, *y.shape), np.nan)
                    parts.append((nothing, nothing if variance else None, np.full(1, np.nan),
                                  None if noise is None else nothing))
    stack = lambda n: None if parts[0][n] is None else np.concatenate([p[n] for p in parts])
    mean, var, log_det, draw = stack(0), stack(1), stack(2), stack(3)
    rough = (laplacian(mean) ** 2).sum(axis=(1, 2))
    misfit = (weight * (mean - y) ** 2).sum(axis=(1, 2))
    out = {"mean": turn(mean), "log_det": log_det, "roughness": rough, "misfit": misfit}
    if var is not None:
        out["var"] = turn(var)
    if draw is not None:
        out["draw"] = turn(draw)
    return out
