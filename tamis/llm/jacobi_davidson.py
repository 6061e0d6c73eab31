"""Leading eigenpairs by Jacobi-Davidson, from products with the matrix alone.

``product`` gives the matrix times a block of vectors. It is the only access, so the matrix itself is never formed; a
block serves all open pairs at once. The caller's process holds vectors of one dimension's length, a few per pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = np.finfo(float).eps
INNER = 4
OUTER = 60


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of ``block`` made orthonormal, and orthogonal to ``against``; columns that add nothing go."""
    kept = np.empty((block.shape[0], 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        v = column / size
        for _ in range(3):
            for basis in (*against, kept):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            kept = np.column_stack([kept, v])
    return kept


def corrections(product: Callable, shifts: np.ndarray, ritz: np.ndarray, residuals: np.ndarray, locked: np.ndarray, reduction: float, most: int = INNER) -> np.ndarray:
    """Approximate solutions of (I-UU')(A-shift I)(I-UU') t = -r by MINRES, one equation per column.

    U holds the locked vectors and the column's own Ritz vector. All columns advance together, so each step is one
    product with a block. A column stops when its residual has shrunk to ``reduction`` of its start.
    """

    def project(block: np.ndarray) -> np.ndarray:
        block = block - locked @ (locked.T @ block)
        return block - ritz * np.sum(ritz * block, axis=0)

    v = project(-residuals)
    beta = np.linalg.norm(v, axis=0)
    start = np.where(beta > 0, beta, 1)
    t, v_old, v = np.zeros_like(v), np.zeros_like(v), v / start
    w = w_old = np.zeros_like(v)
    eta, c, c_old, s, s_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    last = np.zeros_like(beta)
    active = beta > 0
    for _ in range(most):
        if not active.any():
            break
        p = np.zeros_like(v)
        p[:, active] = product(v[:, active])
        p = project(p - shifts * v)
        alpha = np.sum(v * p, axis=0)
        p = p - alpha * v - last * v_old
        beta = np.linalg.norm(p, axis=0)
        # two old rotations, then a new one that clears beta
        delta, low, far = c * alpha - c_old * s * last, s * alpha + c_old * c * last, s_old * last
        rho = np.hypot(delta, beta)
        active = active & (rho > 0)
        safe = np.where(rho > 0, rho, 1)
        c_old, s_old, c, s = c, s, delta / safe, beta / safe
        w_old, w = w, (v - far * w_old - low * w) / safe
        t = t + np.where(active, c * eta, 0) * w
        eta = -s * eta
        v_old, v = v, np.where(beta > 0, p / np.where(beta > 0, beta, 1), 0)
        last = beta
        active = active & (np.abs(eta) > reduction * start) & (beta > 0)
    return project(t)


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values falling, unit vectors as columns, largest residual over the largest value) of the ``count`` largest pairs.

    Pairs are locked one after the other, largest first, when their residual is down to rounding. Locked pairs pass a
    last Rayleigh-Ritz step with a fresh product.
    """
    count = min(count, size)
    room = min(size, max(3 * count, count + 8))
    basis = _orthonormal(np.random.default_rng(12).normal(size=(size, min(size, count + 4))))
    image = product(basis)
    locked, locked_image = np.empty((size, 0)), np.empty((size, 0))
    floor = np.inf
    for turn in range(OUTER):
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        basis, image = basis @ turns, image @ turns
        wanted = min(count - locked.shape[1], basis.shape[1])
        residuals = image[:, :wanted] - basis[:, :wanted] * values[:wanted]
        residuals = residuals - locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0)
        scale = max(abs(values[0]), *np.abs(np.sum(locked * locked_image, axis=0)), 0.0) or 1.0
        enough = 8 * EPS * np.sqrt(size) * scale
        # rounding in the products bounds what can be reached: when nothing gets better near that bound, it is reached
        stuck = turn > 3 and norms.max() >= floor / 2 and norms.max() < 50 * enough
        floor = min(floor, norms.max())
        open_at = next((i for i, r in enumerate(norms) if r > enough and not stuck), wanted)
        if open_at:
            locked, locked_image = np.column_stack([locked, basis[:, :open_at]]), np.column_stack([locked_image, image[:, :open_at]])
            basis, image, values, residuals, norms = basis[:, open_at:], image[:, open_at:], values[open_at:], residuals[:, open_at:], norms[open_at:]
            floor = np.inf
        wanted = count - locked.shape[1]
        if wanted == 0:
            break
        take = min(wanted, residuals.shape[1])
        if take:
            todo = [i for i in range(take) if norms[i] > enough]
            more = corrections(product, values[todo], basis[:, todo], residuals[:, todo], locked, max(1e-4, 0.5 ** (turn + 1)))
            more = np.column_stack([more, residuals[:, todo]])[:, : max(1, len(todo))] if not more.any() else more
        else:
            more = np.random.default_rng(turn).normal(size=(size, wanted))
        if basis.shape[1] + more.shape[1] > room - locked.shape[1]:
            keep = min(basis.shape[1], wanted + 4)
            basis, image = basis[:, :keep], image[:, :keep]
        more = _orthonormal(more, locked, basis)
        if not more.shape[1]:
            more = _orthonormal(np.random.default_rng(100 + turn).normal(size=(size, wanted)), locked, basis)
        if more.shape[1]:
            basis, image = np.column_stack([basis, more]), np.column_stack([image, product(more)])
    else:
        raise ArithmeticError(f"{count - locked.shape[1]} eigenpairs did not converge in {OUTER} steps")
    locked = _orthonormal(locked)
    image = product(locked)
    small = locked.T @ image
    values, turns = np.linalg.eigh((small + small.T) / 2)
    values, vectors, image = values[::-1], locked @ turns[:, ::-1], image @ turns[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    worst = np.linalg.norm(product(vectors) - vectors * values, axis=0).max(initial=0.0)
    return values, vectors, float(worst / (values[0] if len(values) and values[0] > 0 else 1.0))
