"""Batch kernels over numpy matrices, one row per vector; everything accumulates in double."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .space import Space


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row, by butterflies over the whole batch."""
    n, d = x.shape
    x = np.array(x, np.float64)
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=None)
def _factors(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal Hadamard matrices whose Kronecker product is the one of size ``d``; the first is 1 x 1 up to 256."""
    low = d if d <= 256 else 1 << ((d.bit_length() - 1) // 2)
    return hadamard(np.eye(d // low)), hadamard(np.eye(low))


def hadamard_products(x: np.ndarray) -> np.ndarray:
    """``hadamard`` by matrix products: several times faster, and other last bits."""
    n, d = x.shape
    high, low = _factors(d)
    out = (x.reshape(-1, len(low)) @ low).reshape(n, d)
    return out if len(high) == 1 else np.matmul(high, out.reshape(n, len(high), len(low))).reshape(n, d)


def unit_rows(space: Space, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 (all 0 where the norm is at most 1e-10) and padded; and the norms."""
    x = np.asarray(x, np.float64)
    norm = np.sqrt((x * x).sum(1))
    inverse = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 1e-10)
    out = np.zeros((len(x), space.padded_dim))
    out[:, : space.dim] = x * inverse[:, None]
    return out, norm


def rotate(space: Space, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit, norm = unit_rows(space, x)
    return hadamard(unit * np.array(space.rot_signs)), norm


def rotated_coords(space: Space, x: np.ndarray) -> np.ndarray:
    """Rotated coordinates over their root mean square."""
    x = np.asarray(x, np.float64)
    square = (x * x).sum(1)
    unit = np.zeros((len(x), space.padded_dim))
    unit[:, : space.dim] = x * np.divide(1.0, np.sqrt(square), out=np.zeros_like(square), where=square > 1e-20)[:, None]
    r = hadamard(unit * np.array(space.rot_signs))
    variance = (r * r).mean(1)
    return r * np.divide(1.0, np.sqrt(variance), out=np.ones_like(variance), where=variance > 1e-20)[:, None]


@dataclass
class Codes:
    """Unpacked codes: levels, signs as 0/1, and float32 norm, gamma, sigma per row."""

    levels: np.ndarray
    signs: np.ndarray
    norm: np.ndarray
    gamma: np.ndarray
    sigma: np.ndarray


@lru_cache(maxsize=64)
def _cells(boundaries: tuple[float, ...]) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(least value, cells per unit, level below each cell's boundary, that boundary): a grid with a boundary at most in each cell."""
    bounds = np.array(boundaries, np.float64)
    gap = np.diff(bounds).min() if len(bounds) > 1 else 1.0
    low, per = bounds[0] - 1.2345 * gap, 1.4 / gap
    cell = np.floor((bounds - low) * per).astype(np.int64)
    base = np.searchsorted(cell, np.arange(cell[-1] + 2), side="left")
    edge = np.append(bounds, np.inf)[np.minimum(base, len(bounds))]
    return low, per, base.astype(np.uint8), edge


def quantise(boundaries: tuple[float, ...], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of ``values`` (boundaries below them), and which are within 1e-9 of a boundary."""
    low, per, base, edge = _cells(boundaries)
    cell = np.clip((values - low) * per, 0, len(base) - 1).astype(np.intp)
    near = edge.take(cell)
    return base.take(cell) + (values > near), np.abs(values - near) < 1e-9


def _encoded(space: Space, x: np.ndarray, transform) -> tuple[Codes, np.ndarray]:
    """Codes, and the rows where other last bits of the transform could change a level or a sign."""
    unit, norm = unit_rows(space, x)
    r = transform(unit * np.array(space.rot_signs))
    sigma = np.maximum(np.sqrt((r * r).mean(1)), 1e-10)
    levels, close = quantise(space.boundaries, r / sigma[:, None])
    residual = r - np.array(space.centroids).take(levels) * sigma[:, None]
    gamma = np.sqrt((residual * residual).sum(1))
    twice = transform(residual * np.array(space.qjl_signs))
    doubt = close.any(1) | (np.abs(twice) <= 1e-9 * gamma[:, None]).any(1)
    return Codes(levels, (twice >= 0).astype(np.uint8), norm.astype(np.float32), gamma.astype(np.float32), sigma.astype(np.float32)), doubt


def encode(space: Space, x: np.ndarray) -> Codes:
    """Codes as the butterflies give them: matrix products over blocks of rows, and the rows they leave in doubt by butterflies."""
    parts, step = [], max(16, (1 << 17) // space.padded_dim)
    for at in range(0, max(1, len(x)), step):
        rows = x[at : at + step]
        codes, doubt = _encoded(space, rows, hadamard_products)
        if doubt.any():
            again, _ = _encoded(space, rows[doubt], hadamard)
            for name in ("levels", "signs", "norm", "gamma", "sigma"):
                getattr(codes, name)[doubt] = getattr(again, name)
        parts.append(codes)
    return Codes(*(np.concatenate([getattr(c, name) for c in parts]) for name in ("levels", "signs", "norm", "gamma", "sigma")))


def pack(space: Space, codes: Codes) -> np.ndarray:
    unit = (codes.levels << 1) | codes.signs
    return unit[:, 0::2] | (unit[:, 1::2] << 4) if space.nibbles else unit


def unpack(space: Space, packed: np.ndarray, norm: np.ndarray, gamma: np.ndarray, sigma: np.ndarray) -> Codes:
    if space.nibbles:
        unit = np.empty((len(packed), space.padded_dim), np.uint8)
        unit[:, 0::2], unit[:, 1::2] = packed & 15, packed >> 4
    else:
        unit = packed
    return Codes(unit >> 1, unit & 1, norm, gamma, sigma)


@dataclass
class Decoded:
    """What every distance needs: c (levels times sigma), h (its second rotation), s (+1/-1), and the scalars."""

    c: np.ndarray
    h: np.ndarray
    s: np.ndarray
    norm: np.ndarray
    gamma: np.ndarray


def decode(space: Space, codes: Codes) -> Decoded:
    c = np.array(space.centroids)[codes.levels] * codes.sigma.astype(np.float64)[:, None]
    return Decoded(c, hadamard_products(c * np.array(space.qjl_signs)), codes.signs * 2.0 - 1.0, codes.norm.astype(np.float64), codes.gamma.astype(np.float64))


def prepare(space: Space, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw queries: rotated, rotated again with the residual's signs, and norms."""
    r, norm = rotate(space, q)
    return r, hadamard_products(r * np.array(space.qjl_signs)), norm


def squared(ip: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (left * left)[:, None] + (right * right)[None, :] - 2.0 * ip * left[:, None] * right[None, :])


def distances(space: Space, mode: str, left, right: Decoded) -> np.ndarray:
    """Squared distances of all pairs. ``left``: prepared raw queries for "asym", decoded codes otherwise.

    With g = h + k * gamma * s, the asymmetric estimate and the full symmetric one before its clamp are single products.
    """
    k = space.scale
    if mode == "asym":
        _, twice, norm = left
        return squared(twice @ (right.h + (k * right.gamma)[:, None] * right.s).T, norm, right.norm)
    first = left.c @ right.c.T
    if mode == "sym":
        ip = first
    elif mode == "light":
        more = k * k * left.gamma[:, None] * right.gamma[None, :] * (left.s @ right.s.T)
        ip = first + np.clip(more, -np.abs(first), np.abs(first))
    elif mode == "full":
        ga, gb = (x.h + (k * x.gamma)[:, None] * x.s for x in (left, right))
        ip = first + np.clip(ga @ gb.T - first, -np.abs(first), np.abs(first))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return squared(ip, left.norm, right.norm)


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    left, right = np.asarray(left, np.float64), np.asarray(right, np.float64)
    return np.maximum(0.0, (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2.0 * left @ right.T)


@dataclass
class Operand:
    """One side of the distances of a mode: squared norm + squared norm - 2 * weight * weight * inner product, at least 0.

    The inner product is u @ u, or with ``c`` (clamped modes) c @ c plus a correction of at most its size, "full": u @ u - c @ c, "light": u @ u.
    """

    mode: str
    u: np.ndarray
    c: np.ndarray | None
    square: np.ndarray
    weight: np.ndarray

    def rows(self, at) -> "Operand":
        return Operand(self.mode, self.u[at], None if self.c is None else self.c[at], self.square[at], self.weight[at])


def operand(space: Space | None, mode: str, side) -> Operand:
    """Of decoded codes, of prepared raw queries (a tuple), or of vectors (mode "exact")."""
    if mode == "exact":
        x = np.asarray(side, np.float64)
        return Operand(mode, x, None, (x * x).sum(1), np.ones(len(x)))
    if mode == "asym" and isinstance(side, tuple):
        _, twice, norm = side
        return Operand(mode, twice, None, norm * norm, norm)
    if mode not in ("asym", "sym", "light", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    signs = (space.scale * side.gamma)[:, None] * side.s if mode != "sym" else None
    u = side.c if mode == "sym" else signs if mode == "light" else side.h + signs
    return Operand(mode, u, side.c if mode in ("light", "full") else None, side.norm * side.norm, side.norm)


def _corrected(mode: str, first: np.ndarray, product: np.ndarray) -> np.ndarray:
    """first + clip(correction, -|first|, |first|), in the place of ``product``."""
    if mode == "full":
        product -= first
    most = np.abs(first)
    np.minimum(product, most, out=product)
    np.maximum(product, np.negative(most, out=most), out=product)
    product += first
    return product


def tile(a: Operand, b: Operand) -> np.ndarray:
    """Squared distances of all pairs of two small sides."""
    if a.mode == "exact":  # one product, squares included
        one = lambda x: np.ones((len(x.u), 1))
        ip = np.concatenate([-2.0 * a.u, a.square[:, None], one(a)], axis=1) @ np.concatenate([b.u, one(b), b.square[:, None]], axis=1).T
        return np.maximum(ip, 0.0, out=ip)
    ip = a.u @ b.u.T
    if a.c is not None:
        ip = _corrected(a.mode, a.c @ b.c.T, ip)
    ip *= -2.0 * a.weight[:, None]
    ip *= b.weight
    ip += a.square[:, None]
    ip += b.square
    return np.maximum(ip, 0.0, out=ip)


def of_pairs(a: Operand, b: Operand, i: np.ndarray, j: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Squared distances of the pairs (i, j); equal rows give equal values wherever they lie, unlike matrix products."""
    out = np.empty(len(i))
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        if a.mode == "exact":
            gap = a.u[x] - b.u[y]
            out[at : at + step] = (gap * gap).sum(1)
            continue
        ip = (a.u[x] * b.u[y]).sum(1)
        if a.c is not None:
            ip = _corrected(a.mode, (a.c[x] * b.c[y]).sum(1), ip)
        out[at : at + step] = np.maximum(0.0, a.square[x] + b.square[y] - 2.0 * ip * a.weight[x] * b.weight[y])
    return out


class Screen:
    """Which pairs may be at a distance of at most so much: one product in single precision, with its greatest error allowed for.

    For clamped modes a product as large as the limit asks for is necessary only if the limit asks for one above 0; other rows pass whole.
    """

    def __init__(self, left: Operand):
        self.clamped = left.c is not None
        self.square = left.square
        self.left = self._rows(left, 2.0 * left.weight, np.full(len(left.u), -1.0))
        self.length = np.sqrt((self.left.astype(np.float64) ** 2).sum(1))

    @staticmethod
    def _rows(x: Operand, weight: np.ndarray, last: np.ndarray) -> np.ndarray:
        u = np.concatenate([x.c, x.u], axis=1) if x.mode == "light" else x.u
        return np.concatenate([weight[:, None] * u, last[:, None]], axis=1).astype(np.float32)

    def right(self, right: Operand) -> tuple[np.ndarray, float, float]:
        rows = self._rows(right, right.weight, right.square)
        return rows, float(np.sqrt((rows.astype(np.float64) ** 2).sum(1).max())), float(right.square.min())

    def passing(self, at: slice, right: tuple[np.ndarray, float, float], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row in ``at``, column) of the pairs that may be within each row's limit."""
        rows, length, least = right
        slack = (rows.shape[1] + 8) * 2.0**-23 * self.length[at] * length + 1e-9 * (1 + self.square[at])
        need = self.square[at] - limit - slack
        if not length * self.length[at].max(initial=0.0) < 1e37:  # beyond single precision
            return np.divmod(np.arange(len(need) * len(rows)), len(rows))
        found = self.left[at] @ rows.T >= np.nextafter(need.astype(np.float32), np.float32(-np.inf))[:, None]
        if self.clamped:
            found[limit >= self.square[at] + least - slack] = True
        return np.divmod(np.flatnonzero(found), len(rows))
