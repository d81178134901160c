"""The immutable configuration of a code: sizes, sign vectors and the scalar codebook."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_WRAP = (1 << 64) - 1


def splitmix64(seed: int):
    """An endless stream of the splitmix64 generator's 64-bit values."""
    state = seed & _WRAP
    while True:
        state = (state + 0x9E3779B97F4A7C15) & _WRAP
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _WRAP
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _WRAP
        yield z ^ (z >> 31)


@lru_cache(maxsize=64)
def sign_vector(d: int, seed: int) -> tuple[float, ...]:
    values = splitmix64(seed)
    return tuple(1.0 if next(values) & 1 else -1.0 for _ in range(d))


@lru_cache(maxsize=64)
def lloyd_max(bits: int, max_iter: int | None = 1000, tol: float = 1e-12) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(boundaries, centroids) of the symmetric scalar quantiser of N(0, 1) with 2**bits levels, rounded to float32.

    With ``max_iter=None`` it runs until it converges; the default cap stops short of that from 5 bits on, and is part
    of the code's definition.
    """
    half = 1 << (bits - 1)
    points = [(i + 0.5) * 3.5 / half for i in range(half)]
    density = lambda t: math.exp(-0.5 * t * t) / math.sqrt(2 * math.pi)
    upper = lambda t: 0.5 * math.erfc(t / math.sqrt(2))
    steps = 0
    while max_iter is None or steps < max_iter:
        steps += 1
        edges = [0.0, *((a + b) / 2 for a, b in zip(points, points[1:])), 1e10]
        moved, fresh = 0.0, []
        for old, lo, hi in zip(points, edges, edges[1:]):
            mass = upper(lo) - upper(hi)
            new = (density(lo) - density(hi)) / mass if mass > 1e-15 else (lo + hi) / 2
            moved = max(moved, abs(new - old))
            fresh.append(new)
        points = fresh
        if moved < tol:
            break
    inner = [(a + b) / 2 for a, b in zip(points, points[1:])]
    bounds = [-x for x in reversed(inner)] + [0.0] + inner
    centres = [-x for x in reversed(points)] + points
    single = lambda xs: tuple(float(np.float32(x)) for x in xs)
    return single(bounds), single(centres)


@dataclass(frozen=True)
class Space:
    """``bits_per_coord`` counts the scalar level's bits and one residual sign: 2 to 8."""

    dim: int
    bits_per_coord: int = 4
    rot_seed: int = 42
    qjl_seed: int = 137
    codebook: str = "capped"

    def __post_init__(self) -> None:
        if not isinstance(self.dim, int) or self.dim < 1:
            raise ValueError("dim must be a positive integer")
        if not 2 <= self.bits_per_coord <= 8:
            raise ValueError("bits_per_coord must be from 2 to 8")
        if self.codebook not in ("capped", "converged"):
            raise ValueError("codebook is 'capped' or 'converged'")

    @property
    def padded_dim(self) -> int:
        return 1 << (max(self.dim, 4) - 1).bit_length()

    @property
    def padded(self) -> bool:
        return self.padded_dim != self.dim

    @property
    def nibbles(self) -> bool:
        return self.bits_per_coord <= 4

    @property
    def packed_bytes(self) -> int:
        return (self.padded_dim + 1) // 2 if self.nibbles else self.padded_dim

    @property
    def code_size_bytes(self) -> int:
        return self.packed_bytes + 12

    @property
    def num_levels(self) -> int:
        return 1 << (self.bits_per_coord - 1)

    @property
    def scale(self) -> float:
        return math.sqrt(math.pi / 2) / math.sqrt(self.padded_dim)

    @property
    def boundaries(self) -> tuple[float, ...]:
        return lloyd_max(self.bits_per_coord - 1, 1000 if self.codebook == "capped" else None)[0]

    @property
    def centroids(self) -> tuple[float, ...]:
        return lloyd_max(self.bits_per_coord - 1, 1000 if self.codebook == "capped" else None)[1]

    @property
    def rot_signs(self) -> tuple[float, ...]:
        return sign_vector(self.padded_dim, self.rot_seed)

    @property
    def qjl_signs(self) -> tuple[float, ...]:
        return sign_vector(self.padded_dim, self.qjl_seed)

    @property
    def compression_ratio(self) -> float:
        return 4.0 * self.dim / self.code_size_bytes

    def manifest(self) -> dict:
        return {"dim": self.dim, "bits_per_coord": self.bits_per_coord, "rot_seed": self.rot_seed, "qjl_seed": self.qjl_seed, "codebook": self.codebook}
