"""The same encoding and distances as Column expressions: no Python on the executors, and plain to compare with SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .space import Space


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def hadamard(x: Column, d: int) -> Column:
    """Orthonormal transform by the definition: entry (i, j) is -1 to the number of bits that i and j share."""
    sign = lambda i, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    row = lambda v, j: F.aggregate(F.transform(v, lambda t, i: t * sign(i, j)), F.lit(0.0), lambda a, t: a + t) / F.sqrt(F.lit(float(d)))
    return bind(x, lambda v: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: row(v, j)))


def checked(x: Column, space: Space) -> Column:
    """The vector as doubles; an error for another length, null for a null vector."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {space.dim} dimensions, got "), F.size(x).cast("string")))
    return F.when(x.isNull(), F.lit(None)).when(F.size(x) != space.dim, wrong).otherwise(doubles(x))


def rotated(x: Column, space: Space) -> Column:
    pad = F.array_repeat(F.lit(0.0), space.padded_dim - space.dim)
    unit = bind(norm(x), lambda n: F.transform(x, lambda v: F.when(n > 1e-10, v / n).otherwise(F.lit(0.0))))
    return hadamard(F.zip_with(F.concat(unit, pad) if space.padded else unit, _literal(space.rot_signs), lambda a, b: a * b), space.padded_dim)


def code(x: Column, space: Space) -> Column:
    """Struct of levels, signs (0/1), and float norm, gamma, sigma."""
    d = float(space.padded_dim)

    def from_rotated(r: Column) -> Column:
        return bind(F.greatest(F.sqrt(dot(r, r) / d), F.lit(1e-10)), lambda sigma: quantised(r, sigma))

    def quantised(r: Column, sigma: Column) -> Column:
        bounds = _literal(space.boundaries)
        levels = F.transform(r, lambda v: F.size(F.filter(bounds, lambda b: v / sigma > b)))
        return bind(levels, lambda q: residual(r, sigma, q))

    def residual(r: Column, sigma: Column, q: Column) -> Column:
        e = F.zip_with(r, q, lambda v, i: v - F.get(_literal(space.centroids), i) * sigma)
        return bind(e, lambda e: F.struct(
            q.alias("levels"),
            F.transform(hadamard(F.zip_with(e, _literal(space.qjl_signs), lambda a, b: a * b), space.padded_dim), lambda v: F.when(v >= 0, 1).otherwise(0)).alias("signs"),
            norm(x).cast("float").alias("norm"), norm(e).cast("float").alias("gamma"), sigma.cast("float").alias("sigma"),
        ))

    return bind(checked(x, space), lambda v: F.when(v.isNotNull(), bind(rotated(v, space), from_rotated)))


def packed(levels: Column, signs: Column, space: Space) -> Column:
    """BINARY of the code's units, by way of hexadecimal digits."""
    unit = F.zip_with(levels, signs, lambda q, s: q * 2 + s)
    hexed = lambda u: F.lpad(F.hex(u), 2, "0")
    if not space.nibbles:
        return F.unhex(F.array_join(F.transform(unit, hexed), ""))
    pairs = bind(unit, lambda u: F.transform(F.sequence(F.lit(0), F.lit(space.packed_bytes - 1)), lambda i: F.get(u, 2 * i) + 16 * F.get(u, 2 * i + 1)))
    return F.unhex(F.array_join(F.transform(pairs, hexed), ""))


def units(binary: Column, space: Space) -> Column:
    """The units of a packed code as integers."""
    byte = lambda i: F.conv(F.hex(F.substring(binary, i + 1, F.lit(1))), 16, 10).cast("int")
    all_bytes = F.transform(F.sequence(F.lit(0), F.lit(space.packed_bytes - 1)), byte)
    if not space.nibbles:
        return all_bytes
    return F.flatten(F.transform(all_bytes, lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4))))


def decoded(packed_: Column, norm_: Column, gamma: Column, sigma: Column, space: Space) -> Column:
    """Struct of c, h, s (+1/-1), norm and gamma as doubles."""
    sg = sigma.cast("double")

    def from_units(u: Column) -> Column:
        c = F.transform(u, lambda v: F.get(_literal(space.centroids), F.shiftright(v, 1)) * sg)
        return bind(c, lambda c: F.struct(
            c.alias("c"), hadamard(F.zip_with(c, _literal(space.qjl_signs), lambda a, b: a * b), space.padded_dim).alias("h"),
            F.transform(u, lambda v: v.bitwiseAND(1) * 2.0 - 1.0).alias("s"), norm_.cast("double").alias("norm"), gamma.cast("double").alias("gamma"),
        ))

    return bind(units(packed_, space), from_units)


def distance(left: Column, right: Column, space: Space, mode: str) -> Column:
    """Squared distance of two decoded structs, or for "asym" of a struct (twice, norm) and a decoded one."""
    k = F.lit(space.scale)
    g = lambda x: F.zip_with(x["h"], x["s"], lambda h, s: h + k * x["gamma"] * s)
    if mode == "asym":
        ip = dot(left["twice"], g(right))
    else:
        first = dot(left["c"], right["c"])
        clamp = lambda t, more: t + F.greatest(-F.abs(t), F.least(F.abs(t), more))
        if mode == "sym":
            ip = first
        elif mode == "light":
            ip = bind(first, lambda t: clamp(t, k * k * left["gamma"] * right["gamma"] * dot(left["s"], right["s"])))
        elif mode == "full":
            ip = bind(first, lambda t: clamp(t, dot(g(left), g(right)) - t))
        else:
            raise ValueError(f"unknown mode {mode!r}")
    return F.greatest(F.lit(0.0), left["norm"] * left["norm"] + right["norm"] * right["norm"] - 2.0 * ip * left["norm"] * right["norm"])


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, v: acc + v)
