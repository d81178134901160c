"""SQL text of codes and distances, with the constants of a space written out, for an independent engine."""

from __future__ import annotations

from ..functions.space import Space


def _list(values) -> str:
    return "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in map(float, values)) + "]"


_SIGN = "(CASE WHEN bit_count(CAST({a} & {b} AS BIGINT)) % 2 = 0 THEN 1.0 ELSE -1.0 END)"


def codes(space: Space, vectors: str = "SELECT vec_id, embedding FROM embeddings", name: str = "code") -> str:
    """CTEs ending in ``name``(vec_id, levels, signs, norm, gamma, sigma) and, before it, ``name``_r (vec_id, j, r, sigma)."""
    d = space.padded_dim
    sign = _SIGN.format(a="a.i", b="t.i")
    return f"""
{name}_x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM ({vectors}) WHERE embedding IS NOT NULL),
{name}_n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda t: t * t))) AS norm FROM {name}_x),
{name}_u AS (SELECT vec_id, t.i AS i, (CASE WHEN norm > 1e-10 AND t.i < {space.dim} THEN x[t.i + 1] / norm ELSE 0 END) * {_list(space.rot_signs)}[t.i + 1] AS w
  FROM {name}_n, range(0, {d}) AS t(i)),
{name}_w AS (SELECT a.vec_id, t.i AS j, sum(a.w * {sign}) / sqrt({d}.0) AS r FROM {name}_u AS a, range(0, {d}) AS t(i) GROUP BY 1, 2),
{name}_r AS (SELECT vec_id, j, r, greatest(sqrt(avg(r * r) OVER (PARTITION BY vec_id)), 1e-10) AS sigma FROM {name}_w),
{name}_q AS (SELECT vec_id, j, r, sigma, len(list_filter({_list(space.boundaries)}, lambda b: b < r / sigma)) AS q FROM {name}_r),
{name}_e AS (SELECT vec_id, j AS i, q, sigma, r - {_list(space.centroids)}[q + 1] * sigma AS e FROM {name}_q),
{name}_s AS (SELECT a.vec_id, t.i AS j, sum(a.e * {_list(space.qjl_signs)}[a.i + 1] * {sign}) >= 0 AS s FROM {name}_e AS a, range(0, {d}) AS t(i) GROUP BY 1, 2),
{name} AS (SELECT e.vec_id, list(e.q ORDER BY e.i) AS levels, list(CASE WHEN s.s THEN 1 ELSE 0 END ORDER BY e.i) AS signs,
  CAST(any_value(n.norm) AS FLOAT) AS norm, CAST(sqrt(sum(e.e * e.e)) AS FLOAT) AS gamma, CAST(any_value(e.sigma) AS FLOAT) AS sigma
  FROM {name}_e AS e JOIN {name}_s AS s ON e.vec_id = s.vec_id AND e.i = s.j JOIN {name}_n AS n ON n.vec_id = e.vec_id GROUP BY e.vec_id)"""


def decoded(space: Space, source: str = "code", name: str = "dec") -> str:
    """CTEs ending in ``name``(vec_id, c, h, s, g, norm, gamma)."""
    d, k = space.padded_dim, space.scale
    sign = _SIGN.format(a="a.i", b="t.i")
    return f"""
{name}_c AS (SELECT vec_id, t.i AS i, {_list(space.centroids)}[levels[t.i + 1] + 1] * CAST(sigma AS DOUBLE) AS c, CAST(signs[t.i + 1] * 2 - 1 AS DOUBLE) AS s FROM {source}, range(0, {d}) AS t(i)),
{name}_h AS (SELECT a.vec_id, t.i AS i, sum(a.c * {_list(space.qjl_signs)}[a.i + 1] * {sign}) / sqrt({d}.0) AS h FROM {name}_c AS a, range(0, {d}) AS t(i) GROUP BY 1, 2),
{name} AS (SELECT c.vec_id, list(c.c ORDER BY c.i) AS c, list(h.h ORDER BY c.i) AS h, list(c.s ORDER BY c.i) AS s,
  list(h.h + {k!r} * CAST(f.gamma AS DOUBLE) * c.s ORDER BY c.i) AS g, any_value(CAST(f.norm AS DOUBLE)) AS norm, any_value(CAST(f.gamma AS DOUBLE)) AS gamma
  FROM {name}_c AS c JOIN {name}_h AS h ON c.vec_id = h.vec_id AND c.i = h.i JOIN {source} AS f ON f.vec_id = c.vec_id GROUP BY c.vec_id)"""


def prepared(space: Space, source: str = "code", name: str = "prep") -> str:
    """CTEs ending in ``name``(vec_id, twice, norm): raw vectors rotated twice, from the CTEs of ``codes``."""
    d = space.padded_dim
    sign = _SIGN.format(a="a.j", b="t.i")
    return f"""
{name}_t AS (SELECT a.vec_id, t.i AS i, sum(a.r * {_list(space.qjl_signs)}[a.j + 1] * {sign}) / sqrt({d}.0) AS h FROM {source}_r AS a, range(0, {d}) AS t(i) GROUP BY 1, 2),
{name} AS (SELECT t.vec_id, list(t.h ORDER BY t.i) AS twice, any_value(n.norm) AS norm FROM {name}_t AS t JOIN {source}_n AS n ON n.vec_id = t.vec_id GROUP BY t.vec_id)"""


def distance(space: Space, mode: str, a: str = "a", b: str = "b") -> str:
    """Squared distance of two rows of ``decoded`` (for "asym", the first of ``prepared``)."""
    dot = lambda x, y: f"list_inner_product({a}.{x}, {b}.{y})"
    t = dot("c", "c")
    clamp = lambda more: f"({t} + greatest(-abs({t}), least(abs({t}), {more})))"
    ip = {
        "asym": dot("twice", "g"),
        "sym": t,
        "light": clamp(f"{space.scale**2!r} * {a}.gamma * {b}.gamma * {dot('s', 's')}"),
        "full": clamp(f"{dot('g', 'g')} - {t}"),
    }[mode]
    return f"greatest(0.0, {a}.norm * {a}.norm + {b}.norm * {b}.norm - 2.0 * {ip} * {a}.norm * {b}.norm)"


EXACT = "list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def ranked(pairs: str, k: int) -> str:
    """(query_id, rank, vec_id, dist) of a query for (query_id, vec_id, dist)."""
    return f"SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INTEGER) AS rank FROM ({pairs})) WHERE rank <= {k}"
