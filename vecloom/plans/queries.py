"""Queries over ``embeddings``; each has the SQL that an independent engine answers alike, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.space import Space, lloyd_max
from ..operators import analytics as A
from ..operators import codes as E
from ..operators import distances as D
from ..operators import ranks as R
from ..runtime import table
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
N_QUERY, K = 20, 10
B4, B8 = Space(64, 4), Space(64, 8)
X = "SELECT vec_id, embedding FROM embeddings"
SCALED = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x * (1 + label) AS FLOAT)) AS embedding FROM embeddings"
SHORT = "SELECT vec_id, embedding[1:48] AS embedding FROM embeddings"


def _query(name: str, sql: str | None = None):
    def add(func):
        QUERIES[name] = func
        if sql is not None:
            SQL[name] = sql
        return func

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols or ("dist",)})


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return E.split_queries(df, N_QUERY)


def _searched(df: DataFrame, space: Space | None, mode: str, k: int = K) -> DataFrame:
    queries, base = _split(df)
    if mode == "exact":
        return D.search(queries, base, None, k, "exact")
    base = E.encode(base, space)
    return D.search(queries if mode == "asym" else E.encode(queries, space), base, space, k, mode)


def _exact_sql(vectors: str = X, k: int = K) -> str:
    pairs = f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {S.EXACT.format(a='a.embedding', b='b.embedding')} AS dist FROM ({vectors}) AS a, ({vectors}) AS b WHERE a.vec_id < {N_QUERY} AND b.vec_id >= {N_QUERY}"
    return S.ranked(pairs, k)


def _pairs_sql(space: Space, mode: str, vectors: str = X, where: str = f"a.vec_id < {N_QUERY} AND b.vec_id >= {N_QUERY}") -> tuple[str, str]:
    """(CTEs, pairs query) of a mode."""
    left = "prep" if mode == "asym" else "dec"
    ctes = S.codes(space, vectors) + "," + S.decoded(space) + ("," + S.prepared(space) if mode == "asym" else "")
    return ctes, f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {S.distance(space, mode)} AS dist FROM {left} AS a, dec AS b WHERE {where}"


def _search_sql(space: Space, mode: str, vectors: str = X, k: int = K) -> str:
    ctes, pairs = _pairs_sql(space, mode, vectors)
    return f"WITH {ctes} {S.ranked(pairs, k)}"


@_query("l2_norms", f"SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda t: t * t))), 6) AS norm FROM ({SCALED})")
def l2_norms(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * (1 + F.col("label"))).cast("float")).alias("embedding"))
    return _rounded(A.norms(df).select("vec_id", "norm"), "norm")


@_query("rotate_wht", f"WITH {S.codes(B4)} SELECT vec_id, CAST(j AS INTEGER) AS pos, round(r, 6) AS value FROM code_r")
def rotate_wht(spark, d):
    return _rounded(A.coords_long(_vectors(spark, d).select("vec_id", C.rotated(C.doubles(F.col("embedding")), B4).alias("coords"))), "value")


@_query("rotated_coords", f"WITH {S.codes(B4, SHORT)} SELECT vec_id, CAST(j AS INTEGER) AS pos, round(r / sigma, 6) AS value FROM code_r")
def rotated_coords(spark, d):
    return _rounded(A.coords_long(E.rotated_coords(E.truncate(_vectors(spark, d), 48), Space(48, 4)).select("vec_id", "coords")), "value")


SQL["rotated_coords"] = f"WITH {S.codes(Space(48, 4), SHORT)} SELECT vec_id, CAST(j AS INTEGER) AS pos, round(r / sigma, 6) AS value FROM code_r"


def _units(space: Space):
    def run(spark, d):
        coded = E.encode(_vectors(spark, d), space)
        return coded.select("vec_id", F.lower(F.hex("code.packed")).alias("packed"))

    return run


def _units_sql(space: Space) -> str:
    unit = "levels[i + 1] * 2 + signs[i + 1]"
    byte = unit if not space.nibbles else "levels[2 * i + 1] * 2 + signs[2 * i + 1] + 16 * (levels[2 * i + 2] * 2 + signs[2 * i + 2])"
    return f"WITH {S.codes(space)} SELECT vec_id, array_to_string(list_transform(range(0, {space.packed_bytes}), lambda i: lower(lpad(to_hex(CAST({byte} AS BIGINT)), 2, '0'))), '') AS packed FROM code"


for _b, _space in ((2, Space(64, 2)), (4, B4), (6, Space(64, 6)), (8, B8)):
    _query(f"encode_units_b{_b}", _units_sql(_space))(_units(_space))


@_query("encode_sql_engine", _units_sql(B4))
def encode_sql_engine(spark, d):
    return E.encode(_vectors(spark, d), B4, engine="sql").select("vec_id", F.lower(F.hex("code.packed")).alias("packed"))


@_query("encode_meta_b8", f"WITH {S.codes(B8, SCALED)} SELECT vec_id, round(CAST(norm AS DOUBLE), 4) AS norm, round(CAST(gamma AS DOUBLE), 6) AS gamma, round(CAST(sigma AS DOUBLE), 6) AS sigma FROM code")
def encode_meta_b8(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * (1 + F.col("label"))).cast("float")).alias("embedding"))
    coded = E.encode(df, B8)
    return coded.select("vec_id", F.round(F.col("code.norm").cast("double"), 4).alias("norm"), *[F.round(F.col(f"code.{f}").cast("double"), 6).alias(f) for f in ("gamma", "sigma")])


@_query("exact_l2_topk", _exact_sql())
def exact_l2_topk(spark, d):
    return _rounded(_searched(_vectors(spark, d), None, "exact"))


@_query("exact_l2_column", f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({S.EXACT.format(a='a.embedding', b='b.embedding')}, 6) AS dist FROM embeddings AS a, embeddings AS b WHERE a.vec_id < {N_QUERY} AND b.vec_id >= {N_QUERY}")
def exact_l2_column(spark, d):
    queries, base = _split(_vectors(spark, d))
    few = F.broadcast(queries.withColumnRenamed("embedding", "q"))  # N_QUERY rows
    return _rounded(base.join(few).select("query_id", "vec_id", C.squared_l2(F.col("q"), F.col("embedding")).alias("dist")))


@_query("asym_1_to_n")
def asym_1_to_n(spark, d):
    df = _vectors(spark, d)
    first = df.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    return _rounded(D.pairwise(first, E.encode(df.where("vec_id > 0"), B8), B8, "asym"))


_c, _p = _pairs_sql(B8, "asym", where="a.vec_id = 0 AND b.vec_id > 0")
SQL["asym_1_to_n"] = f"WITH {_c} SELECT query_id, vec_id, round(dist, 6) AS dist FROM ({_p})"


@_query("asym_nearest")
def asym_nearest(spark, d):
    df = _vectors(spark, d)
    first = df.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    return _rounded(D.nearest(D.pairwise(first, E.encode(df.where("vec_id > 0"), B8), B8, "asym"), K))


SQL["asym_nearest"] = f"WITH {_c} SELECT query_id, vec_id, round(dist, 6) AS dist FROM ({_p}) ORDER BY dist, vec_id LIMIT {K}"

for _mode in ("asym", "sym", "light", "full"):
    for _b, _space in ((4, B4), (8, B8)):
        _query(f"{_mode}_topk_b{_b}", _search_sql(_space, _mode))(lambda spark, d, m=_mode, s=_space: _rounded(_searched(_vectors(spark, d), s, m)))


def _all_pairs(space: Space, mode: str):
    def run(spark, d):
        queries, base = _split(_vectors(spark, d))
        return _rounded(D.pairwise(E.encode(queries, space) if mode != "asym" else queries, E.encode(base, space), space, mode))

    return run


for _mode in ("asym", "sym", "light", "full"):
    _c, _p = _pairs_sql(B4, _mode)
    _query(f"{_mode}_m_to_n", f"WITH {_c} SELECT query_id, vec_id, round(dist, 6) AS dist FROM ({_p})")(_all_pairs(B4, _mode))


@_query("sym_full_prepared_m_to_n", SQL["full_m_to_n"])
def sym_full_prepared_m_to_n(spark, d):
    queries, base = _split(_vectors(spark, d))
    left = F.broadcast(E.decode(E.encode(queries, B4), B4).select("query_id", F.struct("c", "h", "s", "norm", "gamma").alias("a")))  # N_QUERY rows
    right = E.decode(E.encode(base, B4), B4).select("vec_id", F.struct("c", "h", "s", "norm", "gamma").alias("b"))
    return _rounded(right.join(left).select("query_id", "vec_id", C.distance(F.col("a"), F.col("b"), B4, "full").alias("dist")))


@_query("prepare_queries", f"WITH {S.codes(B8)},{S.prepared(B8)} SELECT vec_id AS query_id, CAST(t.i AS INTEGER) AS pos, round(twice[t.i + 1], 6) AS value, round(norm, 6) AS q_norm FROM prep, range(0, 64) AS t(i) WHERE vec_id < {N_QUERY}")
def prepare_queries(spark, d):
    queries, _ = _split(_vectors(spark, d))
    out = E.prepare_queries(queries, B8).select("query_id", "q_norm", F.posexplode("s_q").alias("pos", "value"))
    return _rounded(out, "value", "q_norm")


@_query("decode_values", f"WITH {S.codes(B4)},{S.decoded(B4)} SELECT vec_id, CAST(t.i AS INTEGER) AS pos, round(c[t.i + 1], 6) AS c, round(h[t.i + 1], 6) AS h, s[t.i + 1] AS s FROM dec, range(0, 64) AS t(i) WHERE vec_id < {N_QUERY}")
def decode_values(spark, d):
    out = E.decode(E.encode(_vectors(spark, d).where(F.col("vec_id") < N_QUERY), B4), B4, engine="sql")
    return _rounded(out.select("vec_id", F.posexplode(F.arrays_zip("c", "h", "s")).alias("pos", "v")).select("vec_id", "pos", "v.c", "v.h", "v.s"), "c", "h")


_HITS = "SELECT {k} AS k, count(*) FILTER (WHERE f.rank <= {k} AND t.rank <= {k}) AS hits, count(*) FILTER (WHERE f.rank <= {k} AND t.rank <= {k}) / CAST({n} * {k} AS DOUBLE) AS recall FROM found AS f JOIN truth AS t ON f.query_id = t.query_id AND f.vec_id = t.vec_id"


@_query("recall_at_k", f"WITH {_pairs_sql(B4, 'asym')[0]}, found AS ({S.ranked(_pairs_sql(B4, 'asym')[1], 100)}), truth AS ({_exact_sql(k=100)}) " + " UNION ALL ".join(_HITS.format(k=k, n=N_QUERY) for k in (1, 10, 100)))
def recall_at_k(spark, d):
    df = _vectors(spark, d)
    return A.recall(_searched(df, B4, "asym", 100), _searched(df, None, "exact", 100))


@_query("label_recall", f"WITH {_pairs_sql(B4, 'sym')[0]}, found AS ({S.ranked(_pairs_sql(B4, 'sym')[1], K)}), truth AS ({_exact_sql()}) SELECT e.label AS label, count(f.vec_id) AS hits, count(DISTINCT t.query_id) AS queries, count(f.vec_id) / CAST(count(DISTINCT t.query_id) * {K} AS DOUBLE) AS recall FROM truth AS t JOIN embeddings AS e ON e.vec_id = t.query_id LEFT JOIN found AS f ON f.query_id = t.query_id AND f.vec_id = t.vec_id GROUP BY e.label")
def label_recall(spark, d):
    df = _vectors(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return A.recall_by(_searched(df, B4, "sym"), _searched(df, None, "exact"), K, labels, "label")


#: The truth, and the estimates by name.
_MODES = (None, "exact", "embedding", "embedding"), {m: (B4, m, "embedding" if m == "asym" else "code", "code") for m in ("asym", "sym", "light", "full")}


@_query("rmse_by_mode", f"WITH {S.codes(B4)},{S.decoded(B4)},{S.prepared(B4)}, truth AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {S.EXACT.format(a='a.embedding', b='b.embedding')} AS t FROM embeddings AS a, embeddings AS b WHERE a.vec_id < {N_QUERY} AND b.vec_id >= {N_QUERY}), est AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, a.vec_id AS query_id, b.vec_id AS vec_id, {S.distance(B4, m)} AS dist FROM {'prep' if m == 'asym' else 'dec'} AS a, dec AS b WHERE a.vec_id < {N_QUERY} AND b.vec_id >= {N_QUERY}" for m in ("asym", "sym", "light", "full")) + ") SELECT mode, count(*) AS n, round(sqrt(avg((dist - t) * (dist - t))), 6) AS rmse, round(sqrt(avg((dist - t) * (dist - t))) / avg(t), 6) AS relative FROM est JOIN truth USING (query_id, vec_id) GROUP BY mode")
def rmse_by_mode(spark, d):
    queries, base = _split(E.encode(_vectors(spark, d), B4, keep=True))
    return _rounded(D.rmse_by_mode(queries, base, *_MODES), "rmse", "relative")


@_query("compare_modes", f"WITH {S.codes(B8)},{S.decoded(B8)} SELECT a.vec_id AS query_id, b.vec_id AS vec_id, " + ", ".join(f"round({S.distance(B8, m)}, 6) AS {m}_dist" for m in ("sym", "light", "full")) + " FROM dec AS a, dec AS b WHERE a.vec_id < 3 AND b.vec_id BETWEEN 3 AND 5")
def compare_modes(spark, d):
    coded = E.encode(_vectors(spark, d).where("vec_id < 6"), B8)
    left, right = coded.where("vec_id < 3").withColumnRenamed("vec_id", "query_id"), coded.where("vec_id >= 3")
    out = D.side_by_side(left, right, {f"{m}_dist": (B8, m, "code", "code") for m in ("sym", "light", "full")})
    return _rounded(out, *[f"{m}_dist" for m in ("sym", "light", "full")])


@_query("compression_ratio", "SELECT CAST(dim AS INTEGER) AS dim, CAST(pad AS INTEGER) AS padded_dim, CAST(bits AS INTEGER) AS bits, CAST((CASE WHEN bits <= 4 THEN (pad + 1) // 2 ELSE pad END) + 12 AS INTEGER) AS code_size, round(dim * 4.0 / ((CASE WHEN bits <= 4 THEN (pad + 1) // 2 ELSE pad END) + 12), 6) AS compression_ratio FROM (VALUES (100, 128), (128, 128), (512, 512), (768, 1024), (1536, 2048), (3072, 4096)) AS s(dim, pad), (VALUES (4), (8)) AS b(bits)")
def compression_ratio(spark, d):
    return _rounded(A.sizes(spark, [100, 128, 512, 768, 1536, 3072], [4, 8]), "compression_ratio")


@_query("matryoshka_topk", _search_sql(Space(32, 8), "asym", "SELECT vec_id, embedding[1:32] AS embedding FROM embeddings"))
def matryoshka_topk(spark, d):
    return _rounded(_searched(E.truncate(_vectors(spark, d), 32), Space(32, 8), "asym"))


@_query("padded_dim48_topk", _search_sql(Space(48, 8), "full", SHORT))
def padded_dim48_topk(spark, d):
    return _rounded(_searched(E.truncate(_vectors(spark, d), 48), Space(48, 8), "full"))


def _scaled(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * (1 + F.col("label"))).cast("float")).alias("embedding"))


def _coarse(sql: str) -> str:
    return sql.replace("round(dist, 6)", "round(dist, 3)")  # norms up to 10 are stored in single precision


@_query("scaled_norm_topk", _coarse(_search_sql(B8, "sym", SCALED)))
def scaled_norm_topk(spark, d):
    return _rounded(_searched(_scaled(spark, d), B8, "sym"), "dist", places=3)


_UNIT = f"SELECT vec_id, list_transform(embedding, lambda t: CAST(CAST(t AS DOUBLE) / (CASE WHEN n = 0 THEN 1 ELSE n END) AS FLOAT)) AS embedding FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda t: CAST(t AS DOUBLE) * CAST(t AS DOUBLE)))) AS n FROM ({SCALED}))"


@_query("cosine_topk", _search_sql(B8, "asym", _UNIT))
def cosine_topk(spark, d):
    return _rounded(_searched(E.normalize(_scaled(spark, d)), B8, "asym"))


def _coords(spark, d):
    return A.coords_long(E.rotated_coords(_vectors(spark, d), B4).select("vec_id", "coords"))


_COORDS = f"WITH {S.codes(B4)}, v AS (SELECT r / sigma AS x FROM code_r)"


@_query("coord_moments", f"{_COORDS}, m AS (SELECT count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM v) SELECT any_value(n) AS n, round(any_value(mu), 6) AS mean, round(any_value(sd), 6) AS std, round(avg(pow((x - mu) / sd, 3)), 6) AS skew, round(avg(pow((x - mu) / sd, 4)) - 3, 6) AS kurt FROM v, m")
def coord_moments(spark, d):
    return _rounded(A.moments(_coords(spark, d)), "mean", "std", "skew", "kurt")


@_query("coord_percentiles", _COORDS + " " + " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(x, {q}), 6) AS value FROM v" for q in (0.01, 0.05, 0.95, 0.99)))
def coord_percentiles(spark, d):
    return _rounded(A.percentiles(_coords(spark, d)), "value")


@_query("coord_histogram", f"{_COORDS}, b AS (SELECT CAST(CASE WHEN x < -4 THEN 0 WHEN x >= 4 THEN 33 ELSE floor((x + 4) / 0.25) + 1 END AS BIGINT) AS bin FROM v) SELECT bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * 0.25), 6) AS density FROM b GROUP BY bin")
def coord_histogram(spark, d):
    return _rounded(A.histogram(_coords(spark, d), -4.0, 4.0, 32), "density")


@_query("moments_by_label", f"WITH {S.codes(B4)}, v AS (SELECT e.label, r / sigma AS x FROM code_r JOIN embeddings AS e USING (vec_id)), m AS (SELECT label, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM v GROUP BY label) SELECT label, any_value(n) AS n, round(any_value(mu), 6) AS mean, round(any_value(sd), 6) AS std, round(avg(pow((x - mu) / sd, 3)), 6) AS skew, round(avg(pow((x - mu) / sd, 4)) - 3, 6) AS kurt FROM v JOIN m USING (label) GROUP BY label")
def moments_by_label(spark, d):
    df = table(spark, d, "embeddings").select("label", "embedding")
    coords = A.coords_long(E.rotated_coords(df, B4).select("label", "coords"), id_col="label")
    return _rounded(A.moments(coords, by=["label"]), "mean", "std", "skew", "kurt")


@_query("quant_mse", f"{_COORDS} SELECT count(*) AS n, round(avg(pow(x - {S._list(lloyd_max(3)[1])}[len(list_filter({S._list(lloyd_max(3)[0])}, lambda b: b < x)) + 1], 2)), 9) AS mse FROM v")
def quant_mse(spark, d):
    bounds, centres = lloyd_max(3)
    return _rounded(A.quant_mse(_coords(spark, d), list(centres), list(bounds)), "mse", places=9)


_RANK = "row_number() OVER (ORDER BY {c}) AS i, {c}"


def _with_short(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).withColumn("short", F.slice("embedding", 1, 48))


@_query("spearman_norm", f"WITH p AS (SELECT {S.EXACT.format(a='a.embedding', b='b.embedding')} AS x, {S.EXACT.format(a='c.embedding', b='d.embedding')} AS y FROM embeddings AS a JOIN ({SHORT}) AS c USING (vec_id), embeddings AS b JOIN ({SHORT}) AS d USING (vec_id) WHERE a.vec_id < {N_QUERY} AND b.vec_id >= {N_QUERY}), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p) SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r")
def spearman_norm(spark, d):
    return _rounded(R.spearman_of_pairs(*_split(_with_short(spark, d)), "embedding", "short"), "rho")


_KNN, _KNN_PAIRS = _pairs_sql(B8, "full", where="a.vec_id <> b.vec_id")


@_query("knn_graph", f"WITH {_KNN} {S.ranked(_KNN_PAIRS, 5)}")
def knn_graph(spark, d):
    return _rounded(D.knn_graph(_vectors(spark, d), B8, 5))


_NEAR = _pairs_sql(B8, "full", where="a.vec_id < b.vec_id")[1]


@_query("near_dup_pairs", f"WITH {_KNN} SELECT query_id, vec_id, round(dist, 6) AS dist FROM ({_NEAR}) WHERE dist <= 1.0")
def near_dup_pairs(spark, d):
    codes = E.encode(_vectors(spark, d), B8)
    return _rounded(D.within(codes.withColumnRenamed("vec_id", "query_id"), codes, B8, 1.0, "full", ordered=True))


@_query("unpivot_metrics", "SELECT label, metric, value FROM (SELECT label, round(avg(list_extract(embedding, 1)), 6) AS first_mean, round(avg(list_extract(embedding, 64)), 6) AS last_mean, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY label) UNPIVOT (value FOR metric IN (first_mean, last_mean, n))")
def unpivot_metrics(spark, d):
    wide = table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(F.element_at("embedding", 1)), 6).alias("first_mean"), F.round(F.avg(F.element_at("embedding", 64)), 6).alias("last_mean"), F.count("*").cast("double").alias("n"))
    return A.unpivot(wide, ["label"], ["first_mean", "last_mean", "n"])


@_query("code_wire_roundtrip", _units_sql(B4))
def code_wire_roundtrip(spark, d):
    wire = E.encode(_vectors(spark, d), B4).select("vec_id", E.to_wire(F.col("code")).alias("wire"))
    return E.from_wire(wire, B4).select("vec_id", F.lower(F.hex("code.packed")).alias("packed"))


#: The whole query set: every id divisible by QUERY_EVERY against all other rows. The queries above keep the first N_QUERY ids that their SQL has.
QUERY_EVERY = 100
_WHOLE = f"a.vec_id % {QUERY_EVERY} = 0 AND a.vec_id <> b.vec_id"


def _whole_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id"), df


def _whole_searched(df: DataFrame, space: Space | None, mode: str, k: int = K) -> DataFrame:
    queries, base = _whole_split(df)
    if mode != "exact":
        queries, base = queries if mode == "asym" else E.encode(queries, space), E.encode(base, space)
    return D.search(queries, base, space, k, mode, others=True)


def _whole_pairs(df: DataFrame, space: Space | None, mode: str) -> DataFrame:
    queries, base = _whole_split(df)
    if mode != "exact":
        queries, base = queries if mode == "asym" else E.encode(queries, space), E.encode(base, space)
    return D.pairwise(queries, base, space, mode).where("query_id <> vec_id")


_WHOLE_EXACT = f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {S.EXACT.format(a='a.embedding', b='b.embedding')} AS dist FROM ({{v}}) AS a, ({{v}}) AS b WHERE {_WHOLE}"


def _whole_search_sql(space: Space, mode: str, vectors: str = X) -> str:
    ctes, pairs = _pairs_sql(space, mode, vectors, _WHOLE)
    return f"WITH {ctes} {S.ranked(pairs, K)}"


_query("exact_l2_topk_whole", S.ranked(_WHOLE_EXACT.format(v=X), K))(lambda spark, d: _rounded(_whole_searched(_vectors(spark, d), None, "exact")))
_query("exact_l2_column_whole", f"SELECT query_id, vec_id, round(dist, 6) AS dist FROM ({_WHOLE_EXACT.format(v=X)})")(lambda spark, d: _rounded(_whole_pairs(_vectors(spark, d), None, "exact")))
for _mode in ("asym", "sym", "light", "full"):
    for _b, _space in ((4, B4), (8, B8)):
        _query(f"{_mode}_topk_b{_b}_whole", _whole_search_sql(_space, _mode))(lambda spark, d, m=_mode, s=_space: _rounded(_whole_searched(_vectors(spark, d), s, m)))
    _c, _p = _pairs_sql(B4, _mode, where=_WHOLE)
    _query(f"{_mode}_m_to_n_whole", f"WITH {_c} SELECT query_id, vec_id, round(dist, 6) AS dist FROM ({_p})")(lambda spark, d, m=_mode: _rounded(_whole_pairs(_vectors(spark, d), B4, m)))
_query("matryoshka_topk_whole", _whole_search_sql(Space(32, 8), "asym", "SELECT vec_id, embedding[1:32] AS embedding FROM embeddings"))(lambda spark, d: _rounded(_whole_searched(E.truncate(_vectors(spark, d), 32), Space(32, 8), "asym")))
_query("padded_dim48_topk_whole", _whole_search_sql(Space(48, 8), "full", SHORT))(lambda spark, d: _rounded(_whole_searched(E.truncate(_vectors(spark, d), 48), Space(48, 8), "full")))
_query("scaled_norm_topk_whole", _coarse(_whole_search_sql(B8, "sym", SCALED)))(lambda spark, d: _rounded(_whole_searched(_scaled(spark, d), B8, "sym"), "dist", places=3))
_query("cosine_topk_whole", _whole_search_sql(B8, "asym", _UNIT))(lambda spark, d: _rounded(_whole_searched(E.normalize(_scaled(spark, d)), B8, "asym")))


@_query("prepare_queries_whole", SQL["prepare_queries"].replace(f"WHERE vec_id < {N_QUERY}", f"WHERE vec_id % {QUERY_EVERY} = 0"))
def prepare_queries_whole(spark, d):
    out = E.prepare_queries(_whole_split(_vectors(spark, d))[0], B8).select("query_id", "q_norm", F.posexplode("s_q").alias("pos", "value"))
    return _rounded(out, "value", "q_norm")


@_query("decode_values_whole", SQL["decode_values"].removesuffix(f" WHERE vec_id < {N_QUERY}"))
def decode_values_whole(spark, d):
    out = E.decode(E.encode(_vectors(spark, d), B4), B4, engine="sql")
    return _rounded(out.select("vec_id", F.posexplode(F.arrays_zip("c", "h", "s")).alias("pos", "v")).select("vec_id", "pos", "v.c", "v.h", "v.s"), "c", "h")


@_query("recall_at_k_whole", f"WITH {_pairs_sql(B4, 'asym')[0]}, found AS ({S.ranked(_pairs_sql(B4, 'asym', where=_WHOLE)[1], 100)}), truth AS ({S.ranked(_WHOLE_EXACT.format(v=X), 100)}) " + " UNION ALL ".join(_HITS.format(k=k, n="(SELECT count(DISTINCT query_id) FROM truth)") for k in (1, 10, 100)))
def recall_at_k_whole(spark, d):
    df = _vectors(spark, d)
    return A.recall(_whole_searched(df, B4, "asym", 100), _whole_searched(df, None, "exact", 100))


@_query("label_recall_whole", f"WITH {_pairs_sql(B4, 'sym')[0]}, found AS ({S.ranked(_pairs_sql(B4, 'sym', where=_WHOLE)[1], K)}), truth AS ({S.ranked(_WHOLE_EXACT.format(v=X), K)}) SELECT e.label AS label, count(f.vec_id) AS hits, count(DISTINCT t.query_id) AS queries, count(f.vec_id) / CAST(count(DISTINCT t.query_id) * {K} AS DOUBLE) AS recall FROM truth AS t JOIN embeddings AS e ON e.vec_id = t.query_id LEFT JOIN found AS f ON f.query_id = t.query_id AND f.vec_id = t.vec_id GROUP BY e.label")
def label_recall_whole(spark, d):
    df = _vectors(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return A.recall_by(_whole_searched(df, B4, "sym"), _whole_searched(df, None, "exact"), K, labels, "label")


@_query("rmse_by_mode_whole", SQL["rmse_by_mode"].replace(f"a.vec_id < {N_QUERY} AND b.vec_id >= {N_QUERY}", _WHOLE))
def rmse_by_mode_whole(spark, d):
    queries, base = _whole_split(E.encode(_vectors(spark, d), B4, keep=True))
    return _rounded(D.rmse_by_mode(queries, base, *_MODES, others=True), "rmse", "relative")


@_query("compare_modes_whole", SQL["compare_modes"].replace("a.vec_id < 3 AND b.vec_id BETWEEN 3 AND 5", _WHOLE))
def compare_modes_whole(spark, d):
    names = {f"{m}_dist": (B8, m, "code", "code") for m in ("sym", "light", "full")}
    return _rounded(D.side_by_side(*_whole_split(E.encode(_vectors(spark, d), B8)), names).where("query_id <> vec_id"), *names)


@_query("spearman_norm_whole", SQL["spearman_norm"].replace(f"a.vec_id < {N_QUERY} AND b.vec_id >= {N_QUERY}", _WHOLE))
def spearman_norm_whole(spark, d):
    return _rounded(R.spearman_of_pairs(*_whole_split(_with_short(spark, d)), "embedding", "short"), "rho")


@_query("empirical_lloyd")
def empirical_lloyd(spark, d):
    points = A.empirical_codebook(_coords(spark, d), 2, rounds=30)
    return spark.createDataFrame(list(enumerate(points)), "level int, centroid double")


@_query("codebook_gain")
def codebook_gain(spark, d):
    return A.codebook_gain(_coords(spark, d), range(3, 9))


@_query("ks_test")
def ks_test(spark, d):
    return A.ks_normal(_coords(spark, d))


@_query("k_squared")
def k_squared(spark, d):
    return A.k_squared(_coords(spark, d))


@_query("qq_data")
def qq_data(spark, d):
    return A.normal_quantiles(_coords(spark, d), 19)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of vector 0."""
    return asym_nearest(spark, sf_dir)
