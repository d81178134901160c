import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import columns as C
from vecloom.functions import kernels as K
from vecloom.functions.space import Space
from vecloom.operators import analytics as A
from vecloom.operators import codes as E
from vecloom.operators import distances as D
from vecloom.sources import vectors as V

SPACE = Space(12, 4)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.standard_normal(12)]) for i in range(40)]
    rows += [(40, [0.0] * 12), (41, rows[5][1]), (42, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def _codes(df):
    return {r["vec_id"]: None if r["code"] is None else (bytes(r["code"]["packed"]), r["code"]["norm"], r["code"]["gamma"], r["code"]["sigma"]) for r in df.collect()}


@pytest.mark.parametrize("space", [SPACE, Space(12, 8), Space(12, 3)])
def test_engines_agree(vectors, space):
    a, b = (_codes(E.encode(vectors.where("vec_id <> 40"), space, engine=e)) for e in ("arrow", "sql"))
    assert a.keys() == b.keys() and a.pop(42) is None and b.pop(42) is None and len(a) == 41
    for i, (packed, *floats) in a.items():
        assert packed == b[i][0] and floats == pytest.approx(list(b[i][1:]), rel=2e-7)  # a last bit of single precision


@pytest.mark.parametrize("mode", ["asym", "sym", "light", "full"])
def test_distances_of_both_engines(vectors, mode):
    some = vectors.where("vec_id < 6")
    codes = E.encode(some, SPACE)
    queries = (some if mode == "asym" else codes).withColumnRenamed("vec_id", "query_id")
    blocked = {(r["query_id"], r["vec_id"]): r["dist"] for r in D.pairwise(queries, codes, SPACE, mode).collect()}
    right = E.decode(codes, SPACE, engine="sql").select("vec_id", F.struct("c", "h", "s", "norm", "gamma").alias("b"))
    if mode == "asym":
        left = E.prepare_queries(queries, SPACE).select("query_id", F.struct(F.col("s_q").alias("twice"), F.col("q_norm").alias("norm")).alias("a"))
    else:
        left = E.decode(queries, SPACE).select("query_id", F.struct("c", "h", "s", "norm", "gamma").alias("a"))
    for r in right.join(F.broadcast(left)).select("query_id", "vec_id", C.distance(F.col("a"), F.col("b"), SPACE, mode).alias("dist")).collect():
        assert blocked[r["query_id"], r["vec_id"]] == pytest.approx(r["dist"], abs=1e-9)


def test_blocks_and_partitions_do_not_matter(vectors, monkeypatch):
    codes = E.encode(vectors, SPACE)
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, D.search(queries, codes, SPACE, 4, "asym").collect()))
    monkeypatch.setattr(D, "BROADCAST_QUERIES", 5)
    monkeypatch.setattr(D, "STRIP", 7)
    for parts in (1, 4, 17):
        got = sorted(map(tuple, D.search(queries, codes.repartition(parts), SPACE, 4, "asym", query_rows=11, shard_rows=9).collect()))
        assert [x[:3] for x in got] == [x[:3] for x in want]
        np.testing.assert_allclose([x[3] for x in got], [x[3] for x in want], atol=1e-9)


def test_ties_go_to_the_smaller_id(vectors):
    queries = vectors.where("vec_id = 5").withColumnRenamed("vec_id", "query_id")
    got = D.ground_truth(queries, vectors, 2).collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 5), (2, 41)]


def test_zero_vector_is_at_the_querys_square(vectors):
    q = [1.0, 2.0] + [0.0] * 10
    dist = {r["vec_id"]: r["dist"] for r in D.one_to_n(q, E.encode(vectors, SPACE), SPACE).collect()}
    assert dist[40] == pytest.approx(5.0) and 42 not in dist


def test_validation(spark, vectors):
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    with pytest.raises(ValueError):
        E.encode(wide, SPACE)
    assert E.encode(wide, SPACE, cast=True).count() == 43
    for engine in ("arrow", "sql"):
        with pytest.raises(Exception, match="12 dimensions|expected 12"):
            E.encode(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), SPACE, engine=engine).collect()
        bad = spark.createDataFrame([(1, [float("nan")] * 12), (2, [1.0] * 12)], "vec_id long, embedding array<float>")
        with pytest.raises(Exception, match="NaN"):
            E.encode(bad, SPACE, engine=engine).collect()
        assert {k: v is None for k, v in _codes(E.encode(bad, SPACE, engine=engine, invalid="null")).items()} == {1: True, 2: False}


def test_wire_form(vectors):
    codes = E.encode(vectors.where("vec_id <> 40"), SPACE)
    wire = codes.select("vec_id", E.to_wire(F.col("code")).alias("wire"))
    for r in codes.join(wire, "vec_id").where("code is not null").collect():
        c = r["code"]
        assert bytes(r["wire"]) == bytes(c["packed"]) + np.array([c["norm"], c["gamma"], c["sigma"]], "<f4").tobytes()
    assert _codes(E.from_wire(wire, SPACE)) == _codes(codes)


def test_storage_keeps_the_space(spark, vectors, tmp_path):
    V.write_codes(E.encode(vectors, SPACE), SPACE, str(tmp_path / "codes"))
    back, space = V.read_codes(spark, str(tmp_path / "codes"), SPACE)
    assert space == SPACE and _codes(back) == _codes(E.encode(vectors, SPACE))
    with pytest.raises(ValueError):
        V.read_codes(spark, str(tmp_path / "codes"), Space(12, 8))


def test_vector_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, ids = rng.standard_normal((23, 5)).astype("f4"), rng.integers(0, 99, (23, 4))
    V.write_fvecs(rows, str(tmp_path / "a.fvecs"))
    V.write_fvecs(ids, str(tmp_path / "a.ivecs"))
    got = V._read_vecs(spark, str(tmp_path / "a.fvecs"), 5, "float", block_bytes=100).orderBy("vec_id").collect()
    np.testing.assert_array_equal(np.array([r["embedding"] for r in got], "f4"), rows)
    truth = V.read_ivecs(spark, str(tmp_path / "a.ivecs"), 4).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in truth] == ids.reshape(-1).tolist() and truth[5]["rank"] == 2
    with pytest.raises(ValueError):
        V.read_fvecs(spark, str(tmp_path / "a.fvecs"), 6).collect()
    V.register_dataset(V.Dataset("tiny", str(tmp_path / "a.fvecs"), 5, limit=10, truncate_to=3, metric="cosine"))
    out = np.array([r["embedding"] for r in V.load_dataset(spark, "tiny").collect()])
    assert out.shape == (10, 3)
    np.testing.assert_allclose((out**2).sum(1), 1, rtol=1e-5)


def test_udfs(spark, vectors):
    E.register_udfs(spark, SPACE)
    vectors.where("vec_id in (1, 2, 42)").createOrReplaceTempView("v")
    got = spark.sql("SELECT a.vec_id i, b.vec_id j, vl_dist_sym(vl_encode(a.embedding), vl_encode(b.embedding)) s, vl_dist_asym(a.embedding, vl_encode(b.embedding)) t FROM v a, v b WHERE a.vec_id = 1 AND b.vec_id = 2").first()
    x = np.array([r["embedding"] for r in vectors.where("vec_id in (1, 2)").orderBy("vec_id").collect()])
    d = K.decode(SPACE, K.encode(SPACE, x))
    assert got["s"] == pytest.approx(K.distances(SPACE, "sym", d, d)[0, 1], rel=1e-9)
    assert got["t"] == pytest.approx(K.distances(SPACE, "asym", K.prepare(SPACE, x[:1]), d)[0, 1], rel=1e-9)


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(4000)
    df = spark.createDataFrame([(float(v),) for v in x], "value double")
    m = A.moments(df).first()
    z = (x - x.mean()) / x.std()
    assert m["skew"] == pytest.approx((z**3).mean(), abs=1e-9) and m["kurt"] == pytest.approx((z**4).mean() - 3, abs=1e-9)
    assert [r["value"] for r in A.percentiles(df).collect()] == pytest.approx(np.percentile(x, [1, 5, 95, 99]).tolist())
    assert A.ks_normal(df).first()["p_value"] > 0.001 and A.k_squared(df).first()["p_value"] > 0.001
    book = A.empirical_codebook(df, 2, rounds=40)
    assert book == sorted(book) and A.quant_mse(df, book).first()["mse"] < 0.13
    ties = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (2.0, 7.0), (3.0, 9.0)], "a double, b double")
    assert A.spearman(ties, "a", "b").first()["rho"] == pytest.approx(0.8333333, abs=1e-6)
    assert A.sampled_pairs(spark.range(10).withColumnRenamed("id", "vec_id"), 200).where("i = j or i > 9 or j > 9").count() == 0


def test_matches_stay_below_the_shuffle(vectors):
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    plan = D.search(queries, E.encode(vectors, SPACE), SPACE, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning(query_id") == 1 and "CartesianProduct" not in plan


def test_stream(spark, vectors, tmp_path):
    from vecloom import streaming

    vectors.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "in"))
    streaming.write_stream(streaming.encode_stream(source, SPACE), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 43


def test_codebook_gain_against_numpy(spark):
    """The registered query: 3 to 8 bits, up to 200 rounds, as in numpy on the same coordinates."""
    import os

    from vecloom.functions.space import lloyd_max
    from vecloom.plans import queries as Q

    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    x = np.array([r["value"] for r in Q._coords(spark, d).select("value").collect()])
    mse = lambda points, bounds: np.mean((x - np.float32(points)[np.searchsorted(np.float32(bounds), x)]) ** 2)
    got = {r["bits"]: r for r in Q.QUERIES["codebook_gain"](spark, d).collect()}
    assert sorted(got) == [3, 4, 5, 6, 7, 8]
    for bits, row in got.items():
        n = 1 << bits
        points = np.percentile(x, np.linspace(0, 100, n + 2)[1:-1])
        for _ in range(200):
            level = np.searchsorted((points[:-1] + points[1:]) / 2, x)
            count, total = np.bincount(level, minlength=n), np.bincount(level, x, n)
            fresh = np.where(count > 0, total / np.maximum(count, 1), points)
            if np.abs(fresh - points).max() < 1e-8:
                break
            points = fresh
        bounds, centres = lloyd_max(bits)
        gauss, own = mse(centres, bounds), mse(points, (points[:-1] + points[1:]) / 2)
        assert row["gaussian_mse"] == pytest.approx(gauss, rel=1e-6) and row["empirical_mse"] == pytest.approx(own, rel=1e-5)
        assert row["gain_percent"] == pytest.approx(100 * (gauss - own) / gauss, abs=0.01)


def _made(mode, n, seed):
    """Decoded codes, or what the mode takes, of vectors of very different norms, with copies and zeros."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 12)) * 10.0 ** rng.integers(-3, 4, (n, 1))
    x[n // 2 : n // 2 + 20], x[3] = x[:20], 0
    return x, K.operand(SPACE, mode, x if mode == "exact" else K.decode(SPACE, K.encode(SPACE, x)))


def test_all_pairs_leave_in_tiles():
    """However many queries there are, no batch and no matrix is larger than a tile."""
    _, side = _made("full", 3000, 5)
    some = np.arange(700)
    work = D.All([], ["dist"], np.arange(3000), [side])
    batches = list(work.add(some, [side.rows(some)]))
    assert max(b.num_rows for b in batches) <= D.TILE
    assert sum(b.num_rows for b in batches) == 3000 * 700
    assert len({(q, v) for b in batches[:2] for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}) == sum(b.num_rows for b in batches[:2])


@pytest.mark.parametrize("mode", ["asym", "sym", "light", "full", "exact"])
def test_screened_searches_against_all_pairs(mode, monkeypatch):
    """Products in single precision leave no pair out, and copies are ranked by their ids."""
    monkeypatch.setattr(D, "STRIP", 96)
    monkeypatch.setattr(D, "TILE", 5000)
    x, right = _made(mode, 900, 6)
    left = K.operand(SPACE, mode, K.prepare(SPACE, x)) if mode == "asym" else right
    ids = np.random.default_rng(7).permutation(900)
    i, j = np.divmod(np.arange(900 * 900), 900)
    dist = K.of_pairs(left, right, i, j)
    np.testing.assert_allclose(K.tile(left, right).reshape(-1), dist, rtol=1e-9, atol=1e-9 * (left.square[i] + right.square[j] + 1).max())
    for limit in (0.0, 1.0, float(np.median(dist))):
        got = [b for b in D.Within([], limit, True, ids, [left]).add(ids, [right])]
        got = sorted((q, v, t) for b in got for q, v, t in zip(*(c.to_pylist() for c in b.columns)))
        at = (dist <= limit) & (ids[i] < ids[j])
        assert got == sorted(zip(ids[i[at]].tolist(), ids[j[at]].tolist(), dist[at].tolist()))
    work = D.Nearest([], 4, True, ids, [left])
    for at in range(0, 900, 300):
        list(work.add(ids[at : at + 300], [right.rows(slice(at, at + 300))]))
    order = np.lexsort((ids[j], np.where(i == j, np.inf, dist), i)).reshape(900, 900)[:, :4]
    assert (work.near == ids[j[order]]).all() and (work.dist == dist[order]).all()


def test_codebook_rounds_need_no_job(spark, monkeypatch):
    """The values are sorted once; places and sums come from the blocks that hold a bound, also if few can be held."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal(5000), np.full(700, 0.25), rng.standard_normal(300) * 50])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "value double")
    monkeypatch.setattr(A, "BLOCK_VALUES", 64)
    monkeypatch.setattr(A, "HELD_VALUES", 640)
    values = A.SortedValues(df, "value")
    bounds = np.concatenate([[-1e9, 1e9, 0.25, x.min(), x.max()], rng.standard_normal(20)])
    for some in (bounds[:7], bounds[7:]):
        n, total = values.below(some)
        assert n.tolist() == [int((x <= b).sum()) for b in some]
        np.testing.assert_allclose(total, [x[x <= b].sum() for b in some], atol=1e-9)
    np.testing.assert_allclose(values.quantiles([0.0, 0.1, 0.5, 0.77, 1.0]), np.percentile(x, [0, 10, 50, 77, 100]))
    monkeypatch.undo()
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    A.codebook_gain(df, range(3, 6)).collect()
    assert jobs() - before < 20


@pytest.mark.parametrize("copies", [False, True])
def test_rank_correlation_over_pairs_without_a_shuffle_of_pairs(spark, monkeypatch, copies):
    """As the sorted pairs give it; copies tie."""
    from vecloom.operators import ranks as R

    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 32)).astype("f4")
    if copies:
        x[150:160] = x[:10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("short", F.slice("embedding", 1, 24)).repartition(3)
    queries = df.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    kinds = {c: (None, "exact", c, c) for c in ("embedding", "short")}
    want = A.spearman(D.side_by_side(queries, df, kinds).where("query_id <> vec_id"), "embedding", "short").first()
    with monkeypatch.context() as m:
        m.setattr(A, "spearman", lambda *_: pytest.fail("pairs were sorted"))
        got = R.spearman_of_pairs(queries, df, "embedding", "short").first()
    assert got["n"] == want["n"] == 200 * 599 and got["rho"] == pytest.approx(want["rho"], abs=1e-9)
    monkeypatch.setattr(R, "LEAST", 0.0)
    assert R.spearman_of_pairs(queries, df, "embedding", "short").first()["rho"] == pytest.approx(want["rho"], abs=1e-12)
