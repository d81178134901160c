import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.functions import kernels as K
from vecloom.functions.space import Space, lloyd_max, sign_vector, splitmix64


def test_generator_and_signs():
    assert [f"{x:016x}" for _, x in zip(range(2), splitmix64(42))] == ["bdd732262feb6e95", "28efe333b266f103"]
    assert "".join("+" if s > 0 else "-" for s in sign_vector(32, 137)) == "+----++++-++-+++++-++--+--+++--+"
    assert sum(s > 0 for s in sign_vector(128, 42)) == 61


@pytest.mark.parametrize("bits,least,most", [(1, 0.797885, 0.797885), (2, 0.452780, 1.510418), (3, 0.245094, 2.151946), (5, 0.065894, 3.260782), (7, 0.022399, 4.423718)])
def test_codebook(bits, least, most):
    centres = lloyd_max(bits)[1]
    assert centres[len(centres) // 2] == pytest.approx(least, abs=1e-6)
    assert centres[-1] == pytest.approx(most, abs=1e-6)
    assert list(centres) == [-c for c in reversed(centres)]


def test_converged_codebook_differs_only_where_the_cap_bites():
    assert lloyd_max(3, None) == lloyd_max(3)
    assert lloyd_max(5, None) != lloyd_max(5)


@pytest.mark.parametrize("dim,small,large", [(100, 76, 140), (128, 76, 140), (768, 524, 1036), (3072, 2060, 4108)])
def test_code_sizes(dim, small, large):
    assert (Space(dim, 4).code_size_bytes, Space(dim, 8).code_size_bytes) == (small, large)


@pytest.mark.parametrize("bits", [1, 9])
def test_bits_out_of_range(bits):
    with pytest.raises(ValueError):
        Space(64, bits)


@pytest.mark.parametrize("bits,packed,gamma", [(4, [117, 126], 0.21304575), (8, [94, 127, 207, 111], 0.01482889)])
def test_golden_codes(bits, packed, gamma):
    space = Space(4, bits)
    codes = K.encode(space, np.array([[1.0, 2, 3, 4], [0, 0, 0, 0]]))
    assert K.pack(space, codes)[0].tolist() == packed
    assert codes.gamma[0] == pytest.approx(gamma, abs=1e-7)
    assert (codes.norm[1], codes.sigma[1]) == (0, np.float32(1e-10))
    assert (codes.levels[1] == space.num_levels // 2 - 1).all()


@pytest.mark.parametrize("bits,asym,sym,light,full", [(4, 28.5195, 0.0, 0.0, 14.21875), (8, 28.92358, 20.26122, 20.26122, 18.62854)])
def test_golden_distances(bits, asym, sym, light, full):
    space = Space(4, bits)
    d = K.decode(space, K.encode(space, np.array([[1.0, 2, 3, 4], [4, 3, 2, 1]])))
    assert K.distances(space, "asym", K.prepare(space, np.array([[1.0, 0, 0, 0]])), d)[0, 0] == pytest.approx(asym, abs=1e-4)
    for mode, value in (("sym", sym), ("light", light), ("full", full)):
        assert K.distances(space, mode, d, d)[0, 1] == pytest.approx(value, abs=1e-4)


@pytest.mark.parametrize("bits,asym,sym,light,full", [(8, 0.941, 0.908, 0.908, 0.936), (4, 0.373, 0.199, 0.217, 0.344)])
def test_recall_on_whole_numbers(bits, asym, sym, light, full):
    rng = np.random.default_rng(42)
    base, queries = rng.integers(0, 256, (5000, 128)).astype(float), rng.integers(0, 256, (100, 128)).astype(float)
    space = Space(128, bits)
    truth = np.argsort(K.exact(queries, base), axis=1, kind="stable")[:, :10]
    codes, own = (K.decode(space, K.encode(space, x)) for x in (base, queries))
    for mode, expected in (("asym", asym), ("sym", sym), ("light", light), ("full", full)):
        found = np.argsort(K.distances(space, mode, K.prepare(space, queries) if mode == "asym" else own, codes), axis=1, kind="stable")[:, :10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, truth)]) == pytest.approx(expected, abs=0.006)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.sampled_from([4, 8, 100, 128]), st.integers(2, 8))
def test_properties(seed, dim, bits):
    rng, space = np.random.default_rng(seed), Space(dim, bits)
    x = rng.standard_normal((5, dim)) * rng.uniform(0.1, 50, (5, 1))
    codes = K.encode(space, x)
    for i in range(5):  # a batch is its rows
        one = K.encode(space, x[i : i + 1])
        assert (one.levels[0] == codes.levels[i]).all() and (one.signs[0] == codes.signs[i]).all()
    back = K.unpack(space, K.pack(space, codes), codes.norm, codes.gamma, codes.sigma)
    assert (back.levels == codes.levels).all() and (back.signs == codes.signs).all()
    rotated, norm = K.rotate(space, x)
    np.testing.assert_allclose((rotated**2).sum(1), 1, rtol=1e-9)
    d = K.decode(space, codes)
    for mode in ("sym", "light", "full"):
        assert (K.distances(space, mode, d, d) >= 0).all()
    np.testing.assert_allclose(K.hadamard(K.hadamard(x[:, :4])), x[:, :4], atol=1e-9)


@pytest.mark.parametrize("dim", [32, 128, 1024])
@pytest.mark.parametrize("bits", [4, 8])
def test_asymmetric_error(dim, bits):
    rng = np.random.default_rng(dim * 10 + bits)
    q, x = rng.standard_normal((1, dim)), rng.standard_normal((1, dim))
    space = Space(dim, bits)
    estimate = K.distances(space, "asym", K.prepare(space, q), K.decode(space, K.encode(space, x)))[0, 0]
    true = ((q - x) ** 2).sum()
    assert abs(estimate - true) < (0.25 if bits == 8 else 0.5) * true + 1


@pytest.mark.parametrize("dim", [4, 48, 128, 512, 1000])
@pytest.mark.parametrize("bits", [2, 4, 8])
def test_products_give_the_butterflies_codes(dim, bits):
    """Also where transforms cancel to exactly 0 and where values sit on a boundary, which products decide by their last bits."""
    space = Space(dim, bits)
    rng = np.random.default_rng(dim + bits)
    x = rng.standard_normal((300, dim))
    x[0], x[1], x[2], x[3] = 0, 1, np.arange(dim) % 2, x[4]
    fast, (slow, _) = K.encode(space, x), K._encoded(space, x, K.hadamard)
    for name in ("levels", "signs", "norm", "gamma", "sigma"):
        assert (getattr(fast, name) == getattr(slow, name)).all()
    values = np.concatenate([rng.standard_normal(2000) * 3, space.boundaries, np.nextafter(space.boundaries, 9), [-1e9, 1e9]])
    levels, close = K.quantise(space.boundaries, values)
    assert (levels == np.searchsorted(space.boundaries, values, side="left")).all() and close[2000:-2].all()
    assert len(K.encode(space, x[:0]).norm) == 0
