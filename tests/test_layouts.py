import pytest

from kvlake.functions import codebook, layouts
from kvlake.functions.layouts import Config


def test_page_bytes_follow_the_published_formulas():
    want = {"dense16": (65536, 16384, 8192), "absmax4": (16896, 4608, 2560), "mse4": (16896, 4608, 2560), "prod4": (17152, 4288, 2240), "sign1": (10752, 2688, 1408)}
    for scheme, sizes in want.items():
        got = tuple(layouts.page_bytes(scheme, Config().with_shape(h, d)) for h, d in ((8, 128), (2, 128), (2, 64)))
        assert got == sizes


def test_cache_sizes_match_the_published_ones():
    c = Config().with_shape(2, 128)
    assert [layouts.cache_mb(32768, 36, s, c) for s in ("dense16", "prod4", "mse4")] == [1152, 301.5, 324]
    assert [layouts.cache_mb(8192, 36, s, c) for s in ("dense16", "prod4", "mse4")] == [288, 75.375, 81]


def test_pages_of_few_tokens():
    c = Config().with_shape(2, 64)
    assert [layouts.pool_bytes(n, "mse4", c) // layouts.page_bytes("mse4", c) for n in (0, 1, 16, 17)] == [0, 1, 1, 2]
    assert layouts.cell_offset("prod4", c, "k_scale", 17, 1) == layouts.page_bytes("prod4", c) + layouts.page_regions("prod4", c)["k_scale"][0] + (1 * 2 + 1) * 2


def test_bad_shapes_are_refused():
    for dim in (96, 256, 0):
        with pytest.raises(ValueError):
            Config(dim=dim).check()
    with pytest.raises(ValueError):
        Config(bits=3).check()
    with pytest.raises(ValueError):
        layouts.page_bytes("absmax4", Config(dim=64, group=128))
    with pytest.raises(ValueError):
        layouts.page_bytes("unheard", Config())


def test_designed_levels_are_those_in_use():
    for table, rounds in ((codebook.LEVELS8, 50), (codebook.LEVELS16, 5000)):
        made = codebook.lloyd_max(len(table), rounds)
        assert max(abs(a - b) for a, b in zip(table, made)) < 1e-4
    assert abs(codebook.quantile(0.5)) < 1e-12 and abs(codebook.distribution(codebook.quantile(0.9)) - 0.9) < 1e-12
