"""Images that carry their type and gamma: exploded operators give what those on one raster give."""

import numpy as np
import pytest

from pixelloom.image import PACKED, bitmap, pack, true
from pixelloom.operators import carried as C
from pixelloom.operators import raster as R


def some(seed):
    """True colour of several gammas and of none, bitmaps in plain, opposed and other inks."""
    rng = np.random.default_rng(seed)
    gammas = [2.2, 1.0, None, 1.7, 0.5, 2.2]
    out = {k: true(rng.integers(0, 256, (4 + k, 6, 3)), gamma=g, title=f"t{k}") for k, g in enumerate(gammas)}
    inks = [((65535,) * 3, (0, 0, 0)), ((0, 0, 0), (65535,) * 3), ((65535, 0, 0), (0, 0, 65535))]
    for k, palette in enumerate(inks * 2):
        out[10 + k] = bitmap(rng.integers(0, 2, (5, 7)), title=f"b{k}", gamma=2.2 if k % 2 else None).but(palette=np.array(palette, np.int64))
    return out


def exploded(spark, rasters):
    return C.of_packed(spark.createDataFrame([pack(k, r) for k, r in rasters.items()], PACKED))


def rows_of(c):
    images = {r.image_id: r for r in c.images.collect()}
    pixels = {}
    for r in c.pixels.collect():
        pixels.setdefault(r.image_id, {})[r.y, r.x] = r.idx if images[r.image_id].type == "BITMAP" else (r.r, r.g, r.b)
    return images, pixels


def same(c, want):
    images, pixels = rows_of(c)
    assert set(images) == set(want)
    for k, r in want.items():
        row = images[k]
        assert (row.type, row.title, row.width, row.height) == (r.type, r.title, r.width, r.height), k
        assert R.same_gamma(row.gamma, r.gamma), (k, row.gamma, r.gamma)
        assert len(pixels[k]) == r.width * r.height
        for (y, x), v in pixels[k].items():
            assert v == (int(r.pixels[y, x]) if r.type == "BITMAP" else tuple(map(int, r.pixels[y, x]))), k
        if r.type == "BITMAP":
            assert [(c.red, c.green, c.blue) for c in row.palette] == [tuple(map(int, c)) for c in r.palette]


OPERATORS = {
    "default_gamma": (C.default_gamma, R.default_gamma),
    "linear": (C.linear, R.linear),
    "to_display": (lambda c: C.with_gamma(c, C.F.lit(2.2)), lambda r: R.with_gamma(r, 2.2)),
    "expand": (C.expand, R.expand),
    "gray": (C.gray, R.gray),
    "brighten": (lambda c: C.brighten(c, 130), lambda r: R.brighten(r, 130)),
    "normalize": (C.normalize, R.normalize),
    "smooth": (lambda c: C.smooth(c, 2), lambda r: R.smooth(r, 2)),
    "job": (lambda c: C.brighten(C.normalize(C.gray(C.smooth(C.default_gamma(c)))), 120), lambda r: R.brighten(R.normalize(R.gray(R.smooth(R.default_gamma(r)))), 120)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_as_on_one_raster(spark, name):
    rasters = some(1)
    exploded_form, packed_form = OPERATORS[name]
    same(exploded_form(exploded(spark, rasters)), {k: packed_form(r) for k, r in rasters.items()})


@pytest.mark.parametrize("at", [(0, 0), (2, -1), (-3, 2), (50, 0), (0, -9)])
def test_merge_picks_types_and_gammas(spark, at):
    # as in a job, where every image has a gamma before it is merged
    under, above = ({k: R.default_gamma(r) for k, r in some(n).items()} for n in (2, 3))
    order = list(above)
    over = {k: above[order[(i + 5) % len(order)]] for i, k in enumerate(order)}  # every kind over every other
    del over[order[0]]  # nothing over this one
    want = {k: R.merge(r, over[k], *at) if k in over else r for k, r in under.items()}
    assert {r.type for r in want.values()} == {"TRUE", "BITMAP"}
    same(C.merge(exploded(spark, under), exploded(spark, over), *at), want)
    same(C.merge(exploded(spark, under), exploded(spark, over), *at, display=1.0), {k: R.merge(r, over[k], *at, 1.0) if k in over else r for k, r in under.items()})


def test_bitmaps_over_bitmaps_keep_their_inks(spark):
    rasters = {k: r for k, r in some(4).items() if k >= 10}
    order = list(rasters)
    over = {k: rasters[order[(i + 1) % len(order)]] for i, k in enumerate(order)}
    same(C.merge(exploded(spark, rasters), exploded(spark, over), 1, 1), {k: R.merge(r, over[k], 1, 1) for k, r in rasters.items()})
