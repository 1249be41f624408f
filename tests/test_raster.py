"""Operators on arrays against loops, known answers and properties."""

import random

import numpy as np
import pytest

from pixelloom.image import BITMAP, RGB, TRUE, bitmap, colours_to_depth, indexed, pack, true, unpack
from pixelloom.operators import raster as R
from pixelloom.plans.jobs import best_depth, composed, fit_to_target, process
from pixelloom.plans.options import Job, RenderTarget


def noise(w, h, seed=1):
    return true(np.random.default_rng(seed).integers(0, 256, (h, w, 3)), gamma=1.0, title="t")


def level(r, g, b):
    return (r * 7680 + 50) // 100 + (g * 15104 + 50) // 100 + (b * 2816 + 50) // 100


def test_known_answers():
    assert level(255, 255, 255) == 65280 and int(R.intensity(np.array([[65535] * 3]))[0]) == 65280
    assert R.zoom_index(5, 140).tolist() == [0, 0, 1, 2, 2, 3, 4]
    assert R.smooth(true(np.full((3, 3, 3), 77), gamma=1.0)).pixels.tolist() == [[[77] * 3] * 3] * 3
    one = np.zeros((3, 3, 3), int)
    one[1, 1] = 1
    assert R.smooth(true(one, gamma=1.0)).pixels[1, 1].tolist() == [1, 1, 1]
    assert R.rotate(true([[[1, 1, 1], [2, 2, 2]]]), 90).pixels[:, 0, 0].tolist() == [1, 2]
    assert R.halftone(true(np.full((1, 1, 3), 255), gamma=1.0)).pixels.sum() == 0
    assert R.reduce(true(np.full((4, 4, 3), 255), gamma=2.2), 8).palette.tolist() == [[63488] * 3]
    assert [colours_to_depth(n) for n in (1, 2, 3, 256, 257)] == [0, 1, 2, 8, 9]
    # a single pixel of level 32640 isn't above the threshold: black
    r = indexed([[0]], [[32640 << 0] * 3], gamma=1.0)
    assert R.dither(r).pixels[0, 0] == 1


def test_properties():
    r = noise(7, 5)
    turned = r
    for _ in range(4):
        turned = R.rotate(turned, 90)
    assert (turned.pixels == r.pixels).all()
    assert R.rotate(r, 450).pixels.shape == R.rotate(r, 90).pixels.shape
    assert R.zoom(r, 100, 0) is r
    assert abs(R.gray(R.gray(r)).pixels.astype(int) - R.gray(r).pixels).max() <= 1  # shares are rounded each by itself
    assert R.zoom(r, 20, 20).pixels.shape[:2] == (1, 1)
    with pytest.raises(ValueError):
        R.zoom(r, 1, 1)
    assert R.normalize(true(np.full((2, 2, 3), 9), gamma=1.0)).pixels.max() == 9
    assert R.with_gamma(bitmap([[0, 1]], gamma=2.2), 1.0).gamma == 1.0


def slow_smooth(p):
    h, w, _ = p.shape
    out = np.zeros_like(p)
    for y in range(h):
        for x in range(w):
            for c in range(3):
                s = sum(int(p[min(h - 1, max(0, y + dy)), min(w - 1, max(0, x + dx)), c]) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
                out[y, x, c] = (s + 8) // 9
    return out


@pytest.mark.parametrize("size", [(1, 1), (1, 6), (5, 1), (6, 4)])
def test_smooth_by_loops(size):
    r = noise(*size)
    assert (R.smooth(r, 2).pixels == slow_smooth(slow_smooth(r.pixels.astype(int)))).all()


def slow_dither(levels):
    h, w = len(levels), len(levels[0])
    grid = [row[:] for row in levels]
    out = [[0] * w for _ in range(h)]
    cut = lambda e, k: (abs(e) * k // 16) * (1 if e >= 0 else -1)
    for y in range(h):
        right = y % 2 == 0
        for x in range(w) if right else reversed(range(w)):
            value = 65280 if grid[y][x] > 32640 else 0
            e = grid[y][x] - value
            out[y][x] = int(value < 32640)
            s = 1 if right else -1
            for dx, dy, k in ((s, 0, 7), (-s, 1, 3), (0, 1, 5), (s, 1, 1)):
                if 0 <= x + dx < w and y + dy < h:
                    grid[y + dy][x + dx] += cut(e, k)
    return out


@pytest.mark.parametrize("size", [(1, 1), (1, 5), (5, 1), (2, 2), (13, 9)])
def test_dither_by_loops(size):
    r = noise(*size, seed=3)
    levels = [[level(*map(int, p)) for p in row] for row in r.pixels]
    assert R.dither(r).pixels.tolist() == slow_dither(levels)


def test_reduce_properties():
    r = true(np.random.default_rng(5).integers(0, 256, (20, 20, 3)), gamma=2.2, title="t")
    for n in (2, 7, 64):
        out = R.reduce(r, n)
        assert out.type == RGB and out.used <= n and out.title == f"t ({out.used} colors)"
        assert out.pixels.max() < out.used
        # each pixel's 5-bit colour lies in the box whose mean its colour is: sums agree
        for k in range(out.used):
            part = (r.pixels[out.pixels == k].astype(int) >> 3)
            assert (np.floor(part.mean(0) + 0.5 + 1e-4).astype(int) << 11 >= out.palette[k]).all()
            assert (np.floor(part.mean(0) + 0.5 - 1e-4).astype(int) << 11 <= out.palette[k]).all()
    few = indexed([[0, 1]], [[0, 0, 0], [65535, 65535, 65535]], gamma=2.2)
    assert R.reduce(few, 2) is few
    boxes = R.boxes_of(np.bincount(R.five_bits(r.pixels).ravel(), minlength=32768), 32)
    assert sum(b.weight for b in boxes) == 400 and len(boxes) == 32


F32 = np.float32


def slow_box(cells, total):
    """(mean, spread) of a list of (colour, count), by its definition, in single precision and in order of levels."""
    weight, mean, spread = sum(n for _, n in cells), [], F32(0)
    for c in range(3):
        sums = squares = F32(0)
        for level in range(32):
            n = sum(m for p, m in cells if p[c] == level)
            sums, squares = F32(sums + F32(level * n)), F32(squares + F32(level * level * n))
        mean.append(F32(sums / F32(weight)))
        spread = F32(spread + F32(squares - F32(F32(mean[c] * mean[c]) * F32(weight))))
    return mean, F32(spread / F32(total))


def slow_halves(cells, total, c):
    """The halves of a box that is cut where they vary most from each other, or None."""
    (mean, _), weight = slow_box(cells, total), sum(n for _, n in cells)
    low, high = min(p[c] for p, _ in cells), max(p[c] for p, _ in cells) + 1
    first, last = int(F32(F32(low) + mean[c]) * F32(0.5)), int(F32(mean[c] + F32(high)) * F32(0.5))
    part, most, cut = F32(0), F32(-1), None
    for level in range(first, last + 1):
        below = sum(n for p, n in cells if p[c] <= level)
        if below == weight:
            break
        part = F32(part + F32(level * sum(n for p, n in cells if p[c] == level)) / F32(weight))
        away = F32(mean[c] - part)
        value = F32(F32(F32(below) / F32(weight - below)) * away) * away
        if value > most:
            most, cut = value, level
    halves = [[x for x in cells if (x[0][c] <= cut) == side] for side in (True, False)] if cut is not None else [[]]
    return halves if all(halves) else None


def slow_reduce(pixels, colours):
    """Rows of 8-bit colours -> each pixel's box and the boxes' colours (16 bits)."""
    counts = {}
    for row in pixels:
        for p in row:
            key = tuple(int(v) >> 3 for v in p)
            counts[key] = counts.get(key, 0) + 1
    total = sum(counts.values())
    boxes = [[sorted(counts.items()), None]]
    boxes[0][1] = slow_box(boxes[0][0], total)[1]
    while len(boxes) < colours:
        k = max(range(len(boxes)), key=lambda i: (boxes[i][1], -i))
        if not boxes[k][1] > 0:
            break
        best = None
        for c in range(3):
            halves = slow_halves(boxes[k][0], total, c)
            spread = halves and F32(slow_box(halves[0], total)[1] + slow_box(halves[1], total)[1])
            if halves and (best is None or spread < best[0]):
                best = spread, halves
        if best is None:
            boxes[k][1] = F32(0)
            continue
        boxes[k : k + 1] = [[best[1][0], slow_box(best[1][0], total)[1]]]
        boxes.append([best[1][1], slow_box(best[1][1], total)[1]])
    place = {p: k for k, (cells, _) in enumerate(boxes) for p, _ in cells}
    shown = [[int(m + F32(0.5)) << 11 for m in slow_box(cells, total)[0]] for cells, _ in boxes]
    return [[place[tuple(int(v) >> 3 for v in p)] for p in row] for row in pixels], shown, [cells for cells, _ in boxes]


def slow_diffused(pixels, boxes, shown):
    """Left to right: an error goes on by 7, 3, 5 and 1 sixteenths, held within a bound, none of it lost."""
    h, w, bound = len(pixels), len(pixels[0]), int(256 / len(shown) ** 0.45)
    extent = [[(min(p[c] for p, _ in b), max(p[c] for p, _ in b)) for c in range(3)] for b in boxes]
    grid = [[[int(v) for v in p] for p in row] for row in pixels]
    out, seen = [[0] * w for _ in range(h)], {}
    for y in range(h):
        for x in range(w):
            now = [min(255, max(0, v)) for v in grid[y][x]]
            cell = tuple(v >> 3 for v in now)
            if cell not in seen:
                inside = [k for k, e in enumerate(extent) if all(a <= v <= b for v, (a, b) in zip(cell, e, strict=True))]
                distance = lambda k: (sum(((shown[k][c] >> 8) - now[c]) ** 2 for c in range(3)), -k)
                seen[cell] = inside[-1] if inside else min(range(len(shown)), key=distance)
            k = out[y][x] = seen[cell]
            for c in range(3):
                e = max(-bound, min(bound, now[c] - (shown[k][c] >> 8)))
                share = {n: int(e * n / 16) for n in (1, 3, 5, 7)}
                share[(1, 5, 3, 7)[e % 4]] += e - sum(share.values())
                for dx, dy, n in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        grid[y + dy][x + dx][c] += share[n]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_reduce_by_loops(seed):
    rng = np.random.default_rng(seed)
    pixels = rng.integers(0, 256, (7, 9, 3)) if seed % 2 else np.clip(rng.normal(120, 40, (6, 5, 3)), 0, 255).astype(int)
    r = true(pixels, gamma=2.2)
    for colours in (2, 5, 16):
        place, shown, boxes = slow_reduce(pixels, colours)
        out = R.reduce(r, colours)
        assert out.palette.tolist() == shown and out.pixels.tolist() == place
        assert R.reduce(r, colours, True).pixels.tolist() == slow_diffused(pixels, boxes, shown)


def test_error_diffusion_in_colour():
    ramp = true(np.repeat(np.tile(np.arange(0, 256, 4), (16, 1))[..., None], 3, axis=2), gamma=2.2)
    plain, mixed = R.reduce(ramp, 4), R.reduce(ramp, 4, True)
    shown = lambda r: (r.colours16() >> 8)[..., 0].astype(int)
    # means over blocks come closer with diffusion
    block = lambda a: a.reshape(4, 4, 16, 4).mean((1, 3))
    want = block(ramp.pixels[..., 0].astype(int))
    assert abs(block(shown(mixed)) - want).mean() < abs(block(shown(plain)) - want).mean()
    for k in range(-255, 256):
        shares = R.error_shares(16)
        assert sum(shares[s][k + 255] for s in shares) == max(-int(256 / 16**0.45), min(int(256 / 16**0.45), k))


def test_nearest_takes_the_last_of_equals():
    palette = np.array([[0, 0, 0], [10, 0, 0], [10, 0, 0], [0, 10, 0]])
    assert R.nearest(np.array([10, 0, 0]), palette) == 2
    assert R.nearest(np.array([5, 0, 0]), palette) == 2


def test_border_colours():
    r = indexed([[0, 1]], [[0, 0, 0], [65535, 0, 0]], gamma=1.0)
    out = R.clip(r, -1, 0, 4, 1)
    assert out.used == 3 and out.depth == 2 and out.palette[2].tolist() == [65535] * 3 and out.pixels.tolist() == [[2, 0, 1, 2]]
    again = R.clip(out, -1, 0, 5, 1)
    assert again.used == 3
    b = R.clip(bitmap([[0, 1]], gamma=2.2), 0, 0, 2, 2)
    assert b.type == BITMAP and b.pixels.tolist() == [[0, 1], [0, 0]]
    red = R.clip(bitmap([[0, 1]], gamma=1.0), 0, 0, 3, 1, (65535, 0, 0))
    assert red.type == RGB and red.depth == 2 and red.palette[2].tolist() == [65535, 0, 0]
    assert R.clip(noise(3, 3), 5, 5, 2, 2).pixels.min() == 255


def test_merging():
    dst, src = noise(6, 6), noise(4, 4, 2)
    out = R.merge(dst, src, -1, 3)
    assert (out.pixels[3:6, 0:3] == src.pixels[0:3, 1:4]).all() and (out.pixels[:3] == dst.pixels[:3]).all()
    assert R.merge(dst, src, 6, 0) is dst and R.merge(dst, src, -4, 0) is dst
    a, b = bitmap(np.zeros((2, 2)), gamma=2.2), bitmap([[1]], gamma=2.2)
    assert R.merge(a, b, 1, 1).pixels.tolist() == [[0, 0], [0, 1]]
    flipped = b.but(palette=b.palette[::-1])
    assert R.merge(a, flipped, 1, 1).pixels.tolist() == [[0, 0], [0, 0]]
    # the one farther from the display's gamma moves
    assert R.merge(true(np.zeros((1, 1, 3)), gamma=2.2), true([[[128] * 3]], gamma=1.0), 0, 0).pixels[0, 0, 0] == R.gamma_table(1 / 2.2)[128]


def test_compress_is_ascending_and_once():
    r = indexed([[3, 1, 9]], np.arange(12).reshape(4, 3) * 1000)
    out = R.compress(r)
    assert out.pixels.tolist() == [[2, 1, 0]] and out.palette.tolist() == r.palette[[0, 1, 3]].tolist()
    assert R.compress(out) is out


def test_packing_round_trip():
    for r in (noise(3, 2), bitmap([[0, 1, 1]]), indexed([[0, 299]], np.arange(900).reshape(300, 3), gamma=2.2, title="x")):
        row = dict(zip(("image_id", "title", "type", "width", "height", "depth", "gamma", "palette", "data"), pack(1, r), strict=True))
        back = unpack(row)
        assert (back.pixels == r.pixels).all() and (back.palette == r.palette).all() and back.type == r.type and back.gamma == r.gamma


def test_jobs_in_fixed_order():
    r = noise(8, 6)
    out = process(r, Job(clip=(1, 1, 5, 4), rotate=90, xzoom=200, smooth=1, gray=True, colors=4))
    want = R.reduce(R.gray(R.smooth(R.zoom(R.rotate(R.clip(r, 1, 1, 5, 4), 90), 200, 0))), 4)
    assert (out.pixels == want.pixels).all() and out.title == want.title
    assert process(r, Job(clip=(2, 0, 0, 0))).width == 8  # the image's own width, not what is left
    two = process(r, Job(dither=1, foreground="red", background="#00f"))
    assert two.palette.tolist() == [[0, 0, 65535], [65535, 0, 0]]
    assert process(r, Job(dither=2)).pixels.shape == (24, 32)
    merged = composed([(r, Job()), (noise(2, 2), Job(merge=True, center=True))])
    assert len(merged) == 1 and (merged[0].pixels[2:4, 3:5] == noise(2, 2).pixels).all()


def test_targets():
    r = noise(40, 30)
    assert fit_to_target(r, RenderTarget(mono=True)).type == BITMAP
    few = fit_to_target(r, RenderTarget(max_colors=256))
    assert few.type == RGB and few.used <= 240
    full = fit_to_target(r, RenderTarget(width=100, height=60, fullscreen=True))
    assert (full.width, full.height) == (100, 60) and full.pixels[0, 0].tolist() == [255] * 3
    assert fit_to_target(r, RenderTarget(width=80, height=90, fillscreen=True, onroot=True)).height == 90
    assert [best_depth(8, d) for d in ([1, 4], [1, 8, 24], [24])] == [4, 8, 24]
    assert R.tile(noise(3, 2), 7, 5).pixels.shape == (5, 7, 3)


def test_float32_brightness():
    rng = random.Random(1)
    for _ in range(200):
        v, p = rng.randrange(256), rng.randrange(1, 400)
        want = min(255, int(np.float32(v) * (np.float32(p) / np.float32(100))))
        assert R.brighten(true([[[v] * 3]], gamma=1.0), p).pixels[0, 0, 0] == want
    assert R.default_gamma(noise(1, 1).but(gamma=None)).gamma == 1.0
    assert TRUE == noise(1, 1).type
