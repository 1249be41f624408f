"""Jobs: one image through all its options in the fixed order, and what a target makes of it."""

from __future__ import annotations

from ..image import BITMAP, RGB, TRUE, Raster
from ..operators import raster as R
from ..sources.simple import colour_of
from .options import Job, RenderTarget

BLACK = (0, 0, 0)


def colour(spec: str | None) -> tuple[int, int, int] | None:
    return None if spec is None else colour_of(spec) or BLACK


def zooms(job: Job, r: Raster, target: RenderTarget, scaled: bool = False) -> tuple[int, int]:
    """The percentages for an image, from automatic, scale and plain options."""
    if job.zoom_auto:
        z = R.zoom_auto(r.width, r.height, target.width, target.height)
        return z, z
    if job.iscale and not scaled:
        z = 100 << -job.iscale if job.iscale < 0 else 100 >> job.iscale
        return z, z
    return job.xzoom, job.yzoom


def process(r: Raster, job: Job, target: RenderTarget = RenderTarget(), scaled: bool = False) -> Raster:
    """Clip, rotate, zoom, recolour, smooth, gray, normalize, brighten, reduce, dither, expand, compress."""
    r = R.default_gamma(r, job.gamma)
    if any(job.clip):
        x, y, w, h = job.clip  # a size of 0 is the image's own, even when the corner is inside
        r = R.clip(r, x, y, w or r.width, h or r.height, colour(job.border) or (65535,) * 3)
    if job.rotate:
        r = R.rotate(r, job.rotate)
    x, y = zooms(job, r, target, scaled)
    if x or y:
        if not job.colors and ((not x and y > 100) or (not y and x > 100) or x + y > 200):
            r = R.compress(r)
        r = R.zoom(r, x, y)
    inks = colour(job.foreground), colour(job.background)
    r = R.recolour(r, *inks)
    if job.smooth:
        r = R.smooth(r, job.smooth)
    if job.gray:
        r = R.gray(r)
    if job.normalize:
        r = R.normalize(r)
    if job.bright:
        r = R.brighten(r, job.bright)
    if job.colors and (r.type == TRUE or r.type == RGB and job.colors < r.used):
        r = R.reduce(r, job.colors, job.colordither)
    if job.dither and r.depth > 1:
        r = R.recolour(R.dither(r) if job.dither == 1 else R.halftone(r), *inks)
    if job.expand:
        r = R.expand(r)
    return R.compress(r)


def composed(images: list[tuple[Raster, Job]], target: RenderTarget = RenderTarget()) -> list[Raster]:
    """Processed images, with those to be merged laid over the one before them."""
    out: list[Raster] = []
    for r, job in images:
        r = process(r, job, target)
        if job.merge and out:
            base = out[-1]
            at = job.at or (0, 0)
            if job.center:
                at = tuple(int((a - b) / 2) for a, b in ((base.width, r.width), (base.height, r.height)))
            out[-1] = R.merge(base, r, *at, target.gamma)
        else:
            out.append(r)
    return out


def fit_to_target(r: Raster, target: RenderTarget, job: Job = Job()) -> Raster:
    """Sized, reduced and corrected for a target: what would be shown."""
    r = R.default_gamma(r, job.gamma)
    if target.fullscreen or target.fillscreen:
        wide, high = target.width / r.width, target.height / r.height
        fill = target.fillscreen and target.onroot
        z = int((max(wide, high) if fill else min(wide, high)) * 100 + 0.5)
        if target.fillscreen or target.onroot:
            r = R.zoom(r, z, z)
        if not fill:  # centred, with a border around it
            x, y = int((r.width - target.width) / 2), int((r.height - target.height) / 2)
            r = R.clip(r, x, y, target.width, target.height, colour(job.border) or (65535,) * 3)
    if target.mono and r.type != BITMAP:
        return R.dither(r)
    if target.max_colors is not None and r.type != BITMAP:
        if target.max_colors <= 2:
            return R.dither(r)
        if r.type == TRUE:
            r = R.reduce(r, target.max_colors - 16 if target.max_colors >= 256 else target.max_colors, job.colordither, target.gamma)
    return R.with_gamma(r, target.gamma)


def best_depth(image: int, depths: list[int]) -> int:
    """The smallest depth that holds an image, else the largest there is."""
    return min((d for d in depths if d >= image), default=max(depths))
