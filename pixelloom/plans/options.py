"""The option language: 61 flags, abbreviations, what persists from image to image.

A command is a list of words; flags may be shortened to any prefix that fits one flag
alone. What is set before an image name belongs to that image; some of it stays on for
later images until -newoptions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: General flags, with the number of words each takes.
GENERAL = {
    "debug": 0, "dumpcore": 0, "default": 0, "delay": 1, "display": 1, "dispgamma": 1, "fillscreen": 0, "fit": 0, "forall": 0, "fork": 0, "fullscreen": 0, "geometry": 1, "goto": 1, "help": 0,
    "identify": 0, "install": 0, "list": 0, "onroot": 0, "path": 0, "pixmap": 0, "private": 0, "quiet": 0, "supported": 0, "verbose": 0, "version": 0, "view": 0, "visual": 1, "windowid": 1,
    "cache": 0, "delete": 0, "focus": 0,
}
#: Flags of single images.
LOCAL = {
    "at": 1, "background": 1, "border": 1, "brighten": 1, "center": 0, "clip": 1, "colordither": 0, "cdither": 0, "colors": 1, "dither": 0, "expand": 0, "foreground": 1, "gamma": 1, "gray": 0,
    "grey": 0, "halftone": 0, "idelay": 1, "invert": 0, "iscale": 1, "merge": 0, "name": 1, "newoptions": 0, "normalize": 0, "rotate": 1, "smooth": 0, "title": 1, "xpm": 1, "xzoom": 1,
    "yzoom": 1, "zoom": 1,
}
FLAGS = GENERAL | LOCAL
#: Accepted and passed over: they concern windows, processes or deletion.
WITHOUT_EFFECT = frozenset("debug dumpcore delay display fit fork goto install pixmap private quiet verbose windowid cache delete focus idelay".split())
#: Fields of a job that later images take over.
PERSISTENT = ("border", "bright", "gamma", "colors", "colordither", "dither", "normalize", "smooth", "xpm", "xzoom", "yzoom", "zoom_auto", "iscale_auto")
#: Visual classes that -visual knows, by any unique beginning.
VISUALS = ("DirectColor", "GrayScale", "PseudoColor", "StaticColor", "StaticGray", "TrueColor")


@dataclass(frozen=True)
class RenderTarget:
    """What images are made for, in place of a display."""

    width: int = 1280
    height: int = 1024
    gamma: float = 2.2
    max_colors: int | None = None  # None: true colour
    mono: bool = False
    fullscreen: bool = False
    fillscreen: bool = False
    onroot: bool = False
    forall: bool = False  # fit all images, not the first alone
    mode: str = "view"  # or identify, list, path, supported, version, default
    visual: str | None = None


@dataclass(frozen=True)
class Job:
    """One image with its options."""

    name: str = ""
    at: tuple[int, int] | None = None
    background: str | None = None
    border: str | None = None
    bright: int = 0
    center: bool = False
    clip: tuple[int, int, int, int] = (0, 0, 0, 0)
    colordither: bool = False
    colors: int = 0
    dither: int = 0  # 1 error diffusion, 2 halftone
    expand: bool = False
    foreground: str | None = None
    gamma: float | None = None
    gray: bool = False
    iscale: int = 0
    iscale_auto: bool = False
    merge: bool = False
    normalize: bool = False
    rotate: int = 0
    smooth: int = 0
    title: str | None = None
    xpm: str | None = None
    xzoom: int = 0
    yzoom: int = 0
    zoom_auto: bool = False


@dataclass
class Parsed:
    target: RenderTarget = field(default_factory=RenderTarget)
    jobs: list[Job] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def resolve(word: str) -> str:
    """The flag a word stands for; NOTOPT, SHORTOPT or BADOPT if there is none, or several."""
    if not word.startswith("-"):
        return "NOTOPT"
    found = [f for f in FLAGS if f.startswith(word[1:])]
    return found[0] if len(found) == 1 else "SHORTOPT" if found else "BADOPT"


def number(word: str, low: float, high: float, kind=int):
    """A number within bounds, else None."""
    try:
        v = kind(word)
    except ValueError:
        return None
    return v if low <= v <= high else None


def numbers(word: str, n: int) -> tuple[int, ...] | None:
    parts = word.split(",")
    try:
        return tuple(int(p) for p in parts) if len(parts) == n else None
    except ValueError:
        return None


def visual_class(word: str) -> str | None:
    found = [v for v in VISUALS if v.lower().startswith(word.lower())]
    return found[0] if len(found) == 1 else None


def local_change(job: Job, flag: str, word: str | None) -> Job | None:
    """``job`` with a flag of a single image set; None if its word makes no sense."""
    switches = {"center": {"center": True}, "colordither": {"colordither": True}, "cdither": {"colordither": True}, "dither": {"dither": 1}, "halftone": {"dither": 2}, "expand": {"expand": True}, "gray": {"gray": True}, "grey": {"gray": True}, "invert": {"foreground": "white", "background": "black"}, "merge": {"merge": True}, "normalize": {"normalize": True}, "smooth": {"smooth": job.smooth + 1}}
    if flag in switches:
        return replace(job, **switches[flag])
    if flag in ("background", "border", "foreground", "title"):
        return replace(job, **{flag: word})
    if flag in ("at", "clip"):
        v = numbers(word, 2 if flag == "at" else 4)
        return v and replace(job, **{flag: v})
    if flag == "brighten":
        v = number(word, 1, 10**6)
        return v and replace(job, bright=v)
    if flag == "gamma":
        v = number(word, 0.01, 100, float)
        return v and replace(job, gamma=v)
    if flag == "colors":
        v = number(word, 2, 65536)
        return v and replace(job, colors=v)
    if flag == "rotate":
        v = number(word, -(10**6), 10**6)
        if v is None or v % 90:
            return None
        return replace(job, rotate=v % 360 if v < 0 else v)
    if flag == "iscale":
        if word == "auto":
            return replace(job, iscale_auto=True)
        v = number(word, -16, 16)
        return None if v is None else replace(job, iscale=v)
    if flag == "xpm":
        return replace(job, xpm=word) if word in ("m", "g4", "g", "c") else None
    if flag == "zoom" and word == "auto":
        return replace(job, zoom_auto=True)
    v = number(word, 1, 10**5)
    if v is None:
        return None
    return replace(job, xzoom=v, yzoom=v) if flag == "zoom" else replace(job, **{flag: v})


def general_change(target: RenderTarget, flag: str, word: str | None) -> RenderTarget | None:
    if flag in ("fullscreen", "fillscreen", "onroot", "forall"):
        return replace(target, **{flag: True})
    if flag in ("identify", "list", "path", "supported", "version", "help", "default", "view"):
        return replace(target, mode=flag)
    if flag == "geometry":  # WxH, and a place that a target doesn't have; 0 leaves a size as it is
        size = re.fullmatch(r"(?:(\d+)x(\d+))?(?:[+-]\d+[+-]\d+)?", word)
        return size and replace(target, width=int(size[1] or 0) or target.width, height=int(size[2] or 0) or target.height)
    if flag == "dispgamma":
        v = number(word, 0.05, 20, float)
        return v and replace(target, gamma=v)
    if flag == "visual":
        v = visual_class(word)
        if v is None:
            return None
        limits = {"TrueColor": None, "DirectColor": None, "StaticGray": 2}
        return replace(target, visual=v, max_colors=limits.get(v, 256), mono=v == "StaticGray")
    return target  # WITHOUT_EFFECT


def parse(words: list[str], target: RenderTarget | None = None) -> Parsed:
    """A whole command. Bad words are reported and passed over."""
    out, job = Parsed(target or RenderTarget()), Job()
    at = 0
    while at < len(words):
        word = words[at]
        flag = resolve(word)
        at += 1
        if flag in ("SHORTOPT", "BADOPT"):
            out.errors.append(f"{word}: {'not unique' if flag == 'SHORTOPT' else 'unknown'}")
            continue
        if flag == "NOTOPT":
            flag, values = "name", [word]
        else:
            values = words[at : at + FLAGS[flag]]
            at += FLAGS[flag]
            if len(values) < FLAGS[flag]:
                out.errors.append(f"{word}: a word is missing")
                break
        value = values[0] if values else None
        if flag == "name":
            out.jobs.append(replace(job, name=value))
            job = Job(**{k: getattr(job, k) for k in PERSISTENT})
        elif flag == "newoptions":
            job = replace(job, **{f.name: f.default for f in fields(Job) if f.name in PERSISTENT})
        else:
            changed = local_change(job, flag, value) if flag in LOCAL and flag not in WITHOUT_EFFECT else None
            told = general_change(out.target, flag, value) if flag not in LOCAL or flag in WITHOUT_EFFECT else None
            if changed is None and told is None:
                out.errors.append(f"{word} {value}: no sense")
            job, out.target = changed or job, told or out.target
    return out


def trailing(job: Job, text: str) -> Job:
    """``job`` with the options that a file carries behind its image: they go before what the command says."""
    words = text.split()
    at = 0
    while at < len(words):
        flag = resolve(words[at])
        n = FLAGS.get(flag, 0)
        if flag in LOCAL and flag not in ("name", "newoptions") and flag not in WITHOUT_EFFECT:
            job = local_change(job, flag, words[at + 1] if n and at + 1 < len(words) else None if not n else "") or job
        at += 1 + n
    return job


def catalogue(spark: SparkSession) -> DataFrame:
    """name, position, words, local of each flag."""
    rows = [(n, k, w, n in LOCAL) for k, (n, w) in enumerate(FLAGS.items())]
    return spark.createDataFrame(rows, "name string, position int, words int, is_local boolean")


def resolve_words(words: DataFrame, column: str = "word") -> DataFrame:
    """``words`` with flag: the relational form of ``resolve``. The flags are a constant array, so nothing is joined."""
    names = F.array(*[F.lit(n) for n in FLAGS])
    found = F.filter(names, lambda n: n.startswith(F.substring(F.col(column), 2, 1 << 20)))
    flag = F.when(~F.col(column).startswith("-"), "NOTOPT").when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, "SHORTOPT").otherwise("BADOPT")
    return words.withColumn("flag", flag)
