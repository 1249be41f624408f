"""Options, paths, files and streams."""

import gzip

import numpy as np
import pytest

from pixelloom.functions.colour import parse_colours, read_names
from pixelloom.image import true, unpack
from pixelloom.operators import raster as R
from pixelloom.plans import command, paths
from pixelloom.plans import jobs as J
from pixelloom.plans import options as O
from pixelloom.sources import encode, files
from pixelloom.sources.registry import BUILT_IN, Format, decoded, register_decoder, registry, use
from pixelloom.sources.stream import NotMine, last_options, with_trailing
from pixelloom.streaming import ingest


def test_all_flags():
    assert len(O.GENERAL) + len(O.LOCAL) == 61 and not set(O.GENERAL) & set(O.LOCAL)
    assert [O.resolve(w) for w in ("-del", "-zoom", "-q", "-zz", "x", "-iden", "-c")] == ["SHORTOPT", "zoom", "quiet", "BADOPT", "NOTOPT", "identify", "SHORTOPT"]


def test_what_persists():
    p = O.parse("-smooth -smooth -brighten 120 -gray -rotate -90 -merge a -border red b -newoptions c".split())
    a, b, c = p.jobs
    assert (a.name, a.smooth, a.bright, a.gray, a.rotate, a.merge) == ("a", 2, 120, True, 270, True)
    assert (b.smooth, b.bright, b.gray, b.rotate, b.merge, b.border) == (2, 120, False, 0, False, "red")
    assert c == O.Job(name="c") and not p.errors


def test_words_and_errors():
    p = O.parse("-colors 1 -rotate 45 -zoom auto -clip 1,2,3,4 -at 5,-6 -invert -name -odd -dispgamma 99 -visual true -fullscreen".split())
    job = p.jobs[0]
    assert job.name == "-odd" and job.zoom_auto and job.clip == (1, 2, 3, 4) and job.at == (5, -6) and job.foreground == "white" and job.background == "black"
    assert len(p.errors) == 3 and p.target.fullscreen and p.target.visual == "TrueColor" and p.target.gamma == 2.2
    assert O.parse(["-visual", "s", "x"]).errors and O.parse(["-zoom"]).errors
    every = [w for f, n in O.FLAGS.items() for w in [f"-{f}"] + ["90"] * n]
    assert len(O.parse(every).jobs) == 1


def test_trailing_options_win():
    job = O.trailing(O.Job(rotate=90, smooth=1), "-rotate 180 -smooth -delay 3 -bogus -identify -colors 16")
    assert (job.rotate, job.smooth, job.colors) == (180, 2, 16)


def test_paths(tmp_path, monkeypatch):
    monkeypatch.setenv("PICS", str(tmp_path))
    found, extensions = paths.read_config("# note\npath= $PICS/a \\\n\n  /b\\ c\nextension= .gif .ppm # more\n")
    assert found == [f"{tmp_path}/a", "/b c"] and extensions == [".gif", ".ppm"]
    there = {"/b c/x.ppm", "/b c/x.ppm.Z", "y.gif"}
    look = lambda n: paths.find_image(n, found, extensions, there.__contains__)
    assert look("x") == "/b c/x.ppm" and look("y") == "y.gif" and look("z") is None and look("stdin") == "stdin"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(9)
    rasters = {}
    for k, (form, encoder) in enumerate(sorted(encode.ENCODERS.items())):
        r = true(rng.integers(0, 256, (6 + k, 5, 3)))
        rasters[f"{form}.img"] = r
        (path / f"{form}.img").write_bytes(encoder(r))
    (path / "packed.img").write_bytes(gzip.compress(encode.ppm(rasters["png.img"])))
    (path / "told.img").write_bytes(with_trailing(encode.ppm(rasters["png.img"]), "-rotate 90"))
    (path / "bad.img").write_bytes(b"words, not pixels")
    (path / "short.img").write_bytes(encode.ppm(rasters["png.img"])[:-5])
    return path, rasters


def test_scan_decode_process(spark, folder):
    path, rasters = folder
    images = files.decode(files.scan(spark, f"file://{path}", pattern="*.img")).cache()
    status = {r.path.rsplit("/", 1)[1]: r.status for r in images.select("path", "status").collect()}
    assert status["bad.img"] == "unknown" and status["short.img"] == "partial" and sum(s == "ok" for s in status.values()) == 7
    done = {r.path.rsplit("/", 1)[1]: r for r in files.process(images, O.Job(xzoom=200)).collect()}
    assert done["told.img"].width == 2 * rasters["png.img"].height and done["png.img"].width == 10 and done["bad.img"].data is None
    whole = files.explode_pixels(images.filter("path like '%bmp.img'"))
    assert sorted((r.y, r.x, r.r, r.g, r.b) for r in whole.collect()) == [(y, x, *map(int, rasters["bmp.img"].pixels[y, x])) for y in range(rasters["bmp.img"].height) for x in range(5)]
    back = files.pack_pixels(whole).first()
    assert bytes(back.data) == rasters["bmp.img"].pixels.tobytes()
    lines = {r.path.rsplit("/", 1)[1]: r for r in files.identify(files.scan(spark, f"file://{path}")).collect()}
    assert lines["tga.img"].format == "tga" and "5x10 Targa" in lines["tga.img"].description and lines["bad.img"].format is None
    assert files.supported(spark).count() == len(BUILT_IN)


def test_render_and_write(spark, folder, tmp_path):
    path, rasters = folder
    images = files.decode(files.scan(spark, f"file://{path}", pattern="s*n.img"))
    rendered = files.render(images, O.RenderTarget(gamma=1.0), "png")
    out = files.write_files(rendered, f"file://{tmp_path}/out").collect()
    assert len(out) == 1
    again = files.decode(files.scan(spark, f"file://{tmp_path}/out")).first()
    assert bytes(again.data) == rasters["sun.img"].pixels.tobytes() and again.format == "png"
    edited = files.edit_options(files.scan(spark, f"file://{path}", pattern="told.img"), "-gray").first()
    assert files.options_of(spark.createDataFrame([("x", edited.content)], "path string, content binary")).first().options == "-gray"


def test_mapped_operator(spark, folder):
    path, rasters = folder
    images = files.decode(files.scan(spark, f"file://{path}", pattern="bmp.img"))
    row = files.mapped(images, R.gray).first()
    assert bytes(row.data) == R.gray(rasters["bmp.img"].but(gamma=1.0)).pixels.tobytes()


def test_stream(spark, folder, tmp_path):
    path, _ = folder
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, f"file://{path}", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9
    assert ingest.identified_stream(spark, f"file://{path}").isStreaming


def dots(c, context):
    if c.take(4) != b"DOTS":
        raise NotMine
    return true(np.full((1, c.byte(), 3), 7))


def test_own_decoder_reaches_workers(spark):
    """A format of one's own is tried where files are decoded, not on the driver alone."""
    rows = [("a", bytearray(b"DOTS\5")), ("b", bytearray(b"P4\n8 1\n\xf0")), ("c", bytearray(b"DOT"))]
    given = spark.createDataFrame(rows, "path string, content binary")
    before = {r.path: r.status for r in files.decode(given).collect()}
    assert before == {"a": "unknown", "b": "ok", "c": "unknown"}
    register_decoder("dots", 0, dots, "dots")
    try:
        assert decoded("x", b"DOTS\5").raster.width == 5
        found = {r.path: r for r in files.decode(given).collect()}
        assert {p: (r.status, r.format) for p, r in found.items()} == {"a": ("ok", "dots"), "b": ("ok", "pnm"), "c": ("unknown", None)}
        assert found["a"].width == 5 and bytes(found["a"].data) == b"\7" * 15
        said = {r.path: r for r in files.identify(given).collect()}
        assert (said["a"].width, said["a"].format, said["b"].format, said["c"].status) == (5, "dots", "pnm", "unknown")
        assert files.supported(spark).first().format == "dots"
        later = files.decode(given)  # what was known when the work was described counts
    finally:
        use(BUILT_IN)
    assert {r.path: r.status for r in later.collect()} == {"a": "ok", "b": "ok", "c": "unknown"}
    assert {r.path: r.status for r in files.decode(given).collect()} == before
    own = registry().with_format(Format("dots", dots, "dots"), 3)
    assert {r.path: r.status for r in files.decode(given, formats=own).collect()}["a"] == "ok" and len(registry()) == 20


def test_own_decoder_in_commands_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.dots").write_bytes(b"DOTS\3")
    register_decoder("dots", 0, dots, "dots")
    try:
        assert [(r.width, r.height) for r in command.run(spark, [f"file://{tmp_path}/in/x.dots"]).collect()] == [(3, 1)]
        ingest.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").first().format == "dots"
    finally:
        use(BUILT_IN)


def test_listing_and_looking_up_on_any_file_system(spark, tmp_path):
    for n in ("a/one.gif", "a/two.ppm", "b/three.gif"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    folders = [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]
    rows = paths.list_images(spark, folders).orderBy("position", "name").collect()
    assert [(r.position, r.name, r.length) for r in rows] == [(0, "one.gif", 9), (0, "two.ppm", 9), (1, "three.gif", 11)]
    assert paths.list_images(spark, []).count() == 0
    assert [tuple(r) for r in paths.show_path(spark, ["p", "q"], [".gif"]).collect()] == [("path", 0, "p"), ("path", 1, "q"), ("extension", 0, ".gif")]
    there = paths.file_exists(spark)
    assert paths.find_image("three", folders, [".ppm", ".gif"], there) == f"file://{tmp_path}/b/three.gif"
    assert not there(folders[0]) and paths.find_image("none", folders, [".gif"], there) is None


def test_options_are_found_from_the_end():
    whole = with_trailing(b"P5 1 1 255\n\x07" + bytes(5000), "-gray", "viewer")
    assert last_options(whole + b"junk XXX junk" * 500) == "-gray"
    assert last_options(whole + with_trailing(b"", "-smooth")) == "-smooth"
    assert last_options(b"no options XXX viewer trailing options XXX0005\"-gra") is None


def test_geometry_sizes_the_target():
    size = lambda word: (t := O.parse(["-geometry", word, "x"]).target, (t.width, t.height))[1]
    assert size("300x200") == size("300x200+5-7") == (300, 200)
    assert size("0x200") == (O.RenderTarget().width, 200) and size("+1+1") == (O.RenderTarget().width, O.RenderTarget().height)
    assert O.parse(["-geometry", "wide", "x"]).errors


def test_a_systems_own_colour_names(spark):
    more = read_names("1 2 3 my colour\n")
    rows = spark.createDataFrame([("My Colour",), ("snow",), ("none",)], "spec string")
    got = {r.spec: (r.red, r.green, r.blue, r.known) for r in parse_colours(rows, more=more).collect()}
    assert got == {"My Colour": (257, 514, 771, True), "snow": (65535, 64250, 64250, True), "none": (0, 0, 0, False)}
    assert not parse_colours(rows).filter("known and spec = 'My Colour'").count()


def test_commands_by_mode(spark, tmp_path):
    rng = np.random.default_rng(6)
    a, b = true(rng.integers(0, 256, (6, 8, 3)), gamma=1.0), true(rng.integers(0, 256, (2, 2, 3)), gamma=1.0)
    for n, r in (("a.ppm", a), ("b.ppm", b)):
        (tmp_path / n).write_bytes(encode.ENCODERS["ppm"](r))
    here = [f"file://{tmp_path}"]
    run = lambda words: command.run(spark, words.split(), here, [".ppm"])
    assert sorted((r.format, r.width, r.height) for r in run("-identify a b none").collect()) == [("pnm", 2, 2), ("pnm", 8, 6)]
    assert sorted(r.name for r in run("-list").collect()) == ["a.ppm", "b.ppm"]
    assert [tuple(r) for r in run("-path").collect()] == [("path", 0, here[0]), ("extension", 0, ".ppm")]
    assert run("-supported").count() == len(BUILT_IN) and run("-help").count() == 61 and run("-version").count() == 1
    root = unpack(run("-default -geometry 9x5").drop("position").first().asDict(True))
    assert root.pixels.shape == (5, 9) and (root.pixels == R.tile(R.root_weave(), 9, 5).pixels).all()
    # the second is laid over the first, the third is by itself and shown twice as large
    got = [unpack(r.asDict(True)) for r in run("-dispgamma 1.0 -rotate 90 a -merge -at 1,1 b -newoptions -zoom 200 b").orderBy("position").drop("position").collect()]
    assert len(got) == 2
    assert (got[0].pixels == R.merge(R.rotate(a, 90), b, 1, 1, 1.0).pixels).all() and (got[1].pixels == R.zoom(b, 200, 200).pixels).all()
    assert run("none").count() == 0


def test_only_images_of_one_chain_meet(spark, tmp_path):
    """Eight names, some merged, one that can't be decoded: each chain is a group of its own, as if all were laid out in a row."""
    rng = np.random.default_rng(8)
    rasters = {n: true(rng.integers(0, 256, (4 + k, 5, 3)), gamma=1.0) for k, n in enumerate("abcdef")}
    for n, r in rasters.items():
        (tmp_path / f"{n}.ppm").write_bytes(encode.ENCODERS["ppm"](r))
    (tmp_path / "bad.ppm").write_bytes(b"P6 9")
    words = "-dispgamma 1.0 -merge a b -merge -at 1,2 c bad -merge -center d e -merge f -rotate 90 a".split()
    parsed = O.parse(words)
    here = [f"file://{tmp_path}"]
    found = command.run(spark, words, here, [".ppm"])
    got = {r["position"]: unpack(r) for r in (x.asDict(True) for x in found.collect())}
    told = [(rasters[j.name].but(title=f"{j.name}.ppm"), j) for j in parsed.jobs if j.name in rasters]
    want = [J.fit_to_target(r, parsed.target) for r in J.composed(told, parsed.target)]
    assert sorted(got) == list(range(len(want))) == [0, 1, 2, 3]
    for k, r in enumerate(want):
        assert (got[k].pixels == r.pixels).all() and got[k].title == r.title
    images = command.processed(command.named_files(spark, parsed, here, [".ppm"]), parsed)
    assert sorted(tuple(r) for r in command.chains(images).collect()) == [(0, 0), (1, 1), (2, 1), (4, 1), (5, 2), (6, 2), (7, 3)]
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString().split("AppendColumns")[0].split("BroadcastExchange")[0]


def test_all_images_are_fitted_only_if_asked(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.ppm").write_bytes(encode.ENCODERS["ppm"](true(np.zeros((4, 4, 3)), gamma=1.0)))
    sizes = lambda words: [(r.width, r.height) for r in command.run(spark, words.split(), [f"file://{tmp_path}"], [".ppm"]).orderBy("position").collect()]
    assert sizes("-fillscreen -geometry 12x8 a b") == [(12, 8), (4, 4)]
    assert sizes("-fillscreen -forall -geometry 12x8 a b") == [(12, 8), (12, 8)]
