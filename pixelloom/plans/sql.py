"""DuckDB SQL for the registered queries, written on its own: joins and generated grids where Spark projects."""

from __future__ import annotations

from . import known_tables

CELLS = [int(c, 16) for c in known_tables.CELLS.split()]
FLAGS = known_tables.FLAGS.split()
SENSORS = dict(line.split(" ", 1) for line in known_tables.SENSORS.strip().splitlines())

Q = "greatest(0, least(255, floor((embedding[{} + 1]::DOUBLE + 0.5) * 255)))::INT"
C1 = f"""
WITH c1 AS (
  SELECT vec_id AS image_id, (i % 8)::INT AS x, (i // 8)::INT AS y, {Q.format('i')} AS r, {Q.format('(i + 21) % 64')} AS g, {Q.format('(i + 42) % 64')} AS b
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64)
), ip AS (
  SELECT image_id, x, y, (r // 8)::INT AS idx FROM c1
), pal AS (
  SELECT vec_id AS image_id, i::INT AS idx, (i * 2114)::INT AS red, ((31 - i) * 2114)::INT AS green, ((i * i * 68 + ((vec_id % 7 + 7) % 7) * 256) % 65536)::INT AS blue
  FROM (SELECT vec_id, unnest(range(32)) AS i FROM embeddings WHERE len(embedding) = 64)
), im AS (
  SELECT vec_id AS image_id FROM embeddings WHERE len(embedding) = 64
), other AS (
  SELECT xor(image_id, 1) AS image_id, x, y, r, g, b FROM c1
)
"""
LEVEL = "((r * 7680 + 50) // 100 + (g * 15104 + 50) // 100 + (b * 2816 + 50) // 100)"


def over_c1(select: str, more: str = "") -> str:
    return C1 + more + select


def share(k: int) -> str:
    """k sixteenths of an error, cut towards 0."""
    return f"trunc(e * {k} / 16.0::DOUBLE)::INT"


def added(row: str, *parts: tuple[str, str]) -> str:
    """A row of eight errors with more at some places."""
    more = "".join(f" + CASE WHEN j = {at} THEN {v} ELSE 0 END" for at, v in parts)
    return f"list_transform(range(8), lambda j: {row}[j + 1]{more})"


#: Error diffusion, a pixel a step: cur and nxt are the rows of levels with the errors so far; odd rows run backwards.
DITHERED = f""", lv AS (
  SELECT image_id, list({LEVEL} ORDER BY y, x) AS l FROM c1 GROUP BY image_id
), d AS (
  SELECT image_id, l, 0 AS s, l[1:8] AS cur, list_transform(range(8), lambda j: 0) AS nxt, 0 AS x, 0 AS y, 0 AS black FROM lv
  UNION ALL
  SELECT image_id, l, s + 1,
    CASE WHEN s % 8 = 7 THEN list_transform(range(8), lambda j: coalesce(l[s + 2 + j], 0) + moved[j + 1]) ELSE {added("cur", ("px + way", share(7)))} END,
    CASE WHEN s % 8 = 7 THEN list_transform(range(8), lambda j: 0) ELSE moved END, px, s // 8, (NOT white)::INT
  FROM (
    SELECT *, {added("nxt", ("px", share(5)), ("px + way", share(1)), ("px - way", share(3)))} AS moved
    FROM (SELECT *, cur[px + 1] > 32640 AS white, cur[px + 1] - CASE WHEN cur[px + 1] > 32640 THEN 65280 ELSE 0 END AS e
      FROM (SELECT image_id, l, s, cur, nxt, CASE WHEN s // 8 % 2 = 0 THEN s % 8 ELSE 7 - s % 8 END AS px, CASE WHEN s // 8 % 2 = 0 THEN 1 ELSE -1 END AS way FROM d WHERE s < 64))
  )
)
"""
BLACK_AND_WHITE = C1.replace("WITH c1", "WITH RECURSIVE c1", 1) + DITHERED + "SELECT image_id, x::INT AS x, y::INT AS y, " + ", ".join(f"255 * (1 - black) AS {c}" for c in "rgb") + " FROM d WHERE s > 0"


def every(value: str) -> str:
    """A number below 256 for each pixel, in order, as digits."""
    return f"string_agg(lpad(lower(hex({value})), 2, '0'), '' ORDER BY y, x)"


def ramp(n: int, red: str, green: str, blue: str) -> str:
    """A palette's sum, by formulas of its numbers."""
    return f"(SELECT sum(({red} + 3 * ({green}) + 7 * ({blue})) * (k + 1))::BIGINT FROM range({n}) t(k))"


RGB_DIGITS = "string_agg(lpad(lower(hex(r)), 2, '0') || lpad(lower(hex(g)), 2, '0') || lpad(lower(hex(b)), 2, '0'), '' ORDER BY y, x)"
DARK = every("(r < 128)::INT")
#: Of files of each format: its name, the type, width, height, depth and palette's sum of what they show, and its bytes as digits.
SHOWN = (
    ("fbm", "TRUE", 8, 8, 24, "0", RGB_DIGITS),
    ("cmu", "BITMAP", 8, 8, 1, "720885", DARK),
    ("faces", "RGB", 8, 8, 8, ramp(256, *["k * 256"] * 3), every("r")),
    ("gif", "RGB", 8, 8, 7, ramp(128, "k * 512", "(255 - k) * 256", "k * 256"), every("r // 2")),
    ("jpeg", "RGB", 8, 8, 8, ramp(256, *["k * 257"] * 3), "repeat(lpad(lower(hex(greatest(any_value(r) FILTER (x = 0 AND y = 0), 1))), 2, '0'), 64)"),
    ("rle", "TRUE", 8, 8, 24, "0", RGB_DIGITS),
    ("pcd", "TRUE", 192, 128, 24, "0", "repeat(lpad(lower(hex(((any_value(r) FILTER (x = 0 AND y = 0) * 5 // 8) * floor(255.0::DOUBLE / 182 * 65536 + 0.5)::BIGINT + 32768) // 65536)), 2, '0'), 192 * 128 * 3)"),
    ("xwd", "RGB", 8, 8, 8, ramp(256, "k * 257", "(255 - k) * 257", "k"), every("r")),
    ("mcidas", "RGB", 8, 8, 8, ramp(255, *["k * 257"] * 3), every("least(r, 254)")),
    ("g3", "BITMAP", 8, 8, 1, "720885", DARK),
    ("pcx", "RGB", 8, 8, 8, ramp(256, "k * 256", "(255 - k) * 256", "7 * 256"), every("r")),
    ("img", "BITMAP", 8, 8, 1, "720885", DARK),
    ("mac", "BITMAP", 576, 720, 1, "720885", "repeat(" + " || ".join(f"repeat(({DARK})[{16 * y + 1}:{16 * y + 16}], 72)" for y in range(8)) + ", 90)"),
    ("xpm", "RGB", 8, 8, 2, str((0x1010 + 3 * 0x2020 + 7 * 0x3030) + 65535 * 2 + 3 * 65535 * 3), every("r // 64")),
    ("xbm", "BITMAP", 8, 8, 1, "720885", DARK),
)
HEADS = {
    "fbm": (0, " is a 8x8 FBM image, depth 24 with 0 colors"), "cmu": (2, " is a 8x8 1 plane CMU WM raster"), "faces": (256, " is a  8x8 8-bit grayscale Faces Project image"),
    "gif": (128, " is a 8x8 GIF87a image with 128 colors"), "jpeg": (256, " is a 8x8 JPEG image, color space Grayscale, 1 comps., Huffman coding"), "rle": (0, " is a 8x8 24 bit color RLE image with no map"),
    "pcd": (0, " is a 192x128 Photograph on CD Image"), "xwd": (256, " is a 8x8 XWD image in 8 bit ZPixmap MSB header,  MSB byte order"), "mcidas": (255, " is a McIDAS area, GOES-1 Visible 0 0 (0, 0) (0, 0)"),
    "g3": (2, " is a G3 FAX image."), "pcx": (256, " is a 8x8 PC Paintbrush image"), "img": (2, " is a 8x8 GEM Bit Image"), "mac": (2, " is a 576x720 MacPaint image"),
    "xpm": (4, " is a 8x8 X Pixmap image (Version 3) with 4 colors titled 'image'"), "xbm": (2, " is a 8x8 X11 bitmap file titled 'image'"),
}


def shown_files() -> str:
    rows = ", ".join(f"({k}, '{n}', '{t}', {w}, {h}, {d})" for k, (n, t, w, h, d, _, _) in enumerate(SHOWN))
    sums = " ".join(f"WHEN {k} THEN {p}" for k, (*_, p, _) in enumerate(SHOWN))
    # each format's images are gathered by themselves, so no image is shown in all of them
    data = " UNION ALL ".join(f"SELECT image_id, {digits} AS digits FROM c1 WHERE image_id % {len(SHOWN)} = {k} GROUP BY image_id" for k, (*_, digits) in enumerate(SHOWN))
    return f"""SELECT image_id, image_id || '.' || format AS path, format, 'ok' AS status, type, width, height, depth, md5(digits) AS data_md5, (CASE k {sums} END)::BIGINT AS palette_sum
      FROM ({data}) JOIN (VALUES {rows}) f(k, format, type, width, height, depth) ON k = image_id % {len(SHOWN)}"""


def identified_files() -> str:
    rows = ", ".join(f"({k}, '{n}', {'0, 0' if n == 'g3' else f'{w}, {h}'}, {d}, {HEADS[n][0]}, '{HEADS[n][1].replace(chr(39), chr(39) * 2)}')" for k, (n, _, w, h, d, _, _) in enumerate(SHOWN))
    return f"""SELECT image_id || '.' || format AS path, format, 'ok' AS status, width, height, depth, colors, image_id || '.' || format || said AS told
      FROM im JOIN (VALUES {rows}) f(k, format, width, height, depth, colors, said) ON k = image_id % {len(SHOWN)}"""


def gamma(v: str, exponent: str) -> str:
    return f"floor(0.5 + 255 * pow({v} / 255.0::DOUBLE, {exponent}))::INT"


def bright(v: str, most: int) -> str:
    return f"least({most}, floor({v}::FLOAT * 1.3::FLOAT))::INT"


def zoomed(source: str, w: int, h: int, xz: int, yz: int) -> str:
    """A grid of places of the result, joined with the places they take."""
    ow, oh = w * xz // 100, h * yz // 100
    return f"""SELECT image_id, a::INT AS x, c::INT AS y, r, g, b FROM (SELECT unnest(range({ow})) AS a), (SELECT unnest(range({oh})) AS c), {source}
      WHERE x = a * {w - 1} // {max(1, ow - 1)} AND y = c * {h - 1} // {max(1, oh - 1)}"""


def overlaid(over: str, dx: int, dy: int, base: str = "c1") -> str:
    return f"SELECT d.image_id, d.x, d.y, coalesce(s.r, d.r) AS r, coalesce(s.g, d.g) AS g, coalesce(s.b, d.b) AS b FROM {base} d LEFT JOIN {over} s ON s.image_id = d.image_id AND s.x + {dx} = d.x AND s.y + {dy} = d.y"


def smoothed(source: str) -> str:
    means = ", ".join(f"((sum({c}) + 8) // 9)::INT AS {c}" for c in "rgb")
    return f"""SELECT p.image_id, p.x, p.y, {means} FROM (SELECT image_id, x, y, least(greatest(x + dx, lo_x), hi_x) AS nx, least(greatest(y + dy, lo_y), hi_y) AS ny
      FROM {source}, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM {source})) p
      JOIN {source} q ON q.image_id = p.image_id AND q.x = nx AND q.y = ny GROUP BY p.image_id, p.x, p.y"""


CHANNELS = "(SELECT image_id, 'r' AS channel, r // 8 AS value FROM c1 UNION ALL SELECT image_id, 'g', g // 8 FROM c1 UNION ALL SELECT image_id, 'b', b // 8 FROM c1)"
PLACE = "image_id, x, y"
PARSED = """
  CASE WHEN NOT regexp_full_match(lower(spec), '#([0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{9}|[0-9a-f]{12})') THEN NULL ELSE
    CASE len(spec) - 1
      WHEN 3 THEN ('0x' || substr(lower(spec), 2 + @ * 1, 1))::BIGINT * 4369
      WHEN 6 THEN ('0x' || substr(lower(spec), 2 + @ * 2, 2))::BIGINT * 257
      WHEN 9 THEN ('0x' || substr(lower(spec), 2 + @ * 3, 3))::BIGINT * 65535 // 4095
      ELSE ('0x' || substr(lower(spec), 2 + @ * 4, 4))::BIGINT END END"""


def parsed(specs: str) -> str:
    names = ", ".join(f"('{n}', {r * 257}, {g * 257}, {b * 257})" for n, (r, g, b) in sorted(known_tables.NAMED.items()))
    channels = ", ".join(f"coalesce({PARSED.replace('@', str(k))}, n_{c}, 0)::INT AS {c}" for k, c in enumerate(("red", "green", "blue")))
    return f"WITH s AS ({specs}), n(name, n_red, n_green, n_blue) AS (VALUES {names}) SELECT p_partkey, spec, {channels}, ({PARSED.replace('@', '0')}) IS NOT NULL OR name IS NOT NULL AS known FROM s LEFT JOIN n ON name = lower(spec)"


SPECS = """
  SELECT p_partkey, CASE k % 6 WHEN 0 THEN '#' || h WHEN 1 THEN '#' || substr(h, 4, 3) WHEN 2 THEN '#' || h || substr(h, 1, 3) WHEN 3 THEN '#' || upper(h) || h
    WHEN 4 THEN '#' || substr(h, 1, 4) ELSE '#' || substr(h, 1, 5) || 'x' END AS spec
  FROM (SELECT p_partkey, p_partkey AS k, lpad(lower(hex((p_partkey * 7919) % 16777216)), 6, '0') AS h FROM part)"""

FLAG_ROWS = ", ".join(f"({k}, '{n}')" for k, n in enumerate(FLAGS))
OPTION = f"""
WITH f(k, name) AS (VALUES {FLAG_ROWS}), w AS (
  SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '-' END || substr(name, 1, p_size % 6 + 1) || CASE WHEN p_partkey % 13 = 0 THEN 'q' ELSE '' END AS word
  FROM part JOIN f ON k = p_partkey % {len(FLAGS)}
)
SELECT p_partkey, word, CASE WHEN word NOT LIKE '-%' THEN 'NOTOPT' WHEN count(name) = 1 THEN any_value(name) WHEN count(name) > 1 THEN 'SHORTOPT' ELSE 'BADOPT' END AS flag
FROM w LEFT JOIN f ON starts_with(name, substr(word, 2)) GROUP BY p_partkey, word
"""
PATH = """
WITH n AS (SELECT 'i' || p_partkey AS name, p_size % 5 AS k FROM part), e AS (
  SELECT unnest(CASE k WHEN 0 THEN [name, 'img/' || name] WHEN 1 THEN ['pics/' || name || '.ppm', 'img/' || name || '.gif.Z'] WHEN 2 THEN [name || '.gif', 'pics/' || name || '.Z']
    WHEN 3 THEN [name || '.jpg'] ELSE [name || '.Z', name || '.ppm.Z'] END) AS path FROM n
), c AS (
  SELECT name, unnest([name, name || '.Z', 'img/' || name, 'img/' || name || '.Z', 'img/' || name || '.gif', 'img/' || name || '.gif.Z', 'img/' || name || '.ppm', 'img/' || name || '.ppm.Z',
    'pics/' || name, 'pics/' || name || '.Z', 'pics/' || name || '.gif', 'pics/' || name || '.gif.Z', 'pics/' || name || '.ppm', 'pics/' || name || '.ppm.Z', name || '.gif', name || '.gif.Z', name || '.ppm', name || '.ppm.Z']) AS path,
    unnest(range(18)) AS rank FROM n
)
SELECT n.name, min_by(c.path, c.rank) FILTER (e.path IS NOT NULL) AS found FROM n LEFT JOIN c USING (name) LEFT JOIN (SELECT DISTINCT path FROM e) e ON e.path = c.path GROUP BY n.name
"""
SCALARS = """
SELECT p_partkey, (CASE WHEN p_size >= p_partkey % 50 THEN (p_size - p_partkey % 50) // 2 ELSE -((p_partkey % 50 - p_size) // 2) END)::INT AS centre,
  floor(least(64.0::DOUBLE / (p_size + 1), 48.0::DOUBLE / (p_partkey % 40 + 1)) * 100 + 0.5)::INT AS fit,
  floor(greatest(64.0::DOUBLE / (p_size + 1), 48.0::DOUBLE / (p_partkey % 40 + 1)) * 100 + 0.5)::INT AS cover,
  CASE WHEN p_partkey % 7 < 3 THEN 100 << (3 - p_partkey % 7)::INT ELSE 100 >> (p_partkey % 7 - 3)::INT END::INT AS scale,
  floor(0.5 + 65535.0::DOUBLE * pow((p_partkey * 31 % 65536) / 65535.0::DOUBLE, 2.2::DOUBLE))::INT AS linear,
  ((p_partkey * 31 % 65536 // 256) * 65536 + (p_partkey * 17 % 65536 // 256) * 256 + p_partkey * 13 % 65536 // 256)::INT AS true
FROM part
"""
SENSOR_ROWS = ", ".join(f"({k}, '{v}')" for k, v in SENSORS.items())
HALF = f", small AS ({zoomed('other', 8, 8, 50, 50)})"
TURNED = ", turned AS (SELECT image_id, (3 - y)::INT AS x, x AS y, r, g, b FROM small)"
CELL_ROWS = ", ".join(f"({k}, {c})" for k, c in enumerate(CELLS))
NORMAL = "CASE WHEN hi = lo THEN {0} ELSE least(255, ({0} - lo) * 256 // greatest(hi - lo, 1))::INT END AS {0}"
SIXTEEN = ", ".join(f"({k}, {(k >> 3 & 1) * 255}, {(k >> 1 & 3) * 85}, {(k & 1) * 255})" for k in range(16))

ORACLE_SQL = {
    "pixels": over_c1("SELECT * FROM c1"),
    "palette_lookup": over_c1("SELECT image_id, x, y, red, green, blue FROM ip JOIN pal USING (image_id, idx)"),
    "expand_true": over_c1("SELECT image_id, x, y, red // 256 AS r, green // 256 AS g, blue // 256 AS b FROM ip JOIN pal USING (image_id, idx)"),
    "bitmap_expand": over_c1(f"SELECT {PLACE}, v AS r, v AS g, v AS b FROM (SELECT {PLACE}, CASE WHEN {LEVEL} // 256 < 128 THEN 0 ELSE 255 END AS v FROM c1)"),
    "gray": over_c1(f"SELECT {PLACE}, ({LEVEL} // 256)::INT AS level FROM c1"),
    "gray_palette": over_c1("SELECT image_id, idx, ((red // 256 * 7680 + 50) // 100 + (green // 256 * 15104 + 50) // 100 + (blue // 256 * 2816 + 50) // 100)::INT AS level FROM pal"),
    "gamma_to_linear": over_c1(f"SELECT {PLACE}, r AS v, {gamma('r', '1.0::DOUBLE / ((1.0::FLOAT / 2.2::FLOAT)::FLOAT)::DOUBLE')} AS out FROM c1"),
    "gamma_to_display": over_c1(f"SELECT {PLACE}, r AS v, {gamma('r', '1.0::DOUBLE / (2.2::FLOAT)::DOUBLE')} AS out FROM c1"),
    "brighten": over_c1(f"SELECT {PLACE}, {bright('r', 255)} AS r, {bright('g', 255)} AS g, {bright('b', 255)} AS b FROM c1"),
    "brighten_palette": over_c1(f"SELECT image_id, idx, {bright('red', 65535)} AS red, {bright('green', 65535)} AS green, {bright('blue', 65535)} AS blue FROM pal"),
    "normalize": over_c1(f"SELECT {PLACE}, {NORMAL.format('r')}, {NORMAL.format('g')}, {NORMAL.format('b')} FROM c1 JOIN (SELECT image_id, min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi FROM c1 GROUP BY 1) USING (image_id)"),
    "rotate_90": over_c1("SELECT image_id, (7 - y)::INT AS x, x AS y, r, g, b FROM c1"),
    "rotate_180": over_c1("SELECT image_id, (7 - x)::INT AS x, (7 - y)::INT AS y, r, g, b FROM c1"),
    "rotate_270": over_c1("SELECT image_id, y AS x, (7 - x)::INT AS y, r, g, b FROM c1"),
    "zoom_150": over_c1(zoomed("c1", 8, 8, 150, 150)),
    "zoom_50": over_c1(zoomed("c1", 8, 8, 50, 50)),
    "zoom_x": over_c1(zoomed("c1", 8, 8, 230, 100)),
    "zoom_auto": over_c1(zoomed("c1", 8, 8, min(6 * 90 // 8, 7 * 90 // 8), min(6 * 90 // 8, 7 * 90 // 8))),
    "clip_inner": over_c1("SELECT image_id, x - 2 AS x, y - 2 AS y, r, g, b FROM c1 WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5"),
    "clip_border": over_c1("SELECT im.image_id, a::INT AS x, c::INT AS y, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b FROM im, (SELECT unnest(range(10)) AS a), (SELECT unnest(range(10)) AS c) LEFT JOIN c1 ON c1.image_id = im.image_id AND c1.x = a - 2 AND c1.y = c - 1"),
    "fill_rect": over_c1("SELECT image_id, x, y, CASE WHEN f THEN 9 ELSE r END AS r, CASE WHEN f THEN 99 ELSE g END AS g, CASE WHEN f THEN 199 ELSE b END AS b FROM (SELECT *, x >= 1 AND x < 4 AND y >= 2 AND y < 6 AS f FROM c1)"),
    "tile": over_c1("SELECT image_id, a::INT AS x, c::INT AS y, r, g, b FROM (SELECT unnest(range(19)) AS a), (SELECT unnest(range(11)) AS c), c1 WHERE x = a % 8 AND y = c % 8"),
    "merge_at": over_c1(overlaid("other", 3, -2)),
    "merge_center": over_c1(overlaid("small", 2, 2), HALF),
    "merge_offcanvas": over_c1("SELECT * FROM c1"),
    "collage": over_c1(overlaid("turned", 3, 5, "two"), HALF + TURNED + f", two AS ({overlaid('small', 1, 1)})"),
    "histogram_5bit": over_c1("SELECT image_id, (r // 8 * 1024 + g // 8 * 32 + b // 8)::INT AS cell, count(*) AS n FROM c1 GROUP BY ALL"),
    "histogram_marginals": over_c1(f"SELECT image_id, channel, value::INT AS value, count(*) AS n FROM {CHANNELS} GROUP BY ALL"),
    "box_stats": over_c1(f"SELECT image_id, channel, count(*) AS weight, sum(value)::BIGINT AS total, sum(value * value)::BIGINT AS squares FROM {CHANNELS} GROUP BY ALL"),
    "minmax": over_c1("SELECT image_id, min(least(r, g, b)) AS low, max(greatest(r, g, b)) AS high FROM c1 GROUP BY 1"),
    "used_colors": over_c1("SELECT image_id, count(DISTINCT idx) AS used, count(*) FILTER (idx >= 24) AS out_of_range FROM ip GROUP BY 1"),
    "compress_cmap": over_c1("SELECT image_id, x, y, (dense_rank() OVER (PARTITION BY image_id ORDER BY i) - 1)::INT AS idx FROM (SELECT image_id, x, y, CASE WHEN idx < 24 THEN idx ELSE 0 END AS i FROM ip)"),
    "compress_palette": over_c1("SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY idx) - 1)::INT AS idx, red, green, blue FROM pal SEMI JOIN (SELECT image_id, CASE WHEN idx < 24 THEN idx ELSE 0 END AS idx FROM ip) USING (image_id, idx)"),
    "smooth_1": over_c1(smoothed("c1")),
    "smooth_2": over_c1(smoothed("once"), f", once AS ({smoothed('c1')})"),
    "halftone": over_c1(f"SELECT image_id, (4 * x + k % 4)::INT AS x, (4 * y + k // 4)::INT AS y, ((cell >> (15 - k)::INT) & 1)::INT AS idx FROM (SELECT *, least(16, {LEVEL} // 3855) AS step FROM c1) JOIN (VALUES {CELL_ROWS}) t(step, cell) USING (step), (SELECT unnest(range(16)) AS k)"),
    "threshold_bitmap": over_c1(f"SELECT {PLACE}, ({LEVEL} // 256 < 128)::INT AS idx FROM c1"),
    "nearest_color": over_c1(f"SELECT {PLACE}, (-(min({{'d': (r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2, 'i': -i}}).i))::INT AS idx FROM c1, (VALUES {SIXTEEN}) p(i, pr, pg, pb) GROUP BY {PLACE}"),
    "text_raster_histogram": "SELECT doc_id AS image_id, (v // 8)::INT AS value, count(*) AS n FROM (SELECT doc_id, ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT AS v FROM (SELECT doc_id, h, unnest(range(len(h) // 2)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))) GROUP BY ALL",
    "color_parse": parsed(SPECS),
    "color_name_lookup": parsed("SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS spec FROM part"),
    "color_shades": parsed(f"SELECT p_partkey, ([{', '.join(repr(n) for n in (*known_tables.NAMED, *known_tables.UNKNOWN))}])[(p_partkey % {len(known_tables.NAMED) + len(known_tables.UNKNOWN)} + 1)::INT] AS spec FROM part"),
    "option_resolve": OPTION,
    "path_resolve": PATH,
    "icon_name": "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'Unnamed' ELSE split_part(regexp_replace(split_part(url || ' (50% zoom)', ' ', 1), '^.*/', ''), '.', 1) END AS icon FROM pages",
    "tail": "SELECT page_id, regexp_replace(url, '^.*/', '') AS tail FROM pages",
    "depth_of_colors": "SELECT p_partkey, least(32, CASE WHEN p_partkey = 0 THEN 0 ELSE len(bin(p_partkey)) END)::INT AS depth, (1::BIGINT << least(p_size, 32)) AS colors FROM part",
    "pm_scale": "SELECT p_partkey, ((p_partkey % (p_size + 1)) * 255 // (p_size + 1))::INT AS scaled FROM part",
    "default_gamma": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 1.7 WHEN p_partkey % 7 = 0 THEN 1.0 WHEN p_partkey % 3 = 1 THEN 2.2 WHEN p_partkey % 3 = 2 THEN 1.0 WHEN p_partkey % 2 = 0 THEN 1.8 ELSE 2.2 END::DOUBLE AS gamma FROM part",
    "sensor_name": f"SELECT p_partkey, coalesce(sensor, 'Unknown McIDAS format') AS sensor FROM part LEFT JOIN (VALUES {SENSOR_ROWS}) s(code, sensor) ON code = p_partkey % 100",
    "scalar_arithmetic": SCALARS,
    "pipeline_full": over_c1(
        f"SELECT {PLACE}, least(255, floor(v::FLOAT * 1.2::FLOAT))::INT AS r, least(255, floor(v::FLOAT * 1.2::FLOAT))::INT AS g, least(255, floor(v::FLOAT * 1.2::FLOAT))::INT AS b FROM (SELECT {PLACE}, CASE WHEN hi = lo THEN level ELSE least(255, (level - lo) * 256 // greatest(hi - lo, 1))::INT END AS v FROM lev JOIN (SELECT image_id, min(level) AS lo, max(level) AS hi FROM lev GROUP BY 1) USING (image_id))",
        f", cut AS (SELECT image_id, x - 1 AS x, y - 1 AS y, r, g, b FROM c1 WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 5), rot AS (SELECT image_id, (4 - y)::INT AS x, x AS y, r, g, b FROM cut), zo AS ({zoomed('rot', 5, 6, 150, 200)}), sm AS ({smoothed('zo')}), lev AS (SELECT {PLACE}, {LEVEL} // 256 AS level FROM sm)",
    ),
}
INK = "floor(floor(0.5 + 65535 * pow({} / 65535.0::DOUBLE, 2.2::DOUBLE)) / 256)::INT"
BITS = " + ".join(f"CASE WHEN (k >> {n}) & 1 = 1 THEN {128 >> n} ELSE 0 END" for n in range(8))
ORACLE_SQL |= {
    "best_depth": "SELECT p_partkey, CASE WHEN p_size <= 1 THEN 1 WHEN p_size <= 4 THEN 4 WHEN p_size <= 8 THEN 8 WHEN p_size <= 16 THEN 16 ELSE 24 END AS depth FROM part",
    # the depth is the smallest that is enough, else the largest; then the class by type
    "best_visual": """SELECT p_partkey,
        CASE WHEN p_size <= 1 THEN 'StaticGray' WHEN p_size <= 8 THEN 'PseudoColor' WHEN t = 1 THEN 'DirectColor' WHEN t = 2 THEN 'TrueColor' ELSE 'DirectColor' END AS on_truecolor_class,
        CASE WHEN p_size <= 1 THEN 1 WHEN p_size <= 8 THEN 8 ELSE 24 END AS on_truecolor_depth,
        CASE WHEN p_size <= 8 THEN 'StaticColor' ELSE 'DirectColor' END AS on_directcolor_class, CASE WHEN p_size <= 8 THEN 8 ELSE 16 END AS on_directcolor_depth,
        'GrayScale' AS gray_class, 8 AS gray_depth FROM (SELECT p_partkey, p_size, p_partkey % 3 AS t FROM part)""",
    "found_at": "SELECT p_partkey, nullif(strpos(p_name, substr(p_type, 2, 2)), 0) - 1 AS position FROM part",
    "goto_lookup": "SELECT p_name AS name, min(p_partkey) AS position FROM part GROUP BY 1",
    "bit_order": f"SELECT p_partkey, ({BITS})::INT AS flipped, (v % 256 * 16777216 + v // 256 % 256 * 65536 + v // 65536 % 256 * 256 + v // 16777216)::BIGINT AS swapped FROM (SELECT p_partkey, (p_partkey % 256)::INT AS k, p_partkey * 7919 % 4294967296 AS v FROM part)",
    "recolor_bitmap": over_c1(f"SELECT {PLACE}, " + ", ".join(f"CASE WHEN {LEVEL} // 256 < 128 THEN {INK.format(f)} ELSE {INK.format(b)} END AS {c}" for c, f, b in (("r", 0x8080, 0), ("g", 0x4040, 0), ("b", 0, 0x8080))) + " FROM c1"),
    "comment_value": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN (p_size / 10)::VARCHAR ELSE '9' END AS gamma, NULL::VARCHAR AS absent_note FROM part",
}
BLACK_BITS = "SELECT image_id, x, y, (1 - idx) * 255 AS r, (1 - idx) * 255 AS g, (1 - idx) * 255 AS b FROM"
ORACLE_SQL |= {
    "pipeline_packed": ORACLE_SQL["pipeline_full"],
    "decode_roundtrip": ORACLE_SQL["pixels"],
    "smooth_tiled": over_c1(smoothed("once"), f", once AS ({smoothed('c1')})"),
    "gray_carried": over_c1(f"SELECT image_id, x, y, ({LEVEL} // 256)::INT AS level, 1.0::DOUBLE AS gamma FROM (SELECT image_id, x, y, {', '.join(gamma(c, '1 / (1.0::DOUBLE / own::DOUBLE)::FLOAT::DOUBLE') + f' AS {c}' for c in 'rgb')} FROM (SELECT *, ([1.0, 2.2, 1.7])[(image_id % 3 + 1)::INT]::FLOAT AS own FROM c1))"),
    "dither_fs": BLACK_AND_WHITE,
    "dither_strips": BLACK_AND_WHITE,
    "nearest_palette": over_c1("""SELECT c.image_id, x, y, max_by(idx, idx - 65536::BIGINT * ((r - red // 256) * (r - red // 256) + (g - green // 256) * (g - green // 256) + (b - blue // 256) * (b - blue // 256))) AS idx
      FROM c1 c JOIN pal p ON c.image_id = p.image_id GROUP BY c.image_id, x, y"""),
    "decode_formats": over_c1(shown_files()),
    "identify_formats": over_c1(identified_files()),
    "identify": over_c1("SELECT path, form AS format, 'ok' AS status, 8 AS width, 8 AS height, 24 AS depth, 0 AS colors, path || ' is a 8x8 ' || description || ' image with depth 24' AS description FROM (SELECT image_id, image_id || '.' || ['bmp', 'png', 'ppm', 'sun', 'tga'][(image_id % 5 + 1)::INT] AS path, ['bmp', 'png', 'pnm', 'sun', 'tga'][(image_id % 5 + 1)::INT] AS form, ['BMP', 'PNG', 'portable bitmap, graymap or pixmap', 'Sun raster', 'Targa'][(image_id % 5 + 1)::INT] AS description FROM im)"),
    "trailing_options": over_c1("SELECT image_id || '.' || ['bmp', 'png', 'ppm', 'sun', 'tga'][(image_id % 5 + 1)::INT] AS path, CASE WHEN image_id % 7 = 1 THEN '-rotate 90 -bright ' || (image_id % 50 + 50) END AS options FROM im"),
    "command_words": over_c1("SELECT path, CASE WHEN image_id % 7 = 1 THEN '-rotate 90 -bright ' || (image_id % 50 + 50) || ' ' ELSE '' END || path AS words FROM (SELECT image_id, image_id || '.' || ['bmp', 'png', 'ppm', 'sun', 'tga'][(image_id % 5 + 1)::INT] AS path FROM im)"),
    "smooth_packed": ORACLE_SQL["smooth_1"],
    "halftone_packed": BLACK_BITS + f" ({ORACLE_SQL['halftone']})",
    "zoom_packed": ORACLE_SQL["zoom_150"],
    "clip_packed": ORACLE_SQL["clip_border"],
}
