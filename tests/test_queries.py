"""Every registered image query against DuckDB, over a small cut of the given tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pixelloom.plans.queries import queries
from pixelloom.plans.sql import ORACLE_SQL
from pixelloom.sources import files
from tests.known_files import KNOWN_FILES
from tests.known_sql import KNOWN_SQL
from tests.test_raster import level, slow_diffused, slow_dither, slow_reduce

SOURCE = "/root/testdata/sf0.001"
ROWS = {"embeddings": 24, "part": 200, "pages": 30, "documents": 12}


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    db = duckdb.connect()
    for name, n in ROWS.items():
        db.sql(f"COPY (SELECT * FROM '{SOURCE}/{name}.parquet' LIMIT {n}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    folder, db = small
    got = queries()[name](spark, folder)
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert queries()[name](spark, small[0]).count() > 0


@pytest.mark.parametrize("name", ["decode_formats", "identify_formats"])
def test_gem_files_with_rows_like_a_fax(spark, tmp_path, name):
    """Images of 0.1 GB of tables whose GEM files were once taken for faxes."""
    rows = {491: "d0d2c038e9429fe2", 5186: "94ecc60cdeed84a8", 6236: "eca99833c9f59a92", 6701: "d7d2e63e344d043b"}
    images = [(k, [-0.4 if b == "1" else 0.4 for b in f"{int(v, 16):064b}"]) for k, v in rows.items()]
    spark.createDataFrame(images, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(ORACLE_SQL[name])
    got = queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_known_files_of_every_format(spark, small):
    """Small files of every format and wrapper, encoded by hand, as pixels written by hand."""
    given = spark.createDataFrame([(k, name, bytearray.fromhex(content)) for k, (name, content) in enumerate(KNOWN_FILES)], "image_id bigint, path string, content binary")
    got = sorted((r.image_id, r.x, r.y, r.r, r.g, r.b) for r in files.explode_pixels(files.decode(given)).collect())
    assert got == sorted(small[1].sql(KNOWN_SQL).fetchall())


def test_sequential_queries_by_loops(spark):
    """dither_fs, reduce_n and reduce_dither over their whole table, pixel by pixel."""
    table = {}
    for r in queries()["pixels"](spark, SOURCE).collect():
        table.setdefault(r.image_id, [[None] * 8 for _ in range(8)])[r.y][r.x] = (r.r, r.g, r.b)
    want = {"dither_fs": {}, "reduce_n": {}, "reduce_dither": {}}
    for k, pixels in table.items():
        black = slow_dither([[level(*p) for p in row] for row in pixels])
        want["dither_fs"][k] = [[(255 * (1 - v),) * 3 for v in row] for row in black]
        # linear images are made ready for a display first
        shown8 = [[tuple(int(np.floor(0.5 + 255 * (v / 255.0) ** (1 / float(np.float32(2.2))))) for v in p) for p in row] for row in pixels]
        place, shown, boxes = slow_reduce(shown8, 16)
        colour = [tuple(v >> 8 for v in c) for c in shown]
        want["reduce_n"][k] = [[colour[i] for i in row] for row in place]
        want["reduce_dither"][k] = [[colour[i] for i in row] for row in slow_diffused(shown8, boxes, shown)]
    # the same for images that are never packed
    want |= {"dither_strips": want["dither_fs"], "reduce_relations": want["reduce_n"], "reduce_strips": want["reduce_dither"]}
    assert len(table) > 100
    for name, images in want.items():
        got = queries()[name](spark, SOURCE).collect()
        assert len(got) == 64 * len(table)
        assert all(images[r.image_id][r.y][r.x] == (r.r, r.g, r.b) for r in got), name


def test_entry_has_every_query():
    assert set(queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_projections_do_not_shuffle(spark, small):
    for name in ("gray", "brighten", "rotate_90", "zoom_150", "clip_inner", "clip_border", "fill_rect", "tile", "halftone", "threshold_bitmap", "nearest_color", "text_raster_histogram"):
        plan = queries()[name](spark, small[0])._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
        assert plan.count("Exchange") <= (name == "text_raster_histogram"), name
