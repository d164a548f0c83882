"""Queries on small tables of their own, against their SQL."""

import duckdb

import __spark_entry__ as entry
from tools.oracle_check import compare


def parts(spark, folder, sizes):
    """A part table with one row per cell."""
    rows = [(key, size) for key, size in enumerate(sizes)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def like_sql(spark, name, folder, *tables):
    """Rows of a query, which are those of its SQL."""
    df = entry.queries()[name](spark, folder)
    rows = df.collect()
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    assert compare([tuple(r) for r in rows], df.columns, result.fetchall(), cols) is None
    return rows


def test_rings_are_grown_until_the_cell_is_covered(spark, tmp_path):
    # nuclei at the edge of their cells reach the far side with more than five rings
    sf = parts(spark, tmp_path, [7, 14, 35, 21, 2, 3, 49, 17])
    assert max(r.ring for r in like_sql(spark, "fluor_rings", sf, "part")) > 4


def test_remap_looks_at_every_image_of_a_dataset(spark, tmp_path):
    # images 0, 10, .. 50 of one dataset; the others hold no cells of it
    chosen = {40 * i + j: size for i, sizes in enumerate([(7, 2, 3, 11), (1, 22, 13, 5), (14, 14, 2, 9), (3, 26, 33, 7), (21, 5, 11, 4), (2, 7, 7, 13)]) for j, size in enumerate(sizes)}
    spark.createDataFrame([*chosen.items()], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = like_sql(spark, "remap_batch", str(tmp_path), "part")
    assert len(rows) == 6


def test_greedy_matching_walks_parts_of_a_group(spark, monkeypatch):
    from petridish.operators import engines

    monkeypatch.setattr(engines, "WALKED", 5)
    rows = [(g, i, j, (i * j + g) % 3) for g in (1, 2) for i in range(6) for j in range(5)]
    edges = spark.createDataFrame(rows, "g int, l int, r int, w int")
    got = engines.greedy_matching(edges, ["g"], "l", "r", ["w", "l", "r"]).collect()
    want, used = [], set()
    for g, i, j, w in sorted(rows, key=lambda e: (e[3], e[1], e[2])):
        if not {(g, "l", i), (g, "r", j)} & used:
            used |= {(g, "l", i), (g, "r", j)}
            want.append((g, i, j, w))
    assert sorted(map(tuple, got)) == sorted(want)


def test_pixels_stay_with_their_image(spark, tmp_path):
    sf = parts(spark, tmp_path, [7, 14, 35, 21, 2, 3, 49, 17])
    before = spark.conf.getAll
    df = entry.queries()["roi_intensity"](spark, sf)
    assert "ENSURE_REQUIREMENTS" not in df._jdf.queryExecution().toString()
    assert spark.conf.getAll == before
    like_sql(spark, "roi_intensity", sf, "part")
