"""What only shows at sizes beyond the given tables, brought about on small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import grid as G, plans, sources
from rasterlake.operators import ml
from test_grid import cells
from test_oracle import BASE, duck, normal  # noqa: F401


@pytest.mark.parametrize("name", ["ascii_roundtrip", "ascii_headers"])
def test_rasters_in_parts_are_whole_again(spark, duck, monkeypatch, name):  # noqa: F811
    from rasterlake.queries import QUERIES, SQL

    monkeypatch.setattr(sources, "FILE_ROWS", 150)
    df, cur = QUERIES[name](spark, BASE), duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), cols)


def test_only_parts_are_joined(spark, tmp_path, monkeypatch):
    """Names that look like parts and are none stay: alone, with a gap, or of another width."""
    monkeypatch.setattr(sources, "FILE_ROWS", 2)
    a = np.arange(15.0).reshape(5, 3)
    a[3, 1] = np.nan
    given = {"a": a, "b@0": a[:1], "c@0": a[:2], "c@3": a[:2], "d@0": a[:2], "d@2": a[:2, :2]}
    df = None
    for name, v in given.items():
        df = cells(spark, v, name) if df is None else df.unionByName(cells(spark, v, name))
    sources.write_ascii_grid(df, str(tmp_path / "in"))
    got, heads = sources.join_parts(*sources.read_ascii_grid(spark, str(tmp_path / "in/*/*.txt")))
    assert {r.raster_id: (r.nrows, r.ncols) for r in heads.collect()} == {k: v.shape for k, v in given.items()}
    assert heads.where("raster_id = 'a'").select("yll", "y0").first() == (-5.0, 0.0)
    assert got.count() == df.count() == got.join(df.withColumnRenamed("z", "y"), ["raster_id", "r", "c"]).where(F.col("z").eqNullSafe(F.col("y"))).count()


@pytest.mark.parametrize("rows", [3, 4096])
def test_written_cells_keep_their_place_and_value(spark, tmp_path, monkeypatch, rows):
    """Rows and cells that are not there, whole parts of them too, and cells with the value that stands for missing ones."""
    monkeypatch.setattr(sources, "FILE_ROWS", rows)
    a, b = np.arange(55.0).reshape(11, 5) - 30, np.full((2, 2), -9999.0)
    a[10, 1], a[0, 4], b[1, 0] = np.nan, -9999, np.nan
    gone = "raster_id = 'a' and (r in (1, 3, 4, 5, 9) or r = 2 and c in (0, 2, 4) or r = 7 and c < 4)"
    df = cells(spark, a, "a").where(f"not ({gone})").unionByName(cells(spark, b, "b")).unionByName(cells(spark, a[1:], "c"))
    sources.write_ascii_grid(df, str(tmp_path / "in"))
    got, heads = sources.join_parts(*sources.read_ascii_grid(spark, str(tmp_path / "in/*/*.txt")))
    want = {(n, i, j): v[i, j] for n, v in (("a", a), ("b", b), ("c", a[1:])) for i in range(v.shape[0]) for j in range(v.shape[1])}
    for r in cells(spark, a, "a").where(gone).collect():
        want[("a", r.r, r.c)] = np.nan
    rows = got.collect()
    assert len(rows) == len(want) and {(r.raster_id, r.r, r.c): r.z for r in rows} == {k: None if np.isnan(v) else v for k, v in want.items()}
    assert {r.raster_id: r.nodata for r in heads.collect()} == {"a": -19999.0, "b": -19999.0, "c": -9999.0}
    lines = [x for f in (tmp_path / "in").glob("raster_id=*/*.txt") for x in f.read_text().split("\n")]
    assert sum(len(x.split()) for x in lines if x and not x[0].isalpha()) == len(want)  # nothing is left to the reader
    for i, wrong in enumerate(["c = 0 and r = 5", "r = 5"]):
        with pytest.raises(Exception, match="twice"):
            sources.write_ascii_grid(df.unionByName(df.where(f"raster_id = 'c' and {wrong}")), str(tmp_path / f"twice{i}"))
        with pytest.raises(Exception, match="before row"):
            sources.write_ascii_grid(df.withColumn("r" if i else "c", F.expr(f"if(raster_id = 'c', {'r - 1' if i else 'c - 1'}, {'r' if i else 'c'})")), str(tmp_path / f"before{i}"))


def test_roundtrip_of_odd_vectors(spark, duck, tmp_path, monkeypatch):  # noqa: F811
    """Gaps in vec_id, components that are -0.9999 or NULL."""
    import duckdb

    from rasterlake.queries import QUERIES, SQL

    monkeypatch.setattr(sources, "FILE_ROWS", 50)
    duck.execute(f"""copy (select vec_id + 130 * (vec_id // 40) as vec_id, list_transform(embedding, lambda x, i: CASE WHEN (vec_id + i) % 97 = 0 THEN CAST(-0.9999 AS FLOAT) WHEN (vec_id + i) % 89 <> 0 THEN x END) as embedding, label
        from embeddings where vec_id % 7 <> 3) to '{tmp_path}/embeddings.parquet' (format parquet)""")
    duck.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    own = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        own.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df, cur = QUERIES["ascii_roundtrip"](spark, str(tmp_path)), own.execute(SQL["ascii_roundtrip"])
    cols = [c[0] for c in cur.description]
    want = normal(cur.fetchall(), cols)
    assert normal([tuple(r) for r in df.collect()], df.columns) == want and sum(-9999.0 in r for r in want) > 100


def test_cells_are_not_joined_with_themselves(spark):
    """Cells that come of one row a raster look small to the planner, which then broadcast all of them."""
    df = cells(spark, np.arange(12.0).reshape(3, 4)).where("c <> 2 or r = 1")
    dense = G.densify(df)
    table = G.feature_table(dense.withColumn("height", F.col("z") * 2), ["height"], G.Transform(5.0, 9.0, 2.0, -2.0))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert all("strategy=merge" in x for x in plan.split("\n") if "Join " in x and "(r#" in x), plan
    assert sum("Join " in x and "(r#" in x for x in plan.split("\n")) == 1, plan
    assert "Repartition" in plan.split("explode(sequence(r0")[0].rsplit("explode(sequence(c0", 1)[1]
    got = {(r.id, r.x, r.y, r.elevation, r.height) for r in table.collect()}
    assert got == {(4 * r + c, 5.0 + 2 * c, 9.0 - 2 * r, 4.0 * r + c, 2 * (4.0 * r + c)) for r in range(3) for c in range(4) if c != 2 or r == 1}
    assert dense.count() == 12 and dense.where("z is null").count() == 2


def test_autoencoder_holds_few_vectors_at_a_time(spark, monkeypatch):
    """Rows of packed vectors are small, and so are the batches of them; the result doesn't depend on either."""
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([("t", i, 0, p.tolist()) for i, p in enumerate(rng.normal(size=(500, 3)))], "raster_id string, r int, c int, patch array<double>").coalesce(1)
    want = {r.r: (r.autoencoder_latent_1, r.autoencoder_latent_2) for r in ml.autoencoder(v, hidden=4, steps=2).collect()}
    written, asked = [], []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(ml, "cut", lambda df, **options: written.append(plans.cut(df, **options)) or written[-1])
    monkeypatch.setattr(ml, "batches_of", lambda s, rows: asked.append(rows) or plans.batches_of(s, rows))
    monkeypatch.setattr(ml, "PACK", 480)
    got = {r.r: (r.autoencoder_latent_1, r.autoencoder_latent_2) for r in ml.autoencoder(v, hidden=4, steps=2).collect()}
    sizes = [len(r.x) for t in written if "x" in t.columns for r in t.collect()]
    assert max(sizes) == 480 and sum(sizes) == 500 * 3 * 8 and asked == [ml.PACKS] * 2 and spark.conf.get(name) == before
    assert set(got) == set(want) and np.allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)])


def test_nearest_sends_packs_and_not_pairs_of_blocks(spark, monkeypatch):
    """Exact with ties and copies, whatever the sizes of packs and blocks; vectors pass in packs, so few rows are written."""
    rng = np.random.default_rng(6)
    x, k = np.concatenate([rng.integers(0, 4, (150, 3)), np.full((30, 3), 2), rng.integers(0, 900, (120, 3))]) + 1e6, 5
    ids = rng.choice(10**15, len(x), replace=False)
    v = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, x)], "id long, patch array<double>")
    written = []
    monkeypatch.setattr(ml, "cut", lambda df, **options: written.append(plans.cut(df, **options)) or written[-1])
    got = {}
    for r in ml.nearest(v, k, block=64).collect():
        got.setdefault(r.src, set()).add((r.gap, r.dst))
    for i, p in zip(ids, x):
        assert got[i] == set(sorted((float(g), int(j)) for g, j in zip(((x - p) ** 2).sum(1), ids) if j != i)[:k])
    packed = [t for t in written if "x" in t.columns]
    assert len(packed) == 1 and packed[0].count() < 40 and max(len(r.ids) for r in packed[0].collect()) <= 16 * 8
    assert written[-1].count() == k * len(x)  # only the nearest are written, not those of each block


def _brute(ids, x, k):
    return [sorted((float(g), int(j)) for g, j in zip(((x - p) ** 2).sum(1), ids) if j != i)[:k] for i, p in zip(ids, x)]


def test_nearest_compares_few_pairs():
    """Most vectors are never compared, and yet the nearest are exact; far outliers, which spoil single precision, change nothing."""
    rng = np.random.default_rng(8)
    x, k = rng.normal(size=(6000, 3)).round(3), 6
    for far in (0, 1e12):
        x[17] += far
        order = ml._order(x, ml.LEAF)
        ids, v = order.astype(np.int64) * 7, x[order]
        found = ml._Nearest(k, ids[:4000], v[:4000])
        found.inside(ml._tree(v[:4000], 0, 4000), (ids[:4000], v[:4000], 0), 0)
        found.visit(np.arange(4000), ml._tree(v[4000:], 0, 2000), (ids[4000:], v[4000:], 4000))
        found.settle()
        assert found.compared < 0.3 * 4000 * 6000
        for i in range(0, 4000, 97):
            want = sorted((float(g), int(j)) for g, j in zip(((v[i] - v) ** 2).sum(1), ids) if j != ids[i])[:k]
            assert list(zip(found.gap[i].tolist(), found.who[i].tolist())) == want and ids[found.at[i]].tolist() == [j for _, j in want]


@pytest.mark.parametrize("taken", [1 << 17, 64])
def test_nearest_of_copies_in_cells(spark, monkeypatch, taken):
    """Many copies only ask; vectors are dealt into cells; those that aren't finite are left out."""
    monkeypatch.setattr(ml, "TAKEN", taken)
    rng = np.random.default_rng(9)
    x, k = np.concatenate([rng.integers(0, 50, (150, 2)), np.full((90, 2), 7), np.zeros((9, 2))]).astype(float) / 3, 4
    ids = rng.permutation(len(x)) * 11
    odd = [(-1, [np.nan, 1.0]), (-2, [np.inf, 1.0])]
    v = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, x)] + odd, "id long, patch array<double>")
    got = {}
    for r in ml.nearest(v, k, block=64).collect():
        got.setdefault(r.src, []).append((r.gap, r.dst))
    assert {i: sorted(p) for i, p in got.items()} == dict(zip(ids.tolist(), _brute(ids, x, k)))


def test_spectral_values_are_those_of_the_whole_graph(spark):
    """20 steps over links between tasks are those of the dense matrix; every row is there, and labels follow the values."""
    rng = np.random.default_rng(10)
    x, k = rng.integers(0, 90, (200, 3)).astype(float), 5
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, patch array<double>")
    w = np.zeros((200, 200))
    for i, best in enumerate(_brute(range(200), x, k)):
        w[i, [j for _, j in best]] = 1
    w = w + w.T
    want = w.sum(axis=1)
    for _ in range(20):
        want = w @ want / w.sum(axis=1)
    got = {r.id: r.value for r in ml._walked(v, k, 20, "patch", block=32).collect()}
    assert sorted(got) == list(range(200)) and np.allclose([got[i] for i in range(200)], want, rtol=1e-12)

    odd = spark.createDataFrame([("t", i, 0, p.tolist()) for i, p in enumerate(x)] + [("t", 900, 0, [np.nan] * 3)], "raster_id string, r int, c int, patch array<double>")
    labels = {r.r: r.cluster_label for r in ml.spectral_clusters(odd).collect()}
    assert len(labels) == 201 and labels.pop(900) is None and set(labels.values()) == {0, 1, 2}
    same = odd.withColumn("patch", F.array(F.lit(1.0)))
    assert {r.cluster_label for r in ml.spectral_clusters(same).collect()} <= {0, 1, 2} and ml.spectral_clusters(same).count() == 201
