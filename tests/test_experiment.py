import datetime

import numpy as np
import pytest

from cellstrand.operators import experiment as ex
from cellstrand.operators import matrix, qc
from cellstrand.streaming import fragments as stream
from cellstrand.streaming import run


def small(spark, cells=("ACG", "TTT")):
    counts = spark.createDataFrame([(f"ENSG{i}", c, i + 1) for i in range(3) for c in cells], "feature string, cell string, n long")
    return ex.CellExperiment(counts, counts.select("cell").distinct(), counts.select("feature").distinct())


def test_accessors(spark):
    e = small(spark)
    for name in ("qc_metrics", "demultiplex_info", "umi_dup_info"):
        with pytest.warns(UserWarning):
            assert getattr(e, name) is None
    e.qc_metrics = spark.createDataFrame([("ACG", 5), ("TTT", 6)], "cell string, total int")
    e.demultiplex_info = spark.createDataFrame([("x", 1)], "status string, count long")
    assert e.qc_metrics.columns == ["cell", "total"] and e.qc_metrics.count() == 2
    assert e.demultiplex_info.count() == 1
    assert e.validate().organism == "hsapiens_gene_ensembl" and e.gene_id_type == "ensembl_gene_id"
    e.organism = "NA"
    assert e.organism is None


def test_save_and_load(spark, tmp_path):
    e = small(spark).validate()
    e.umi_dup_info = spark.createDataFrame([(1, 2)], "duplication_number int, count long")
    e.save(str(tmp_path / "e"))
    back = ex.CellExperiment.load(spark, str(tmp_path / "e"))
    assert sorted(back.counts.collect()) == sorted(e.counts.collect())
    assert back.metadata == e.metadata and back.umi_dup_info.count() == 1


def test_integration(spark):
    rna, atac = small(spark, ("AAC", "GGT")), small(spark, ("GTT", "CCC"))
    matches = spark.createDataFrame([("AAC", "AAC"), ("GGT", "GGG")], "rna string, atac string")
    out, merged = ex.integrate({"rna": rna, "atac": atac}, matches)
    assert {r["cell"] for r in out["atac"].cells.collect()} == {"AAC", "GGG"}  # turned
    assert merged.count() == 2
    assert {r["cell"]: r["shared"] for r in out["rna"].cells.collect()} == {"AAC": True, "GGT": True}
    with pytest.raises(ValueError):
        ex.rename_cells(rna, spark.createDataFrame([("AAC", "x")], "cell_name string, barcode_sequence string"))


def test_chi_square():
    assert abs(qc.chi_square_quantile(0.99, 4) - 13.2767) < 1e-3
    assert abs(qc.chi_square_cdf(3.841459, 1) - 0.95) < 1e-6
    assert abs(qc.normal_quantile(0.975) - 1.959964) < 1e-5


def test_outliers_found():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 3)) * [1, 2, 0.5] + [10, 12, 5]
    x[:5] -= [8, 15, 4]
    out = qc.outliers_of(x, side="low")
    assert out[:5].all() and out[5:].sum() <= 10
    assert not qc.outliers_of(x, side="high")[:5].any()
    assert qc.outliers_of(x, comp=2, side="both")[:5].all()


def test_outlier_table(spark):
    draw = np.random.default_rng(3)
    rows = [(f"c{i}", int(g), int(t)) for i, (g, t) in enumerate(zip(draw.normal(900, 60, 80), draw.normal(4000, 300, 80), strict=True))] + [("bad", 30, 40)]
    cells = spark.createDataFrame(rows, "cell_id string, number_of_genes int, total_count_per_cell int")
    left = qc.remove_outliers(qc.detect_outliers(cells))
    assert "bad" not in {r["cell_id"] for r in left.collect()}
    with pytest.raises(ValueError):
        qc.detect_outliers(cells, side="middle")


def test_tf_idf_and_reduction(spark):
    draw = np.random.default_rng(0)
    rows = [(f"f{i}", f"c{j:02d}", int(draw.integers(5, 9))) for j in range(20) for i in (range(10) if j < 10 else range(10, 20))]
    counts = spark.createDataFrame(rows, "feature string, barcode string, n long")
    groups = {r["barcode"]: r["cluster"] for r in matrix.clusters(matrix.nearest_cells(matrix.lsi(matrix.tf_idf(counts), 4), 6)).collect()}
    assert {groups[f"c{j:02d}"] for j in range(10)}.isdisjoint({groups[f"c{j:02d}"] for j in range(10, 20)})


def test_communities_of_a_large_graph(spark):
    """A graph over the driver's bound is put together first; rings of cliques stay apart."""
    edges = [(f"c{k}n{i}", f"c{k}n{j}") for k in range(6) for i in range(8) for j in range(8) if i != j]
    edges += [(f"c{k}n0", f"c{(k + 1) % 6}n1") for k in range(6)]
    near = spark.createDataFrame([(a, 1, b, 0.5) for a, b in edges], "barcode string, rank int, neighbour string, distance double")
    whole = {r["barcode"]: r["cluster"] for r in matrix.clusters(near).collect()}
    parts = {r["barcode"]: r["cluster"] for r in matrix.clusters(near, most_edges=40).collect()}
    for found in (whole, parts):
        assert len(found) == 48 and len(set(found.values())) == 6
        assert all(found[f"c{k}n{i}"] == found[f"c{k}n0"] for k in range(6) for i in range(8))


def test_lsi_is_the_decomposition(spark):
    draw = np.random.default_rng(4)
    dense = draw.random((12, 8)) * (draw.random((12, 8)) < 0.7)
    rows = [(f"f{i:02d}", f"c{j}", float(dense[i, j])) for i in range(12) for j in range(8) if dense[i, j]]
    got = matrix.lsi(spark.createDataFrame(rows, "feature string, barcode string, value double"), rank=4, rounds=30)
    scores = np.array([r["scores"] for r in got.orderBy("barcode").collect()])
    _, d, vt = np.linalg.svd(dense)
    want = (vt[:3].T) * d[:3]
    assert np.allclose(np.abs(scores), np.abs(want), atol=1e-3)


def test_empty_droplets(spark):
    draw = np.random.default_rng(6)
    ambient = [(f"f{i}", f"e{j}", 1) for j in range(60) for i in draw.choice(20, 3, replace=False)]
    cell = [(f"f{i}", "real", 40) for i in (0, 1)]
    counts = spark.createDataFrame([(a, b, int(n)) for a, b, n in ambient + cell], "feature string, barcode string, n long")
    tested = qc.empty_droplets(counts, lower=3, rounds=200)
    assert [r["barcode"] for r in qc.cells_of_droplets(tested, 0.05).collect()] == ["real"]


def test_streamed_pairs(spark, tmp_path):
    schema = "rname string, qname string, coordinate int, reverse boolean, barcode string, ts timestamp"
    rows = spark.sql("select * from values ('c', 'a', 10, false, 'X', timestamp'2024-01-01 00:00:00'), ('c', 'a', 90, true, null, timestamp'2024-01-01 00:00:01'), ('c', 'b', 10, false, 'X', timestamp'2024-01-01 00:00:01') as t(rname, qname, coordinate, reverse, barcode, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    found = stream.paired_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("pairs").collect()] == [("c", 10, 90, "X")]


def test_principal_components_and_tree(spark):
    draw = np.random.default_rng(7)
    dense = draw.random((9, 30)) * (draw.random((9, 30)) < 0.8)
    rows = [(f"f{i}", f"c{j:02d}", float(dense[i, j])) for i in range(9) for j in range(30) if dense[i, j]]
    values = spark.createDataFrame(rows, "feature string, barcode string, value double")
    genes = values.select("feature").distinct()
    got = np.array([r["scores"] for r in matrix.principal_components(values, genes, 3).orderBy("barcode").collect()])
    x = (dense - dense.mean(axis=1, keepdims=True)).T
    u, d, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * d[:3]), atol=1e-8)
    tree = matrix.gene_tree(values, genes).orderBy("step").collect()
    far = 1 - np.corrcoef(dense)
    np.fill_diagonal(far, np.inf)
    assert len(tree) == 8 and tree[0]["height"] == pytest.approx(far.min())


def test_components(spark):
    import random

    from cellstrand.operators.graph import components

    draw = random.Random(2)
    edges = [(f"n{draw.randint(0, 60):02d}", f"n{draw.randint(0, 60):02d}") for _ in range(40)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_false_discovery(spark):
    draw = np.random.default_rng(1)
    p = np.round(draw.random(200) ** 2, 2) + 0.001
    got = {r["i"]: r["fdr"] for r in qc.false_discovery(spark.createDataFrame(list(enumerate(map(float, p))), "i int, p_value double")).collect()}
    order = np.argsort(-p, kind="stable")
    rate, least = {}, 1.0
    for rank, i in zip(range(len(p), 0, -1), order, strict=True):
        least = min(least, p[i] * len(p) / rank)
        rate[i] = least
    for i in range(len(p)):  # ties share the best
        assert got[i] == pytest.approx(min(rate[j] for j in range(len(p)) if p[j] == p[i]))


def test_ambient_profile(spark):
    rows = [("a", "e1", 1), ("b", "e2", 1), ("b", "e1", 2), ("c", "big", 50), ("d", "big", 9)]
    counts = spark.createDataFrame(rows, "feature string, barcode string, n long")
    got = {r["feature"]: r["p"] for r in qc.ambient_profile(counts, 5).collect()}
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx({"a": 0.25 * 0.75, "b": 0.75 * 0.75, "c": 0.125, "d": 0.125})


def test_folded_stream_is_the_batch_fold(spark, tmp_path):
    import random

    from cellstrand.operators import fragments

    draw = random.Random(8)
    rows = [("c", f"q{draw.randint(0, 40)}", draw.randint(0, 300), draw.random() < 0.5, draw.choice(["X", None]), i) for i in range(160)]
    ends = spark.createDataFrame(rows, "rname string, qname string, coordinate int, reverse boolean, barcode string, ord long")
    timed = ends.selectExpr("rname", "qname", "coordinate", "reverse", "barcode", "timestamp_seconds(1700000000 + ord) as ts")
    # a late end of another name moves the watermark past all
    last = spark.sql("select 'c' as rname, 'zz' as qname, 1 as coordinate, true as reverse, 'X' as barcode, timestamp_seconds(1800000000) as ts")
    for k, df in enumerate((timed.where("second(ts) < 30"), timed.where("second(ts) >= 30"))):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last.write.mode("append").parquet(str(tmp_path / "in"))
    found = stream.folded_stream(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = fragments.paired(ends).collect()
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, want)) and len(want) > 3


def test_layout_keeps_neighbours_together(spark):
    """Three clouds far apart in eight dimensions, two of them one in the first two, end up apart."""
    draw = np.random.default_rng(5)
    points = {f"c{i:02d}": draw.normal(size=8) + 9 * np.eye(8)[3 * (i % 3)] for i in range(60)}
    scores = spark.createDataFrame([(c, v.tolist()) for c, v in points.items()], "barcode string, scores array<double>")
    near = matrix.nearest_cells(scores, 10)
    edges = matrix.fuzzy_edges(near).collect()
    assert all(0 < r["weight"] <= 1 and r["a"] < r["b"] for r in edges)
    got = {r["barcode"]: np.array([r["x"], r["y"]]) for r in matrix.umap(near, scores, epochs=15, group=30).collect()}
    assert set(got) == set(points)
    apart = {}
    for a in got:
        for b in got:
            if a < b:
                apart.setdefault(tuple(sorted((int(a[1:]) % 3, int(b[1:]) % 3))), []).append(np.linalg.norm(got[a] - got[b]))
    mean = {k: np.mean(v) for k, v in apart.items()}
    assert min(mean[k] for k in mean if k[0] != k[1]) > 2 * max(mean[k] for k in mean if k[0] == k[1])


def test_stream_of_pairs_holds_buckets(spark, tmp_path):
    """Names share the state of a bucket; mates in different batches meet, ends in one batch go by ord."""
    schema = "ord long, rname string, qname string, coordinate int, reverse boolean, barcode string, ts timestamp"
    at = datetime.datetime(2024, 1, 1)
    forward = [(2 * i, "chr1", f"q{i}", i, False, "AC" if i % 2 else None, at) for i in range(200)]
    back = [(2 * i + 1, "chr1", f"q{i}", i + 100, True, "GT" if i % 3 else None, at) for i in range(200)]
    spark.createDataFrame(forward + back[:100][::-1], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(back[100:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ends = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = run.used_up(stream.paired_stream(ends, buckets=4), str(tmp_path / "out"))
    want = [("chr1", i, i + 100, "AC" if i % 2 else "GT") for i in range(200) if i % 2 or i % 3]
    assert sorted(tuple(r) for r in made.collect()) == want
    files = [f for f in (tmp_path / "out" / "state" / "commits").iterdir() if f.name.isdigit()]
    assert len(files) >= 2
    with run.Progress(spark) as seen:
        held = []
        seen.onQueryProgress = lambda event: held.extend(s.numRowsTotal for s in event.progress.stateOperators)
        run.used_up(stream.paired_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).where("not reverse"), buckets=4), str(tmp_path / "open"))
    assert held and max(held) <= 4


def test_nearest_cells_in_tiles(spark):
    """Memory is bounded by the tiles, and equal distances go by name, whatever blocks cells fall in."""
    draw = np.random.default_rng(3)
    x = draw.integers(0, 4, (300, 3)).astype(float)
    names = np.array([f"c{i * 37 % 300}" for i in range(300)], object)
    i, j, far = matrix.nearest_of(x, names, x, names, 7, tile=50, rows=16)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = [np.lexsort((names, row))[:7] for row in d]
    assert j.reshape(300, 7).tolist() == [w.tolist() for w in want] and np.allclose(far.reshape(300, 7), [d[a][w] for a, w in enumerate(want)])
    scores = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "barcode string, scores array<double>")
    got = {(r["barcode"], r["rank"]): r["neighbour"] for r in matrix.nearest_cells(scores, 7, block=64, wide=150).collect()}
    assert got == {(names[a], r + 1): names[c] for a, w in enumerate(want) for r, c in enumerate(w)}
