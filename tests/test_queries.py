"""Every query with SQL gives what DuckDB makes of that SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from cellstrand.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(round(float(v), 6) + 0.0)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_without_sql_is_tested_elsewhere(spark):
    """Queries that SQL can't say: their operators are held against plain versions in the
    other tests; here, what each must keep."""
    without = set(registry.QUERIES) - set(registry.ORACLE_SQL)
    assert without == {"barcode_neighbour_merge", "umi_correct_1", "umi_correct_2", "umi_correct_3", "umi_dedup_stat", "outliers_mahalanobis", "empty_droplets", "lsi_scores", "knn_cells", "cell_clusters"}
    found = {name: registry.QUERIES[name](spark, DATA) for name in without}
    histogram = registry._hist(spark, DATA).where("n >= 2")
    assert found["barcode_neighbour_merge"].agg({"n": "sum"}).first()[0] == histogram.agg({"n": "sum"}).first()[0]
    raw = {(r["gene_id"], r["cell_id"]): r["n"] for r in registry.QUERIES["umi_counts_raw"](spark, DATA).collect()}
    for mode in (1, 2, 3):
        fixed = {(r["gene_id"], r["cell_id"]): r["n"] for r in found[f"umi_correct_{mode}"].collect()}
        assert set(fixed) == set(raw) and all(1 <= n <= raw[k] for k, n in fixed.items())
    once = {(r["gene_id"], r["cell_id"]): r["n"] for r in registry.QUERIES["umi_correct_1"](spark, DATA).collect()}
    lost = {}
    for k, n in raw.items():
        lost[k[1]] = lost.get(k[1], 0) + n - once[k]
    assert {r["cell_id"]: r["corrected_UMI"] for r in found["umi_dedup_stat"].collect()} == lost
    cells = {r["cell_id"] for r in registry.QUERIES["gene_qc_metrics"](spark, DATA).collect()}
    assert {r["cell_id"] for r in found["outliers_mahalanobis"].collect()} == cells
    drops = found["empty_droplets"].collect()
    assert drops and all(0 < r["p_value"] <= r["fdr"] <= 1 for r in drops)
    barcodes = {r["barcode"] for r in registry._umi_matrix(spark, DATA).select("barcode").distinct().collect()}
    assert {r["barcode"] for r in found["lsi_scores"].collect()} == barcodes == {r["barcode"] for r in found["cell_clusters"].collect()}
    near = found["knn_cells"].collect()
    assert {r["barcode"] for r in near} == barcodes and all(r["distance"] == 0 for r in near if r["barcode"] == r["neighbour"])
    for r in near:
        assert 1 <= r["rank"] <= min(30, len(barcodes))


def test_entry(spark):
    assert entry.entry(spark).columns == ["feature", "barcode", "n"]
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
