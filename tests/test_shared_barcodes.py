"""Demultiplexing queries where cells share barcodes: what DuckDB makes of their SQL."""

import os

import duckdb
import pytest

from cellstrand.plans import registry
from test_queries import DATA, TABLES, plain


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables; every third customer comes again with a key whose barcode is the same."""
    place = tmp_path_factory.mktemp("tables")
    for t in TABLES:
        if t != "customer":
            os.symlink(f"{DATA}/{t}.parquet", place / f"{t}.parquet")
    source = f"'{DATA}/customer.parquet'"
    twice = f"select * from {source} union all select * replace (c_custkey + 4096 as c_custkey) from {source} where c_custkey % 3 = 0"
    duckdb.connect().execute(f"copy ({twice}) to '{place}/customer.parquet' (format parquet)")
    return str(place)


@pytest.mark.parametrize("name", ["corrected_barcodes", "counting_run", "demux_cell_reads", "demux_cell_stat", "demux_overall_stat", "plot_demultiplex_share", "report_tables"])
def test_same_as_sql_with_shared_barcodes(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert want
    made = registry.QUERIES[name](spark, folder).select(*[f"`{c}`" for c in names]).collect()
    assert sorted(tuple(map(plain, r)) for r in made) == want


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """The smallest tables; every customer comes again, so no barcode is listed for one cell only."""
    place = tmp_path_factory.mktemp("crowded")
    for t in TABLES:
        if t != "customer":
            os.symlink(f"{DATA}/{t}.parquet", place / f"{t}.parquet")
    source = f"'{DATA}/customer.parquet'"
    twice = f"select * from {source} union all select * replace (c_custkey + 4096 as c_custkey) from {source}"
    duckdb.connect().execute(f"copy ({twice}) to '{place}/customer.parquet' (format parquet)")
    return str(place)


@pytest.mark.parametrize("name", ["corrected_barcodes", "counting_run", "demux_cell_reads", "demux_cell_stat", "demux_overall_stat", "plot_demultiplex_share", "report_tables"])
def test_same_as_sql_without_lone_barcodes(spark, crowded, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{crowded}/{t}.parquet'")
    # of cells that share their barcodes none gets a read
    assert con.execute(registry.ORACLE_SQL["experiment_demultiplexing"]).fetchall() == [("barcode_match", 0)]
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    made = registry.QUERIES[name](spark, crowded).select(*[f"`{c}`" for c in names]).collect()
    assert sorted(tuple(map(plain, r)) for r in made) == want


def test_shares_are_rounded_as_in_sql(spark, crowded, tmp_path):
    """41 of 640 reads: 0.0640625, whose double lies below the middle of two numbers of six places."""
    for t in TABLES:
        if t != "events":
            os.symlink(f"{crowded}/{t}.parquet", tmp_path / f"{t}.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when event_id < 41 then 'click' else 'view' end as event_type) from '{DATA}/events.parquet' where event_id < 640) to '{tmp_path}/events.parquet' (format parquet)")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = {r[0]: r[1:] for r in con.execute(registry.ORACLE_SQL["plot_demultiplex_share"]).fetchall()}
    assert want["barcode_unmatch_mapped_to_exon"] == (41, 0.064062)
    assert {r["status"]: (r["count"], r["share"]) for r in registry.QUERIES["plot_demultiplex_share"](spark, str(tmp_path)).collect()} == want
