"""A virtual assay: reads, molecules, fragments and features as projections of the given tables.

Columns are SQL expressions that Spark and DuckDB read alike, so a query and the SQL
that says the same start from equal rows.  `frame` gives a DataFrame, `sql` the text
of a common table expression, in which ``end`` is written ``stop``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def base4(number: str, digits: int) -> str:
    """A number as letters A, C, G, T, the last digit first."""
    return "concat(" + ", ".join(f"substr('ACGT', cast(floor(({number}) / {float(4**i):.1f}e0) as int) % 4 + 1, 1)" for i in range(digits)) + ")"


def _int(x: str) -> str:
    return f"cast(floor({x}) as int)"


_QUALITY = "translate({}, 'ACGT', '#5?I')"

#: name: (table, {column: expression})
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "v_reads": (
        "events",
        {
            "read_id": "event_id",
            "qname": "concat('r', cast(event_id as varchar(20)))",
            "cell_bc": base4("user_id * 29 + (case when event_id % 11 = 0 then 1 else 0 end)", 6),
            "umi": base4("event_id % 257", 6),
            "flag": "case when event_type = 'signup' then 4 when event_id % 2 = 0 then 0 else 16 end",
            "rname": "concat('chr', cast(user_id % 7 + 1 as varchar(20)))",
            "pos": _int("value"),
            "gene_id": "case when event_type in ('click', 'purchase') then concat(case when event_id % 13 = 0 then 'ERCC-' else 'ENSG' end, cast(event_id % 40 as varchar(20))) end",
            "map_status": "case when event_type = 'signup' then 4 when event_type = 'error' then 1 when event_type = 'view' then 2 else -cast(event_id % 500 as int) end",
        },
    ),
    "v_cells": (
        "customer",
        {"cell_id": "concat('CELL', cast(c_custkey as varchar(20)))", "barcode": base4("c_custkey * 29", 6), "ord": "c_custkey"},
    ),
    "v_pairs": (
        "events",
        {
            "ordinal": "event_id",
            "name": "concat('read', cast(event_id as varchar(20)))",
            "seq1": "replace(" + base4("(event_id * 7919) % 1048576", 10) + ", 'GGT', 'GNT')",
            "qual1": _QUALITY.format(base4("(event_id * 31) % 1048576", 10)),
            "seq2": "replace(" + base4("(event_id * 104729) % 268435456", 14) + ", 'CCAT', 'CCNT')",
            "qual2": _QUALITY.format(base4("(event_id * 613) % 268435456", 14)),
        },
    ),
    "v_umi": (
        "lineitem",
        {"cell_id": "cast(l_suppkey as varchar(20))", "gene_id": "concat('G', cast(l_partkey % 200 as varchar(20)))", "umi": base4("l_orderkey % 64", 3), "pos": "l_linenumber"},
    ),
    "v_frag": (
        "lineitem",
        {
            "chrom": "concat('chr', cast(l_linenumber as varchar(20)))",
            "start": _int("l_extendedprice"),
            "end": f"{_int('l_extendedprice')} + 4 * {_int('l_quantity')}",
            "barcode": base4("l_suppkey", 8),
        },
    ),
    "v_feat": (
        "part",
        {"chrom": "concat('chr', cast(p_partkey % 7 + 1 as varchar(20)))", "start": "cast(50 * p_partkey as int)", "end": "cast(50 * p_partkey + 10 * p_size as int)"},
    ),
    "v_promoter": (
        "part",
        {"chrom": "concat('chr', cast(p_partkey % 7 + 1 as varchar(20)))", "start": "cast(90 * p_partkey as int)", "end": "cast(90 * p_partkey + 40 as int)"},
    ),
    "v_enhancer": (
        "supplier",
        {"chrom": "concat('chr', cast(s_suppkey % 7 + 1 as varchar(20)))", "start": "cast(997 * s_suppkey as int)", "end": "cast(997 * s_suppkey + 500 as int)"},
    ),
    "v_black": (
        "supplier",
        {"chrom": "concat('chr', cast(s_suppkey % 7 + 1 as varchar(20)))", "start": "cast(1009 * s_suppkey as int)", "end": "cast(1009 * s_suppkey + 150 as int)"},
    ),
    "v_tss": (
        "supplier",
        {
            "tss_id": "s_suppkey",
            "chrom": "concat('chr', cast(s_suppkey % 7 + 1 as varchar(20)))",
            "start": "cast(1013 * s_suppkey as int)",
            "end": "cast(1013 * s_suppkey as int)",
        },
    ),
    "v_exon": (
        "part",
        {
            "gene_id": "concat('G', cast(floor(p_partkey / 4.0e0) as int))",
            "chrom": "concat('chr', cast(floor(p_partkey / 4.0e0) as int) % 7 + 1)",
            "start": "cast(120 * p_partkey as int)",
            "end": "cast(120 * p_partkey + 5 * p_size as int)",
            "strand": "case when cast(floor(p_partkey / 4.0e0) as int) % 2 = 0 then 1 else -1 end",
        },
    ),
    "v_aligned": (
        "lineitem",
        {
            "qname": "concat(cast(l_orderkey as varchar(20)), '/', cast(l_partkey as varchar(20)), '/', cast(l_suppkey as varchar(20)), '/', cast(l_linenumber as varchar(20)))",
            "flag": f"case when {_int('l_quantity')} % 2 = 0 then 0 else 16 end",
            "rname": "concat('chr', cast(l_partkey % 7 + 1 as varchar(20)))",
            "pos": "cast(120 * l_partkey + l_suppkey as int)",
            "cigar": f"concat(cast(20 + {_int('l_quantity')} as varchar(20)), 'M', cast(60 * l_linenumber as varchar(20)), 'N30M')",
        },
    ),
    "v_ends": (
        "orders",
        {
            "ord": "o_orderkey",
            "rname": "concat('chr', cast(cast(floor(o_orderkey / 2.0e0) as int) % 5 + 1 as varchar(20)))",
            "qname": "concat('q', cast(cast(floor(o_orderkey / 2.0e0) as int) as varchar(20)))",
            "coordinate": f"cast({_int('o_totalprice')} % 4000 as int)",
            "reverse": "(o_custkey % 2 = 0)",
            "barcode": "case when o_custkey % 9 = 0 then null else " + base4("o_orderkey % 97", 4) + " end",
        },
    ),
    "v_collapse": (
        "lineitem",
        {
            "chrom": "concat('chr', cast(l_linenumber as varchar(20)))",
            "start": f"{_int('l_extendedprice')} % 120",
            "end": f"{_int('l_extendedprice')} % 120 + 20 + {_int('l_quantity')} % 12",
            "barcode": base4("l_suppkey % 6", 2),
        },
    ),
}


def _spark(expression: str) -> str:
    return expression.replace("varchar(20)", "string")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{_spark(e)} as `{c}`" for c, e in columns.items()])


def sql(*names: str) -> str:
    """``WITH`` and the tables of these names."""
    one = lambda n: f"{n} AS (SELECT " + ", ".join(f"{e} AS {'stop' if c == 'end' else c}" for c, e in TABLES[n][1].items()) + f" FROM {TABLES[n][0]})"
    return "WITH " + ", ".join(map(one, names))
