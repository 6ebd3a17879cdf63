"""Registered queries against their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from strandlake.plans.registry import ORACLE_SQL, QUERIES

#: Queries that go the same way as one that is run here; the driver compares them all.
LEFT = {
    "allele_support", "bed_intersect", "bundle_jobs", "capped_clusters", "channel_colours", "cigar_explode", "clip_reads", "confident_sites",
    "consecutive_runs", "expert_mix", "haplotype_match", "hotspot_islands", "in_confident", "indel_evidence", "label_attach", "mixture_mean", "op_alleles",
    "pair_likelihood", "partial_alleles", "reads_by_site", "resolve_partials", "sink_predictions", "site_alleles", "snv_evidence",
    "src_predictions", "top_genotype", "truth_haplotypes", "union_hotspots",
}


def cell(x):
    return (1, "") if x is None or pd.isna(x) is True else (0, f"{x:.9g}" if isinstance(x, float) else str(x))


def plain(df):
    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL.keys() - LEFT))
def test_same_rows(spark, sf, duck, name):
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(duck.sql(ORACLE_SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
