"""Some registered queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from loculus.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["preprocess_transcripts", "nc_ratio", "prefilter_stats", "shape_features", "point_in_polygon", "peripheral_score", "ripley_extremes", "proximal_pairs_2d", "cpb_p_values", "region_fractions", "composition_flux", "pair_context_summary", "gene_hubs", "cells_by_balance",
         "randomized_labels", "repaired_shapes", "pattern_features", "gene_celltype_scores", "significant_pairs", "differential_p_values", "grouped_run_summary", "prefilter_distributions", "nc_ratio_report"]


def rows(df):
    df = df[sorted(df.columns)]
    said = lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(said, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "nation", "part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).df())
