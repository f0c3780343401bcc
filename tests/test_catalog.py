"""Queries against their DuckDB SQL, on the smallest tables; and the catalogue's form."""

import math
from pathlib import Path

import duckdb
import pytest

from polyseq.plans import whole as catalog

DATA = "/root/testdata/sf0.001"
QUICK = (
    "seq_validate", "composition", "seq_properties", "charge_metrics", "kappa_charge", "scd", "find_positions", "mutation_validate", "mutation_apply_multi", "mutate_all", "fasta_format", "gen_progressive", "gen_single_site", "gen_blocks",
    "chain_segments", "chain_string", "regions_filtered", "linker_stats", "omega", "sticker_clustering", "entropy_spacing", "entropy_block", "entropy_composition", "theta_classes", "theta_pairs", "energy_uniform", "spearman", "ff_neighbours", "ff_topk",
    "map_raw", "delta_g", "diff_metrics", "graph_clustering", "auto_threshold", "energy_by_sep", "ham_gradient", "map_stats", "map_normalize_zscore", "map_normalize_minmax", "sticker_pair_dist",
    "percolation_curve", "persistence_diagrams", "betti_curves", "homology_metrics", "energy_distances", "sticker_betweenness", "topology_metrics", "graph_components", "graph_distances", "h_eff", "training_rows", "entropy_metrics", "map_slices", "value_bags", "pair_masks", "criteria_overlap",
    "slide_gauss", "base_variants", "residue_at", "numeric_mask", "ff_components", "ff_lookup", "ff_rows", "ff_ranking", "theta_composition", "delta_g_documents", "valency_documents", "linfit_delta_g", "profile_documents",
    "map_smooth_clamped", "map_moments_documents", "chain_energy_documents", "total_energy_documents", "energy_uniform_documents", "theta_classes_documents", "theta_pairs_documents", "variant_differences", "diff_topk", "entropy_interaction", "graph_local_clustering", "entropy_degree",
)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    missing = value is None or (isinstance(value, float) and math.isnan(value))
    return None if missing else float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", QUICK)
def test_same_as_duckdb(spark, tables, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = tables.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[k]) for k in order) for r in relation.fetchall()), key=repr)
    assert found == wanted


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
