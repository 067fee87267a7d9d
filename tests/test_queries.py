import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from stemma.operators import reconstruct
from stemma.plans import file_queries

BASE = ["event_counts", "mle_idm_bdm_lrt", "pair_counts_and_runs", "array_dedup", "single_link_clusters", "leaf_distance", "leaf_rows", "unseen_probability"]
BASE += ["ml_states", "branch_gains_losses", "pair_distances", "split_mismatch_columns", "event_bundle", "age_sorted_tokens", "tokens_moved_from_guide", "refinement_keeps_leaves", "first_seen_ids", "category_counts", "pooled_estimates_by_chunk"]
BASE += [*file_queries.QUERIES, "arrays_without_gaps", "rate_conversions", "group_agreement", "inverted_maps", "near_genes_or_typed", "rows_of_chosen_runs", "leaf_actions", "tree_with_leaf_actions", "parameter_grid", "mutated_arrays"]
#: Queries of reconstructed states.
EMPTY_BLOCKS = ["duplicate_candidates", "contradictions", "decision_rule", "event_bundle", "event_counts", "groups_with_losses", "event_labels", "leaf_only_gains", "losses_with_others", "leaf_rows", "loss_blocks", "ml_states", "mle_idm_bdm_lrt"]


def rows(table):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        return None if not isinstance(v, list) and pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr([plain(v) for v in r]) for r in table[sorted(table.columns)].itertuples(index=False))


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", BASE)
def test_like_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    assert rows(entry.queries()[name](spark, data).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", EMPTY_BLOCKS)
def test_like_sql_with_blocks_without_tokens(spark, data, monkeypatch, name):
    """As on large tables: a group's tokens are dealt out to many blocks, and some get none."""
    monkeypatch.setattr(reconstruct, "CELLS", 1)
    test_like_sql(spark, data, name)
