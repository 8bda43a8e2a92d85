"""Core queries on documents with null keys, repeated ids, repeated rows, null and empty texts."""

import pytest

import __spark_entry__ as entry

from .oracle import assert_same, connection

QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = ["entropy_curve_by_lang", "entropy_estimators", "entropy_matched_budget", "entropy_budget_ladder", "row_numbers", "round_robin", "upserted_cells", "surface_counts", "batch_sizes", "proper_noun_pool",
         "shards_and_splits", "row_slice", "budgeted_selection", "fraction_sample", "stratified_sample", "recorded_subsets", "first_occurrences", "epoch_permutations", "compared_sets", "parsed_documents", "ranked_candidates"]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """The documents, some rows of them twice, a source without a language, rows without an id, and empty texts."""
    out = tmp_path_factory.mktemp("nulls")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(40).selectExpr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS lang", "source", "n_chars")
    blank = spark.createDataFrame([(1, "", "en", "s", 0), (1, " \n", None, "s", 2), (None, None, None, None, None), (2, "5 .", "en", "s", 3)], docs.schema)
    docs.unionByName(docs.limit(15)).unionByName(odd).unionByName(blank).coalesce(2).write.parquet(f"{out}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_nulls_and_repeats(spark, folder, name):
    assert_same(connection(folder), QUERIES[name](spark, folder), SQL[name])
