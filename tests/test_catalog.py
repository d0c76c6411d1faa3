"""Every registered query of the library against its SQL over the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import compare, connect  # noqa: E402

from convlens.plans import catalog, catalog_answers, catalog_built, catalog_more  # noqa: E402, F401

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    (columns, got), (want_columns, want) = compare(catalog.QUERIES[name](spark, DATA), connect(DATA), catalog.SQL[name])
    assert columns == want_columns
    assert got == want
    assert got


@pytest.mark.parametrize("name", ["flat_search", "grouped_search", "nested_messages", "explained_ranks", "explained_known_pairs", "sitting_search"])
def test_scores_match_over_more_rows(spark, name):
    """Unrounded scores, alike to nine digits, over tables of ten times the size."""
    folder = DATA.replace("0.001", "0.01")
    (columns, got), (want_columns, want) = compare(catalog.QUERIES[name](spark, folder), connect(folder), catalog.SQL[name])
    assert columns == want_columns and got == want and got
