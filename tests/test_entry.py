import pytest

import __spark_entry__ as entry
from tests.check_oracles import connect, differences

# A fast selection; tests/check_oracles.py compares every query.
QUICK = ["adjusted_scores", "dedup_best", "best_rank_counts", "job_status", "upsert_by_key", "uniform_sample", "label_sample",
         "row_cap", "tv_complement", "category_adherence", "new_row_synthesis", "sequence_features", "metadata_counts"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100 and len(entry.oracle_sql()) > 80


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["Synthesizer", "Wins"] and frame.count() == 6


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, sf, name):
    frame = entry.queries()[name](spark, sf)
    cursor = connect(sf).execute(entry.oracle_sql()[name])
    assert differences(frame.columns, [tuple(r) for r in frame.collect()], [c[0] for c in cursor.description], cursor.fetchall()) is None
