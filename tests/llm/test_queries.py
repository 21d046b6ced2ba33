import pytest
from test_entry import entry, same


@pytest.mark.parametrize("name", ["p4_frequencies", "p6_found", "p7_counts"])
def test_against_sql(spark, sf, name):
    same(spark, sf, name)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p9_found", "p10_found", "p8_fill"])
def test_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0
