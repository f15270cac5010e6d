import pytest

from tessera.llm.queries import QUERIES
from tessera.llm.sql import SQL
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, data, name):
    assert_same(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs_and_repeats_no_row(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(str(v) for v in r) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name,columns", [
    ("p1_found", ["kind", "record_id", "unit_id"]), ("p2_found", ["image_id_a", "image_id_b"]), ("p3_found", ["first_alert_id", "last_alert_id"]), ("p4_found", ["entry_id", "field", "ref_id"]),
    ("p5_found", ["kind", "record_id", "head_id"]), ("p6_found", ["plan_id", "category"]), ("p7_ids", ["doc_id", "ids"]), ("p8_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id"]),
])
def test_columns_are_as_agreed(spark, data, name, columns):
    assert QUERIES[name](spark, data).columns == columns
