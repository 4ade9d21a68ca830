from __future__ import annotations

import oracle
import pytest

from strandloom.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf), duck, queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


COLUMNS = {
    "p1_found": {"field_name", "id_a", "id_b"},
    "p2_found": {"field_name", "category"},
    "p3_found": {"record_id", "cut_pos"},
    "p4_found": {"genome_key", "group_key"},
    "p5_found": {"value_id", "cluster_id"},
    "p6_found": {"doc_id", "item_id"},
    "p7_found": {"source"},
    "p8_found": {"doc_id", "reading_level"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert set(queries.QUERIES[name](spark, sf).columns) == COLUMNS[name]
