import pytest

from jobloom.llm.openings import with_opening
from jobloom.llm.plain_form import plain_columns
from jobloom.llm.queries import QUERIES, SQL
from jobloom.llm.tokens import with_tokens

SMALL = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": [("name_1", "string"), ("name_2", "string")],
    "p2_found": [("inbox_id", "bigint"), ("prior_key", "string")],
    "p3_found": [("record_kind", "string"), ("id_1", "bigint"), ("id_2", "bigint")],
    "p4_found": [("group_id", "bigint"), ("source_id", "bigint")],
    "p5_found": [("requirement_id", "bigint"), ("skill_id", "int")],
    "p6_found": [("field", "string"), ("record_id", "bigint")],
    "p9_found": [("doc_id", "bigint"), ("subject_id", "int")],
}


@pytest.mark.parametrize("name", FOUND)
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.dtypes == FOUND[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in ("p1_found", "p3_found"):
        assert all(r[-2] < r[-1] for r in rows)


def test_packing_and_mixing(spark):
    got = QUERIES["p7_pack"](spark, SMALL).collect()
    room = {"small": 256, "medium": 1024, "large": 4096}
    by = {}
    for r in got:
        by[r.size_name, r.container_id] = by.get((r.size_name, r.container_id), 0) + r.length
    assert set(r.size_name for r in got) == set(room) and all(v <= room[k] for (k, _), v in by.items())
    limit = {r.source: r.max_repeats for r in spark.read.parquet(f"{SMALL}/mix_targets.parquet").collect()}
    assert all(r.times <= limit.get(r.source, 0) for r in QUERIES["p8_mix"](spark, SMALL).collect())


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([("Ｄev - X", "Natal, RN", "old", True, 1)], "title string, location string, title_plain string, role boolean, n_tokens int")
    assert plain_columns(df, ["title"]).first().title_plain == "Dev - X"
    assert with_opening(df, "title", "location").first().role == "dev"
    assert with_tokens(df, "title").first().n_tokens > 1
