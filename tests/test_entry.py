import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query_and_all_problems_are_there():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    core = {"p1_found", "p4_found", "p6_found"}
    assert core <= names
    if entry.llm_queries:
        assert {"p2_found", "p3_found", "p5_found", "p7_found", "p8_ids", "p9_pack", "p10_found"} <= names
