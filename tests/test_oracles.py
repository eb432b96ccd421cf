import pytest

from tests import oracle
from tidemark.plans import registry
from tidemark.session import table


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, small, con, name):
    oracle.check(spark, small, registry.QUERIES[name], registry.ORACLE[name], con)


#: queries without SQL and the tests that hold them against plain models
MODELLED = {
    "canonical_lines": "test_models", "line_hashes": "test_models", "search_tokens": "test_models", "parsed_fields": "test_models", "redact_documents": "test_models",
    "mined_templates": "test_templates", "p1_found": "test_loglines", "p1_entries": "test_loglines", "p4_found": "test_clock",
}


def test_every_query_has_sql_or_a_model():
    assert set(registry.QUERIES) - set(registry.ORACLE) == set(MODELLED)


@pytest.mark.parametrize("name", ["p1_found", "p1_entries"])
def test_entries_cover_each_line_from_the_first_head_on(spark, small, name):
    """Spans of a file's entries follow one another, and each begins where the one before ends."""
    lines = table(spark, small, "log_lines").where("parse_status = 'UNPARSED'").select("file_id", "line_no").distinct().collect()
    numbers = {}
    for r in lines:
        numbers.setdefault(r.file_id, []).append(r.line_no)
    found = {}
    for r in registry.QUERIES[name](spark, small).collect():
        found.setdefault(r.file_id, []).append((r.line_no, r.line_span))
    assert found
    for file_id, entries in found.items():
        places = {n: i for i, n in enumerate(sorted(numbers[file_id]))}
        entries.sort()
        assert all(places[a] + span == places[b] for (a, span), (b, _) in zip(entries, entries[1:]))
        assert places[entries[-1][0]] + entries[-1][1] == len(places)
