"""Every registered reference query against its SQL twin."""

import pytest
from compare import database, rows

from convspan.operators import tool_units
from convspan.plans import catalogue

SF = "/root/testdata/sf0.001"
#: (sample, index, role, call ids, result ids) of tool exchanges.
TOOL_FIXTURE = [
    ("chained", 0, "user", [], []), ("chained", 1, "assistant", ["c1", "c2"], []), ("chained", 2, "tool", [], ["c2"]), ("chained", 3, "tool", [], ["c1"]), ("chained", 4, "assistant", ["c3"], []),
    ("chained", 5, "tool", [], ["c3"]), ("chained", 6, "assistant", [], []), ("chained", 7, "user", [], []), ("unknown", 0, "user", [], []), ("unknown", 1, "assistant", ["c1"], []), ("unknown", 2, "tool", [], ["c9"]),
    ("open", 0, "assistant", ["c1"], []), ("open", 1, "tool", [], ["c1"]), ("outside", 0, "user", ["c1"], []), ("again", 0, "assistant", ["c1"], []), ("again", 1, "tool", [], ["c1"]), ("again", 2, "assistant", ["c1"], []),
]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    found = catalogue.queries()[name](spark, SF).toPandas()
    wanted = database(SF).sql(catalogue.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry_and_lists():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_only_queries(spark):
    rows = spark.createDataFrame(TOOL_FIXTURE, "sample_id string, message_index int, role string, call_ids array<string>, result_ids array<string>")
    units = {(r.sample_id, r.first_message): r for r in tool_units.tool_units(rows).collect()}
    assert units["chained", 1].last_message == 6 and units["chained", 1].has_tool_call
    assert all(units[name, None].reason for name in ("unknown", "open", "outside", "again"))
    assert len({r.identity for r in catalogue.queries()["recipe_identity"](spark, SF).where("error is null").collect()}) > 1


def test_whole_tables(spark):
    """No vector and no conversation is left out."""
    vectors, turns = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("embeddings", "conversations"))
    n = vectors.count()
    assert n > 64 and catalogue.queries()["lora_merge_all"](spark, SF).count() == n * 64
    assert catalogue.queries()["lora_param_count_all"](spark, SF).first().parameters == n * 4 + 4 * 64
    told = catalogue.queries()["explain_all_tokens"](spark, SF)
    assert told.select("sample_id").distinct().count() == turns.select("conv_id").distinct().count() > 1
