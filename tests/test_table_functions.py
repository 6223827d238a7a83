"""Table functions by SQL: planned for their table, refused while planning."""

import pytest

from convspan.functions import table_functions

HERE = "convspan.functions.table_functions"


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    spark.sql("SELECT 7 AS id, array(named_struct('role', 'user', 'content', 'q'), named_struct('role', 'assistant', 'content', 'a')) AS messages, 'x' AS more UNION ALL SELECT 8, array(), 'y'").createOrReplaceTempView("raw_rows")
    spark.sql("SELECT * FROM VALUES ('s', 1, 'assistant', 'yo'), ('s', 0, 'user', 'hi'), ('t', 0, 'user', '') AS t(sample_id, message_index, role, text)").createOrReplaceTempView("message_rows")
    return spark.sql


def test_columns_pass_through(sql):
    found = sql(f"SELECT * FROM adapt_rows(TABLE(raw_rows), adapter => '{HERE}:first_exchange')")
    assert found.columns == ["id", "messages", "more", "message_index", "role", "message", "reason"]
    assert sorted((r.id, r.more, r.message_index, r.role, r.message, r.reason) for r in found.where("id = 7").collect()) == [(7, "x", 0, "user", "q", None), (7, "x", 1, "assistant", "a", None)]
    assert found.where("id = 8").first().reason == "no question with an answer"


def test_samples_in_order(sql):
    found = sql(f"SELECT * FROM render_rows(TABLE(message_rows) PARTITION BY sample_id ORDER BY message_index, renderer => '{HERE}:transcript') ORDER BY sample_id, span_index").collect()
    assert "".join(r.text for r in found if r.sample_id == "s") == "user: hi\nassistant: yo\n" and [r.span_index for r in found if r.sample_id == "t"] == [0, 1]


def test_calls_that_are_refused(sql):
    for call, match in (
        (f"adapt_rows(TABLE(raw_rows), adapter => '{HERE}:nothing')", "names no function"), ("adapt_rows(TABLE(raw_rows), adapter => 'json')", "names no function"), (f"render_rows(TABLE(raw_rows), renderer => '{HERE}:transcript')", "lacks"),
        ("encode_texts(TABLE(raw_rows), encoder => 'x')", "lacks"), ("encode_texts(TABLE(message_rows), encoder => '/no/such/file')", "No such file"),
    ):
        with pytest.raises(Exception, match=match):
            sql(f"SELECT * FROM {call}").collect()
