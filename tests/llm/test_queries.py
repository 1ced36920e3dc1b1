"""The registered queries that SQL can express against their SQL, on the smallest tables."""

import duckdb
import pytest

from genoquilt.llm import queries

TABLES = "orders lineitem documents embeddings conversations".split()


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op2_exact_topk", "op5_near_duplicates"}))
def test_query_equals_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    order = ", ".join(f'"{c}"' for c in sorted(got.columns))
    want = con.sql(queries.oracle_sql()[name]).project(order).fetchall()
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_chat_calls_are_parsed_once(spark):
    text = '<tool_call>{"id":"a","name":"n","arguments":{"x":1}}</tool_call><tool_call>no json</tool_call>'
    msgs = spark.createDataFrame([(1, 1, "assistant", text), (1, 2, "assistant", "<tool_call> open")], "conv_id long, turn long, role string, text string").repartition(1)
    calls = queries.chat.parse_calls(msgs)
    assert calls._jdf.queryExecution().optimizedPlan().toString().count("JsonToStructs") + calls._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 3
    assert sorted((r["at"], r["call_id"], r["name"], r["arguments"]) for r in calls.collect()) == [(0, "a", "n", {"x": "1"}), (1, None, None, None)]
