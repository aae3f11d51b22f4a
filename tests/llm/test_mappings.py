"""Typed chat tables by the fingerprint of their schema."""

import pytest

from tidemark.llm import chat_format, queries


def test_the_fingerprint_of_a_table_selects_its_mapping(spark, tmp_path):
    rows = [(1, 0, "human", "hi"), (1, 1, "gpt", "hello"), (2, 0, None, None)]
    same = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, `from` string, value string").write.parquet(f"{tmp_path}/a/conversations.parquet")
    spark.createDataFrame(same, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    a, b = (sorted(map(tuple, queries.op3_chat_formatting(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b and len(a) == 3
    with pytest.raises(ValueError):
        chat_format.turn_rows(spark.createDataFrame([(1, "x")], "conv_id long, other string"))
