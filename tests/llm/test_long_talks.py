"""Conversations with very many turns that have no number, or one number."""

import pytest

from tidemark.llm import transcripts


@pytest.mark.parametrize("turn", [None, 7])
def test_turns_without_order_are_cut_by_position(spark, monkeypatch, turn):
    monkeypatch.setattr(transcripts, "CHUNK", 50)
    rows = [(1, turn, "user" if i % 2 else "assistant", f"text {i}") for i in range(400)] + [(2, 0, "user", "hello")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = [len(r["rows"]) for r in transcripts._chunks(df, "conv_id", "turn", "text", "role").collect()]
    assert sorted(sizes) == [1, *[50] * 8]
    assert transcripts.recovered(df).count() == len(rows)
