"""Rows that repeat a doc_id, or have none, are documents of their own in the pipeline's stages."""

from __future__ import annotations

from collections import Counter

from strikeplane.llm import mixing, simhash

SCHEMA = "doc_id long, text string, source string"


def text(name: str, n: int = 40) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def test_near_dedup_keeps_a_row_of_each_component(spark):
    rows = [(1, text("a"), "s"), (1, text("b"), "s"), (2, text("b"), "s"), (None, text("c"), "s"), (None, text("c"), "s"), (None, text("d"), "s"), (3, text("d"), "s"), (4, text("e"), "s"), (4, text("e"), "s")]
    kept = sorted((r.text[0], r.doc_id) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [("a", 1), ("b", 1), ("c", None), ("d", 3), ("e", 4)]


def test_the_mix_draws_rows_of_one_id_apart(spark):
    rows = [(7, text(f"p{i}x"), "s") for i in range(60)] + [(None, text(f"q{i}x"), "s") for i in range(60)]
    rows += [(1000 + i, text(f"r{i}x"), "t") for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.take(docs)
    words = Counter()
    for r in taken.collect():
        words[r.source] += 40
    total = 240 * 40
    assert abs(words["s"] - total / 3) <= 40 and abs(words["t"] - 2 * total / 3) <= 40
    # rows of unlike sizes under one id are taken by their own
    unlike = spark.createDataFrame([(7, text("p", 10 + i), "s") for i in range(60)] + [(100 + i, text("r", 40), "t") for i in range(60)], SCHEMA)
    want = mixing.mix(unlike)
    assert mixing.take(unlike).count() == sum(r.copies for r in want.collect())
