"""The pipeline's stages against plain versions of them, on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from strikeplane.llm.shared import materialize  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(
        spark.createDataFrame([(900001, None, "en", "src1", 0), (900002, "12 34 !!", "en", "src1", 8)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "test-stage")
        seen[name] = (before, docs)
        if name != "packed":
            assert docs.columns == columns
    before, after = seen["language"]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    assert {900001, 900002} <= gone and len(gone) <= 2 + 0.03 * before.count()

    before, after = seen["near_duplicates"]
    rows = before.select("doc_id", "text").collect()
    sets = {r.doc_id: brute.shingles(r.text, 5) for r in rows}
    kept, gone = {r.doc_id for r in after.collect()}, set()
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for d in sets.keys() - kept:  # whoever goes has somebody alike
        assert max(alike(d, x) for x in sets if x != d) > 0.7
        gone.add(d)
    missed = [(a, b) for a in kept for b in kept if a < b and alike(a, b) > 0.85]
    assert len(missed) <= 0.1 * max(10, len(gone))

    before, after = seen["secret_scan"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not brute.base_spans(r.text)
        if not brute.base_spans(texts[r.doc_id]):
            assert r.text == texts[r.doc_id] or "[SECRET]" in r.text
    assert after.count() == before.count()

    before, after = seen["mixture"]
    times = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in before.collect()}
    size = {r.doc_id: (r.source, len(brute.WORD.findall(r.text))) for r in before.collect()}
    taken, sizes, largest = {}, {}, max(n for _, n in size.values())
    for d, (s, n) in size.items():
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + n * times.get(d, 0)
    for s, t in brute.targets(sizes).items():
        assert abs(taken[s] - t) <= largest

    before, after = seen["packed"]
    assert after.filter("piece = 0").count() == before.count()
    full = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in full) <= 2048
    assert len(full) <= -(-sum(r.n for r in full) // 2048) + 2


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)
