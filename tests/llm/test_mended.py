"""Recall of short near copies, marks in texts with very many secrets, and the language sample."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from strikeplane.llm import langid, secrets, simhash


def short_pair(i: int, shared: int, a: int, b: int) -> tuple[str, str]:
    """Two texts of shared + a and shared + b five-word shingles, of which the first `shared` are the same."""
    head = [f"w{i}x{j}" for j in range(shared + 4)]
    return " ".join(head + [f"a{i}x{j}" for j in range(a)]), " ".join(head + [f"b{i}x{j}" for j in range(b)])


def test_short_texts_at_the_bound(spark):
    """4 to 24 shingles, right at 0.8 and right below: every pair at the bound is linked, no other; of 32 to 140, nine in ten."""
    above, below, longer = [], [], []
    for i in range(60):
        for shared, a, b in ((4, 0, 1), (4, 1, 0), (8, 1, 1), (8, 0, 2), (12, 0, 3), (16, 2, 2), (16, 0, 4), (20, 2, 3)):
            above.append(short_pair(len(above), shared, a, b))
        for shared, a, b in ((28, 3, 4), (28, 0, 7), (44, 4, 7), (60, 7, 8), (100, 12, 13), (112, 14, 14)):
            longer.append(short_pair(20_000 + len(longer), shared, a, b))
        for shared, a, b in ((3, 0, 1), (7, 1, 1), (11, 0, 3), (15, 2, 2), (19, 2, 3)):
            below.append(short_pair(10_000 + len(below), shared, a, b))
    rows = [(2 * i + k, t) for i, p in enumerate(above + below + longer) for k, t in enumerate(p)]
    got = {r.doc_id: r.component for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(above) + len(below) + len(longer))]
    assert sum(linked[: len(above)]) >= 0.99 * len(above)
    assert not any(linked[len(above) : len(above) + len(below)])
    assert sum(linked[-len(longer) :]) >= 0.9 * len(longer)


def test_marks_stand_where_secrets_were(spark):
    rng = random.Random(6)
    bits = ["password = hunter2x", "é plain words", "AKIA" + "A1B2" * 5, "0123456789abcdef" * 2, "token:0123456789abcdef0123456789abcdef", " \n", "𝄞" * 1030, "api_key=abcdefg,", "x" * 700]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 14)))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.secret_spans for r in secrets.scan(df).collect()}
    for r in secrets.redact(df).collect():
        text = dict(rows)[r.doc_id]
        if text is None:
            assert r.text is None
            continue
        out, at = "", 0
        for s in sorted((x["start"], x["end"]) for x in spans[r.doc_id]):
            if s[0] >= at:
                out += text[at : s[0]] + "[SECRET]"
            at = max(at, s[1])
        assert r.text == out + text[at:]


def test_redact_takes_time_with_the_text_alone(spark):
    """50,000 secrets in one text; ten times the secrets take about ten times as long."""

    def seconds(n: int) -> float:
        df = spark.createDataFrame([(1, "token=abcdefgh " * n)], "doc_id long, text string")
        scanned = secrets.scan(df, out_col="found").cache()
        scanned.count()
        began = time.time()
        got = secrets.redact(df).first().text
        assert got == "[SECRET] " * n
        return time.time() - began

    seconds(100)
    few, many = seconds(5_000), seconds(50_000)
    assert many < 25 * max(few, 0.4)


@pytest.mark.parametrize("ids", ["one", "null", "own"])
def test_the_sample_is_bounded_whatever_the_ids(spark, ids, monkeypatch):
    parts = {"en": "the and of ing tion".split(), "de": "der und sch keit ung".split()}
    rng = random.Random(2)
    rows = [({"one": 2, "null": None, "own": i}[ids], " ".join(rng.choices(parts[lang], k=12)), lang) for i in range(3000) for lang in parts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    total = spark.sparkContext.accumulator(0)
    plain = langid.counts

    def counting(*a):
        total.add(1)
        return plain(*a)

    monkeypatch.setattr(langid, "counts", counting)
    model = langid.fit(df, per_language=300)
    monkeypatch.undo()
    assert 450 <= total.value <= 750
    said = langid.predict(df.withColumn("row", F.monotonically_increasing_id()), model, keep=("row", "lang"))
    assert said.filter("lang = lang_pred").count() > 0.99 * len(rows)
    if ids != "null":
        whole = df.withColumn("doc_id", F.lit(3).cast("long")) if ids == "one" else df
        assert langid.keep_known(whole).count() > 0.99 * whole.count()


def test_copies_are_learned_once(spark):
    rows = [(i, "der und sch keit", "de") for i in range(5000)] + [(i, f"the and of ing tion {i}", "en") for i in range(50)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert model.languages == ["de", "en"] and model.predict("der und sch keit")[0] == "de"
