"""The error-correcting codes against a plain version: classifiers, margins, losses, scores and the flag."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from strikeplane.llm import langid


def grams(text, buckets):
    words = re.sub(rb"[^a-z\x80-\xff]", b" ", text.encode().lower()).split()
    raw = b" " + b" ".join(words) + b" "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for c in raw[i : i + n]:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
            out[(h ^ h >> 15) % buckets] += 1
    return out


def plain(train, texts, buckets=1 << 14, sharpness=3.0, least_lead=0.5):
    languages = sorted({lang for _, lang in train})
    n_bits = 2 ** (len(languages) - 1) - 1
    # bit j splits the first language's side from the rest: every split once
    code = [[1] * n_bits] + [[(j >> (len(languages) - 2 - k)) & 1 for j in range(n_bits)] for k in range(len(languages) - 1)]
    share = []
    for lang in languages:
        total = Counter()
        for text, own in train:
            if own == lang:
                g = grams(text, buckets)
                for b, n in g.items():
                    total[b] += n / math.sqrt(max(1, sum(g.values())))
        row = [round(total[b], 6) + 0.5 / buckets for b in range(buckets)]
        share.append([x / sum(row) for x in row])
    weights, quality = [], []
    for j in range(n_bits):
        one = [s for s, c in zip(share, code) if c[j]]
        rest = [s for s, c in zip(share, code) if not c[j]]
        w = [math.log(sum(s[b] for s in one) / len(one)) - math.log(sum(s[b] for s in rest) / len(rest)) for b in range(buckets)]
        weights.append(w)
        quality.append(max(1e-3, min((1 if c[j] else -1) * sum(x * y for x, y in zip(s, w)) for s, c in zip(share, code))))
    mean = sum(quality) / len(quality)
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append((langid.UNDETERMINED, 0.0, True))
            continue
        g = grams(text, buckets)
        margin = [sharpness * sum(n * w[b] for b, n in g.items()) / sum(g.values()) for w in weights]
        loss = [sum(math.log1p(math.exp(-m * (1 if c[j] else -1))) * quality[j] / mean for j, m in enumerate(margin)) for c in code]
        order = sorted(range(len(loss)), key=loss.__getitem__)
        out.append((languages[order[0]], 1 / sum(math.exp(loss[order[0]] - x) for x in loss), loss[order[1]] - loss[order[0]] < least_lead))
    return out


def test_predictions_equal_a_plain_version(spark):
    rng = random.Random(3)
    parts = {"en": "the and of ing tion".split(), "de": "der und sch keit ung".split(), "fr": "le et que eau é".split()}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))
    train = [(make(lang, rng.randint(3, 30)), lang) for lang in parts for _ in range(30)]
    texts = [make(rng.choice("en de fr".split()), rng.randint(1, 9)) for _ in range(40)] + [make("en", 4) + " " + make("de", 4) for _ in range(10)] + [None, "", "12 !!", "x", "É", "日本"]
    model = langid.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    want = plain(train, texts)
    assert any(w[2] for w in want[:50]) and not all(w[2] for w in want[:50])
    for i, (lang, score, ambiguous) in enumerate(want):
        assert (got[i].lang_pred, got[i].ambiguous) == (lang, ambiguous)
        assert got[i].score == pytest.approx(score, rel=1e-6)


def test_kept_documents_have_their_own_columns(spark):
    rows = [(i, "the and of the tion " * 5 if i % 2 else "der und sch keit ung " * 5, "en" if i % 2 else "de", 0.5, "x") for i in range(40)] + [(90, "1 2", "en", 0.1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {0.5} and kept.count() == 40
