"""Prefix trie, Jaccard join and collocations against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeplane.llm import jaccard, parts, phrases, trie
from strikeplane.llm.shared import bitmap, in_bitmap

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# the trie


def plain_nodes(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[conv].append((turn is not None, turn or 0, key, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(convs.get(c - c % 20, [])[:h] + v[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, s in made.items():
        for i in range(len(s) + 1):
            members[s[:i]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats():
    rng = random.Random(5)
    rows = [(None, 0, "user", "no conversation"), (41, None, None, "first"), (41, None, "user", None), (41, 2, "user", "twice"), (41, 2, "user", "twice"), (7, 0, "user", "x" * 50_000)]
    for c in range(100, 220):
        for t in range(rng.randrange(0, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {rng.randrange(2)}" if c % 3 else f"{'deep ' * (t + 1)}"))
    rows += [(c, t, "user", "the same") for c in range(300, 340) for t in range(5)]
    return rows


@pytest.mark.parametrize("split_above", [200_000, 40, 3])
def test_trie(spark, split_above):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    got = trie.prefix_nodes(trie.with_shared_heads(trie.turns_in_order(df)), split_above)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_nodes(rows)
    none = trie.prefix_nodes(trie.with_shared_heads(trie.turns_in_order(df.limit(0))), split_above)
    assert none.count() == 0 and none.columns == got.columns


def test_double_array_holds_its_sequences():
    rng = random.Random(2)
    sequences = [[rng.randrange(1, 60) for _ in range(rng.randrange(0, 7))] for _ in range(400)] + [[i] for i in range(1, 300)]
    made = trie.DoubleArray(sequences)
    prefixes = {tuple(s[:i]) for s in sequences for i in range(len(s) + 1)}
    assert len(made.order) == len(set(made.order)) == len(prefixes)
    ends = {}
    for p in prefixes:
        states = list(made.walk(list(p)))
        assert len(states) == len(p) + 1
        assert ends.setdefault(states[-1], p) == p
        missing = next(c for c in range(1, 400) if (*p, c) not in prefixes)
        assert made.child(states[-1], missing) == -1


# the Jaccard join


def plain_components(rows, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(lowered(text))
        sets.append(frozenset(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in at[x])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for x in s:
            at[x].append(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for m in groups.values():
        least = min((rows[i][0] for i in m if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least) for i in m]
    return sorted(out, key=str)


def near_texts():
    rng = random.Random(1)
    words, rows = [f"w{i}" for i in range(2000)], []
    for n in (2, 5, 9, 10, 11, 13, 17, 30, 60, 150):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            for _ in range(8):
                w = list(base)
                for _ in range(rng.randrange(0, n // 30 + 2)):
                    w[rng.randrange(n)] = rng.choice(words)
                rows.append((len(rows), " ".join(w + [rng.choice(words) for _ in range(rng.choice([0, 0, 1, n // 9]))])))
    shared = " ".join(rng.choice(words) for _ in range(70))
    rows += [(len(rows) + i, f"{shared} {' '.join(rng.choice(words) for _ in range(120))}") for i in range(40)]  # a shared passage links nobody
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(60):  # each close to the next, the ends are not
        chain = chain[1:] + [rng.choice(words)]
        rows.append((5000 - i, " ".join(chain)))
    return rows + [(7000, None), (7001, ""), (7002, " \n"), (None, "a b"), (None, "a b"), (7003, "A  b"), (7004, "lone"), (7003, "lone"), (7005, "deep " * 60_000)]


@pytest.mark.parametrize("split_above,percent", [(2_000_000, 90), (900, 90), (900, 80)])
def test_similarity_join_is_exact(spark, split_above, percent):
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("n", F.lit(3)).repartition(5)
    got = jaccard.similarity_join(df, percent=percent, split_above=split_above)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_components(rows, percent)
    if split_above == 900 and percent == 90:
        assert jaccard.similarity_join(df.limit(0)).count() == 0


def test_close_sets_share_a_projected_region():
    rng, radius = np.random.default_rng(3), parts.Radius(90)
    for _ in range(600):
        n = int(rng.integers(9, 130))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        most = radius.differing(len(a))
        gone = int(rng.integers(0, most + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, most - gone, dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(a) != len(b) or shared < len(a):
            close = bool(radius.close(np.array(shared), np.array(len(a) + len(b) - shared)))
            if close:
                assert set(parts.part_keys(a, radius).tolist()) & set(parts.part_keys(b, radius).tolist())


def test_regions_find_what_walking_finds():
    rng, radius = np.random.default_rng(4), parts.Radius(90)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 40, 90, dtype=np.uint64)
        for _ in range(40):
            keep = rng.random(90) > rng.choice([0.0, 0.02, 0.05])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 40, int(rng.integers(0, 5)), dtype=np.uint64)])))
    flat = jaccard.Sets(sets)
    everyone = np.arange(len(sets))

    def grouped(links):
        label = list(range(len(sets)))
        for a, b in links:
            x, y = label[a], label[b]
            label = [x if z == y else z for z in label]
        return {frozenset(np.flatnonzero(np.array(label) == z).tolist()) for z in set(label)}

    close = [(i, j) for i in range(len(sets)) for j in np.flatnonzero(radius.close(*flat.meet(i, everyone))).tolist()]
    assert grouped(jaccard.region_links(flat, everyone, radius, pivots=6, few=5)) == grouped(close) == grouped(jaccard.walk(flat, everyone, radius))


def test_bitmap_knows_all_keys(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 3000)
    words = bitmap(spark.createDataFrame([(int(k),) for k in keys[:1000]], "key long"), "key")
    known = in_bitmap(words, keys)
    assert known[:1000].all() and known[1000:].mean() < 0.05


# collocations


def plain_collocations(rows, least, top, covered=80):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found = {p: x for p, x in c.items() if x >= least and " " in p}
        gone = set()
        for p, x in found.items():
            w = p.split(" ")
            gone |= {q for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * x >= covered * found[q := " ".join(w[i : i + k])]}
        told = []
        for p, a in found.items():
            if p not in gone:
                w = p.split(" ")
                s, _, left, right = min((2_000_000 * a // (c[x] + c[y]), k, c[x], c[y]) for k in range(1, len(w)) for x, y in [(" ".join(w[:k]), " ".join(w[k:]))])
                told.append((-s, -a, p.encode(), (p, a, left, right, n[lang], s)))
        out += [(lang, i + 1, *t[3]) for i, t in enumerate(sorted(told)[:top])]
    return sorted(out)


@pytest.mark.parametrize("every", [1, 3, 1000])
def test_collocations(spark, every):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(12)] + ["É", "été", "zu　m"]
    rows = [("en", " ".join(rng.choices(common, k=rng.randrange(0, 60))).replace("c3 ", "c3. ").replace("c5 c1", "C5\tc1")) for _ in range(120)]
    rows += [("en", "one fixed phrase here; one fixed phrase, one fixed")] * 30 + [(None, "a a a a a a\na b"), (None, None), ("und", "a a"), ("fr", ""), ("de", "run on " * 20_000)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(1)).withColumn("chunk", F.lit("x")).repartition(4)
    got = phrases.collocations(df, least=5, top=150, every=every)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 5, 150)
    if every == 3:
        assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    """Frequencies whose product passes 64 bits give exact scores."""
    a, left, right = 10**13 + 1, 2 * 10**13 + 3, 3 * 10**13 + 7
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    got = df.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 2_000_000 * a // (left + right)


def test_chunks_own_each_start_once():
    rng = random.Random(3)
    for _ in range(200):
        text = " ".join(rng.choice(["a", "bb", "ccc", "d.", "e", "f"]) for _ in range(rng.randrange(0, 40)))
        for every in (1, 2, 5):
            grams = Counter()
            for c in phrases.chunks(text, phrases.Triggers(every)):
                own, _, after = c.partition(b"\t")
                words, n = own.split(b" ") + (after.split(b" ") if after else []), len(own.split(b" "))
                grams.update(tuple(words[i : i + k]) for i in range(n) for k in range(1, 5) if i + k <= len(words))
            want = Counter()
            for piece in text.split("."):
                w = [x.encode() for x in piece.split()]
                want.update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
            assert grams == want
