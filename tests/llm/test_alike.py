"""Near copies of the pipeline: by exact similarity of shingles, right at the bound."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strikeplane.llm import simhash
from strikeplane.llm.components import components


def edited(i: int, new: int, total: int = 204) -> tuple[str, str]:
    """Two texts of total words, whose last `new` words differ: of total - 4 shingles each, all but `new` are shared."""
    words = [f"w{i}x{j}" for j in range(total)]
    return " ".join(words), " ".join(words[: total - new] + [f"v{i}x{j}" for j in range(new)])


def similarity(new: int, total: int = 204) -> float:
    return (total - 4 - new) / (total - 4 + new)


def linked(spark, pairs: list[tuple[str, str]]) -> list[bool]:
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r.doc_id: r.component for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]


def test_pairs_right_above_the_bound_are_linked_and_right_below_are_not(spark):
    above = [edited(i, 17 + i % 6) for i in range(200)]
    below = [edited(1000 + i, 23 + i % 6) for i in range(200)]
    assert {round(similarity(17 + i), 2) for i in range(6)} == {0.84, 0.83, 0.82, 0.81, 0.80} and similarity(22) >= 0.8 > similarity(23)
    got = linked(spark, above + below)
    assert sum(got[:200]) >= 185
    assert not any(got[200:])


@pytest.mark.parametrize("nodes", [200, 1 << 18, 1 << 24, 1 << 35])
def test_pairs_at_the_bound_share_a_block_at_every_size(nodes):
    """Block lengths and numbers of large corpora, on pairs at similarity 0.8: about 95 in a hundred meet."""
    bits, blocks = simhash.block_plan(nodes, 0.8)
    rng = np.random.default_rng(nodes % 1000)
    sets = rng.integers(0, 2**63, (300, 220), dtype=np.uint64)
    prints = [np.stack([simhash.wide_fingerprint(x[cut]) for x in sets]) for cut in (slice(0, 198), slice(22, 220))]  # 176 of 220 shared
    a, b = (simhash.block_keys(p, bits, blocks, 42) for p in prints)
    assert (a == b).any(axis=1).mean() >= 0.93
    stranger = simhash.block_keys(prints[0][::-1].copy(), bits, blocks, 42)
    assert (a == stranger).mean() < 4 * 2.0**-bits + 1e-4


def test_a_much_repeated_line_decides_nothing(spark):
    line = "\n".join(["one line that comes again and again"] * 300)
    own = [" ".join(f"a{i}x{j}" for j in range(60)) for i in range(2)]
    assert linked(spark, [(f"{own[0]}\n{line}", f"{own[1]}\n{line}")]) == [False]


@pytest.mark.parametrize("split_above", [150, 2_000_000])
def test_links_connect_what_all_pairs_connect(spark, split_above):
    rng = random.Random(4)
    sets = []
    for label in range(3):
        base = rng.sample(range(1000), 40)
        for _ in range(40):  # walks away from the base by small steps: chains
            base = base[rng.randint(0, 4) :] + rng.sample(range(1000, 3000), rng.randint(0, 4))
            sets.append((label, sorted(set(base))))
    members = spark.createDataFrame([(label, i, len(x)) for i, (label, x) in enumerate(sets)], "label long, node long, n long")
    hashes = spark.createDataFrame([(i, bytearray(np.array(x, dtype="<u8").tobytes())) for i, (_, x) in enumerate(sets)], "row long, hashes binary")
    edges = simhash.jaccard_links(members, hashes, 0.8, split_above)
    found = {r.node: r.label for r in components(edges).collect()}
    root = list(range(len(sets)))
    for i, (la, a) in enumerate(sets):
        for j, (lb, b) in enumerate(sets[:i]):
            if la == lb and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert [found.get(i, i) for i in range(len(sets))] == root
    assert 3 < len(set(root)) < len(sets)
