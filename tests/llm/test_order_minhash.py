import random

import pyarrow as pa
import pytest

from pulsegrid.llm import order_minhash
from pulsegrid.llm.components import components

SCHEMA = "doc_id long, text string, node string, first string"


def brute(rows):
    """doc_id -> smallest doc_id of its class, from all pairs."""
    grams = list(order_minhash.shingles(pa.array([r[1] for r in rows], pa.string())))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if order_minhash.similar(grams[i], grams[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], least[root(i)]) for i, r in enumerate(rows))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_similar_is_the_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 40))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(30))
        if not b:
            continue
        common = lcs(a, b)
        want = common / (len(a) + len(b) - common) >= 0.8 - 1e-12
        import numpy as np

        assert order_minhash.similar(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == want


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"w{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"w{rng.randrange(10**6)}")
        elif len(words) > 20:
            del words[at]
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(90)]
    passage = [f"p{rng.randrange(10**6)}" for _ in range(40)]
    texts = [edited(rng, base, rng.randrange(8)) for _ in range(60)]
    texts += [edited(rng, rng.choice(texts), rng.randrange(4)) for _ in range(60)]
    # a passage that many otherwise different texts share
    texts += [[f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))] + passage for _ in range(60)]
    texts += [base] * 20
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "x", "y") for i, t in enumerate(texts)]
    got = order_minhash.near_classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_a_shared_passage_brings_no_pairs_together(spark, monkeypatch):
    """Of many texts that share a passage, two thirds of each, no pair is compared beyond the leaders' own."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([*passage, *(f"u{i}x{k}" for k in range(rng.randrange(25, 35)))]), "x", "y") for i in range(400)]
    met, verified = [], []
    meeting, check = order_minhash._meeting, order_minhash._verified
    monkeypatch.setattr(order_minhash, "_meeting", lambda ranked: met.append(meeting(ranked)) or met[-1])
    monkeypatch.setattr(order_minhash, "_verified", lambda pairs, texts: verified.append(pairs.count()) or check(pairs, texts))
    got = order_minhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(400)]
    assert verified[0] <= order_minhash.SKETCHES * 400 and sum(verified[1:]) == 0 and len(met) == 1


def test_edge_cases(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [
        (1, None, "n", "f"), (2, "", "n", "f"), (3, " \t\n", "n", "f"), (4, "a b c", "n", None), (5, "A  b c", None, "f"),
        (6, "a b c d", "n", "f"), (7, long, "n", "f"), (8, long + " tail", "n", "f"), (9, "same words here in both texts", "n", "f"),
        (9, "Same words here in both texts", "n", "f"), (None, long, "n", "f"),
    ]
    got = order_minhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 9), (9, 9), (None, 7)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert order_minhash.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_first_of_each_keeps_columns(spark):
    rows = [(1, "one two three four five six", "n", "a"), (0, "one two three four five six", "n", "b"), (3, "x", "n", "c")]
    kept = order_minhash.first_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "node", "first"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (500, 501), (501, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 500: 500, 501: 500}
