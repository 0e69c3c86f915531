"""Near copies: planted pairs among documents that share boilerplate, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripstrata.llm import near


def boilerplate(rng, pairs, part, words=200):
    """`pairs` documents that share `part` of their words as one passage, and a copy of each with some words changed."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    shared = [word() for _ in range(int(words * part))]
    out = []
    for i in range(pairs):
        own = [word() for _ in range(words - len(shared))]
        text = shared + own
        copy = list(text)
        while True:
            copy[rng.randrange(len(shared), words)] = word()
            now = near.shingles(" ".join(copy))
            one = near.shingles(" ".join(text))
            common = len(np.intersect1d(one, now))
            alike = common / (len(one) + len(now) - common)
            if alike < 0.84:
                break
        if alike < 0.8:
            copy, alike = list(text), 1
            copy[-4:] = [word() for _ in range(4)]
            copy[len(shared)] = word()
        out += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    return out


@pytest.mark.parametrize("part", [0.3, 0.5, 0.7])
def test_near_copies_in_boilerplate_are_found(spark, docs, part):
    """Pairs of a similarity of 0.80 to 0.84, or a little more, all of whose buckets are filled by a passage that all documents share."""
    rng = random.Random(int(part * 10))
    rows = boilerplate(rng, 300, part)
    numbered = docs(*rows).repartition(4).withColumn("n", F.col("doc_id"))
    gone = {r["row"] for r in near.near_copies(numbered, "n").collect()}
    assert gone <= {2 * i + 1 for i in range(300)} and len(gone) >= 297


def test_near_copies_odd(spark, docs, odd):
    numbered = docs(*odd).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    place = {r["n"]: (r["doc_id"], r["text"]) for r in numbered.collect()}
    gone = [place[r["row"]] for r in near.near_copies(numbered, "n").collect()]
    # one of the four texts without words stays, and one of the repeated rows
    assert sorted(gone, key=str) == sorted([(2, ""), (3, " \t\n"), (None, None), (4, "a")], key=str)
    assert near.near_copies(docs().withColumn("n", F.col("doc_id")), "n").collect() == []


def alike(one, two):
    common = len(np.intersect1d(one, two))
    return common / (len(one) + len(two) - common)


def test_prefix_join_finds_all_pairs_of_two_components(spark, docs):
    """Sets of many lengths over few and many common shingles: no pair of the wanted similarity is lost, and linked copies don't meet."""
    rng = np.random.default_rng(3)
    base = [rng.integers(-(1 << 62), 1 << 62, 60) for _ in range(4)]
    sets = []
    for i in range(160):
        of = base[i % 4]
        kept = of[rng.random(len(of)) < rng.choice([0.8, 0.9, 0.97, 1.0])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 8))])))
    group = [i if i % 3 else 0 for i in range(160)]
    held = spark.createDataFrame([(i, group[i], x.tolist()) for i, x in enumerate(sets)], "id long, component long, set array<long>").repartition(3)
    with near.Scratch(spark) as s:
        met = {(r["a"], r["b"]) for r in near.rest_pairs(held, s, 0.8).collect()}
    wanted = {(i, j) for i in range(160) for j in range(i + 1, 160) if group[i] != group[j] and alike(sets[i], sets[j]) >= 0.8}
    assert len(wanted) > 500 and wanted <= met
    assert not any(group[i] == group[j] for i, j in met)


def test_large_buckets_lose_no_pair(spark, docs, monkeypatch):
    """300 planted pairs all of whose buckets count as large, with one pivot: what the pivots don't link the prefix join does."""
    monkeypatch.setattr(near, "PIVOTS", 1)
    found = near.candidates
    monkeypatch.setattr(near, "candidates", lambda nodes, s: found(nodes, s, 1, near.BANDS - 1))
    rows = boilerplate(random.Random(11), 300, 0.7)
    gone = {r["row"] for r in near.near_copies(docs(*rows).withColumn("n", F.col("doc_id")), "n").collect()}
    assert gone == {2 * i + 1 for i in range(300)}


def test_simhash_alone_finds_close_copies(spark, docs, monkeypatch):
    """With the MinHash candidates taken away, copies within 2 bits are still dropped: one changed word in long texts; far ones stay."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(40):
        base = [word() for _ in range(1500)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join([*base[:-1], word()])), (3 * i + 2, " ".join(word() for _ in range(50)))]
    print_of = {d: near.fingerprint(t) for d, t in rows}
    close = {3 * i + 1 for i in range(40) if (print_of[3 * i] ^ print_of[3 * i + 1]).bit_count() <= 2}
    found = near.candidates

    def none(nodes, s):
        pairs, rest = found(nodes, s)
        return pairs.where("false"), rest.where("false")

    monkeypatch.setattr(near, "candidates", none)
    gone = {r["row"] for r in near.near_copies(docs(*rows).withColumn("n", F.col("doc_id")), "n").collect()}
    assert len(close) > 20 and gone == close
