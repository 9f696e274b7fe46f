import random

import numpy as np
import pytest

from corpusmill.llm import neardups as N


def _weighted(a: dict, b: dict) -> float:
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


@pytest.mark.parametrize("weights", [(1, 1), (1, 5), (3, 40)])
def test_signatures_estimate_weighted_jaccard(weights):
    rng = np.random.default_rng(0)
    low, high = weights
    bags = []
    for shared in (0, 20, 60):
        a = {i: int(rng.integers(low, high + 1)) for i in range(60)}
        b = {i if i < shared else i + 1000: a[i] if i % 2 else int(rng.integers(low, high + 1)) for i in range(60)}
        bags += [a, b]
    row = np.concatenate([np.full(len(b), i) for i, b in enumerate(bags)])
    e = N.mix64(np.concatenate([np.array(list(b), np.uint64) for b in bags]) + np.uint64(1))
    w = np.concatenate([np.array(list(b.values()), float) for b in bags])
    m = 4096
    sig = N.bag_minhash(row, e, w, len(bags), m)
    for i in range(0, len(bags), 2):
        true = _weighted(bags[i], bags[i + 1])
        assert abs((sig[i] == sig[i + 1]).mean() - true) < 4 * np.sqrt(0.25 / m)


def test_signature_is_order_free_and_empty_row():
    e = N.mix64(np.arange(1, 9, dtype=np.uint64))
    a = N.bag_minhash(np.zeros(8, int), e, np.ones(8), 2, 32)
    b = N.bag_minhash(np.zeros(8, int), e[::-1].copy(), np.ones(8), 2, 32)
    assert (a == b).all() and (a[1] == np.iinfo(np.uint64).max).all()


def _texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    out, key = {}, 0
    for _ in range(40):
        base = rng.choices(vocab, k=rng.randint(25, 120))
        out[key] = " ".join(base)
        for edits in (1, 3, 12):
            x = list(base)
            for _ in range(edits):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            key += 1
            out[key] = " ".join(x)
        key += 1
    out[key] = out[0]
    out[key + 1] = out[0]
    return out


def _sets(t, n):
    w = t.lower().split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize(("threshold", "size", "multiset", "bands", "rows"), [(0.5, 3, False, 42, 3), (0.8, 5, True, 16, 8)])
def test_links_equal_brute_force(spark, threshold, size, multiset, bands, rows):
    texts = _texts()
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(900, None, 1), (901, "", 1), (902, "short", 1)], "doc_id long, text string, band int")
    found = N.near_duplicates(df, threshold, size, 20, bands, rows, multiset)
    pairs = [(r["doc_id_a"], r["doc_id_b"]) for r in N.expand(*found).collect()]
    got = {(r["doc_id_a"], r["doc_id_b"]): r["similarity"] for r in N.expand(*found).collect()}
    assert len(pairs) == len(set(pairs))
    want = {}
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = _sets(texts[a], size), _sets(texts[b], size)
            if multiset:
                s = _weighted({k: x.count(k) for k in set(x)}, {k: y.count(k) for k in set(y)})
            else:
                s = len(set(x) & set(y)) / len(set(x) | set(y))
            if s >= threshold:
                want[a, b] = s
    missed = set(want) - set(got)
    assert not set(got) - set(want) and len(missed) <= (0 if size == 3 else len(want) * 0.05)
    assert all(got[p] is None or abs(got[p] - want[p]) < 1e-9 for p in got)


def test_default_bands_lose_no_pair_at_the_threshold(spark):
    """300 pairs of 94 runs, 84 of them shared: a similarity of 84 / 104 = 0.808."""
    rows = []
    for i in range(300):
        t = [f"p{i}w{j}" for j in range(98)]
        rows += [(2 * i, " ".join(t), 1), (2 * i + 1, " ".join(t[:88] + [f"q{i}w{j}" for j in range(10)]), 1)]
    links, _, _ = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, band int"))
    got = {(r["key_a"], r["key_b"]): r["similarity"] for r in links.collect()}
    assert set(got) == {(2 * i, 2 * i + 1) for i in range(300)}
    assert all(abs(s - 84 / 104) < 1e-9 for s in got.values())


def test_classes_and_repeats(spark):
    t = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (2, t), (3, t + " end"), (3, t + " end"), (4, "other " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in N.duplicate_classes(*N.near_duplicates(df)).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (1, 1, 1), 4: (4, 0, 1)}


def test_short_and_blank_texts_have_classes(spark):
    t = " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(1, "two words"), (2, "two words"), (3, "one"), (4, None), (5, ""), (6, " \t"), (7, " \t"), (8, t), (9, t + " end")], "doc_id long, text string")
    found = N.near_duplicates(df)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in N.duplicate_classes(*found, docs=df).collect()}
    assert got == {1: (1, 0, 2), 2: (1, 0, 2), **{i: (i, 0, 1) for i in (3, 4, 5, 6, 7)}, 8: (8, 1, 1), 9: (8, 1, 1)}
    assert {tuple(r) for r in N.near_duplicates(df, min_words=2)[1].collect()} == {(1, 1), (1, 2), (8, 8), (9, 9)}


def test_hot_copies_and_empty(spark):
    t = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(i, t if i % 3 == 0 else f"{t} {i} " + " ".join(f"q{i}_{j}" for j in range(40))) for i in range(90)], "doc_id long, text string")
    links, copies, _ = N.near_duplicates(df, 0.5, 3, 20, 42, 3, False)
    assert links.count() == 0 and copies.filter("rep = 0").count() == 30
    found = N.near_duplicates(df.limit(0))
    assert [x.count() for x in found] == [0, 0, 0] and N.duplicate_classes(*found).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_many_near_copies_of_one_text(spark, monkeypatch, block):
    """Near copies of one text: every link counts, but pairs inside a ball are not listed."""
    monkeypatch.setattr(N, "BLOCK", block)
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"x{i}", *base[i % 190 + 1 + (i % 3 == 0) * 5 :]]), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, band int")
    links, copies, balls = N.near_duplicates(df)
    sets = {k: set(_sets(t, 5)) for k, t, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in N.expand(links, copies, balls).collect()]
    assert set(got) == want and len(got) == len(want)
    assert links.count() < len(want) / 2
    n = {r["doc_id"]: r["n_links"] for r in N.duplicate_classes(links, copies, balls).collect()}
    assert n == {k: sum(k in p for p in want) for k in sets}


def test_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 5)
    df = spark.createDataFrame([(g, i) for g, n in ((1, 23), (2, 1), (3, 5)) for i in range(n)], "g long, k long")
    got = sorted(map(tuple, N.block_pairs(df, "g", "k").collect()))
    assert got == sorted((g, a, b) for g, n in ((1, 23), (2, 1), (3, 5)) for a in range(n) for b in range(a + 1, n))
