import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import shared
from corpusmill.operators import annotate as A
from corpusmill.operators import collate as C
from corpusmill.operators import features as L
from corpusmill.operators import graph as G
from corpusmill.operators import network as N
from corpusmill.operators import predict as P
from corpusmill.operators import sampling as S
from corpusmill.operators import scoring as G2
from corpusmill.operators import stats as T
from corpusmill.operators import vectorops as V
from corpusmill.shared import components, ranked


def _tokens(spark, rows):
    """(doc, sent, i, text, pos, dep, head)."""
    by = {(d, i): (t.lower(), p) for d, _, i, t, p, _, _ in rows}
    full = [(d, s, i, 0, t, t.lower(), p, p, dep, h, t.isalpha(), not t.isalnum(), by[d, h][0], by[d, h][1], by[d, h][1]) if (d, h) in by else (d, s, i, 0, t, t.lower(), p, p, dep, h, t.isalpha(), not t.isalnum(), None, None, None) for d, s, i, t, p, dep, h in rows]
    return spark.createDataFrame(full, A.TOKEN_SCHEMA)


DOC = [
    (1, 0, 0, "The", "DET", "det", 1), (1, 0, 1, "dog", "NOUN", "ROOT", 1), (1, 0, 2, "ran", "VERB", "conj", 1), (1, 0, 3, ".", "PUNCT", "punct", 2),
    (1, 1, 4, "However", "ADV", "advmod", 5), (1, 1, 5, "dogs", "NOUN", "ROOT", 5), (1, 1, 6, "dog", "NOUN", "compound", 5),
    (2, 0, 0, "!", "PUNCT", "ROOT", 0),
]


def test_ranks_and_sums_across_partitions(spark):
    rng = random.Random(0)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot"]), i, rng.choice([None, 1, 5])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int, w int").repartition(7)
    by = {}
    for g, k, w in sorted(rows, key=lambda r: r[1]):
        n, s = by.get(g, (0, 0))
        by[g] = (n + 1, s + (w or 0))
        by[g, k] = (n, s)
    got = ranked(df, ["g"], ["k"]).join(ranked(df, ["g"], ["k"], "before", "w").select("k", "before"), "k").collect()
    assert len(got) == 2000 and all((r["rank"], r["before"]) == by[r["g"], r["k"]] for r in got)
    assert ranked(df.limit(0), ["g"], ["k"]).count() == 0
    assert sorted(r["rank"] for r in ranked(df, [], ["k"]).collect()) == list(range(2000))


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 7), (10, 11), (11, 12), (12, 10)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 10: 10, 11: 10, 12: 10, **{100 + i: 100 for i in range(41)}}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(e, "src long, dst long"), most_rounds=2)


def test_chase(spark):
    up = [(i, i - 1) for i in range(1, 40)] + [(100, 7)]
    assert {r["u"]: r["root"] for r in shared.chase(spark.createDataFrame(up, "u long, p long")).collect()} == dict.fromkeys([*range(1, 40), 100], 0)
    with pytest.raises(RuntimeError):
        shared.chase(spark.createDataFrame([(1, 2), (2, 1)], "u long, p long"), 5)


def test_spanning_forest(spark):
    rng = random.Random(2)
    e = [(a, b, rng.choice([0.1, 0.5, 0.9])) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.2] + [(100, 101, 0.3)]
    forest, labels = G.spanning_forest(spark.createDataFrame(e, "a long, b long, w double"))
    rows = forest.collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    best = 0.0
    n = 0
    for a, b, w in sorted(e, key=lambda x: -x[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            best += w
            n += 1
    assert len(rows) == n and sum(r["w"] for r in rows) == pytest.approx(best)
    roots = {r["node"]: r["root"] for r in labels.collect()}
    assert all((roots[a] == roots[b]) == (find(a) == find(b)) for a in roots for b in roots)


def _brute_tree(links, min_rows):
    """Condensed hierarchy by hand: (stability and rows of every node, the node and the similarity each row joins at)."""
    comp, nodes, rows, of, kids = {}, {}, {}, {}, {}
    for a, b, w in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        x, y = (comp.setdefault(k, frozenset([k])) for k in (a, b))
        if x is y:
            continue
        z, lam = x | y, 1 / (1 - w)
        big = [c for c in (x, y) if c in of]
        if len(big) == 2:
            new = (len(nodes), "n")
            nodes[new] = []
            for c in (x, y):
                kids[of[c]] = (new, w)
                nodes[of[c]].append((len(c), lam))
            nodes[new].append((-len(z), lam))
        elif big or len(z) >= min_rows:
            new = of[big[0]] if big else (len(nodes), "n")
            nodes.setdefault(new, [])
            for k in z - (big[0] if big else frozenset()):
                rows[k] = (new, w)
                nodes[new].append((-1, lam))
        else:
            new = None
        if new:
            of[z] = new
        for k in z:
            comp[k] = z
    end = 1 / (1 - min(w for _, _, w in links))
    for c in set(comp.values()):
        if c in of:
            nodes[of[c]].append((len(c), end))
    return {n: -sum(k * lam for k, lam in v) for n, v in nodes.items()}, rows, kids


@pytest.mark.parametrize("range_links", [1000, 40])
def test_condensed_hierarchy_equals_brute_force(spark, range_links):
    rng = random.Random(4)
    pts = [rng.gauss(c, 0.4 + 0.2 * (c % 3)) for c in (0, 5, 7, 20) for _ in range(16)] + [rng.uniform(-5, 30) for _ in range(25)]
    n = len(pts)
    order = sorted(range(n), key=pts.__getitem__)
    links = [(min(i, j), max(i, j), 1 - abs(pts[i] - pts[j]) / 40) for i, j in zip(order, order[1:])]
    stability, rows, kids = _brute_tree(links, 5)
    df = spark.createDataFrame(links, "a long, b long, w double")
    nodes, entered = G.condense(df, 5, range_links)
    got = nodes.collect()
    assert sorted(round(r["stability"], 6) for r in got) == sorted(round(s, 6) for s in stability.values())
    assert {r["key"]: round(r["w"], 9) for r in entered.collect()} == {k: round(w, 9) for k, (_, w) in rows.items()}
    assert len([r for r in got if r["parent"] is None]) == len(stability) - len(kids)
    # cut at one similarity: the components of the links above it
    for least in (0.9, 0.99):
        comp = {r["node"]: r["component"] for r in components(df.filter(F.col("w") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"))).collect()}
        size = {c: list(comp.values()).count(c) for c in comp.values()}
        want = {k: c for k, c in comp.items() if size[c] >= 5}
        assert {r["key"]: r["cluster_id"] for r in G.clusters_at(nodes, entered, least).collect()} == want
    # excess of mass: a node counts if it is stabler than the best below it
    def best(node):
        below = [k for k, (p, _) in kids.items() if p == node]
        sub = [best(k) for k in below]
        most = sum(s for s, _ in sub)
        return (stability[node], [node]) if stability[node] >= most or not below else (most, sum((c for _, c in sub), []))

    chosen = sum((best(r)[1] for r in stability if r not in kids), [])
    members, clusters = G.condensed_clusters(df, 5, range_links=range_links)
    assert sorted(round(r["stability"], 6) for r in clusters.collect()) == sorted(round(stability[c], 6) for c in chosen)
    leaf = G.condensed_clusters(df, 5, "leaf", range_links)[1]
    assert leaf.count() == len([x for x in stability if x not in {p for p, _ in kids.values()}])
    assert G.condensed_clusters(df.limit(0))[0].count() == 0


def test_ngrams(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    assert sorted(map(tuple, C.ngrams(df, 3).collect())) == [("#", "#", "a"), ("#", "a", "b")]
    docs = spark.createDataFrame([("x y x y z!",), ("x",)], "text string")
    assert C.ngrams(docs, 2).count() == C.ngrams(docs, 1).count() == 7
    assert {tuple(r) for r in C.ngram_counts(docs, 2, 2).collect()} == {("x", "y", 2), ("#", "x", 2)}


def test_partials_equal_whole(spark):
    g = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1), ("b", 1), ("c", 1)], "t string, count long")
    assert {tuple(r) for r in C.merge_partials(g, ["t"], 2).collect()} == {("a", 3), ("b", 2)}


def test_annotator():
    rows = A.RuleAnnotator().annotate("The big dogs quickly chased 3 cats. Ok!\n\nYes")
    assert [r[3] for r in rows] == ["The", "big", "dogs", "quickly", "chased", "3", "cats", "Ok", "Yes"]
    assert [r[0] for r in rows] == [0] * 7 + [1, 2]
    by = {r[3]: r for r in rows}
    assert by["The"][7] == "ROOT" and by["big"][5] == "NOUN" and by["chased"][6] == "VBD" and by["3"][7] == "nummod"
    text = "The big dogs quickly chased 3 cats. Ok!\n\nYes"
    assert all(text[r[2] : r[2] + len(r[3])] == r[3] for r in rows)
    assert A.RuleAnnotator().annotate("...") == [] and A.RuleAnnotator().annotate("a, b")[1][7:9] == ("punct", 0)


def test_features(spark):
    t = _tokens(spark, DOC)
    f = {r["doc_id"]: r for r in L.basic_features(t).collect()}
    one = f[1]
    assert one["lexical_density"] == 5 / 6 and one["mean_word_length"] == pytest.approx((3 + 3 + 3 + 7 + 4 + 3) / 6)
    assert one["words_per_sentence"] == 3.0 and one["clauses_per_tunit"] == 1.0 and one["connective_density"] == 0.5
    assert one["mean_dep_distance"] == pytest.approx((1 + 1 + 1 + 1 + 1) / 5)
    assert f[2]["lexical_density"] is None and f[2]["mean_dep_distance"] is None
    m = {r["doc_id"]: r["mod_per_nom"] for r in L.modifiers_per_nominal(t).collect()}
    assert m == {1: 2 / 3, 2: None}
    o = {r["doc_id"]: r["content_word_overlap"] for r in L.content_overlap(t).collect()}
    assert o == {1: 1 / 4, 2: None}


def test_overlap_of_empty_sentences(spark):
    rows = [(1, 0, 0, "x", "NOUN", "ROOT", 0), (1, 0, 1, "y", "NOUN", "pobj", 0), (1, 1, 2, "y", "NOUN", "ROOT", 2), (1, 1, 3, "z", "NOUN", "pobj", 2), (1, 2, 4, "!", "PUNCT", "ROOT", 4), (1, 3, 5, "!", "PUNCT", "ROOT", 5)]
    assert L.content_overlap(_tokens(spark, rows)).first()["content_word_overlap"] == pytest.approx((1 / 3 + 0 + 0) / 3)


def test_mutual_information(spark):
    grams = spark.createDataFrame([("h", "d", "amod", 4), ("h", "x", "dobj", 4), ("y", "d", "nsubj", 4), ("y", "x", "prep", 52)], "head_lemma string, dependent_lemma string, relation string, count long")
    pairs = spark.createDataFrame([(1, "amod", "h", "d"), (1, "amod", "h", "d"), (1, "advmod", "no", "hit"), (2, "dobj", "h", "zz")], "doc_id long, relation string, head_lemma string, dependent_lemma string")
    got = {r["doc_id"]: r for r in L.association(pairs, grams).collect()}
    assert set(got) == {1} and got[1]["amod_mi"] == 2.0 and got[1]["dobj_mi"] is None


def test_mtld():
    assert L.mtld_of(["a"] * 9) is None
    words = ["a", "b"] * 10
    # every third word closes a factor: a b a -> 2/3
    assert L.mtld_of(words) == pytest.approx(20 / (6 + 0 / 0.28), rel=1e-9)
    assert L.mtld_of([str(i) for i in range(12)]) == 12.0


def test_frequency_default(spark):
    freq = spark.createDataFrame([("dog", 9), ("the", 1)], "token string, count long")
    got = L.log_frequency(_tokens(spark, DOC[:3]), freq).first()["log_mean_token_freq"]
    assert got == pytest.approx((math.log10(0.1) + math.log10(0.9) + math.log10(0.1)) / 3)


@pytest.mark.parametrize(("n", "centre", "size", "want"), [(10, 0, 4, (0, 4)), (10, 5, 4, (3, 7)), (10, 9, 4, (6, 10)), (10, 5, 1, (5, 6)), (9, 4, 9, (0, 8)), (9, 0, 9, (0, 9)), (10, 9, 3, (8, 10)), (3, 1, 0, (1, 2)), (5, 2, 64, (0, 5))])
def test_centred_window(spark, n, centre, size, want):
    s, e = P.centred_window(F.lit(n), F.lit(centre), size)
    assert tuple(spark.range(1).select(s, e).first()) == want == G2.centred(n, centre, size)


def test_predictability(spark):
    s = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, float("inf")), (2, float("nan")), (2, None)], "doc_id long, loss double")
    got = {r["doc_id"]: r for r in P.doc_predictability(s).collect()}
    assert got[1]["var_loss"] == 2.0 and got[1]["mean_loss"] == 2.0 and got[2]["var_loss"] == 0.0 and 3 not in got
    every = {r["doc_id"]: r for r in P.doc_predictability(s, spark.createDataFrame([(1,), (3,), (4,)], "doc_id long")).collect()}
    assert set(every) == {1, 3, 4} and every[4]["mean_loss"] == float("inf") and every[4]["mean_entropy"] == 0.0 and every[3]["n_tokens"] == 0
    sub = spark.createDataFrame([(1, [0.0, 2.0]), (2, [])], "i int, l array<double>")
    rows = {r["i"]: r for r in P.subword_summary(sub, "l").collect()}
    assert rows[1]["mean_loss"] == 1.0 and rows[2]["mean_loss"] == float("inf") and rows[2]["mean_prob"] == 0.0


def test_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(1, "a b a c a b")], "doc_id long, text string")
    m = P.NgramModel(docs)
    t = spark.createDataFrame([(1, i, w, "a", "b") for i, w in enumerate(["a", "b", "c", "unseen"])], "doc_id long, i int, token string, prev string, prev2 string")
    p = {r["token"]: math.exp(-r["loss"]) for r in m.score(t).collect()}
    assert sum(p.values()) == pytest.approx(1.0)  # the unseen token has the probability kept for all unseen ones


def test_alignment(spark):
    w = spark.createDataFrame([(1, 0, 0), (1, 1, 5), (1, 2, 9)], "doc_id long, i int, char_start int")
    p = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 2, 5), (1, 3, 5), (1, 4, 8)], "doc_id long, sub_i int, char_start int")
    assert sorted(map(tuple, P.align(w, p).select("i", "first", "end").collect())) == [(0, 0, 2), (1, 2, 3)]
    assert P.align(w, p.limit(0)).count() == 0


def _model():
    words = [*G2.SPECIAL, "a", "b", "c"]
    c = np.zeros((8, 8))
    for x, y, n in ((1, 5, 4), (5, 6, 3), (6, 5, 2), (5, 7, 1)):
        c[x, y] = n
    return G2.CountModel(words, G2.follow_table(c, 0.7))


def test_scores_are_those_of_the_model(spark):
    m = _model()
    assert np.allclose(np.exp(m.follow[[0, 1, 5, 6, 7]]).sum(1), 1)
    docs = spark.createDataFrame([(1, "a b a x c"), (2, None), (3, " ")], "doc_id long, text string")
    ids = [5, 6, 5, 0, 7]
    got = {r["i"]: r for r in G2.score(docs, m, "causal", None).collect()}
    assert len(got) == 5 and all(abs(got[i]["loss"] + m.follow[([1, *ids])[i], ids[i]]) < 1e-9 for i in range(5))
    assert {r["i"]: round(r["loss"], 9) for r in G2.score(docs, m, "causal", 2, 2).collect()} == {i: round(r["loss"], 9) for i, r in got.items()}
    assert [r["i"] for r in G2.score(docs, m, "causal", 2, first_window_only=True).collect()] == [0, 1]
    masked = {r["i"]: r for r in G2.score(docs, m, "masked", 64, 2).collect()}
    p = np.exp(m.follow[5]) * np.exp(m.follow[:, 5])
    p[~np.isfinite(p)] = 0
    p /= p.sum()
    assert abs(masked[1]["prob"] - p[6]) < 1e-9 and abs(masked[1]["entropy"] + (p * np.log(p + 1e-10)).sum()) < 1e-9
    with pytest.raises(ValueError):
        G2.score(docs, m, "both")


def test_windows_mask_whole_words_and_pad():
    todo = list(G2.requests([5, 6, 7, 5, 6], [(0, 1), (1, 3), (3, 5)], 4, True))
    assert [(r.word, r.target) for r in todo] == [(0, 5), (1, 6), (1, 7), (2, 5), (2, 6)]
    assert todo[1].ids == [1, 5, 3, 3, 5, 2] and (todo[1].at, todo[2].at) == (2, 3)
    part, ids, attention = next(G2.batches_of(iter(todo[:1] + [G2.Request([1, 2], 0, 5, 0)]), 32))
    assert ids.shape == (2, 6) and list(ids[1, 2:]) == [G2.PADDING] * 4 and list(attention[1]) == [1, 1, 0, 0, 0, 0]


def test_transformation_vectors(spark):
    m, e = _model(), np.random.default_rng(0).standard_normal((8, 3))
    docs = spark.createDataFrame([(1, "a b a c a b")], "doc_id long, text string")
    got = {r["i"]: r for r in G2.transformation_vectors(docs, m, e, 0.0, top=2).collect()}
    p = np.exp(m.follow[5]) * np.exp(m.follow[:, 5])
    p[~np.isfinite(p)] = 0
    best = np.argsort(-p)[:2]
    assert got[1]["delta"] == pytest.approx(p[best] / p[best].sum() @ e[best] - e[6]) and got[1]["left_context"] == "a" and got[1]["top_predicted"][0] == m.words[best[0]]
    assert G2.transformation_vectors(docs, m, e, 1e9).count() == 0


def test_winsorize_and_residuals(spark):
    df = spark.createDataFrame([(i, "g" if i < 3 else None, v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0, None, float("nan")])], "k int, g string, x double")
    v = [r["x"] for r in T.winsorize(df.filter("k in (0, 1, 2, 3)"), ["x"]).orderBy("k").collect()]
    assert v == pytest.approx([1.03, 2, 3, 9.79])
    res = {r["k"]: r["x"] for r in T.residualize(df, ["x"], "g").collect()}
    assert res == {0: -1.0, 1: 0.0, 2: 1.0, 3: 0.0, 4: None, 5: None}


def test_budget(spark):
    d = spark.createDataFrame([("s", i, 10, 100) for i in range(50)], "name string, doc_id long, token_count int, target_tokens long")
    got = S.token_budget(d).collect()
    assert len(got) == 11 and max(r["tokens_before"] for r in got) == 100


def test_rater_mean_and_groups(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 2.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(T.rater_mean(F.col("a"), F.col("b"))).collect()] == [2.0, 2.0, None]
    s = spark.createDataFrame([(2.5,), (2.6,), (4.0,), (None,)], "s double")
    assert [r[0] for r in s.select(T.proficiency(F.col("s"))).collect()] == ["Low", "Mid", "High", None]


def test_graphical_lasso():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5000, 5))
    x[:, 1] += 0.8 * x[:, 0]
    x[:, 3] -= 0.6 * x[:, 2]
    r = np.corrcoef(x.T)
    k, _ = N.lasso_precision(r, 0.0)
    assert np.allclose(k, np.linalg.inv(r), atol=1e-3)
    net = N.partial_correlations(r, 5000)
    assert net[0, 1] > 0.4 and net[2, 3] < -0.3 and abs(net[0, 2]) < 0.05 and np.allclose(net, net.T)
    assert (N.walktrap(net) == [1, 1, 2, 2, 3]).all()


def test_shortest_paths():
    net = np.zeros((4, 4))
    for a, b, w in ((0, 1, 0.5), (1, 2, -0.5), (2, 3, 1.0)):
        net[a, b] = net[b, a] = w
    between, close = N.paths(net)
    assert list(between) == [0, 2, 2, 0] and close[0] == pytest.approx(1 / (2 + 4 + 5))


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "k int, a double, b double, c double")
    m = N.moments(df, ["a", "b", "c"], "k", 1, N.once).first()["m"]
    r, n = N.correlation_of(np.array(m), 3)
    assert n == 300 and np.allclose(r, np.corrcoef(x.T))
    boot = [np.array(v["m"])[0] for v in N.moments(df, ["a", "b", "c"], "k", 200, N.poisson).collect()]
    assert abs(np.mean(boot) - 300) < 5 and abs(np.std(boot) - 300**0.5) < 4


def test_bootstrap_finds_the_edge(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3))
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([(i, "u" if i % 2 else "v", *map(float, r)) for i, r in enumerate(x)], "k int, g string, a double, b double, c double")
    e = {(r["src"], r["dst"]): r for r in N.bootstrap_edges(df, ["a", "b", "c"], "k", 20).collect()}
    assert e["a", "b"]["low"] > 0.4 and e["a", "b"]["kept"] == 1.0 and e["a", "b"]["low"] <= e["a", "b"]["weight"] <= e["a", "b"]["high"]
    p = {r["statistic"]: r["p_value"] for r in N.comparison_test(df, ["a", "b", "c"], "k", "g", "u", "v", 20).collect()}
    assert p["max_difference"] > 0.05


def test_posneg_and_nmf(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0])], "k long, v array<float>")
    assert df.select(V.posneg(F.col("v"))).first()[0] == [1.0, 0.0, 0.0, 2.0]
    rng = np.random.default_rng(0)
    x = rng.random((120, 3)) @ rng.random((3, 6))
    w, h, err = V.nmf(spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)] + [(999, None)], "k long, v array<float>"), "k", "v", 6, 3, 60, 1e-6)
    rows = {r["k"]: r["loadings"] for r in w.collect()}
    assert err < 0.05 and (h >= 0).all() and len(rows) == 120 and min(min(v) for v in rows.values()) >= 0


def test_neighbours_and_labels(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal(8) * 3 + 0.3 * rng.standard_normal((40, 8)) for _ in range(3)])
    df = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "k long, v array<float>")
    knn = V.knn_graph(df, "k", "v", 8, 10, block=50)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in knn.collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    assert all(got[i] == set(np.argsort(-s[i])[:10].tolist()) for i in range(120))
    labels = {r["key"]: r["label"] for r in V.density_labels(knn, 10).collect()}
    assert len(labels) == 120 and all(len({labels[i] for i in range(g, g + 40)} - {-1}) <= 1 for g in (0, 40, 80))
    y = V.layout(V.fuzzy_graph(knn, 10), 2, 3).collect()
    assert len(y) == 120 and all(np.isfinite(r["y"]).all() for r in y)


def test_dependency_pairs_equal_the_join(spark):
    docs = spark.createDataFrame([(1, "The big dogs chased small cats. Dogs ran quickly!"), (2, None), (3, ""), (4, "...")], "doc_id long, text string")
    whole = C.count_by(C.depgrams(A.annotate(docs)), C.DEPGRAM)
    parts = C.merge_partials(A.dependency_pairs(docs), C.DEPGRAM)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and parts.count() > 3


def test_one_pass_features_equal_the_aggregates(spark):
    docs = spark.createDataFrame([(1, "The big dogs chased small cats. However, dogs ran quickly! The dogs and the cats saw red dogs."), (2, None), (3, "..."), (4, "One")], "doc_id long, text string")
    t = A.annotate(docs)
    one = {r["doc_id"]: r.asDict() for r in L.document_features(docs).collect()}
    for part in (L.basic_features(t), L.modifiers_per_nominal(t), L.content_overlap(t), L.sentence_similarity(t), L.mtld(t)):
        for r in part.collect():
            for k, v in r.asDict().items():
                assert one[r["doc_id"]][k] == (pytest.approx(v) if v is not None else None), k
    assert set(one) == {1, 4}


def test_annotator_failures_are_rejects(spark):
    class Picky(A.RuleAnnotator):
        def annotate(self, text):
            if "bad" in text:
                raise ValueError("can't")
            return super().annotate(text)

    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in A.annotate(docs, Picky()).collect()} == {1}
    assert [tuple(r) for r in A.rejects(docs, Picky()).collect()] == [(2, "ValueError: can't")]


def test_fixed_group_sizes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(500)], "k int, a double")
    edge = N.thresholds(df, ["a"], "k", 7, 123)
    keys = np.array([r[0] for r in df.select(F.xxhash64(F.lit(42), "k")).collect()])
    assert ((N._uniform(keys, 7) < edge).sum(0) == 123).all()


def test_communities_of_replicates(spark):
    rows = [(0, "a", 1), (0, "b", 1), (0, "c", 2), (1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "a", 1), (2, "b", 1), (2, "c", 1)]
    c = spark.createDataFrame(rows, "replicate long, node string, community int")
    final = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, community int")
    got = {r["node"]: r["stability"] for r in N.item_stability(c, final).collect()}
    assert got["a"] == 1.0 and got["c"] == pytest.approx(1 / 3) or got["b"] == 1.0
    n = {r["n_communities"]: (r["n_replicates"], r["modal"]) for r in N.community_counts(c).collect()}
    assert n == {2: (2, True), 1: (1, False)}
    one = spark.createDataFrame([("a", 1), ("b", 1)], "node string, community int")
    assert N.bridge_groups(one, final).count() == 3 and N.bridge_groups(final, one).count() == 3


def test_shows(spark):
    rows = spark.createDataFrame([(i, i % 3, [1.0, float(i)], float(-i), "NOUN" if i % 2 else "VERB", "d", "low") for i in range(12)] + [(99, -1, [0.0, 1.0], 0.0, "X", "d", "low")], "row_id long, label int, vec array<double>, surprisal double, pos_tag string, dep_rel string, prof string")
    assert [r["row_id"] for r in V.cluster_show(rows, 1, "surprisal", 3).orderBy("number").collect()] == [1, 4, 7]
    assert [r["row_id"] for r in V.cluster_show(rows, 1, "surprisal", 3, pos=["NOUN"]).orderBy("number").collect()] == [1, 7]
    assert V.cluster_show(rows, 0, "centroid", 2, dim=2).count() == 2 and V.cluster_show(rows, 0, "random", 9).count() == 4
    for bad in (-1, 7):
        with pytest.raises(ValueError, match=r"valid: \[0, 1, 2\] \(3 in all\)"):
            V.cluster_show(rows, bad)
    assert tuple(V.valid_labels(rows).first()) == (3, [0, 1, 2])
    assert {r["g"]: r["x"] for r in T.top_shares(spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, None), (2, "c")], "g int, x string"), ["g"], "x", 2).collect()} == {1: "b(50%),a(25%)", 2: "c(100%)"}


def test_rank_correlation_by_group(spark):
    df = spark.createDataFrame([(g, float(x), float(y)) for g, pts in (("u", [(1, 2), (2, 4), (3, 9)]), ("v", [(1, 3), (2, 2), (3, 1), (3, None)])) for x, y in [(a, b if b is not None else float("nan")) for a, b in pts]], "g string, x double, y double").withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    got = {r["g"]: (round(r["rho"], 9), r["n"]) for r in T.spearman_by(df, "g", "x", "y").collect()}
    assert got == {"u": (1.0, 3), "v": (-1.0, 3)}


def test_rank_correlation_of_constant_groups(spark):
    """A component without any loading, equal levels, one row: NaN, whatever the partitions, and the other groups keep theirs."""
    pts = [("dead", 0.0, 1 + i % 3) for i in range(150)] + [("level", i / 7, 2) for i in range(149)] + [("one", 1.0, 3)] + [("u", i / 7, i) for i in range(99)]
    df = spark.createDataFrame([(g, float(x), int(y)) for g, x, y in pts], "g string, x double, y int")
    for parts in (1, 7):
        got = {r["g"]: (str(round(r["rho"], 9)), r["n"]) for r in T.spearman_by(df.repartition(parts), "g", "x", "y").collect()}
        assert got == {"dead": ("nan", 150), "level": ("nan", 149), "one": ("nan", 1), "u": ("1.0", 99)}


def test_summary_of_a_dead_component(spark):
    long = spark.createDataFrame([(i, c, float(i * c)) for i in range(6) for c in (0, 1)], "k long, component int, loading double")
    meta = spark.createDataFrame([(i, 1.0, p, "NOUN", "a") for i, p in enumerate(["low", "low", "mid", "mid", "high", "high"])], "k long, surprisal double, prof string, pos_tag string, token_text string")
    got = {r["component"]: (r["sparsity"], r["top_load"], str(round(r["rho"], 6))) for r in V.component_summary(long, meta, "k", 3).collect()}
    assert got == {0: (1.0, 0.0, "nan"), 1: (1 / 6, 4.0, "0.956183")}


def test_approximate_top(spark):
    df = spark.createDataFrame([("a", "x")] * 9 + [("b", "x")] * 5 + [(str(i), "y") for i in range(30)], "token_0 string, token_1 string")
    assert [tuple(r) for r in C.approximate_top(df, ["token_0", "token_1"], 2, 100).collect()] == [("a\tx", 9), ("b\tx", 5)]


def test_tables_of_a_scope_are_deleted(spark):
    with shared.scope(spark):
        a, b = shared.cut(spark.range(3)), shared.cut(spark.range(4), keep=True)
        files = a.inputFiles()
    assert b.count() == 4 and not any(__import__("os").path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)
