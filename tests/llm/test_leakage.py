import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import leakage as L


def brute(tokens, items, n):
    out = set()
    for key, seq in items:
        runs = {tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)}
        if any(tuple(tokens[i : i + n]) in runs for i in range(len(tokens) - n + 1)):
            out.add(key)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton_equals_brute_force(items, tokens, n):
    items = list(enumerate(items))
    found = L.SuffixAutomaton(items, n).scan(tokens)
    assert set(found) == brute(tokens, items, n)
    for key, (spans, longest) in found.items():
        covered = {i for s, e in spans for i in range(s, e)}
        seq = dict(items)[key]
        runs = {tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)}
        assert covered == {i + k for i in range(len(tokens) - n + 1) if tuple(tokens[i : i + n]) in runs for k in range(n)}
        whole = {tuple(seq[i:j]) for i in range(len(seq)) for j in range(i + n, len(seq) + 1)}
        assert longest == max(j - i for i in range(len(tokens)) for j in range(i + n, len(tokens) + 1) if tuple(tokens[i:j]) in whole)


@given(st.text(alphabet="aİßΣ é\u0301-9_", max_size=40))
def test_places_of_words(text):
    nfc, at = L.placed_words(text)
    assert len(at) == len(L.words(text))
    for (i, j), w in zip(at, L.words(text)):
        assert w.replace("ς", "σ") in nfc[i:j].lower().replace("ς", "σ")


def test_documents(spark):
    rng = random.Random(1)
    w = [f"word{i}" for i in range(200)]
    passage = rng.choices(w, k=30)
    rows = [
        (1, "x " + " ".join(passage[5:17]).upper() + " y"), (2, " ".join(passage[5:16])), (3, None), (4, ""), (5, ", ".join(passage)),
        (6, " ".join(rng.choices(w, k=50_000) + passage)), (7, "café " * 12), (8, " ".join(["Before:", *passage[:13], "and after", *["z"] * 20])),
    ]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, " ".join(passage), "d"), (11, " ".join(passage[::-1]), "d"), (12, None, "d"), (13, "café " * 20, "d"), (14, "short", "d"), (None, " ".join(passage), "d")], "item_id long, text string, doc_id string")
    leaks = L.find_leaks(docs, items, 12, keep_text=True)
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.collect()}
    assert set(got) == {(1, 10), (5, 10), (6, 10), (7, 13), (8, 10)}
    assert got[5, 10]["longest"] == 30 and got[1, 10]["covered"] == 12 and [tuple(s) for s in got[8, 10]["spans"]] == [(1, 14)]
    done = {r["doc_id"]: r for r in L.clean_leaks(leaks).collect()}
    assert {k: r["verdict"] for k, r in done.items()} == {1: "drop", 5: "drop", 6: "cut spans", 7: "drop", 8: "cut spans"}
    assert done[8]["cleaned"] == "Before: and after" + " z" * 20 and done[5]["cleaned"] is None and done[6]["cleaned"] == " ".join(rows[5][1].split()[:50_000]) + " "
    assert {(r["item_id"], r["n_docs"], r["longest"]) for r in L.leak_report(leaks).collect()} == {(10, 4, 30), (13, 1, 12)}


def test_repeated_runs_are_no_longer_match(spark):
    """Two runs of 12 that overlap in the document but not in the item are one span of words and no run of more than 12."""
    a = [f"a{i}" for i in range(12)]
    text = " ".join([*a, "b"])
    item = " ".join([*a, "c", *a[1:], "b"])
    r = L.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), 12).first()
    assert r["longest"] == 12 and r["covered"] == 13


def test_coverage_is_of_all_items(spark):
    parts = [[f"{k}{i}" for i in range(12)] for k in "abc"]
    docs = spark.createDataFrame([(1, " ".join(sum(([*p, *["z"] * 4] for p in parts), [])))], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(parts)], "item_id long, text string")
    r = L.clean_leaks(L.find_leaks(docs, items, 12, keep_text=True)).first()
    assert r["coverage"] == 0.75 and r["verdict"] == "drop" and r["n_items"] == 3


def test_many_automata_and_empty(spark, monkeypatch):
    monkeypatch.setattr(L, "AUTOMATON_WORDS", 10)
    monkeypatch.setattr(L, "TASK_DOCS", 1)
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(i, "a b c " + "x " * i) for i in range(8)], "item_id long, text string")
    assert sorted(r["item_id"] for r in L.find_leaks(docs, items, 3).collect()) == sorted(list(range(8)) * 2)
    assert L.find_leaks(docs, items.limit(0), 3).count() == 0
    assert L.find_leaks(docs.limit(0), items, 3).count() == 0
