import numpy as np
import pandas as pd
import pytest

from corpusmill.llm import encoding as E

WORDS = "le garçon a trouvé la fenêtre près de l'hôpital et la société élégante ; über die Straße ging ein größerer Mann später nach Köln ; la niña soñó mañana con el corazón – “bien” dijo, déjà vu à la café"


def _corpus():
    rng = np.random.default_rng(0)
    w = WORDS.split()
    return [" ".join(rng.choice(w, 40)) for _ in range(400)]


def _model(texts):
    n = {}
    for t in texts:
        for a, b in zip(t, t[1:]):
            k = (ord(a), ord(b))
            n[k] = n.get(k, 0) + 1
    return E.PairModel.of(pd.DataFrame([(a, b, c) for (a, b), c in n.items()], columns=["a", "b", "n"]))


def _wrong(t, written, read):
    return t.encode(written, "ignore").decode(read, "replace")


@pytest.fixture(scope="module")
def fixer():
    return E.Restorer(_model(_corpus()))


@pytest.mark.parametrize("read", ["latin-1", "mac_roman", "cp437", "cp850", "iso8859_15"])
def test_utf8_read_wrongly_is_restored(fixer, read):
    t = "la fenêtre près de la société, über die Straße"
    new, names, lost = fixer.restore(t.encode().decode(read))
    assert new == t and names and not lost


def test_utf8_as_windows_1252_in_part_and_twice(fixer):
    t = "la niña soñó mañana"
    once = t.encode().decode("cp1252")
    assert fixer.restore(once)[0] == t
    assert fixer.restore("le garçon a trouvé " + once)[0] == "le garçon a trouvé " + t
    assert fixer.restore(once.encode().decode("cp1252"))[0] == t


def test_eight_bit_read_as_other(fixer):
    t = "le garçon a trouvé la fenêtre près de la société élégante"
    for read in ("cp437", "mac_roman"):
        new, names, _ = fixer.restore(_wrong(t, "cp1252", read))
        assert new == t and names == [f"cp1252 as {read}"]


def test_lost_characters_are_reported(fixer):
    _, _, lost = fixer.restore(_wrong("la niña soñó", "latin-1", "utf-8"))
    assert lost == 3


@pytest.mark.parametrize("t", ["le garçon a trouvé la fenêtre", "MAÇÃ E PÃO", "«Âtre» — vieux mot.", "3 × 4 ≈ 12, θ ≥ Θ.", "© 2024 ™", "├── src\n│   └── notes", "plain", ""])
def test_sound_texts_stay(fixer, t):
    assert fixer.restore(t) == (t, [], 0)


def test_segments_are_maximal(fixer):
    s = "trouvÃ© la fenêtre"
    spans = fixer.segments(s)
    assert any(i <= s.index("Ã") < j for i, j in spans) and all(not (i <= s.index("ê") < j) for i, j in spans)


def test_documents(spark):
    texts = _corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, "la niña soñó".encode().decode("cp1252")), (9001, None), (9002, ""), (9003, "ni�a"), (9000, "la niña soñó".encode().decode("cp1252"))]
    long = ("le garçon a trouvé " * 20_000) + "Straße".encode().decode("latin-1")
    df = spark.createDataFrame([(k, t, "x") for k, t in [*rows, (9004, long)]], "doc_id long, text string, mapping string")
    got = sorted((r["doc_id"], r["restorable"], r["n_lost"]) for r in E.find_garbled(df).collect())
    assert got == [(9000, True, 0), (9000, True, 0), (9003, False, 1), (9004, True, 0)]
    assert E.find_garbled(df.limit(0)).count() == 0


def test_pair_counts_cover_everything(spark):
    df = spark.createDataFrame([("éa",), ("éa",), (None,), ("日本",)], "text string")
    got = {(r["a"], r["b"]): r["n"] for r in E.char_pairs(df).collect()}
    assert got[ord("é"), ord("a")] == 2 and got[E.SINGLE + (ord("日") >> 8), E.SINGLE + (ord("本") >> 8)] == 1
