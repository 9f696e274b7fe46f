import hashlib
import unicodedata

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.shared import strip_ws, ws_count


def _one(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_ws_count_is_like_split(spark):
    v = ["a b", "", "  ", None, "a b\tc\n", "\x1ca\x1fb", "x y"]
    assert _one(spark, ws_count, v) == [0 if x is None else len(x.split()) for x in v]


def test_strip(spark):
    v = [" a ", "\t b\n", None, "", "\x1d c \x1e"]
    assert _one(spark, strip_ws, v) == [x if x is None else x.strip() for x in v]


def test_clean_text(spark):
    def clean(t):
        if t is None:
            return None
        for k, p in X.PII.items():
            t = t.replace(k, p)
        t = unicodedata.normalize("NFC", t)
        import re

        t = re.sub(r"[^\S\n]+", " ", t)
        return "\n".join(x.strip() for x in t.split("\n")).strip()

    v = ["  A\t b \r\n  c  ", None, "", "ét  e", "mail |||EMAIL_ADDRESS||| x", "\n\n a \n\n b\n", "  "]
    assert _one(spark, X.clean_text, v) == [clean(x) for x in v]
    assert _one(spark, X.clean_text, ["  A\t b \r\n  c  "]) == ["A b\nc"]


def test_code_fraction(spark):
    v = ["def f():\nhello wo", "", None, "    x\ny", "\tx", "   ", "import a\r\nplain", "a // b"]
    assert _one(spark, X.code_fraction, v) == [0.5, None, None, 0.5, 1.0, None, 8 / 13, 4 / 5]


def test_md5_mod(spark):
    v = ["x42", "", "abc"]
    assert _one(spark, X.md5_mod, v) == [int(hashlib.md5(x.encode()).hexdigest(), 16) % 10_000 for x in v]
    assert _one(spark, X.md5_mod, ["x42"]) == [3523]


def test_concordance_pieces(spark):
    assert _one(spark, lambda c: X.truncate_left(c, 8), ["abcdefghij", "ab"]) == ["...fghij", "      ab"]
    assert _one(spark, lambda c: X.truncate_right(c, 8), ["abcdefghij", "ab"]) == ["abcde...", "ab      "]
    assert _one(spark, lambda c: X.centred(c, 9), ["abc", "ab"]) == ["   abc   ", "   ab    "]


def test_references(spark):
    v = ["body\nReferences\n[1] x", "body", "the references\nare", "a\nWorks cited:\n", None]
    assert _one(spark, X.before_references, v) == ["body", "body", "the references\nare", "a", None]


def test_json(spark):
    v = ['{"url": "u"}', '{"url": "u"', None, "{}", '{"url": 3}']
    assert _one(spark, lambda c: X.jsonl_value(c, "$.url"), v) == ["u", None, None, None, "3"]
