"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.shared import nfc, strip_ws

# Placeholders of personal data and their substitutes.
PII = {
    "|||EMAIL_ADDRESS|||": "email@example.com",
    "|||PHONE_NUMBER|||": "555-0100",
    "|||IP_ADDRESS|||": "0.0.0.0",
}

# What a line of code starts with.
CODE_STARTS = (
    "{", "}", "<", "//", "/*", "#include", "import ", "def ", "class ", "function ", "var ", "let ", "const ", "return ", "if (", "for (", "while (",
)

_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def replace_pii(c: Column) -> Column:
    for mark, plain in PII.items():
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def collapse(c: Column) -> Column:
    """Runs of white space other than line feeds become one space; lines and the whole are stripped."""
    c = F.regexp_replace(c, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    return F.regexp_replace(F.regexp_replace(c, " *\n *", "\n"), r"^[ \n]+|[ \n]+$", "")


def clean_text(c: Column) -> Column:
    """Substitutes for personal data, NFC, collapsed white space; NULL stays NULL."""
    return collapse(nfc(replace_pii(c)))


def code_fraction(c: Column) -> Column:
    """Share of stripped characters in lines that look like code; NULL where there are no characters."""
    starts = F.lit(False)
    lines = F.split(c, _LINES)

    def of(line: Column) -> Column:
        bare = strip_ws(line)
        looks = line.startswith("    ") | line.startswith("\t")
        for x in CODE_STARTS:
            looks = looks | bare.startswith(x)
        n = F.length(bare)
        return F.struct(n.alias("n"), F.when(looks | starts, n).otherwise(0).alias("code"))

    total = F.aggregate(
        F.transform(lines, of),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("code")),
        lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["code"] + x["code"]).alias("code")),
    )
    return F.when(total["n"] > 0, total["code"] / total["n"])


def md5_mod(c: Column, modulus: int = 10_000) -> Column:
    """The 128-bit md5 of a string, modulo a number below 2^31, from four 32-bit parts."""
    digest, rest = F.md5(c), F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        rest = (rest * (2**32 % modulus) + part) % modulus
    return rest


def truncate_left(c: Column, n: int) -> Column:
    """The last characters with an ellipsis before, padded on the left to n."""
    return F.lpad(F.when(F.length(c) > n, F.concat(F.lit("..."), F.right(c, F.lit(n - 3)))).otherwise(c), n, " ")


def truncate_right(c: Column, n: int) -> Column:
    return F.rpad(F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c), n, " ")


def centred(c: Column, n: int) -> Column:
    """The first n - 2 characters centred in n columns (the odd space goes right)."""
    t = F.left(c, F.lit(n - 2))
    return F.rpad(F.concat(F.repeat(F.lit(" "), ((F.lit(n) - F.length(t)) / 2).cast("int")), t), n, " ")


# Widths of the columns of a concordance line.
KWIC_CONTEXT, KWIC_WORD, KWIC_SURPRISAL, KWIC_POS, KWIC_DEP, KWIC_LEVEL, KWIC_PREDICTION = 35, 16, 5, 5, 7, 5, 16


def at_least(c: Column, n: int) -> Column:
    """Padded on the right to n; longer texts stay whole."""
    return F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))


def kwic_line(number: Column) -> Column:
    """A concordance line: number, left context, [word], right context, surprisal, tag, relation, level and three predictions with their chances.

    From the columns left_context, token_text, right_context, surprisal, pos_tag, dep_rel, prof_tertile, top3_predicted, top3_probs; what is NULL is blank.
    """
    say = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = number.cast("string")

    def guess(k: int) -> Column:
        word, p = F.get("top3_predicted", F.lit(k)), F.floor(F.get("top3_probs", F.lit(k)) * 100 + 0.5).cast("long")
        said = F.concat(strip_ws(word), F.lit("("), F.floor(p / 100).cast("string"), F.lit("."), F.lpad((p % 100).cast("string"), 2, "0"), F.lit(")"))
        return at_least(F.coalesce(said, F.lit("")), KWIC_PREDICTION)

    return F.concat(
        F.when(F.length(n) >= 3, n).otherwise(F.lpad(n, 3, " ")), F.lit("  "), truncate_left(say("left_context"), KWIC_CONTEXT), F.lit("  ["), centred(say("token_text"), KWIC_WORD - 2), F.lit("]  "),
        truncate_right(say("right_context"), KWIC_CONTEXT), F.lit("  "), F.coalesce(F.when(F.col("surprisal").isNotNull(), F.format_string("%5.2f", "surprisal")), F.lit(" " * KWIC_SURPRISAL)), F.lit("  "),
        at_least(say("pos_tag"), KWIC_POS), F.lit(" "), at_least(say("dep_rel"), KWIC_DEP), F.lit(" "), at_least(say("prof_tertile"), KWIC_LEVEL), F.lit(" "), guess(0), guess(1), guess(2),
    )


def before_references(c: Column) -> Column:
    """Text up to a line that only says References, Bibliography or Works cited."""
    return F.regexp_replace(c, r"(?is)\n[ \t]*(references|bibliography|works cited)[ \t]*:?[ \t]*(\n.*)?$", "")


def jsonl_value(c: Column, path: str) -> Column:
    """A string out of JSON text; NULL for text that isn't JSON."""
    return F.try_variant_get(F.try_parse_json(c), path, "string")


def token_array(c: Column) -> Column:
    """Runs of letters, runs of digits, and single other characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\p{N}+|[^ \t\n\f\r\p{L}\p{N}])"), F.lit(1))
