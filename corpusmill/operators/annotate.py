"""Annotation of texts into a token table; the annotator is a plug-in with a rule-based one built in.

The rules are a deterministic stand-in, not the equal of a statistical parser: another annotator plugs in by the same
method.
"""

from __future__ import annotations

from collections import Counter
from typing import Protocol

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import cut

TOKEN_SCHEMA = (
    "doc_id long, sent_i int, i int, char_start int, text string, lemma string, pos string, tag string, dep string, head_i int,"
    " is_alpha boolean, is_punct boolean, head_lemma string, head_tag string, head_pos string"
)

#: closed classes of the rules
LEXICON = {
    "DET": "a an the this that these those some any no every each".split(),
    "PRON": "i you he she it we they me him her us them who what".split(),
    "ADP": "of in on at by for with from to into about near over under".split(),
    "AUX": "is are was were be been am has have had will would can could should may must do does did".split(),
    "CCONJ": "and or but nor".split(),
}
SUFFIXES = (("ADV", ("ly",)), ("ADJ", ("ful", "ous", "al", "ive", "able", "ible", "ic")), ("VERB", ("ed", "ing", "ize", "ise")))
_DEP = {"DET": "det", "ADJ": "amod", "NUM": "nummod", "ADV": "advmod", "AUX": "aux", "VERB": "conj", "ADP": "prep", "CCONJ": "cc", "PRON": "nsubj"}
FORWARD = ("DET", "ADJ", "NUM")  # attach to the next word
_WORD_POS = {w: p for p, ws in LEXICON.items() for w in ws}


class Annotator(Protocol):
    def annotate(self, text: str) -> list[tuple]:
        """Rows of TOKEN_SCHEMA without doc_id."""


class RuleAnnotator:
    """Sentences end at . ! ? or line feeds; tokens are runs of letters, runs of digits, and single other characters."""

    def __init__(self) -> None:
        self.sentence = regex.compile(r"[.!?]+(?:[ \t\n\f\r]+|$)|\n+")
        self.token = regex.compile(r"\p{L}+|\p{N}+|[^ \t\n\f\r\p{L}\p{N}]")
        self.letter = regex.compile(r"\p{L}")
        self.digit = regex.compile(r"\p{N}")
        self.known: dict[str, tuple] = {}

    def kind(self, text: str) -> tuple:
        """(lemma, pos, tag, is_alpha, is_punct) of a token by itself."""
        if (got := self.known.get(text)) is None:
            low = text.lower()
            alpha, num = bool(self.letter.match(text)), bool(self.digit.match(text))
            if num:
                pos = "NUM"
            elif not alpha:
                pos = "PUNCT"
            else:
                pos = _WORD_POS.get(low) or next((p for p, ends in SUFFIXES if low.endswith(ends)), "NOUN")
            tag = "NNS" if pos == "NOUN" and low.endswith("s") else "VBD" if pos == "VERB" and low.endswith("ed") else pos
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[text] = (low, pos, tag, alpha, not alpha and not num)
        return got

    def annotate(self, text: str) -> list[tuple]:
        out: list[tuple] = []
        sent = at = 0
        for m in [*self.sentence.finditer(text), None]:
            end = m.start() if m else len(text)
            found = [(x.start() + at, x.group()) for x in self.token.finditer(text[at:end])]
            at = m.end() if m else end
            if not found:
                continue
            base = len(out)
            kinds = [self.kind(t) for _, t in found]
            words = [k for k, x in enumerate(kinds) if not x[4]]
            place = {k: n for n, k in enumerate(words)}
            before = None  # the last word seen
            for k, ((start, t), (low, pos, tag, alpha, punct)) in enumerate(zip(found, kinds)):
                if punct:
                    head, dep = before if before is not None else words[0] if words else k, "punct"
                elif before is None:
                    head, dep, before = k, "ROOT", k
                else:
                    n = place[k]
                    head = words[n + 1] if pos in FORWARD and n + 1 < len(words) else before
                    if pos == "NOUN":
                        other = kinds[head][1]
                        dep = "dobj" if other == "VERB" else "compound" if other == "NOUN" else "pobj"
                    else:
                        dep = _DEP[pos]
                    before = k
                out.append((sent, base + k, start, t, low, pos, tag, dep, base + head, alpha, punct))
            sent += 1
        return out


def annotate(docs: DataFrame, annotator: Annotator | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The token table of a collection, one pass without shuffle; NULL and blank texts have no tokens.

    The annotator holds a document's whole tree, so every token brings its head's lemma, tag and part of speech: no self-join later.  A text
    that the annotator fails on has no tokens and no part in the run's failure; :func:`rejects` lists such texts.
    """
    engine = annotator or RuleAnnotator()
    types = [pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 5, pa.int32(), pa.bool_(), pa.bool_(), *[pa.string()] * 3]
    names = [x.split()[0] for x in TOKEN_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    try:
                        got = engine.annotate(t)
                    except Exception:  # noqa: BLE001 - whatever a plug-in raises, see rejects()
                        continue
                    rows += [(k, *r, got[r[8]][4], got[r[8]][6], got[r[8]][5]) for r in got]
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, TOKEN_SCHEMA)


def rejects(docs: DataFrame, annotator: Annotator | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, error of the texts that the annotator fails on."""
    engine = annotator or RuleAnnotator()

    def run(batches):
        for b in batches:
            ids, errors = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    engine.annotate(t or "")
                except Exception as e:  # noqa: BLE001
                    ids.append(k)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(errors, pa.string())], names=["doc_id", "error"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, error string")


_stored: dict[tuple, DataFrame] = {}


def stored_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The token table of documents read from files, as a table that is written once.

    With ``path`` it is written there and read from there ever after; else it is kept in the shared folder for the session, by the files
    that the documents come from, their lengths and their times.
    """
    spark = docs.sparkSession
    if path:
        disk = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not disk.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            annotate(docs).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)
    files = docs.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("file_time")).distinct()
    mark = files.agg(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()[0]
    at = (spark.sparkContext.applicationId, mark, docs.schema.simpleString())
    if at not in _stored:
        _stored[at] = cut(annotate(docs), "tokens", keep=True)
    return _stored[at]


def concordance(docs: DataFrame, word: str, width: int = 10, annotator: Annotator | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, i, text, left_context, right_context of every token whose lemma is ``word``: ``width`` tokens on each side, joined by blanks."""
    engine = annotator or RuleAnnotator()
    types, names = [pa.int64(), pa.int32(), *[pa.string()] * 3], ["doc_id", "i", "text", "left_context", "right_context"]

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = engine.annotate(t) if t else []
                said = [r[3] for r in got]
                rows += [(k, r[1], r[3], " ".join(said[max(0, r[1] - width) : r[1]]), " ".join(said[r[1] + 1 : r[1] + 1 + width])) for r in got if r[4] == word]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, i int, text string, left_context string, right_context string")


def dependency_pairs(docs: DataFrame, annotator: Annotator | None = None, text: str = "text") -> DataFrame:
    """head_lemma, head_tag, relation, dependent_lemma, dependent_tag, count: partial counts of each batch of documents.

    The annotator holds a document's whole tree, so heads are looked up in place: no self-join of the token table, and what
    is shuffled to sum the counts is already summed per batch.  Roots and punctuation are left out.
    """
    engine = annotator or RuleAnnotator()
    names = ["head_lemma", "head_tag", "relation", "dependent_lemma", "dependent_tag"]

    def run(batches):
        for b in batches:
            count: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    rows = engine.annotate(t)
                    count.update((rows[r[8]][4], rows[r[8]][6], r[7], r[4], r[6]) for r in rows if r[7] not in ("ROOT", "punct"))
            columns = list(zip(*count)) if count else [[]] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array(list(count.values()), pa.int64())], names=[*names, "count"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", count long")
