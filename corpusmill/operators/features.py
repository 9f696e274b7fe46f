"""Linguistic features of documents, as aggregates over the token table."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.annotate import Annotator, RuleAnnotator
from corpusmill.operators.collate import depgrams
from corpusmill.shared import with_one

# The list of connectives.
CONNECTIVES = (
    "also", "although", "and", "because", "besides", "but", "consequently", "conversely", "finally", "first", "firstly", "for", "furthermore",
    "hence", "however", "if", "indeed", "instead", "lastly", "likewise", "meanwhile", "moreover", "nevertheless", "next", "nonetheless", "nor",
    "once", "or", "otherwise", "overall", "second", "secondly", "similarly", "since", "so", "still", "subsequently", "then", "therefore", "third",
    "thirdly", "though", "thus", "unless", "whereas", "while", "yet",
)

CONTENT = ("NOUN", "VERB", "ADJ", "ADV")
MODIFIERS = ("amod", "det", "nummod", "compound")
MI_RELATIONS = ("amod", "dobj", "advmod")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def _basic() -> list[Column]:
    alpha = F.col("is_alpha")
    root = F.col("dep") == "ROOT"
    sents = F.max("sent_i") + 1
    return [
        _ratio(F.count_if(alpha & F.col("pos").isin(*CONTENT)), F.count_if(alpha)).alias("lexical_density"),
        F.avg(F.when(alpha, F.length("text"))).alias("mean_word_length"),
        (F.count_if(~F.col("is_punct")) / sents).alias("words_per_sentence"),
        _ratio(sents, F.count_if(root)).alias("clauses_per_tunit"),
        F.avg(F.when(~root, F.abs(F.col("i") - F.col("head_i")))).alias("mean_dep_distance"),
        (F.count_if(F.lower("text").isin(*CONNECTIVES)) / sents).alias("connective_density"),
    ]


def _modifiers() -> Column:
    return _ratio(F.count_if(F.col("dep").isin(*MODIFIERS) & (F.col("head_pos") == "NOUN")), F.count_if(F.col("pos") == "NOUN")).alias("mod_per_nom")


def basic_features(tokens: DataFrame) -> DataFrame:
    """One aggregate per document for all features that need no other row: undefined ones are NULL."""
    return tokens.groupBy("doc_id").agg(*_basic())


def modifiers_per_nominal(tokens: DataFrame) -> DataFrame:
    """Children of nouns that are modifiers, per noun; no noun: NULL."""
    return tokens.groupBy("doc_id").agg(_modifiers())


def log_frequency(tokens: DataFrame, freq: DataFrame) -> DataFrame:
    """Mean log10 of the relative frequency of alphabetic lemmas; unknown ones count 1.  ``freq``: token, count."""
    total = freq.agg(F.sum("count").alias("_total"))  # one row
    words = tokens.filter("is_alpha").groupBy("doc_id", F.col("lemma").alias("token")).agg(F.count(F.lit(1)).alias("_n"))
    hit = with_one(words.join(freq, "token", "left"), total)
    logs = F.log10(F.coalesce("count", F.lit(1)) / F.col("_total"))
    return hit.groupBy("doc_id").agg((F.sum(F.col("_n") * logs) / F.sum("_n")).alias("log_mean_token_freq"))


def association(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Mean mutual information of a document's (head, dependent) pairs per relation; pairs without joint count don't count.

    ``pairs``: doc_id, relation, head_lemma, dependent_lemma.  ``grams``: head_lemma, dependent_lemma, relation, count; joint
    counts are of the relation, marginals and total of all relations.
    """
    joint = grams.filter(F.col("relation").isin(*MI_RELATIONS)).groupBy("relation", "head_lemma", "dependent_lemma").agg(F.sum("count").alias("_j"))
    heads = grams.groupBy("head_lemma").agg(F.sum("count").alias("_h"))
    deps = grams.groupBy("dependent_lemma").agg(F.sum("count").alias("_d"))
    total = grams.agg(F.sum("count").alias("_t"))
    used = pairs.filter(F.col("relation").isin(*MI_RELATIONS)).groupBy("doc_id", "relation", "head_lemma", "dependent_lemma").agg(F.count(F.lit(1)).alias("_n"))
    scored = with_one(used.join(joint, ["relation", "head_lemma", "dependent_lemma"]).join(heads, "head_lemma").join(deps, "dependent_lemma"), total)
    mi = F.log2(F.col("_j") * F.col("_t") / (F.col("_h") * F.col("_d")))
    aggs = []
    for r in MI_RELATIONS:
        hit = F.when(F.col("relation") == r, F.col("_n"))
        aggs.append((F.sum(hit * mi) / F.sum(hit)).alias(f"{r}_mi"))
    return scored.groupBy("doc_id").agg(*aggs)


def content_overlap(tokens: DataFrame) -> DataFrame:
    """Mean Jaccard overlap of the content lemmas of adjacent sentences; two empty ones give 0, one sentence NULL."""
    content = F.col("is_alpha") & F.col("pos").isin(*CONTENT)
    sents = tokens.repartition("doc_id").groupBy("doc_id", "sent_i").agg(F.collect_set(F.when(content, F.xxhash64("lemma"))).alias("_s"))
    pair = sents.withColumn("_next", F.lead("_s").over(Window.partitionBy("doc_id").orderBy("sent_i")))
    both, either = F.size(F.array_intersect("_s", "_next")), F.size("_s") + F.size("_next")
    j = F.when(F.col("_next").isNotNull(), F.when(either > 0, both / (either - both)).otherwise(0.0))
    return pair.groupBy("doc_id").agg(F.avg(j).alias("content_word_overlap"))


def token_vector(c: Column, dim: int = 8) -> Column:
    """A deterministic stand-in for word vectors: signed bytes of the lemma's md5."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.conv(F.substring(F.md5(c), (k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") - 128)


def sentence_similarity(tokens: DataFrame, dim: int = 8) -> DataFrame:
    """Mean cosine of adjacent sentences' mean vectors; pairs with a zero vector are skipped.

    The mean's direction is the sum's, and the sums are whole numbers: one aggregate column per dimension, no arrays shuffled.
    """
    v = tokens.select("doc_id", "sent_i", *[F.expr(f"int(conv(substring(md5(lemma), {2 * k + 1}, 2), 16, 10)) - 128").alias(f"v{k}") for k in range(dim)])
    s = v.groupBy("doc_id", "sent_i").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(dim)])
    w = Window.partitionBy("doc_id").orderBy("sent_i")
    s = s.select("doc_id", *[f"v{k}" for k in range(dim)], *[F.lead(f"v{k}").over(w).alias(f"n{k}") for k in range(dim)])

    def dot(a, b):
        return sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in range(1, dim)), F.col(f"{a}0") * F.col(f"{b}0"))

    cosine = _ratio(dot("v", "n").cast("double"), F.sqrt(dot("v", "v").cast("double")) * F.sqrt(dot("n", "n").cast("double")))
    return s.groupBy("doc_id").agg(F.avg(cosine).alias("sentence_similarity"))


def mtld_of(words: list[str], threshold: float = 0.72) -> float | None:
    """Mean of the forward and the backward pass of words per factor; below ten words undefined."""
    if len(words) < 10:
        return None

    def one(seq) -> float:
        seen: set[str] = set()
        n = factors = 0
        ratio = 1.0
        for w in seq:
            n += 1
            seen.add(w)
            ratio = len(seen) / n
            if ratio <= threshold:
                factors += 1
                seen.clear()
                n = 0
                ratio = 1.0
        if n:
            factors += (1 - ratio) / (1 - threshold)
        return len(words) / factors if factors else float(len(words))

    return (one(words) + one(reversed(words))) / 2


@F.pandas_udf(T.DoubleType())
def _mtld(s: pd.Series) -> pd.Series:
    return s.map(lambda x: np.nan if (v := mtld_of(list(x))) is None else v)


def mtld(tokens: DataFrame) -> DataFrame:
    """Measure of textual lexical diversity over alphabetic lemmas in order; the scan is sequential, so it is an Arrow function."""
    words = tokens.filter("is_alpha").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "lemma"))).alias("_w"))
    return words.select("doc_id", F.nanvl(_mtld(F.col("_w.lemma")), F.lit(None).cast("double")).alias("mtld"))


def document_features(docs: DataFrame, annotator: Annotator | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The features that need no other document (all but the frequency and the three associations): one pass, no shuffle.

    Documents without tokens have no row; NULL where undefined.  The formulas are those of the aggregates above.
    """
    engine = annotator or RuleAnnotator()
    connectives, content, modifiers = frozenset(CONNECTIVES), frozenset(CONTENT), frozenset(MODIFIERS)
    vectors: dict[str, np.ndarray] = {}

    def vector(lemma: str) -> np.ndarray:
        if (v := vectors.get(lemma)) is None:
            if len(vectors) > 200_000:  # a memo; without an entry the vector is computed again
                vectors.clear()
            v = vectors[lemma] = np.frombuffer(hashlib.md5(lemma.encode("utf-8", "surrogatepass")).digest()[:8], np.uint8).astype(np.float64) - 128
        return v

    def of(rows: list[tuple]) -> tuple:
        alpha = [r for r in rows if r[9]]
        sents = rows[-1][0] + 1
        roots = sum(r[7] == "ROOT" for r in rows)
        away = [abs(r[1] - r[8]) for r in rows if r[7] != "ROOT"]
        nouns = sum(r[5] == "NOUN" for r in rows)
        mods = sum(r[7] in modifiers and rows[r[8]][5] == "NOUN" for r in rows)
        sets: list[set] = [set() for _ in range(sents)]
        sums = np.zeros((sents, 8))
        for r in rows:
            if r[9] and r[5] in content:
                sets[r[0]].add(r[4])
        np.add.at(sums, [r[0] for r in rows], [vector(r[4]) for r in rows])
        overlap = [len(a & b) / len(a | b) if a or b else 0.0 for a, b in zip(sets, sets[1:])]
        size = np.sqrt((sums**2).sum(1))
        near = [float(a @ b / (x * y)) for a, b, x, y in zip(sums, sums[1:], size, size[1:]) if x * y > 0]
        mean = lambda x: sum(x) / len(x) if x else None
        return (
            sum(r[5] in content for r in alpha) / len(alpha) if alpha else None, mean([len(r[3]) for r in alpha]), sum(not r[10] for r in rows) / sents, sents / roots if roots else None,
            mean(away), sum(r[3].lower() in connectives for r in rows) / sents, mods / nouns if nouns else None, mean(overlap), mean(near), mtld_of([r[4] for r in alpha]) if alpha else None,
        )

    names = ["lexical_density", "mean_word_length", "words_per_sentence", "clauses_per_tunit", "mean_dep_distance", "connective_density", "mod_per_nom", "content_word_overlap", "sentence_similarity", "mtld"]

    def run(batches):
        for b in batches:
            ids, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and (rows := engine.annotate(t)):
                    ids.append(k)
                    out.append(of(rows))
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.float64()) for c in columns]], names=["doc_id", *names])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def all_features(docs: DataFrame, tokens: DataFrame, freq: DataFrame, grams: DataFrame) -> DataFrame:
    """The 14 features of every document: one row per document with tokens, NULL where undefined.

    Ten of them come from one pass over the documents; frequency and associations join what a document has with the collection's
    tables, from ``tokens`` (a stored token table).
    """
    out = document_features(docs)
    for f in (log_frequency(tokens, freq), association(depgrams(tokens), grams)):
        out = out.join(f, "doc_id", "left")
    return out


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Undefined values per column: feature, n_null, pct; one aggregate, then unpivoted."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns])
    return one.unpivot("_n", columns, "feature", "n_null").select("feature", "n_null", F.round(100 * F.col("n_null") / F.col("_n"), 4).alias("pct"))
