"""Queries over token tables, essays and pilot rows: features, predictability, sampling of rows; and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import annotate as A
from corpusmill.operators import features as L
from corpusmill.operators import predict as P
from corpusmill.operators import sampling as S
from corpusmill.operators import scoring as G
from corpusmill.operators.collate import count_by, depgrams
from corpusmill.plans.corpus import TOKEN_CTE, TOKENS, WSC, table
from corpusmill.plans.corpus import tokens_of as _tokens
from corpusmill.shared import with_one

Q_: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        k = name or f.__name__
        Q_[k] = f
        if sql:
            SQL[k] = sql
        return f

    return add


def r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


_CONN = ", ".join(f"'{w}'" for w in L.CONNECTIVES)
_BASIC = {
    "lexical_density": "count_if(is_alpha and pos in ('NOUN', 'VERB', 'ADJ', 'ADV')) / nullif(count_if(is_alpha), 0)",
    "mean_word_length": "avg(length(text)) filter (where is_alpha)",
    "words_per_sentence": "count_if(not is_punct) / (max(sent_i) + 1)",
    "clauses_per_tunit": "(max(sent_i) + 1) / nullif(count_if(dep = 'ROOT'), 0)",
    "mean_dep_distance": "avg(abs(i - head_i)) filter (where dep <> 'ROOT')",
    "connective_density": f"count_if(lower(text) in ({_CONN})) / (max(sent_i) + 1)",
}


def _basic(spark, d, name):
    return L.basic_features(_tokens(spark, d)).select("doc_id", r(F.col(name)).alias(name))


for _k, _s in _BASIC.items():
    query(f"with {TOKEN_CTE} select doc_id, round({_s}, 6) as {_k} from tokens group by doc_id", _k)(lambda spark, d, n=_k: _basic(spark, d, n))

_MOD = "count_if(dep in ('amod', 'det', 'nummod', 'compound') and head_pos = 'NOUN') / nullif(count_if(pos = 'NOUN'), 0)"


@query(f"with {TOKEN_CTE} select doc_id, round({_MOD}, 6) as mod_per_nom from tokens group by doc_id")
def mod_per_nom(spark, d):
    return L.modifiers_per_nominal(_tokens(spark, d)).select("doc_id", r(F.col("mod_per_nom")).alias("mod_per_nom"))


def _freq(spark, d):
    return table(spark, d, "trigrams").filter("count >= 1").groupBy(F.col("token_2").alias("token")).agg(F.sum("count").alias("count"))


_FREQ = "(select token_2 as token, sum(count)::bigint as count from trigrams where count >= 1 group by all)"


@query(f"with {TOKEN_CTE} select doc_id, round(avg(log10(coalesce(count, 1) / (select sum(count) from {_FREQ}))), 6) as log_mean_token_freq from tokens left join {_FREQ} on lemma = token where is_alpha group by doc_id")
def log_mean_token_freq(spark, d):
    return L.log_frequency(_tokens(spark, d), _freq(spark, d)).select("doc_id", r(F.col("log_mean_token_freq")).alias("log_mean_token_freq"))


_ASSOC = (
    "g as (select doc_id, dep as relation, head_lemma, lemma as dependent_lemma from tokens where dep not in ('ROOT', 'punct')), j as (select relation, head_lemma, dependent_lemma, count(*) as j from g group by all),"
    " h as (select head_lemma, count(*) as h from g group by all), e as (select dependent_lemma, count(*) as e from g group by all), n as (select count(*) as n from g),"
    " scored as (select doc_id, relation, log2(j * n / (h * e)) as mi from g join j using (relation, head_lemma, dependent_lemma) join h using (head_lemma) join e using (dependent_lemma) cross join n where relation in ('amod', 'dobj', 'advmod'))"
)
_MI = ", ".join(f"round(avg(mi) filter (where relation = '{x}'), 6) as {x}_mi" for x in L.MI_RELATIONS)


@query(f"with {TOKEN_CTE}, {_ASSOC} select doc_id, {_MI} from scored group by doc_id")
def relation_mi(spark, d):
    g = depgrams(_tokens(spark, d))
    m = L.association(g, count_by(g, ["head_lemma", "relation", "dependent_lemma"]))
    return m.select("doc_id", *[r(F.col(f"{x}_mi")).alias(f"{x}_mi") for x in L.MI_RELATIONS])


@query(
    f"with {TOKEN_CTE}, s as (select doc_id, sent_i, coalesce(list(distinct lemma) filter (where is_alpha and pos in ('NOUN', 'VERB', 'ADJ', 'ADV')), []) as s from tokens group by all),"
    " p as (select doc_id, s, lead(s) over (partition by doc_id order by sent_i) as n from s),"
    " q as (select doc_id, n is not null as ok, len(list_intersect(s, n)) as i, len(s) + len(n) - len(list_intersect(s, n)) as u from p)"
    " select doc_id, round(avg(case when ok then case when u > 0 then i / u else 0 end end), 6) as content_word_overlap from q group by doc_id"
)
def content_word_overlap(spark, d):
    return L.content_overlap(_tokens(spark, d)).select("doc_id", r(F.col("content_word_overlap")).alias("content_word_overlap"))


_DIM = range(8)
_VK = ", ".join(f"sum(('0x' || substr(md5(lemma), {2 * k + 1}, 2))::int - 128) as v{k}" for k in _DIM)
_LEAD = ", ".join(f"lead(v{k}) over (partition by doc_id order by sent_i) as n{k}" for k in _DIM)


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{k} * {b}{k}" for k in _DIM) + ")::double"


@query(
    f"with {TOKEN_CTE}, s as (select doc_id, sent_i, {_VK} from tokens group by all), p as (select *, {_LEAD} from s)"
    f" select doc_id, round(avg({_dot('v', 'n')} / nullif(sqrt({_dot('v', 'v')}) * sqrt({_dot('n', 'n')}), 0)), 6) as sentence_similarity from p group by doc_id"
)
def sentence_similarity(spark, d):
    return L.sentence_similarity(_tokens(spark, d)).select("doc_id", r(F.col("sentence_similarity")).alias("sentence_similarity"))


@query()
def mtld(spark, d):
    return L.mtld(_tokens(spark, d))


def _essays(spark, d):
    """The latest delivery of each essay."""
    e = table(spark, d, "ellipse_final_github")
    return e.groupBy("text_id_kaggle").agg(F.max(F.struct("loaded_at", "overall", "prompt", "full_text", *_SCORES)).alias("e")).select("text_id_kaggle", "e.*")


_SCORES = ["cohesion", "syntax", "vocabulary", "phraseology", "grammar", "conventions"]
_SC = ", ".join(_SCORES)
ESSAYS = (
    f"(select text_id_kaggle, loaded_at, case when isnan(overall) then null else overall end as overall, prompt, full_text, {_SC} from (select *, row_number() over (partition by text_id_kaggle"
    f" order by loaded_at desc, overall desc nulls last, prompt desc nulls last, full_text desc nulls last, {', '.join(s + ' desc nulls last' for s in _SCORES)}) as rn from ellipse_final_github) where rn = 1)"
)


def clean_essays(spark, d):
    return _essays(spark, d).withColumn("overall", F.nanvl("overall", F.lit(None).cast("double")))


def _all_features(spark, d):
    t = _tokens(spark, d)
    return L.all_features(table(spark, d, "documents"), t, _freq(spark, d), count_by(depgrams(t), ["head_lemma", "relation", "dependent_lemma"]))


@query()
def all_features(spark, d):
    return _all_features(spark, d)


_DOC = [*_BASIC, "mod_per_nom", "content_word_overlap", "sentence_similarity"]
_ALL = [*_DOC, "log_mean_token_freq", *[f"{x}_mi" for x in L.MI_RELATIONS]]


@query(
    f"with {TOKEN_CTE}, {_ASSOC}, b as (select doc_id, {', '.join(f'round({s}, 6) as {k}' for k, s in _BASIC.items())}, round({_MOD}, 6) as mod_per_nom from tokens group by doc_id),"
    f" m as (select doc_id, {_MI} from scored group by doc_id), o as ({SQL['content_word_overlap'].split(TOKEN_CTE)[1].strip(', ').join(['with ', ''])}),"
    f" v as ({SQL['sentence_similarity'].split(TOKEN_CTE)[1].strip(', ').join(['with ', ''])}), l as ({SQL['log_mean_token_freq'].split(TOKEN_CTE)[1]})"
    f" select doc_id, {', '.join(_ALL)} from b left join m using (doc_id) left join o using (doc_id) left join v using (doc_id) left join l using (doc_id)"
)
def features_table(spark, d):
    """The 13 features that SQL can state (all but the diversity measure), from the one-pass operator."""
    return _all_features(spark, d).select("doc_id", *[r(F.col(c)).alias(c) for c in _ALL])


@query(
    f"with {TOKEN_CTE}, f as (select doc_id, {', '.join(f'round({s}, 6) as {k}' for k, s in _BASIC.items())} from tokens group by doc_id)"
    " select d.doc_id, d.lang, " + ", ".join(_BASIC) + " from documents d join f using (doc_id)"
)
def features_merge(spark, d):
    f = L.basic_features(_tokens(spark, d)).select("doc_id", *[r(F.col(k)).alias(k) for k in _BASIC])
    return table(spark, d, "documents").select("doc_id", "lang").join(f, "doc_id").select("doc_id", "lang", *_BASIC)


@query(" union all ".join(f"select '{c}' as feature, count_if({c} is null or isnan({c}))::bigint as n_null, round(100 * count_if({c} is null or isnan({c})) / count(*), 4) as pct from ellipse_final_github" for c in ["overall", *_SCORES]))
def null_audit(spark, d):
    return L.null_audit(table(spark, d, "ellipse_final_github"), ["overall", *_SCORES])


# predictability: essays scored against counts of the collection
_SEQ = (
    f"seq as (select doc_id, i - 1 as i, t[i] as token, case when i > 1 then t[i - 1] else '#' end as prev, case when i > 2 then t[i - 2] else '#' end as prev2 from (select doc_id, t, unnest(range(1, len(t) + 1)) as i from (select doc_id, {TOKENS} as t from documents)))"
)
_ITEM = _SEQ.replace("seq as", "item as").replace("doc_id", "item_id").replace("from documents", "from eval_items")
_LM = (
    f"{_SEQ}, {_ITEM}, g as (select prev2, prev, token, count(*) as c3 from seq group by all), g12 as (select prev2, prev, sum(c3) as c12 from g group by all), b as (select prev, token, sum(c3) as c2 from g group by all),"
    " c as (select prev, sum(c3) as c1 from g group by all), u as (select token, sum(c3) as c0 from g group by all), z as (select sum(c0) as n, count(*) as v from u),"
    " loss as (select item_id, i, token, -ln(0.5 * coalesce(c3 / c12, 0) + 0.3 * coalesce(c2 / c1, 0) + 0.2 * (coalesce(c0, 0) + 1) / (n + v + 1)) as loss from item left join g using (prev2, prev, token)"
    " left join g12 using (prev2, prev) left join b using (prev, token) left join c using (prev) left join u using (token) cross join z)"
)


def _losses(spark, d):
    model = P.NgramModel(table(spark, d, "documents"))
    return model.score(P.sequences(table(spark, d, "eval_items"), "item_id")), model


@query(f"with {_LM} select item_id as doc_id, i::int as i, token, round(loss, 6) as loss from loss")
def token_surprisal(spark, d):
    s, _ = _losses(spark, d)
    return s.select("doc_id", "i", "token", r(F.col("loss")).alias("loss"))


# scoring by logits over a bounded vocabulary
_MODEL = (
    f"{_SEQ}, {_ITEM}, voc as (select token, row_number() over (order by count(*) desc, token) + 4 as id from seq group by token order by count(*) desc, token limit 500),"
    " coded as (select doc_id, i, coalesce(id, 0) as w from seq left join voc using (token)), pr as (select w, lag(w, 1, 1) over (partition by doc_id order by i) as v from coded), c as (select v, w, count(*) as n from pr group by all),"
    " s as (select v, sum(n) as s from c group by v), u as (select w, sum(n) as k from c group by w), z as (select sum(n) as t from c), ids as (select id as w from voc union all select 0), size as (select count(*) as m from ids),"
    " uni as (select w, (coalesce(k, 0) + 1) / (t + m) as q from ids left join u using (w), z, size), froms as (select w as v from ids union all select 1),"
    " p as (select v, w, case when s is null then q else 0.7 * coalesce(n, 0) / s + 0.3 * q end as p from froms cross join uni left join s using (v) left join c using (v, w)),"
    " it as (select item_id, i, token, coalesce(id, 0) as w from item left join voc using (token)),"
    " near as (select *, lag(w, 1, 1) over (partition by item_id order by i) as l, lead(w, 1, -1) over (partition by item_id order by i) as r from it)"
)
_MASKED = (
    f"{_MODEL}, ask as (select distinct l, r from near), joint as (select l, r, a.w, a.p * case when r = -1 then 1 else b.p end as q from ask join p a on a.v = l left join p b on b.v = a.w and b.w = r),"
    " dist as (select l, r, w, q / sum(q) over (partition by l, r) as q from joint), hs as (select l, r, -sum(q * ln(q + 1e-10)) as h from dist group by all),"
    " masked as (select item_id, i, token, l, r, near.w, -ln(q) as loss, q as prob, h from near join dist using (l, r, w) join hs using (l, r))"
)


def _counted(spark, d):
    return G.count_model(table(spark, d, "documents"))


@query(f"with {_MODEL}, h as (select v as l, -sum(p * ln(p + 1e-10)) as h from p group by v) select item_id as doc_id, i::int as i, token, round(-ln(p), 6) as loss, round(p, 6) as prob, round(h, 6) as entropy from near join p on v = l and p.w = near.w join h using (l)")
def causal_surprisal(spark, d):
    """Every token after those before it, in windows of 64."""
    s = G.score(table(spark, d, "eval_items"), _counted(spark, d), "causal", 64, key="item_id")
    return s.select("doc_id", "i", "token", *[r(F.col(c)).alias(c) for c in ("loss", "prob", "entropy")])


@query(f"with {_MASKED} select item_id as doc_id, i::int as i, token, round(loss, 6) as loss, round(prob, 6) as prob, round(h, 6) as entropy from masked")
def masked_surprisal(spark, d):
    """Every token masked in its window of 64."""
    s = G.score(table(spark, d, "eval_items"), _counted(spark, d), "masked", 64, key="item_id")
    return s.select("doc_id", "i", "token", *[r(F.col(c)).alias(c) for c in ("loss", "prob", "entropy")])


@query(f"with {_MODEL}, h as (select v as l, -sum(p * ln(p + 1e-10)) as h from p group by v) select item_id as doc_id, i::int as i, token, round(-ln(p), 6) as loss, round(h, 6) as entropy from near join p on v = l and p.w = near.w join h using (l) where i < 16")
def first_window_surprisal(spark, d):
    """The causal scores of the tokens that begin in the first window of 16, and no others."""
    s = G.score(table(spark, d, "eval_items"), _counted(spark, d), "causal", 16, key="item_id", first_window_only=True)
    return s.select("doc_id", "i", "token", r(F.col("loss")).alias("loss"), r(F.col("entropy")).alias("entropy"))


@query(f"with {_MASKED} select item_id as doc_id, round(avg(loss), 6) as mean_loss, round(avg(prob), 6) as mean_prob, round(avg(h), 6) as mean_entropy, round(coalesce(var_samp(loss), 0), 6) as var_loss, count(*) as n_tokens from masked group by item_id")
def doc_predictability(spark, d):
    e = table(spark, d, "eval_items")
    p = P.doc_predictability(G.score(e, _counted(spark, d), "masked", 64, key="item_id"), e, "item_id")
    return p.select("doc_id", *[r(F.col(c)).alias(c) for c in ("mean_loss", "mean_prob", "mean_entropy", "var_loss")], "n_tokens")


@query(f"with {_LM} select item_id as doc_id, round(avg(loss), 6) as mean_loss, round(avg(exp(-loss)), 6) as mean_prob, round(coalesce(var_samp(loss), 0), 6) as var_loss, count(*) as n_tokens from loss group by item_id")
def trigram_predictability(spark, d):
    s, _ = _losses(spark, d)
    p = P.doc_predictability(s)
    return p.select("doc_id", *[r(F.col(c)).alias(c) for c in ("mean_loss", "mean_prob", "var_loss")], "n_tokens")


@query(f"with {_MASKED} select item_id as doc_id, i::int as i, token, round(loss, 6) as loss from masked where item_id = (select min(item_id) from eval_items) and i = 3")
def token_lookup(spark, d):
    e = table(spark, d, "eval_items")
    first = e.agg(F.min("item_id")).first()[0]
    s = P.token_at(G.score(e.filter(F.col("item_id") == first), _counted(spark, d), "masked", 64, key="item_id"), first, 3)
    return s.select("doc_id", "i", "token", r(F.col("loss")).alias("loss"))


@query(f"with {_SEQ}, b as (select prev, token, count(*) as c from seq group by all) select prev, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) + 0.0 as entropy from b group by prev")
def context_entropy(spark, d):
    return P.NgramModel(table(spark, d, "documents")).entropy().select("prev", r(F.col("entropy")).alias("entropy"))


@query(f"with {_LM}, s as (select quantile_cont(loss, 0.9) as q from loss) select item_id as doc_id, i::int as i, token from loss, s where loss >= q")
def surprisal_threshold(spark, d):
    s, _ = _losses(spark, d)
    edge = s.agg(F.percentile("loss", F.lit(0.9)).alias("_q"))
    return with_one(s, edge).filter("loss >= _q").select("doc_id", "i", "token")


_AT = "(select doc_id, len(t) as n, unnest([0, len(t) // 2, len(t) - 1]) as i from (select doc_id, " + TOKENS + " as t from documents) where len(t) > 0)"


@query(
    " union all ".join(
        f"select doc_id, {k} as size, (case when i - {k // 2} < 0 then 0 when greatest(i + {k // 2}, i - {k // 2} + 1) > n then greatest(n - {k}, 0) else i - {k // 2} end)::int as start,"
        f" (case when i - {k // 2} < 0 then least({k}, n) when greatest(i + {k // 2}, i - {k // 2} + 1) > n then n else greatest(i + {k // 2}, i - {k // 2} + 1) end)::int as end_, i::int as i from {_AT}"
        for k in (1, 9, 64)
    )
)
def centred_window(spark, d):
    """Windows of 1, 9 and 64 around the first, the middle and the last token."""
    n = F.size(X.token_array(F.col("text")))
    t = table(spark, d, "documents").select("doc_id", n.alias("n")).filter("n > 0")
    t = t.select("doc_id", "n", F.explode(F.array(F.lit(0), F.floor(F.col("n") / 2).cast("int"), F.col("n") - 1)).alias("i"))
    out = []
    for k in (1, 9, 64):
        start, end = P.centred_window(F.col("n"), F.col("i"), k)
        out.append(F.struct(F.lit(k).alias("size"), start.cast("int").alias("start"), end.cast("int").alias("end_")))
    return t.select("doc_id", "i", F.inline(F.array(*out)))


@query("select doc_id, i, array_to_string(t[greatest(i - 8, 0) + 1:i], ' ') as context from (select doc_id, t, len(t) // 2 as i from (select doc_id, " + TOKENS + " as t from documents) where len(t) > 0)")
def causal_context(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.token_array(F.col("text")).alias("t")).filter(F.size("t") > 0)
    t = t.withColumn("i", F.floor(F.size("t") / 2).cast("int"))
    return t.select("doc_id", F.col("i").cast("long").alias("i"), F.array_join(P.causal_context(F.col("t"), F.col("i"), 8), " ").alias("context"))


def _starts(pattern: str, name: str) -> str:
    # a token's start: the lengths of all pieces before it, pieces being tokens and what lies between
    return (
        f"(select doc_id, row_number() over (partition by doc_id order by k) - 1 as {name}, start as char_start from (select doc_id, k, p, sum(length(p)) over (partition by doc_id order by k) - length(p) as start"
        rf" from (select doc_id, unnest(l) as p, unnest(range(len(l))) as k from (select doc_id, regexp_extract_all(text, '{pattern}|[ \t\n\f\r]') as l from eval))) where p not in (' ', chr(9), chr(10), chr(12), chr(13)))"
    )


@query(
    "with eval as (select item_id as doc_id, text from eval_items), w as " + _starts(r"\p{L}+|\p{N}+|[^ \t\n\f\r\p{L}\p{N}]", "i") + ", s as " + _starts(r"\p{L}{1,4}|\p{N}{1,3}|[^ \t\n\f\r\p{L}\p{N}]", "sub_i")
    + ", f as (select doc_id, char_start, min(sub_i) as first from s group by all) select doc_id, i, first, coalesce(lead(first) over (partition by doc_id order by first), first + 1) as end_ from w join f using (doc_id, char_start)"
)
def token_alignment(spark, d):
    """Words against pieces of up to four letters: the alignment of two tokenizers."""
    e = table(spark, d, "eval_items")

    def starts(pattern: str, out: str):
        piece = F.regexp_extract_all("text", F.lit(f"({pattern}|[ \\t\\n\\f\\r])"), F.lit(1))
        cum = F.aggregate(piece, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x)))
        z = F.arrays_zip(piece.alias("p"), cum.alias("s"))
        keep = F.filter(z, lambda x: x["p"].rlike(r"[^ \t\n\f\r]"))
        return e.select(F.col("item_id").alias("doc_id"), F.posexplode(keep).alias(out, "_z")).select("doc_id", F.col(out).cast("long").alias(out), F.col("_z.s").alias("char_start"))

    a = P.align(starts(r"\p{L}+|\p{N}+|[^ \t\n\f\r\p{L}\p{N}]", "i"), starts(r"\p{L}{1,4}|\p{N}{1,3}|[^ \t\n\f\r\p{L}\p{N}]", "sub_i"))
    return a.withColumnRenamed("end", "end_")


@query(f"with e as {ESSAYS}, q as (select quantile_cont(overall, 1 / 3) as a, quantile_cont(overall, 2 / 3) as b from e) select text_id_kaggle, case when overall is null then null when overall <= a then 'low' when overall <= b then 'mid' else 'high' end as tertile from e, q")
def tertile_bins(spark, d):
    return S.with_tertiles(clean_essays(spark, d), "overall").select("text_id_kaggle", "tertile")


@query(
    f"with e as {ESSAYS}, q as (select quantile_cont(overall, 1 / 3) as a, quantile_cont(overall, 2 / 3) as b from e), t as (select text_id_kaggle, case when overall <= a then 'low' when overall <= b then 'mid' else 'high' end as tertile from e, q where overall is not null)"
    " select text_id_kaggle, tertile from (select *, row_number() over (partition by tertile order by md5(text_id_kaggle || '42'), text_id_kaggle) as n from t) where n <= 333"
)
def stratified_sample(spark, d):
    t = S.with_tertiles(clean_essays(spark, d).filter("overall is not null"), "overall")
    return S.stratified(t, "tertile", "text_id_kaggle", 333).select("text_id_kaggle", "tertile")


_PILOT = "(select distinct on (row_id) * from pilot_metadata order by row_id, loaded_at)"
_PROF = f"trim(lower(prof_tertile), {WSC})"


def pilot(spark, d):
    """Each pilot row once; repeated deliveries are unchanged."""
    return table(spark, d, "pilot_metadata").dropDuplicates(["row_id"])


def prof() -> Column:
    return S.source_name(F.col("prof_tertile"))


@query(f"with p as {_PILOT}, e as {ESSAYS}, q as (select quantile_cont(overall, 0.667) as q from e), h as (select quantile_cont(surprisal, 0.9) as t from p join e on p.essay_id = e.text_id_kaggle, q where overall >= q) select row_id from p, h where surprisal >= t")
def high_surprisal_rows(spark, d):
    """Rows at or above the 90th percentile of the rows of the best essays."""
    p, e = pilot(spark, d), clean_essays(spark, d)
    q = e.agg(F.percentile("overall", F.lit(0.667)).alias("_q"))
    best = with_one(e, q).filter("overall >= _q").select(F.col("text_id_kaggle").alias("essay_id"))
    t = p.join(best, "essay_id").agg(F.percentile("surprisal", F.lit(0.9)).alias("_t"))
    return with_one(p, t).filter("surprisal >= _t").select("row_id")


@query(
    f"with {TOKEN_CTE}, w as (select doc_id, i, text, string_agg(text, ' ') over (partition by doc_id order by i rows between 10 preceding and 1 preceding) as left_context,"
    " string_agg(text, ' ') over (partition by doc_id order by i rows between 1 following and 10 following) as right_context, lemma from tokens) select doc_id, i, text, coalesce(left_context, '') as left_context, coalesce(right_context, '') as right_context from w where lemma = 'because'"
)
def kwic_concordance(spark, d):
    """Ten tokens around each hit, cut from the document's own token array in the pass that makes it: no shuffle."""
    hits = table(spark, d, "documents").filter(F.lower("text").contains("because"))
    return A.concordance(hits, "because", 10)


def kwic_sql(number: str = "1") -> str:
    """One concordance line; cells wider than their column are not cut, as in the layout."""
    wide = lambda c, n: f"case when length({c}) >= {n} then {c} else rpad({c}, {n}, ' ') end"
    pct = lambda k: f"floor(top3_probs[{k}] * 100 + 0.5)::bigint"
    guess = lambda k: wide(
        f"(case when len(top3_predicted) >= {k} and top3_predicted[{k}] is not null and top3_probs[{k}] is not null then trim(top3_predicted[{k}], {WSC}) || '(' || ({pct(k)} // 100) || '.' || lpad(({pct(k)} % 100)::varchar, 2, '0') || ')' else '' end)", 16
    )
    say = lambda c: f"coalesce({c}, '')"
    return (
        f"case when length(({number})::varchar) >= 3 then ({number})::varchar else lpad(({number})::varchar, 3, ' ') end || '  '"
        " || lpad(case when length(left_context) > 35 then '...' || right(left_context, 32) else coalesce(left_context, '') end, 35, ' ') || '  [' || rpad(repeat(' ', ((14 - length(left(coalesce(token_text, ''), 12))) // 2)::int) || left(coalesce(token_text, ''), 12), 14, ' ') || ']  '"
        " || rpad(case when length(right_context) > 35 then left(right_context, 32) || '...' else coalesce(right_context, '') end, 35, ' ') || '  ' || coalesce(printf('%5.2f', round(surprisal::decimal(12, 4), 2)::double), '     ') || '  '"
        f" || {wide(say('pos_tag'), 5)} || ' ' || {wide(say('dep_rel'), 7)} || ' ' || {wide(say('prof_tertile'), 5)} || ' ' || {guess(1)} || {guess(2)} || {guess(3)}"
    )


@query(f"select row_id, {kwic_sql('row_id')} as line from {_PILOT}")
def kwic_format(spark, d):
    return pilot(spark, d).select("row_id", X.kwic_line(F.col("row_id")).alias("line"))


@query(f"select row_id, surprisal from {_PILOT} where pos_tag in ('NOUN', 'VERB') and dep_rel in ('dobj', 'nsubj') and {_PROF} in ('low', 'mid') order by surprisal desc, row_id limit 50")
def concordance_filter(spark, d):
    """Filters first, then the limit: or within a filter, and across filters."""
    f = pilot(spark, d).filter(F.col("pos_tag").isin("NOUN", "VERB") & F.col("dep_rel").isin("dobj", "nsubj") & prof().isin("low", "mid"))
    return f.orderBy(F.desc("surprisal"), "row_id").limit(50).select("row_id", "surprisal")


@query(f"select row_id, surprisal from (select * from {_PILOT} order by surprisal desc, row_id limit 200) where pos_tag = 'NOUN'")
def limit_then_filter(spark, d):
    """The limit first, then the filter: may give fewer rows."""
    return pilot(spark, d).orderBy(F.desc("surprisal"), "row_id").limit(200).filter("pos_tag = 'NOUN'").select("row_id", "surprisal")


@query(f"select essay_id, list_sort(list(distinct spacy_idx)) as targets, count(*) as n from {_PILOT} where surprisal >= 5 group by essay_id")
def target_sets(spark, d):
    return pilot(spark, d).filter("surprisal >= 5").groupBy("essay_id").agg(F.sort_array(F.collect_set("spacy_idx")).alias("targets"), F.count(F.lit(1)).alias("n"))


@query(f"select distinct essay_id from {_PILOT} p where not exists (select 1 from ellipse_final_github e where e.text_id_kaggle = p.essay_id)")
def missing_essays(spark, d):
    e = table(spark, d, "ellipse_final_github").select(F.col("text_id_kaggle").alias("essay_id"))
    return pilot(spark, d).select("essay_id").distinct().join(e, "essay_id", "left_anti")


@query(f"with p as {_PILOT} select (select count(*) from pilot_metadata) as delivered, (select count(*) from p) as rows, (select count(distinct row_id) from pilot_deltas) as vectors, (select count(*) from p where row_id not in (select row_id from pilot_deltas)) as rows_without_vector")
def reconcile_counts(spark, d):
    m = table(spark, d, "pilot_metadata").groupBy("row_id").agg(F.count(F.lit(1)).alias("_m"))
    v = table(spark, d, "pilot_deltas").groupBy("row_id").agg(F.count(F.lit(1)).alias("_v"))
    b = m.join(v, "row_id", "full")
    return b.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("delivered"), F.count("_m").alias("rows"), F.count("_v").alias("vectors"), F.count_if(F.col("_m").isNotNull() & F.col("_v").isNull()).alias("rows_without_vector"))


@query("with t as (select row_id, unnest(list_transform(range(1, len(top3_probs) + 1), lambda k: struct_pack(rank := k, token := top3_predicted[k], p := top3_probs[k])), recursive := true) from (select distinct on (row_id) * from pilot_metadata order by row_id, loaded_at)) select row_id, rank::int as rank, token, round(p / sum(p) over (partition by row_id), 6) as p from t")
def top_predictions(spark, d):
    """The three predictions as rows, renormalised inside the row's own arrays."""
    total = F.aggregate("top3_probs", F.lit(0.0), lambda a, x: a + x)
    z = pilot(spark, d).select("row_id", F.posexplode("top3_probs").alias("k", "q"), total.alias("total"), "top3_predicted")
    return z.select("row_id", (F.col("k") + 1).alias("rank"), F.get("top3_predicted", F.col("k")).alias("token"), r(F.try_divide("q", "total")).alias("p"))


@query(f"select row_id, surprisal, round(exp(-surprisal), 9) as prob from {_PILOT} where surprisal is not null and isfinite(surprisal)")
def surprisal_to_prob(spark, d):
    return pilot(spark, d).filter(F.col("surprisal").isNotNull() & ~F.isnan("surprisal") & (F.abs("surprisal") < float("inf"))).select("row_id", "surprisal", F.round(F.exp(-F.col("surprisal")), 9).alias("prob"))


_E = "(select vec_id, unnest(embedding)::double as x, unnest(range(64)) as k from embeddings)"


@query(
    f"with {_MASKED}, hit as (select * from masked where loss >= 8), cand as (select item_id, i, dist.w, q, row_number() over (partition by item_id, i order by round(q, 12) desc, dist.w) as n from hit join dist using (l, r)),"
    " best as (select item_id, i, w, q / sum(q) over (partition by item_id, i) as q from cand where n <= 50), ne as (select count(*) as m from embeddings), "
    f" e as (select row_number() over (partition by k order by vec_id) - 1 as pos, k, x from {_E}), exp_ as (select item_id, i, k, sum(q * x) as e from best cross join ne join e on pos = w % m group by all)"
    " select item_id as doc_id, hit.i::int as i, token, round(loss, 6) as loss, k::int as k, round(exp_.e - e.x, 6) as x from hit join exp_ using (item_id, i) cross join ne join e using (k) where e.pos = hit.w % m"
)
def transformation_vectors(spark, d):
    """Expected minus observed embedding of the tokens of high masked surprisal; a word's embedding is the row of its number, going round."""
    e = np.array([x["embedding"] for x in table(spark, d, "embeddings").orderBy("vec_id").limit(600).collect()])  # no more rows than words
    m = _counted(spark, d)
    t = G.transformation_vectors(table(spark, d, "eval_items"), m, e[np.arange(len(m.words)) % len(e)], 8.0, key="item_id")
    return t.select("doc_id", "i", "token", r(F.col("loss")).alias("loss"), F.posexplode("delta").alias("k", "x")).withColumn("x", r(F.col("x")))


@query(f"with {_MASKED}, hit as (select * from masked where loss >= 8), cand as (select item_id, i, dist.w, q, row_number() over (partition by item_id, i order by round(q, 12) desc, dist.w) as n from hit join dist using (l, r)) select item_id as doc_id, i::int as i, n::int as rank, coalesce(token, '<unk>') as word, round(q, 6) as p from cand left join voc on id = w where n <= 3")
def predicted_words(spark, d):
    """The three most probable words at the tokens of high masked surprisal."""
    m = _counted(spark, d)
    t = G.transformation_vectors(table(spark, d, "eval_items"), m, np.zeros((len(m.words), 1)), 8.0, key="item_id")
    z = t.select("doc_id", "i", F.posexplode(F.arrays_zip("top_predicted", "top_probs")).alias("n", "z"))
    return z.select("doc_id", "i", (F.col("n") + 1).alias("rank"), F.col("z.top_predicted").alias("word"), r(F.col("z.top_probs")).alias("p"))
