"""Queries over documents: sampling, cleaning, verification, frequency tables; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import annotate as A
from corpusmill.operators import collate as C
from corpusmill.operators import sampling as S
from corpusmill.operators import verify as Q
from corpusmill.shared import shared_dir, ws_count
from corpusmill.streaming import budget

Q_: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        k = name or f.__name__
        Q_[k] = f
        if sql:
            SQL[k] = sql
        return f

    return add


# what the SQL repeats: white space as Python has it, in RE2
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WSC = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
N_WS = f"coalesce(len(list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda x: x <> '')), 0)"
NAME = f"trim(lower(source), {WSC})"
DOCS = f"(select *, {NAME} as name, {N_WS} as token_count from documents)"
SPEC = f"(select * from {DOCS} join source_spec using (name))"


def _docs(spark, d):
    return table(spark, d, "documents")


def _named(spark, d):
    return _docs(spark, d).withColumn("name", S.source_name(F.col("source"))).withColumn("token_count", ws_count(F.col("text")))


def _spec(spark, d):
    return S.with_spec(_docs(spark, d), table(spark, d, "source_spec"))


@query(f"select doc_id, {N_WS}::bigint as n_tokens from documents")
def ws_token_count(spark, d):
    return _docs(spark, d).select("doc_id", ws_count(F.col("text")).alias("n_tokens"))


@query(f"select doc_id, name, token_count::bigint as token_count from {SPEC} where token_count >= min_doc_tokens")
def length_filter(spark, d):
    return _spec(spark, d).filter(S.long_enough()).select("doc_id", "name", "token_count")


_META = "case when json_valid(metadata) then metadata->>'$.{}' end"
_DOMAIN = (
    f"(len(domain_filter) = 0 or coalesce(len(list_filter(domain_filter, lambda x: contains(coalesce({_META.format('url')}, url, ''), x)"
    f" or contains(coalesce({_META.format('source_domain')}, ''), x))) > 0, false))"
)


@query(f"select doc_id, name from {SPEC} where {_DOMAIN}")
def domain_filter(spark, d):
    return _spec(spark, d).filter(S.in_domains()).select("doc_id", "name")


_STARTS = " or ".join(f"starts_with(b, '{x}')" for x in X.CODE_STARTS)
_CODE = (
    "(select doc_id, sum(length(b)) as n, sum(case when starts_with(line, '    ') or starts_with(line, chr(9)) or " + _STARTS + " then length(b) else 0 end) as code"
    f" from (select doc_id, line, regexp_replace(line, '^[{WS}]+|[{WS}]+$', '', 'g') as b from (select doc_id, unnest(regexp_split_to_array(text, "
    r"'\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')) as line from documents)) group by doc_id)"
)


@query(f"select doc_id, case when n > 0 then code / n end as fraction from documents left join {_CODE} using (doc_id)")
def code_fraction(spark, d):
    return _docs(spark, d).select("doc_id", X.code_fraction(F.col("text")).alias("fraction"))


@query(f"select s.doc_id from {SPEC} s left join {_CODE} c using (doc_id) where max_code_fraction is null or coalesce(code / nullif(n, 0) <= max_code_fraction, false)")
def code_filter(spark, d):
    return _spec(spark, d).filter(S.little_code()).select("doc_id")


def _md5_mod(x: str) -> str:
    c = [f"(('0x' || substr(md5({x}), {1 + 8 * i}, 8))::bigint)" for i in range(4)]
    return f"((({c[0]} % 10000 * 7296 + {c[1]}) % 10000 * 7296 + {c[2]}) % 10000 * 7296 + {c[3]}) % 10000"


@query(f"select doc_id, {_md5_mod('doc_id::varchar || 42')} as bucket from documents where {_md5_mod('doc_id::varchar || 42')} < 2500")
def hash_accept(spark, d):
    k = F.concat(F.col("doc_id").cast("string"), F.lit("42"))
    return _docs(spark, d).filter(S.accept_by_hash(F.col("doc_id"), 2500)).select("doc_id", X.md5_mod(k).alias("bucket"))


_BUDGET = (
    "(select *, sum(token_count) over (partition by name order by md5(doc_id::varchar || '42'), doc_id rows unbounded preceding) - token_count as tokens_before"
    f" from {SPEC} where token_count >= min_doc_tokens and {_DOMAIN})"
)


@query(f"select name, doc_id, token_count::bigint as token_count, tokens_before::bigint as tokens_before from {_BUDGET} where tokens_before < floor(target_tokens * 1.05)")
def token_budget_sample(spark, d):
    return S.token_budget(_spec(spark, d).filter(S.long_enough() & S.in_domains()))


@query(f"select name, count(*) as docs, sum(token_count)::bigint as tokens, round(100 * sum(token_count) / any_value(target_tokens), 2) as pct from {_BUDGET} where tokens_before < floor(target_tokens * 1.05) group by name")
def sampling_summary(spark, d):
    kept = token_budget_sample(spark, d).join(F.broadcast(table(spark, d, "source_spec").select("name", "target_tokens")), "name")
    share = F.round(100 * F.sum("token_count") / F.first("target_tokens"), 2)
    return kept.groupBy("name").agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"), share.alias("pct"))


_PII = "text"
for _k, _v in X.PII.items():
    _PII = f"replace({_PII}, '{_k}', '{_v}')"


@query(f"select doc_id, {_PII} as text from documents where contains(text, '|||')")
def pii_replace(spark, d):
    return _docs(spark, d).filter(F.contains("text", F.lit("|||"))).select("doc_id", X.replace_pii(F.col("text")).alias("text"))


_HWS = WS.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")
CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({_PII}), '[{_HWS}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query(f"select doc_id, md5({CLEAN}) as digest, length({CLEAN})::int as n_chars from documents")
def clean_text(spark, d):
    c = _docs(spark, d).select("doc_id", X.clean_text(F.col("text")).alias("t"))
    return c.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


_CLEANED = f"(select doc_id, dolma_id, {NAME} as name, text, {N_WS} as token_count from (select * replace ({CLEAN} as text) from documents))"


def _cleaned(spark, d):
    c = _docs(spark, d).withColumn("text", X.clean_text(F.col("text"))).withColumn("name", S.source_name(F.col("source")))
    return c.withColumn("token_count", ws_count(F.col("text")))


@query(
    f"select name, count_if(token_count >= 50)::bigint as docs, coalesce(sum(token_count) filter (where token_count >= 50), 0)::bigint as tokens, count_if(token_count < 50)::bigint as dropped,"
    f" grouping(name)::int as is_total from {_CLEANED} group by rollup (name)"
)
def preprocess_summary(spark, d):
    return Q.preprocess_summary(_cleaned(spark, d), 50)


@query(f"select doc_id, {_META.format('source_domain')} as domain, {_META.format('register')} as register, round(try_cast({_META.format('lang_score')} as double), 6) as lang_score from documents")
def json_metadata_parse(spark, d):
    v = F.try_parse_json("metadata")
    return _docs(spark, d).select(
        "doc_id", F.try_variant_get(v, "$.source_domain", "string").alias("domain"), F.try_variant_get(v, "$.register", "string").alias("register"),
        F.round(F.try_variant_get(v, "$.lang_score", "double"), 6).alias("lang_score"),
    )


@query("select doc_id, row_number() over (order by doc_id) - 1 as position, (row_number() over (order by doc_id) - 1) % 8 as worker from documents")
def stride_partition(spark, d):
    return S.strides(_docs(spark, d), "doc_id", 8)


@query("select doc_id from documents where trim(text) <> ''")
def drop_null_blank(spark, d):
    return _docs(spark, d).filter(F.trim("text") != "").select("doc_id")


TOKENS = r"regexp_extract_all(lower(text), '\p{L}+|\p{N}+|[^ \t\n\f\r\p{L}\p{N}]')"


def _ngram_sql(n: int, least: int) -> str:
    keys = ", ".join(f"token_{k}" for k in range(n))
    cols = ", ".join(f"t[i + {k}] as token_{k}" for k in range(n))
    pad = "".join("list_append(" for _ in range(n - 1)) + "[]::varchar[]" + ", '#')" * (n - 1)
    return f"select {keys}, count(*) as count from (select {cols} from (select t, unnest(range(1, len(t) - {n - 2})) as i from (select list_concat({pad}, {TOKENS}) as t from documents))) group by all having count(*) >= {least}"


for _n in (1, 2, 3):
    query(_ngram_sql(_n, 2), f"ngram_counts_{_n}")(lambda spark, d, n=_n: C.ngram_counts(_docs(spark, d), n, 2))

_MERGED = "select corpus, token_0, token_1, token_2, sum(count)::bigint as count from trigrams where count >= 1 group by all having sum(count) >= 2"


def _merged(spark, d):
    return C.merge_partials(table(spark, d, "trigrams").filter("count >= 1"), ["corpus", "token_0", "token_1", "token_2"], 2)


@query(_MERGED)
def ngram_partial_merge(spark, d):
    return _merged(spark, d)


@query(f"select token_2, sum(count)::bigint as count from ({_MERGED}) group by token_2")
def unigram_marginal(spark, d):
    return C.marginal(_merged(spark, d), ["token_2"])


@query(f"select token_0, token_1, token_2, count from ({_ngram_sql(3, 1)}) order by count desc, token_0, token_1, token_2 limit 20")
def top_k_ngrams(spark, d):
    return C.top(C.ngram_counts(_docs(spark, d), 3), ["token_0", "token_1", "token_2"])


@query(f"select token_0, token_1, token_2, sum(count)::bigint as count from ({_MERGED}) group by all")
def corpus_union_norms(spark, d):
    """Both corpora's tables, each held to its floor, then summed."""
    m = _merged(spark, d)
    a, b = m.filter("corpus = 'a'").drop("corpus"), m.filter("corpus != 'a'").drop("corpus")
    return C.marginal(a.unionByName(b), ["token_0", "token_1", "token_2"])


@query("select head_lemma, dependent_lemma, relation, sum(count)::bigint as count from depgrams where count >= 1 group by all")
def depgram_collapse_tags(spark, d):
    return C.marginal(table(spark, d, "depgrams").filter("count >= 1"), ["head_lemma", "dependent_lemma", "relation"])


_DEP = "(select head_lemma, dependent_lemma, relation, sum(count)::bigint as count from depgrams where count >= 1 group by all)"


@query(
    f"select 'head' as side, head_lemma as lemma, sum(count)::bigint as count from {_DEP} group by all union all select 'dependent', dependent_lemma, sum(count)::bigint from {_DEP} group by all"
    f" union all select 'total', null, sum(count)::bigint from {_DEP}"
)
def mi_marginals(spark, d):
    """All three marginals in one pass over grouping sets."""
    g = table(spark, d, "depgrams").filter("count >= 1")
    sets = g.groupingSets([["head_lemma"], ["dependent_lemma"], []], "head_lemma", "dependent_lemma")
    h, e = F.grouping("head_lemma") == 0, F.grouping("dependent_lemma") == 0
    per = sets.agg(h.alias("_h"), e.alias("_e"), F.sum("count").alias("count"))
    side = F.when(F.col("_h"), "head").when(F.col("_e"), "dependent").otherwise("total")
    return per.select(side.alias("side"), F.when(F.col("_h"), F.col("head_lemma")).when(F.col("_e"), F.col("dependent_lemma")).alias("lemma"), "count")


@query(f"select doc_id, floor((sum(n) over (order by doc_id rows unbounded preceding) - n) / 20000)::bigint as file from (select doc_id, {N_WS} as n from documents)")
def token_file_buckets(spark, d):
    return C.file_buckets(_named(spark, d), 20_000)


@query(f"select count(*) as n_types, sum(count)::bigint as n_tokens, max(count)::bigint as most from ({_MERGED})")
def collate_verify(spark, d):
    return C.table_report(_merged(spark, d))


_AT = "list_sort(list(token_count))[(least(floor(count(*) * {}), count(*) - 1) + 1)::int]"


@query(
    "select name, count(*) as docs, sum(token_count)::bigint as tokens, round(100 * sum(token_count) / any_value(target_tokens), 2) as pct_of_target,"
    " round(100 * sum(token_count) / any_value(target_tokens) - 100, 2) as deviation_pct, abs(100 * sum(token_count) / any_value(target_tokens) - 100) <= 5 as within_5pct,"
    f" round(sum(token_count) / count(*), 1) as mean_tokens, median(token_count) as median, {_AT.format(0.05)}::bigint as p5, {_AT.format(0.95)}::bigint as p95,"
    f" count_if(token_count < 100)::bigint as below_min from {SPEC} group by name"
)
def verify_source_stats(spark, d):
    return Q.source_stats(_named(spark, d), table(spark, d, "source_spec"), 100)


@query(
    "with f as (select count_if(contains(text, '|||'))::bigint as pii_remaining, count_if(coalesce(trim(text), '') = '')::bigint as empty_docs, count(*) - count(distinct coalesce(dolma_id, '')) as duplicate_ids from documents),"
    " g as (select *, list_filter([case when pii_remaining > 0 then 'pii_remaining: ' || pii_remaining end, case when empty_docs > 0 then 'empty_docs: ' || empty_docs end,"
    " case when duplicate_ids > 0 then 'duplicate_ids: ' || duplicate_ids end], lambda x: x is not null) as l from f)"
    " select pii_remaining, empty_docs, duplicate_ids, array_to_string(l, '; ') as issues, len(l) = 0 as passed from g"
)
def verify_flags(spark, d):
    return Q.flags(_docs(spark, d))


@query("select dolma_id, count(*) as n from documents where dolma_id is not null group by dolma_id having count(*) > 1")
def duplicate_ids(spark, d):
    return _docs(spark, d).filter("dolma_id is not null").groupBy("dolma_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("select md5(text) as digest, min(doc_id) as first_doc, count(*) as copies from documents where text is not null group by text having count(*) > 1")
def duplicate_texts(spark, d):
    """Grouped by digest: the texts themselves aren't shuffled."""
    return _docs(spark, d).filter("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query(
    f"select name, doc_id, replace(substr(text, 1, 200), chr(10), ' ') as preview from (select *, row_number() over (partition by name order by md5(doc_id::varchar || '42'), doc_id) as n from {DOCS}) where n <= 10"
)
def sample_preview(spark, d):
    return Q.preview(_named(spark, d))


@query(r"select doc_id, regexp_replace(text, '(?is)\n[ \t]*(references|bibliography|works cited)[ \t]*:?[ \t]*(\n.*)?$', '') as text from documents where contains(lower(text), 'references')")
def references_cut(spark, d):
    return _docs(spark, d).filter(F.contains(F.lower("text"), F.lit("references"))).select("doc_id", X.before_references(F.col("text")).alias("text"))


@query(f"select case when token_count < 100 then 'short' when token_count < 500 then 'medium' else 'long' end as stratum, count(*) as docs, sum(token_count)::bigint as tokens from {DOCS} where token_count >= 20 group by 1")
def length_strata(spark, d):
    n = F.col("token_count")
    s = F.when(n < 100, "short").when(n < 500, "medium").otherwise("long")
    return _named(spark, d).filter(n >= 20).groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clean, tokenise, count trigrams (at least 2), sum over the last word, and list the most frequent words."""
    clean = _docs(spark, d).withColumn("text", X.clean_text(F.col("text")))
    return C.top(C.marginal(C.ngram_counts(clean, 3, 2), ["token_2"]), ["token_2"])


_CLEAN_TRI = _ngram_sql(3, 2).replace("from documents", f"from (select {CLEAN} as text from documents)")
query(f"select token_2, sum(count)::bigint as count from ({_CLEAN_TRI}) group by token_2 order by count desc, token_2 limit 20", "flagship_unigrams")(flagship)

# the token table in SQL: the rules of the built-in annotator
_WORDS = " ".join(f"when lemma in ({', '.join(repr(w) for w in ws)}) then '{p}'" for p, ws in A.LEXICON.items())
_ENDS = " ".join("when " + " or ".join(f"ends_with(lemma, '{e}')" for e in ends) + f" then '{p}'" for p, ends in A.SUFFIXES)
TOKEN_CTE = rf"""
sents as (select doc_id, unnest(p) as sent, unnest(range(len(p))) as part from (select doc_id, regexp_split_to_array(text, '[.!?]+(?:[ \t\n\f\r]+|$)|\n+') as p from documents where text <> '')),
split as (select doc_id, part, regexp_extract_all(sent, '\p{{L}}+|\p{{N}}+|[^ \t\n\f\r\p{{L}}\p{{N}}]') as toks from sents),
full_ as (select doc_id, toks, row_number() over (partition by doc_id order by part) - 1 as sent_i, coalesce(sum(len(toks)) over (partition by doc_id order by part rows between unbounded preceding and 1 preceding), 0) as base from split where len(toks) > 0),
raw as (select doc_id, sent_i, base, unnest(toks) as text, unnest(range(len(toks))) as k from full_),
typed as (select *, lower(text) as lemma, regexp_matches(text, '^\p{{L}}') as is_alpha, not regexp_matches(text, '^[\p{{L}}\p{{N}}]') as is_punct from raw),
tagged as (select *, case when is_punct then 'PUNCT' when not is_alpha then 'NUM' {_WORDS} {_ENDS} else 'NOUN' end as pos from typed),
placed as (select *, case when pos = 'NOUN' and ends_with(lemma, 's') then 'NNS' when pos = 'VERB' and ends_with(lemma, 'ed') then 'VBD' else pos end as tag from tagged),
headed as (select *, case when not is_punct then struct_pack(k := k, lemma := lemma, tag := tag, pos := pos) end as word, struct_pack(k := k, lemma := lemma, tag := tag, pos := pos) as own from placed),
sides as (select *, last_value(word ignore nulls) over (s rows between unbounded preceding and 1 preceding) as prev, first_value(word ignore nulls) over (s rows between 1 following and unbounded following) as next
 from headed window s as (partition by doc_id, sent_i order by k)),
linked as (select *, case when is_punct then coalesce(prev, next, own) when prev is null then own when pos in ('DET', 'ADJ', 'NUM') and next is not null then next else prev end as head from sides),
tokens as (select doc_id, sent_i, (base + k)::int as i, text, lemma, pos, tag, is_alpha, is_punct, (base + head.k)::int as head_i, head.lemma as head_lemma, head.tag as head_tag, head.pos as head_pos,
 case when is_punct then 'punct' when prev is null then 'ROOT' when pos = 'NOUN' then case head.pos when 'VERB' then 'dobj' when 'NOUN' then 'compound' else 'pobj' end
 when pos = 'DET' then 'det' when pos = 'ADJ' then 'amod' when pos = 'NUM' then 'nummod' when pos = 'ADV' then 'advmod' when pos = 'AUX' then 'aux' when pos = 'VERB' then 'conj' when pos = 'ADP' then 'prep' when pos = 'CCONJ' then 'cc' else 'nsubj' end as dep
 from linked)"""


def tokens_of(spark: SparkSession, d: str) -> DataFrame:
    """The stored token table of the documents."""
    return A.stored_tokens(_docs(spark, d))


_ROW = ["sent_i", "i", "text", "lemma", "pos", "tag", "dep", "head_i", "head_lemma", "head_tag", "head_pos"]


@query(
    f"with {TOKEN_CTE} select doc_id, count(*) as n_tokens, count_if(is_alpha) as n_alpha, count_if(is_punct) as n_punct,"
    f" sum(('0x' || substr(md5({' || chr(9) || '.join(c + '::varchar' for c in _ROW)}), 1, 12))::bigint)::bigint as digest from tokens group by doc_id"
)
def token_table(spark, d):
    """A digest of every document's token rows: the sum of the rows' hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\t", *[F.col(c).cast("string") for c in _ROW])), 1, 12), 16, 10).cast("long")
    return tokens_of(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if("is_alpha").alias("n_alpha"), F.count_if("is_punct").alias("n_punct"), F.sum(h).alias("digest"))


@query(
    f"with {TOKEN_CTE} select head_lemma, head_tag, dep as relation, lemma as dependent_lemma, tag as dependent_tag, count(*) as count"
    " from tokens where dep not in ('ROOT', 'punct') group by all having count(*) >= 2"
)
def depgram_counts(spark, d):
    return C.merge_partials(A.dependency_pairs(_docs(spark, d)), C.DEPGRAM, 2)


@query("select name, target_tokens from source_spec where corpus = 'a'")
def spec_selection(spark, d):
    return S.select_specs(table(spark, d, "source_spec"), corpus="a").select("name", "target_tokens")


@query("select doc_id from documents order by md5(doc_id::varchar || '42'), doc_id limit 100")
def hash_sample(spark, d):
    return S.hash_sample(_docs(spark, d), "doc_id", 100).select("doc_id")


@query("select md5(full_text) as digest, prompt, case when isnan(overall) then null else overall end as overall from ellipse_final_github where trim(full_text) <> ''")
def essay_pairs(spark, d):
    p = S.text_pairs(table(spark, d, "ellipse_final_github"), "full_text", ["prompt", "overall"])
    return p.select(F.md5("text").alias("digest"), "meta.prompt", F.nanvl("meta.overall", F.lit(None).cast("double")).alias("overall"))


@query(_ngram_sql(2, 1))
def streaming_ngram_counts(spark, d):
    """The bigram counts as a Structured Streaming query over the documents' files, run until they are used up."""
    docs = budget.documents(spark, f"{d}/documents.parque[t]", "text string")  # a pattern: the table may be a file or a folder
    return budget.collect_ngrams(docs, 2, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")


_TARGET = 5_000


@query(f"select source, doc_id, n as token_count, before as tokens_before from (select source, doc_id, {N_WS}::bigint as n, (sum({N_WS}) over (partition by source order by doc_id rows unbounded preceding) - {N_WS})::bigint as before from documents where source in ('wiki', 'reddit', 'pes2o')) where before < {int(_TARGET * 1.05)}")
def streaming_token_budget(spark, d):
    """The token budget as a stateful stream; all files are of one trigger, in which documents come by their key."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = budget.documents(spark, f"{d}/documents.parque[t]", "doc_id long, text string, source string", files_per_trigger=1_000_000)
    kept = budget.running_budget(docs, dict.fromkeys(("wiki", "reddit", "pes2o"), _TARGET))
    kept.writeStream.format("parquet").option("path", f"{home}/kept").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{home}/kept")


@query(f"select count(*) as n_types, sum(count)::bigint as n_tokens from ({_ngram_sql(1, 1)})")
def token_types(spark, d):
    return C.table_report(C.ngram_counts(_docs(spark, d), 1)).select("n_types", "n_tokens")


@query(f"select token_0, count from ({_ngram_sql(1, 1)}) order by count desc, token_0 limit 10")
def approximate_top_words(spark, d):
    """The ten most frequent words by a sketch of 20,000 counters a task, which is exact while a task sees fewer distinct words."""
    t = C.approximate_top(C.ngrams(_docs(spark, d), 1), ["token_0"], 10, 20_000)
    return t.select(F.col("item").alias("token_0"), "count")
