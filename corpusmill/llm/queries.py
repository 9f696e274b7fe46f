"""Queries pN_ over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import clusters, encoding, frequencies, leakage, mixing, neardups, proportions, vectors
from corpusmill.shared import shared_dir, strip_ws, ws_count

Query = Callable[[SparkSession, str], DataFrame]

TRIGRAM_KEY = ("shard", "corpus", "token_0", "token_1", "token_2")
DEPGRAM_KEY = ("shard", "corpus", "head_lemma", "head_tag", "relation", "dependent_lemma", "dependent_tag")
TRIGRAM_FIELDS = {"trigrams.token_2": "token_2"}
DEPGRAM_FIELDS = {"depgrams.head_lemma": "head_lemma", "depgrams.dependent_lemma": "dependent_lemma"}


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The counted records of sample_plans: field, category, key."""
    e = frequencies.latest_rows(_read(spark, d, "ellipse_final_github"), ["text_id_kaggle"], "overall", "loaded_at")
    grid = [x / 2 for x in range(2, 11)]
    e = e.filter(F.col("overall").isin(grid)).select(
        F.lit("overall").alias("field"), F.format_number("overall", 1).alias("category"), F.col("text_id_kaggle").alias("key")
    )
    p = _read(spark, d, "pilot_metadata").select("row_id", strip_ws(F.lower("prof_tertile")).alias("category"))
    p = p.groupBy("row_id").agg(F.min("category").alias("category")).filter(F.col("category").isin("low", "mid", "high"))
    return e.unionByName(p.select(F.lit("prof_tertile").alias("field"), "category", F.col("row_id").cast("string").alias("key")))


def p1_found(spark, d):
    _, report = proportions.sample_to_targets(_records(spark, d), _read(spark, d, "sample_plans"))
    return report.filter("unmet").select("plan_id", "category")


def p1_sample(spark, d):
    sample, _ = proportions.sample_to_targets(_records(spark, d), _read(spark, d, "sample_plans"))
    return sample


def p1_report(spark, d):
    _, report = proportions.sample_to_targets(_records(spark, d), _read(spark, d, "sample_plans"))
    return report


def p1_targets(spark, d):
    """What the report says of every category but the draw itself."""
    return p1_report(spark, d).select("plan_id", "category", F.round("required", 6).alias("required"), "available", "unmet")


def p2_found(spark, d):
    return clusters.linked_clusters(_read(spark, d, "pilot_deltas"), 0.33, 10).select(F.col("key").alias("row_id"), "cluster_id")


def p2_clusters(spark, d):
    """Clusters of the condensed hierarchy with core distances of 5 neighbours, and the pos_tag values of their rows."""
    got = clusters.density_forest(_read(spark, d, "pilot_deltas"), 0.25, min_samples=5)
    members, found = clusters.condensed_clusters(got[0], 10)
    tags = _read(spark, d, "pilot_metadata").select(F.col("row_id").alias("key"), F.col("pos_tag").alias("tag"))
    return clusters.describe(members, found, tags)


def _links(spark, d):
    """Sets of 3-word runs at 0.5: 42 bands of 3 rows find a pair at the threshold with probability 0.996."""
    return neardups.near_duplicates(_read(spark, d, "documents"), threshold=0.5, size=3, min_words=20, bands=42, band_rows=3, multiset=False)


def p3_found(spark, d):
    return neardups.expand(*_links(spark, d)).select("doc_id_a", "doc_id_b")


def p3_classes(spark, d):
    docs = _read(spark, d, "documents")
    return neardups.duplicate_classes(*neardups.near_duplicates(docs), docs=docs)


def p4_found(spark, d):
    n = vectors.close_neighbours(_read(spark, d, "pilot_deltas"), 5, 0.70)
    return n.select(F.least("key", "neighbour").alias("row_id_a"), F.greatest("key", "neighbour").alias("row_id_b")).distinct()


def p4_neighbours(spark, d):
    """The 10 most similar rows of every row whose id is divisible by 50."""
    v = _read(spark, d, "pilot_deltas")
    return vectors.search(v, v.filter("row_id % 50 = 0"), 10)


def _tables(spark, d):
    return [(_read(spark, d, "trigrams"), TRIGRAM_KEY, TRIGRAM_FIELDS), (_read(spark, d, "depgrams"), DEPGRAM_KEY, DEPGRAM_FIELDS)]


def _kept(spark, tables):
    """Counts of the tables' fields after a first load (deliveries before 2025 or of no date) and one increment (the rest), from the kept state."""
    out = None
    for t, key, fields in tables:
        home = f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}"
        rows, counts = frequencies.kept_rows(spark, f"{home}/rows", fields), frequencies.kept_counts(spark, f"{home}/counts")
        late = F.expr("coalesce(loaded_at >= timestamp'2025-01-01', false)")
        for part in (t.filter(~late), t.filter(late)):
            frequencies.apply_delivery(rows, counts, part, key, fields)
        c = counts.read().drop("bucket")
        out = c if out is None else out.unionByName(c)
    return out


def p5_found(spark, d):
    return frequencies.mark_terms(_kept(spark, _tables(spark, d))).filter(F.col("mark").isNotNull()).select("field", "term", "mark")


def p5_counts(spark, d):
    """A recount from scratch."""
    return frequencies.count_terms(_tables(spark, d))


def p5_incremental(spark, d):
    """The field of the trigrams; p5_increments has all three."""
    return _kept(spark, _tables(spark, d)[:1])


def p5_increments(spark, d):
    return _kept(spark, _tables(spark, d))


def _leaks(spark, d, **more):
    return leakage.find_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"), 12, **more)


def p6_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_cleaned(spark, d):
    """The leaking documents, dropped or with the leaked passages cut out."""
    return leakage.clean_leaks(_leaks(spark, d, keep_text=True))


def p6_report(spark, d):
    """The test items that leaked."""
    return leakage.leak_report(_leaks(spark, d))


def _white_sized(spark, d):
    return mixing.sized(_read(spark, d, "documents"), ws_count)


def p7_found(spark, d):
    report = mixing.mix_report(mixing.length_histogram(_white_sized(spark, d)), _read(spark, d, "source_mix"))
    return report.filter("unmet").select("mix_id", "source")


def p7_targets(spark, d):
    """Targets and sizes by white-space tokens, and whether the plan keeps to its target."""
    r = mixing.mix_report(mixing.length_histogram(_white_sized(spark, d)), _read(spark, d, "source_mix"))
    kept = F.col("tokens") <= F.col("target") + 1e-6
    return r.select("mix_id", "source", F.round("target", 4).alias("target"), "size", F.col("capacity").cast("long").alias("capacity"), "unmet", kept.alias("fitted"))


def _bpe_sized(spark, d):
    import public_tokenizers

    ranks = mixing.tokenizer_path("byte_bpe_50k.tiktoken")
    return mixing.sized(_read(spark, d, "documents"), lambda c: mixing.bpe_sizes(c, ranks, public_tokenizers.PATTERN))


def p7_selection(spark, d):
    return mixing.mix_sources(_bpe_sized(spark, d), _read(spark, d, "source_mix"))[0]


def p7_report(spark, d):
    return mixing.mix_sources(_bpe_sized(spark, d), _read(spark, d, "source_mix"))[1]


def p8_found(spark, d):
    return encoding.find_garbled(_read(spark, d, "documents")).select("doc_id")


def p8_restored(spark, d):
    return encoding.find_garbled(_read(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in sorted(globals().items()) if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_TERM = "trim(lower(nfc_normalize({c})), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160))"
_LATEST = "(select *, row_number() over (partition by {k} order by loaded_at desc, count desc nulls last) as rn from {t})"


def _terms_sql() -> str:
    parts = []
    for t, key, fields in (("trigrams", TRIGRAM_KEY, TRIGRAM_FIELDS), ("depgrams", DEPGRAM_KEY, DEPGRAM_FIELDS)):
        for f, c in fields.items():
            latest = _LATEST.format(k=", ".join(key), t=t)
            parts.append(f"select '{f}' as field, {_TERM.format(c=c)} as term, count from {latest} where rn = 1 and count >= 1 and {c} is not null")
    return "select field, term, sum(count)::bigint as total, count(*) as n_rows from (" + " union all ".join(parts) + ") where term <> '' group by field, term"


_WORDS = r"regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+')"
_VECTORS = (
    "v as (select row_id, any_value(delta)::double[] as x from pilot_deltas where len(delta) = 768 and len(list_filter(delta, lambda x: x is null or isnan(x))) = 0"
    " and len(list_filter(delta, lambda x: x <> 0)) > 0 and row_id is not null group by row_id)"
)


def _components(rounds: int = 8) -> str:
    """Smallest key joined to each of ``nodes`` by ``edges`` (both ways): rounds of the smallest neighbour's label, and that label's own."""
    out = ["l0 as materialized (select key, key as root from nodes)"]
    for k in range(rounds):
        out.append(f"m{k} as materialized (select l.key, least(any_value(l.root), coalesce(min(o.root), any_value(l.root))) as root from l{k} l left join edges e on e.a = l.key left join l{k} o on o.key = e.b group by l.key)")
        out.append(f"l{k + 1} as materialized (select x.key, y.root from m{k} x join m{k} y on y.key = x.root)")
    return ", ".join(out) + f", label as (select * from l{rounds})"


def _runs(n: int) -> str:
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


def oracle_sql() -> dict[str, str]:
    found = {
        "p2_found": f"with {_VECTORS}, nodes as (select row_id as key from v), edges as materialized (select x.row_id as a, y.row_id as b from v x join v y on x.row_id <> y.row_id where list_cosine_similarity(x.x, y.x) >= 0.33), {_components()}"
        " select key as row_id, root as cluster_id from (select *, count(*) over (partition by root) as n from label) where n >= 10",
        "p3_found": f"with t as (select doc_id, {_WORDS} as w from documents), s as (select doc_id, list_distinct({_runs(3)}) as r from t where len(w) >= 20), u as (select doc_id, len(r) as n, unnest(r) as run from s)"
        " select x.doc_id as doc_id_a, y.doc_id as doc_id_b from u x join u y on x.run = y.run and x.doc_id < y.doc_id group by all having count(*) >= 0.5 * (any_value(x.n) + any_value(y.n) - count(*))",
        "p3_classes": f"with t as (select text, min(doc_id) as rep, count(distinct doc_id) as n_copies, any_value({_WORDS}) as w from documents where text <> '' group by text), k as (select * from t where len(w) >= 1),"
        f" u as (select rep, run, count(*) as c from (select rep, unnest({_runs(5)}) as run from k where len(w) >= 5) group by all), z as (select rep, sum(c) as n from u group by rep),"
        " j as (select x.rep as a, y.rep as b, sum(least(x.c, y.c)) as i from u x join u y on x.run = y.run and x.rep < y.rep group by all), l as (select a, b from j join z p on p.rep = a join z q on q.rep = b where i >= 0.8 * (p.n + q.n - i) - 1e-9),"
        f" edges as materialized (select a, b from l union all select b, a from l), nodes as (select rep as key from k), {_components()}, n as (select a as key, count(*) as n_links from edges group by a),"
        " c as (select doc_id, root as class_id, coalesce(n_links, 0) as n_links, n_copies from documents join k using (text) join label on rep = label.key left join n on n.key = rep)"
        " select * from c union all select doc_id, doc_id, 0, 1 from documents where doc_id not in (select doc_id from c)",
        "p4_found": f"with {_VECTORS}, p as (select x.row_id as a, y.row_id as b, list_cosine_similarity(x.x, y.x) as s from v x join v y on x.row_id <> y.row_id)"
        " select distinct least(a, b) as row_id_a, greatest(a, b) as row_id_b from (select *, row_number() over (partition by a order by s desc, b) as n from p) where n <= 5 and s >= 0.7",
        "p6_found": f"with d as (select doc_id, {_WORDS} as w from documents), r as (select doc_id, unnest({_runs(12)}) as run from d where len(w) >= 12), e as (select item_id, {_WORDS} as w from eval_items),"
        f" q as (select item_id, unnest({_runs(12)}) as run from e where len(w) >= 12) select distinct doc_id, item_id from r join q using (run)",
    }
    terms = _terms_sql()
    records = (
        "select 'overall' as field, printf('%.1f', overall) as category from (select *, row_number() over (partition by text_id_kaggle order by loaded_at desc, overall desc) as rn"
        " from ellipse_final_github) where rn = 1 and overall in (1.0,1.5,2.0,2.5,3.0,3.5,4.0,4.5,5.0)"
        " union all select 'prof_tertile', c from (select row_id, min(trim(lower(prof_tertile), chr(9) || chr(10) || chr(13) || ' ' || chr(160))) as c from pilot_metadata group by row_id) where c in ('low','mid','high')"
    )
    plans = (
        f"with r as ({records}), n as (select field, count(*) as n from r group by field), c as (select field, category, count(*) as k from r group by field, category)"
        " select p.plan_id, p.category from sample_plans p left join n using (field) left join c using (field, category)"
        " where coalesce(k, 0) < greatest(p.min_rows, p.target_share * p.sample_fraction * coalesce(n, 0))"
    )
    targets = plans.split(" select p.plan_id, p.category from")[0] + (
        ", q as (select p.plan_id, p.category, greatest(p.min_rows, p.target_share * p.sample_fraction * coalesce(n, 0)) as required, coalesce(k, 0) as available from sample_plans p left join n using (field) left join c using (field, category))"
        " select plan_id, category, round(required, 6) as required, available, available < required as unmet from q"
    )
    mix = (
        "with s as (select lower(trim(source, chr(9) || chr(10) || chr(13) || ' ' || chr(160))) as source, sum(coalesce(len(list_filter(regexp_split_to_array(text, '[\\s\\x{85}\\x{a0}\\x{1c}-\\x{1f}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')), 0)) as size from documents group by 1),"
        " m as (select m.*, coalesce(s.size, 0) as size from source_mix m left join s using (source)),"
        " t as (select mix_id, sum(size) as whole from m group by mix_id)"
        " select mix_id, source from m join t using (mix_id) where size * max_repeats < target_share * total_factor * whole"
    )
    mixes = mix.split(" select mix_id, source from m join t")[0] + (
        ", q as (select mix_id, source, target_share * total_factor * whole as target, size::bigint as size, (size * max_repeats)::bigint as capacity from m join t using (mix_id))"
        " select mix_id, source, round(target, 4) as target, size, capacity, capacity < target as unmet, true as fitted from q"
    )
    return {
        **found,
        "p1_found": plans,
        "p1_targets": targets,
        "p7_targets": mixes,
        "p5_counts": terms,
        "p5_increments": terms,
        "p5_incremental": f"select * from ({terms}) where field = 'trigrams.token_2'",
        "p5_found": f"with t as ({terms}), f as (select field, sum(n_rows) as n from t group by field)"
        " select field, term, 'rare' as mark from t where total <= 3 union all select t.field, term, 'common' from t join f on t.field = f.field where n_rows >= 0.01 * n",
        "p7_found": mix,
    }
