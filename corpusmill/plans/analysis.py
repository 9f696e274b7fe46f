"""Queries over scores, networks, vectors and association measures; and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from corpusmill.operators import association as M
from corpusmill.operators import network as N
from corpusmill.operators import stats as S
from corpusmill.operators import vectorops as V
from corpusmill.plans.corpus import table
from corpusmill.functions.text import kwic_line
from corpusmill.plans.essays import _PILOT, _PROF, ESSAYS, _SCORES, clean_essays, kwic_sql, pilot, prof

Q_: dict = {}
SQL: dict[str, str] = {}
ALL = ["overall", *_SCORES]
#: replicates of the resampling queries, components and most rounds of the factorisation
SIZES = {"edges": 1000, "cases": 1000, "communities": 500, "permutations": 1000, "k": 50, "rounds": 500}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        k = name or f.__name__
        Q_[k] = f
        if sql:
            SQL[k] = sql
        return f

    return add


def r(c, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


_CLEAN = f"(select text_id_kaggle, prompt, {', '.join(f'case when isnan({c}) then null else {c} end as {c}' for c in ALL)} from {ESSAYS})"
_COMPLETE = f"(select * from {_CLEAN} where {' and '.join(c + ' is not null' for c in ALL)})"


def _e(spark, d):
    return S.numbers(clean_essays(spark, d), ALL).select("text_id_kaggle", "prompt", *ALL)


def _complete(spark, d):
    return S.complete(_e(spark, d), ALL)


@query(f"select text_id_kaggle from {_COMPLETE}")
def listwise_complete(spark, d):
    return _complete(spark, d).select("text_id_kaggle")


_LONG = " union all ".join(f"select '{c}' as variable, {c} as x from {_CLEAN} where {c} is not null" for c in ALL)


@query(
    f"select variable, count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd, min(x) as min, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q75, max(x) as max,"
    " round(any_value(m3) / pow(any_value(m2), 1.5) * pow((count(x) - 1) / count(x), 1.5), 6) as skew, round(any_value(m4) / pow(any_value(m2), 2) * pow((count(x) - 1) / count(x), 2) - 3, 6) as kurtosis"
    f" from (select variable, x, avg(pow(x - mu, 2)) over v as m2, avg(pow(x - mu, 3)) over v as m3, avg(pow(x - mu, 4)) over v as m4 from (select variable, x, avg(x) over (partition by variable) as mu from ({_LONG})) window v as (partition by variable)) group by variable"
)
def describe(spark, d):
    s = S.describe(_e(spark, d), ALL)
    return s.select("variable", "n", r("mean").alias("mean"), r("sd").alias("sd"), "min", "q25", "median", "q75", "max", r("skew").alias("skew"), r("kurtosis").alias("kurtosis"))


_Q = ", ".join(f"quantile_cont({c}, 0.01) as l_{c}, quantile_cont({c}, 0.99) as h_{c}" for c in ALL)
_W = ", ".join(f"round(least(greatest({c}, l_{c}), h_{c}), 9) as {c}" for c in ALL)
_WINS = f"(select text_id_kaggle, prompt, {_W} from {_COMPLETE}, (select {_Q} from {_COMPLETE}))"


@query(f"select text_id_kaggle, {', '.join(ALL)} from {_WINS}")
def winsorize(spark, d):
    return S.winsorize(_complete(spark, d), ALL).select("text_id_kaggle", *[r(c, 9).alias(c) for c in ALL])


_GROUP = "case when overall <= 2.5 then 'Low' when overall >= 4.0 then 'High' else 'Mid' end"


@query(f"with g as (select *, {_GROUP} as grp from {_COMPLETE}), q as (select grp, quantile_cont(cohesion, 0.01) as l, quantile_cont(cohesion, 0.99) as h from g group by grp) select text_id_kaggle, round(least(greatest(cohesion, l), h), 9) as cohesion from g join q using (grp)")
def winsorize_in_groups(spark, d):
    g = _complete(spark, d).withColumn("grp", S.proficiency(F.col("overall")))
    return S.winsorize(g, ["cohesion"], by="grp").select("text_id_kaggle", r("cohesion", 9).alias("cohesion"))


@query(f"select text_id_kaggle, {', '.join(f'round({c} - avg({c}) over (partition by prompt), 6) as {c}' for c in ALL)} from {_WINS}")
def residualize(spark, d):
    w = S.residualize(S.winsorize(_complete(spark, d), ALL), ALL, "prompt")
    return w.select("text_id_kaggle", *[r(c).alias(c) for c in ALL])


_R2 = " union all ".join(f"select '{c}' as variable, round(1 - sum(pow({c} - m, 2)) / sum(pow({c} - t, 2)), 6) as r2 from (select {c}, avg({c}) over (partition by prompt) as m, avg({c}) over () as t from {_COMPLETE})" for c in ALL)


@query(_R2)
def prompt_r2(spark, d):
    return S.r_squared(_complete(spark, d), ALL, "prompt").select("variable", r("r2").alias("r2"))


@query(" union all ".join(f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as r from {_CLEAN}" for i, a in enumerate(ALL) for b in ALL[i:]))
def correlation_matrix(spark, d):
    return S.correlations(_e(spark, d), ALL).select("x", "y", r("r").alias("r"))


@query(f"with a as (select overall, vocabulary from {_CLEAN} where overall is not null and vocabulary is not null), b as (select rank() over (order by overall) + (count(*) over (partition by overall) - 1) / 2 as x, rank() over (order by vocabulary) + (count(*) over (partition by vocabulary) - 1) / 2 as y from a) select round(corr(x, y), 6) as rho, count(*) as n from b")
def spearman(spark, d):
    return S.spearman(_e(spark, d), "text_id_kaggle", "overall", "vocabulary").select(r("rho").alias("rho"), "n")


@query(f"select least(greatest(floor((least(surprisal, 20) - 4) / 0.5) + 1, 0), 33)::bigint as bin, count(*) as n from {_PILOT} where surprisal is not null group by 1")
def loss_histogram(spark, d):
    """32 bins from 4 to 20, larger values clipped into the last."""
    return S.histogram(pilot(spark, d), "surprisal", 4.0, 20.0, 32).select("bin", "n")


@query(f"select text_id_kaggle, (coalesce(grammar, 0) + coalesce(conventions, 0)) / nullif((grammar is not null)::int + (conventions is not null)::int, 0) as mean_score from {_CLEAN}")
def rater_means(spark, d):
    return _e(spark, d).select("text_id_kaggle", S.rater_mean(F.col("grammar"), F.col("conventions")).alias("mean_score"))


@query(f"select round(corr(grammar, conventions), 6) as r, count(*) as n from {_CLEAN} where grammar is not null and conventions is not null")
def rater_agreement(spark, d):
    e = _e(spark, d).dropna(subset=["grammar", "conventions"])
    return e.agg(r(F.corr("grammar", "conventions")).alias("r"), F.count(F.lit(1)).alias("n"))


@query(f"select {_GROUP} as prof_group, count(*) as n from {_CLEAN} where overall is not null group by 1")
def prof_groups(spark, d):
    g = _e(spark, d).filter("overall is not null").select(S.proficiency(F.col("overall")).alias("prof_group"))
    return g.groupBy("prof_group").agg(F.count(F.lit(1)).alias("n"))


@query(f"select pos_tag, n, round(n / sum(n) over (), 6) as share from (select pos_tag, count(*) as n from {_PILOT} group by 1)")
def tag_shares(spark, d):
    return S.shares(pilot(spark, d), "pos_tag").select("pos_tag", "n", r("share").alias("share"))


@query(f"select {_PROF} as prof, pos_tag, count(*) as n from {_PILOT} where {_PROF} in ('low', 'mid', 'high') group by 1, 2 qualify row_number() over (partition by prof order by count(*) desc, pos_tag) = 1")
def top_tag_by_level(spark, d):
    return S.modes(pilot(spark, d).withColumn("prof", prof()).filter(F.col("prof").isin("low", "mid", "high")), ["prof"], "pos_tag")


@query(" union all ".join(f"select '{c}' as variable, count(distinct {c}) as n_distinct, round(stddev_samp({c}), 6) as sd, count(distinct {c}) <= 1 as constant from {_CLEAN}" for c in ALL))
def constant_columns(spark, d):
    return S.constant_columns(_e(spark, d), ALL).withColumn("sd", r("sd"))


@query(f"select pos_tag, count(*) filter (where {_PROF} = 'low') as low, count(*) filter (where {_PROF} = 'mid') as mid, count(*) filter (where {_PROF} = 'high') as high from {_PILOT} group by 1")
def tag_crosstab(spark, d):
    p = pilot(spark, d).withColumn("prof", prof())
    return p.groupBy("pos_tag").pivot("prof", ["low", "mid", "high"]).agg(F.count(F.lit(1))).fillna(0)


# networks -----------------------------------------------------------------------------------------------------------


def _net(spark, d):
    return N.network(_complete(spark, d), ALL, "text_id_kaggle")


@query()
def glasso_network(spark, d):
    return N.edges(spark, _net(spark, d), ALL).select("src", "dst", F.round("weight", 3).alias("weight"))


@query()
def centrality(spark, d):
    net = _net(spark, d)
    between, close = N.paths(net)
    side = spark.createDataFrame([(c, float(x), float(y)) for c, x, y in zip(ALL, between, close)], "node string, betweenness double, closeness double")
    return side.join(N.strength(N.edges(spark, net, ALL)), "node", "left")


@query()
def communities(spark, d):
    return spark.createDataFrame([(c, int(g)) for c, g in zip(ALL, N.walktrap(_net(spark, d)))], "node string, community int")


# a network whose weights both engines can state: correlations of at least 0.3 by size
_FIXED = "(select x as src, y as dst, r as weight from (" + SQL["correlation_matrix"] + ") where x <> y and abs(r) >= 0.3)"
_WAYS = f"(select * from {_FIXED} union all select dst, src, weight from {_FIXED})"


def _fixed(spark, d):
    return S.correlations(_e(spark, d), ALL).filter("x != y").select(F.col("x").alias("src"), F.col("y").alias("dst"), r("r").alias("weight")).filter(F.abs("weight") >= 0.3)


@query(f"select src as node, round(sum(abs(weight)), 6) as strength, round(sum(weight), 6) as expected_influence from {_WAYS} group by 1")
def strength(spark, d):
    s = N.strength(_fixed(spark, d))
    return s.select("node", r("strength").alias("strength"), r("expected_influence").alias("expected_influence"))


_COMM = "(values " + ", ".join(f"('{c}', {1 if i < 4 else 2})" for i, c in enumerate(ALL)) + ") as c(node, community)"


@query(f"select c.node, c.community, round(coalesce(sum(abs(weight)) filter (where o.community <> c.community), 0), 6) as bridge_strength, round(coalesce(sum(weight) filter (where o.community <> c.community), 0), 6) as bridge_influence from {_COMM} left join {_WAYS} e on c.node = e.src left join (select node as n2, community from {_COMM}) o on o.n2 = e.dst group by 1, 2")
def bridge_strength(spark, d):
    c = spark.createDataFrame([(x, 1 if i < 4 else 2) for i, x in enumerate(ALL)], "node string, community int")
    b = N.bridge(_fixed(spark, d), c)
    return b.select("node", "community", r("bridge_strength").alias("bridge_strength"), r("bridge_influence").alias("bridge_influence"))


@query()
def bootstrap_edges(spark, d):
    return N.bootstrap_edges(_complete(spark, d), ALL, "text_id_kaggle", SIZES["edges"])


@query()
def case_dropping(spark, d):
    return N.stability_coefficient(N.case_dropping(_complete(spark, d), ALL, "text_id_kaggle", SIZES["cases"]))


def _replicated(spark, d):
    m = N.moments(_complete(spark, d), ALL, "text_id_kaggle", 1, N.once).first()["m"]
    rmat, n = N.correlation_of(np.array(m), len(ALL))
    final = spark.createDataFrame([(c, int(g)) for c, g in zip(ALL, N.walktrap(N.partial_correlations(rmat, n)))], "node string, community int")
    return N.parametric_communities(rmat, n, ALL, spark, SIZES["communities"]), final


@query()
def bootstrap_communities(spark, d):
    return N.item_stability(*_replicated(spark, d))


@query()
def community_counts(spark, d):
    return N.community_counts(_replicated(spark, d)[0])


def _compared(spark, d):
    g = _complete(spark, d).withColumn("grp", S.proficiency(F.col("overall")))
    return N.comparison_test(g, ALL[1:], "text_id_kaggle", "grp", "Low", "High", SIZES["permutations"])


@query()
def network_comparison(spark, d):
    return _compared(spark, d)


@query()
def significant_edges(spark, d):
    """Edges of ``cohesion`` that differ between the groups at p < .05."""
    return N.significant(_compared(spark, d), "cohesion")


# vectors ------------------------------------------------------------------------------------------------------------


def _emb(spark, d):
    return table(spark, d, "embeddings")


@query("select vec_id, i::int as i, round(x, 6) as x from (select vec_id, unnest(list_concat(list_transform(embedding, lambda x: greatest(x, 0)), list_transform(embedding, lambda x: greatest(-x, 0)))) as x, unnest(range(128)) as i from embeddings)")
def posneg_split(spark, d):
    return _emb(spark, d).select("vec_id", F.posexplode(V.posneg(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


_UNNEST = "(select vec_id, label, unnest(embedding)::double as x, unnest(range(64)) as k from embeddings)"


@query(f"with u as {_UNNEST}, c as (select label, k, avg(x) as m from u group by all) select vec_id, label, round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) as distance from u join c using (label, k) group by all")
def centroid_cosine(spark, d):
    return V.centroid_distance(_emb(spark, d), "label", "embedding", 64).select("vec_id", "label", r("distance").alias("distance"))


@query(f"with u as {_UNNEST}, c as (select label, k, avg(x) as m from u group by all), s as (select vec_id, label, 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) as distance from u join c using (label, k) group by all) select label, vec_id, rank::int as rank from (select *, row_number() over (partition by label order by round(distance, 9), vec_id) as rank from s) where rank <= 5")
def cluster_show(spark, d):
    """The five rows nearest to each cluster's centroid."""
    s = V.centroid_distance(_emb(spark, d), "label", "embedding", 64)
    order = Window.partitionBy("label").orderBy(F.round("distance", 9), "vec_id")
    return s.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("label", "vec_id", "rank")


_CS = f"(select m.*, case when e.label < 2 then -1 else e.label end as label, {_PROF} as prof from {_PILOT} m join embeddings e on m.row_id = e.vec_id)"


@query(f"with c as {_CS}, t as (select label, pos_tag as top_pos from c where label >= 0 and pos_tag is not null group by label, pos_tag qualify row_number() over (partition by label order by count(*) desc, pos_tag) = 1), w as (select label, token_text as top_token from c where label >= 0 and token_text is not null group by label, token_text qualify row_number() over (partition by label order by count(*) desc, token_text) = 1) select label, count(*) as size, round(avg(surprisal), 6) as mean_surprisal, round(stddev_samp(surprisal), 6) as sd_surprisal, round(count_if(prof = 'low') / count(prof), 6) as low_share, any_value(top_pos) as top_pos, any_value(top_token) as top_token from c join t using (label) join w using (label) where label >= 0 group by label")
def cluster_summary(spark, d):
    """Clusters of the embeddings (two of them taken as noise), described by the pilot rows of the same number."""
    s = V.cluster_summary(_clustered(spark, d))
    return s.select("label", "size", r("mean_surprisal").alias("mean_surprisal"), r("sd_surprisal").alias("sd_surprisal"), r("low_share").alias("low_share"), "top_pos", "top_token")


def _clustered(spark, d):
    e = _emb(spark, d).select(F.col("vec_id").alias("row_id"), F.when(F.col("label") < 2, -1).otherwise(F.col("label")).alias("label"))
    return pilot(spark, d).join(e, "row_id").withColumn("prof", prof())


@query("with u as (select vec_id, unnest(embedding)::double as loading, unnest(range(64)) as component from embeddings) select component::int as component, vec_id, rank::int as rank from (select *, row_number() over (partition by component order by loading desc, vec_id) as rank from u) where rank <= 10")
def topn_per_component(spark, d):
    long = _emb(spark, d).select("vec_id", F.posexplode("embedding").alias("component", "loading"))
    return V.top_per_component(long, "vec_id", 10).select("component", "vec_id", "rank")


@query()
def nmf_fit(spark, d):
    w, _, _ = V.nmf(_emb(spark, d), "vec_id", "embedding", 64, k=SIZES["k"], rounds=SIZES["rounds"])
    return w


@query("select count(*) as n_rows, 50 as k, true as fits, true as non_negative from embeddings")
def nmf_error(spark, d):
    """Rows, components, whether 50 components leave less than 65 % of the vectors' length, and whether nothing is negative."""
    w, h, error = V.nmf(_emb(spark, d), "vec_id", "embedding", 64, k=SIZES["k"], rounds=SIZES["rounds"])
    return w.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(h)).alias("k"), F.lit(bool(error < 0.65)).alias("fits"), (F.min(F.array_min("loadings")) >= 0).alias("non_negative"))


@query()
def nmf_summary(spark, d):
    """Components of the embeddings, described by the pilot rows of the same number; a component without any loading has no rho."""
    w, _, _ = V.nmf(_emb(spark, d), "vec_id", "embedding", 64, k=SIZES["k"], rounds=SIZES["rounds"])
    return V.component_summary(V.loadings_long(w, "vec_id"), _meta(spark, d), "vec_id", 50).withColumn("rho", S.number("rho"))


def _meta(spark, d):
    return pilot(spark, d).withColumn("vec_id", F.col("row_id")).withColumn("prof", prof())


_LOAD = "(select vec_id, unnest(embedding)::double as loading, unnest(range(64)) as component from embeddings)"
_TOP = f"(select * from (select *, row_number() over (partition by component order by loading desc, vec_id) as n from {_LOAD}) where n <= 50)"
_META = f"(select *, row_id as vec_id, {_PROF} as prof from {_PILOT})"


def _fixed_loadings(spark, d):
    return _emb(spark, d).select("vec_id", F.posexplode("embedding").alias("component", "loading")).withColumn("loading", F.col("loading").cast("double"))


@query(
    f"with t as (select t.*, surprisal, pos_tag, token_text, prof from {_TOP} t left join {_META} m using (vec_id)), all_ as (select component, count(*) as n from t group by all),"
    " tag as (select component, string_agg(pos_tag || '(' || floor(100 * c / n + 0.5)::bigint || '%)', ',' order by k) as top_pos from (select component, pos_tag, count(*) as c, row_number() over (partition by component order by count(*) desc, pos_tag) as k from t where pos_tag is not null group by component, pos_tag) join all_ using (component) where k <= 3 group by component),"
    " word as (select component, token_text as top_token from t where token_text is not null group by component, token_text qualify row_number() over (partition by component order by count(*) desc, token_text) = 1),"
    f" lev as (select component, loading, case prof when 'low' then 1 when 'mid' then 2 when 'high' then 3 end as y from {_LOAD} join {_META} using (vec_id)),"
    " rk as (select component, rank() over (partition by component order by loading) + (count(*) over (partition by component, loading) - 1) / 2 as a, rank() over (partition by component order by y) + (count(*) over (partition by component, y) - 1) / 2 as b from lev where y is not null),"
    f" sp as (select component, avg((loading < 1e-6)::int) as sparsity from {_LOAD} group by all)"
    " select component::int as component, round(avg(loading), 6) as top_load, round(avg(surprisal), 6) as surprisal, " + ", ".join(f"round(count_if(prof = '{x}') / nullif(count(prof), 0), 6) as {x}_share" for x in ("low", "mid", "high"))
    + ", any_value(top_pos) as top_pos, any_value(top_token) as top_token, any_value(round(sparsity, 6)) as sparsity, any_value(rho) as rho from t left join tag using (component) left join word using (component) join sp using (component) left join (select component, round(corr(a, b), 6) as rho from rk group by component) using (component) group by component"
)
def component_table(spark, d):
    """The description of components, over loadings that SQL can state too: the embeddings' own dimensions."""
    s = V.component_summary(_fixed_loadings(spark, d), _meta(spark, d), "vec_id", 50)
    return s.select("component", *[r(c).alias(c) for c in ("top_load", "surprisal", "low_share", "mid_share", "high_share", "sparsity", "rho")], "top_pos", "top_token")


@query(f"select number::int as number, vec_id, {kwic_sql('number')} as line from (select *, row_number() over (order by loading desc, vec_id) as number from {_TOP} join {_META} using (vec_id) where component = 3 and pos_tag in ('NOUN', 'VERB') and prof in ('low', 'mid'))")
def component_show(spark, d):
    """Of the 50 rows that load most on one component, those that pass the filters, as concordance lines."""
    s = V.component_show(_fixed_loadings(spark, d), _meta(spark, d), "vec_id", 3, 50, pos=["NOUN", "VERB"], prof=["low", "mid"])
    return s.select("number", "vec_id", kwic_line(F.col("number")).alias("line"))


def _labelled(spark, d):
    return _emb(spark, d).join(_meta(spark, d), "vec_id")


_DIST = f"with u as {_UNNEST}, b as (select * from embeddings join {_META} using (vec_id)), m as (select u.* from u where vec_id in (select vec_id from b)), c as (select label, k, avg(x) as m from m group by all), s as (select vec_id, label, 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) as distance from m join c using (label, k) where label = 3 group by all)"


@query(f"{_DIST} select number::int as number, vec_id, {kwic_sql('number')} as line from (select b.*, row_number() over (order by round(distance, 9), vec_id) as number from s join b using (vec_id) where pos_tag in ('NOUN', 'VERB')) where number <= 20")
def concordance_centroid(spark, d):
    """Concordance lines of one cluster, nearest to its centroid first."""
    s = V.cluster_show(_labelled(spark, d), 3, "centroid", 20, "vec_id", vec="embedding", dim=64, pos=["NOUN", "VERB"])
    return s.select("number", "vec_id", kwic_line(F.col("number")).alias("line"))


@query(f"select number::int as number, vec_id, {kwic_sql('number')} as line from (select *, row_number() over (order by surprisal desc nulls last, vec_id) as number from embeddings join {_META} using (vec_id) where label = 5) where number <= 20")
def concordance_surprisal(spark, d):
    s = V.cluster_show(_labelled(spark, d), 5, "surprisal", 20, "vec_id", vec="embedding", dim=64)
    return s.select("number", "vec_id", kwic_line(F.col("number")).alias("line"))


@query(f"select number::int as number, vec_id from (select vec_id, row_number() over (order by md5(vec_id::varchar || '42'), vec_id) as number from embeddings join {_META} using (vec_id) where label = 5) where number <= 20")
def concordance_random(spark, d):
    return V.cluster_show(_labelled(spark, d), 5, "random", 20, "vec_id", vec="embedding", dim=64).select("number", "vec_id")


@query("select count(distinct label) as n_clusters, list_slice(list_sort(list(distinct label)), 1, 20) as first_ids from embeddings where label >= 0")
def valid_clusters(spark, d):
    return V.valid_labels(_emb(spark, d))


@query("with p as (select a.vec_id as src, b.vec_id as dst, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id) select src, dst, rank::int as rank from (select *, row_number() over (partition by src order by s desc, dst) as rank from p) where rank <= 15")
def knn_graph(spark, d):
    return V.knn_graph(_emb(spark, d), "vec_id", "embedding", 64).select("src", "dst", "rank")


@query()
def umap_layout(spark, d):
    return V.layout(V.fuzzy_graph(V.knn_graph(_emb(spark, d), "vec_id", "embedding", 64)), 2, 8)


@query()
def hdbscan_labels(spark, d):
    return V.density_labels(V.knn_graph(_emb(spark, d), "vec_id", "embedding", 64))


@query("with u as (select vec_id, label, unnest(embedding)::double as x, unnest(range(64)) as k from embeddings) select vec_id, k::int as k, round(x - avg(x) over (partition by label, k), 6) as x from u")
def lemma_residual(spark, d):
    s = V.lemma_residual(_emb(spark, d), "label", "embedding", 64)
    return s.select("vec_id", F.posexplode("residual").alias("k", "x")).select("vec_id", "k", r("x").alias("x"))


# association --------------------------------------------------------------------------------------------------------

_F = "(select head_lemma, dependent_lemma, sum(count) as f from depgrams where count >= 1 and head_lemma is not null and dependent_lemma is not null group by all)"
_ASSOC = f"(select head_lemma, dependent_lemma, f::double as f, f1::double as f1, f2::double as f2, n::double as n from {_F} join (select head_lemma, sum(f) as f1 from {_F} group by 1) using (head_lemma) join (select dependent_lemma, sum(f) as f2 from {_F} group by 1) using (dependent_lemma) cross join (select sum(f) as n from {_F}))"


def _pairs(spark, d):
    g = table(spark, d, "depgrams").filter("count >= 1 and head_lemma is not null and dependent_lemma is not null")
    return M.with_marginals(g, "head_lemma", "dependent_lemma")


@query(f"select head_lemma, dependent_lemma, round(log2(f * n / (f1 * f2)), 6) as pmi from {_ASSOC} where f >= 5")
def pmi(spark, d):
    return _pairs(spark, d).filter("f >= 5").select("head_lemma", "dependent_lemma", r(M.pmi()).alias("pmi"))


@query(f"select head_lemma, dependent_lemma, round(14 + log2(2 * f / (f1 + f2)), 6) as log_dice from {_ASSOC}")
def log_dice(spark, d):
    return _pairs(spark, d).select("head_lemma", "dependent_lemma", r(M.log_dice()).alias("log_dice"))


@query(f"select head_lemma, dependent_lemma, round(f / f1 - coalesce((f2 - f) / nullif(n - f1, 0), 0), 6) as delta_p from {_ASSOC}")
def delta_p(spark, d):
    return _pairs(spark, d).select("head_lemma", "dependent_lemma", r(M.delta_p()).alias("delta_p"))


@query(f"select head_lemma, dependent_lemma, round(log2(f * f * n / (f1 * f2)), 6) as mi2, round(log2(f * f * f * n / (f1 * f2)), 6) as mi3 from {_ASSOC}")
def mi2_mi3(spark, d):
    return _pairs(spark, d).select("head_lemma", "dependent_lemma", r(M.pmi(2)).alias("mi2"), r(M.pmi(3)).alias("mi3"))


_RC = "(select head_lemma, dependent_lemma, sum(count)::bigint as count from depgrams where count >= 1 and head_lemma is not null and dependent_lemma is not null and corpus {} 'a' group by all)"


@query(f"with a as {_RC.format('=')}, b as {_RC.format('<>')}, j as (select head_lemma, dependent_lemma, coalesce(a.count, 0) as count_a, coalesce(b.count, 0) as count_b from a full join b using (head_lemma, dependent_lemma)) select *, round(log2(((count_a + 0.5) / ((select sum(count) from a) + 1)) / ((count_b + 0.5) / ((select sum(count) from b) + 1))), 6) as log_ratio from j order by count_a + count_b desc, head_lemma, dependent_lemma limit 100")
def register_contrast(spark, d):
    g = table(spark, d, "depgrams").filter("count >= 1 and head_lemma is not null and dependent_lemma is not null")
    keys = ["head_lemma", "dependent_lemma"]
    a, b = (g.filter(c).groupBy(*keys).agg(F.sum("count").alias("count")) for c in ("corpus = 'a'", "corpus != 'a'"))
    out = M.register_contrast(a, b, keys)
    return out.select(*keys, "count_a", "count_b", r("log_ratio").alias("log_ratio"))


@query(f"select count(*)::bigint as n_edges, round(1 - count(*) / 21, 6) as sparsity from {_FIXED} where weight <> 0")
def network_sparsity(spark, d):
    return N.sparsity(_fixed(spark, d), len(ALL)).select("n_edges", r("sparsity").alias("sparsity"))


@query(f"select node, rank::int as rank from (select node, row_number() over (order by strength desc, node) as rank from ({SQL['strength']}))")
def strength_rank(spark, d):
    """Place of each variable by strength; the nodes are the variables of one network."""
    s = N.strength(_fixed(spark, d)).select("node", r("strength").alias("strength"))
    return s.select("node", F.row_number().over(Window.orderBy(F.desc("strength"), "node")).alias("rank"))


@query()
def edge_differences(spark, d):
    """Edges of ``cohesion`` in the networks of low and of high proficiency."""
    g = _complete(spark, d).withColumn("grp", S.proficiency(F.col("overall")))
    cols = ALL[1:]
    a, b = (N.edges(spark, N.network(g.filter(F.col("grp") == x), cols, "text_id_kaggle"), cols) for x in ("Low", "High"))
    return N.edge_differences(a, b, "cohesion")


@query()
def network_summary(spark, d):
    """One row per variable: community, strength, expected influence and betweenness of the estimated network."""
    net = _net(spark, d)
    between, _ = N.paths(net)
    side = spark.createDataFrame([(c, int(g), float(b)) for c, g, b in zip(ALL, N.walktrap(net), between)], "node string, community int, betweenness double")
    return side.join(N.strength(N.edges(spark, net, ALL)), "node", "left")


@query(f"select count(distinct label) filter (where label >= 0) as n_clusters, count(*) filter (where label < 0) as n_noise, round(100 * count(*) filter (where label >= 0) / count(*), 6) as pct_clustered from {_CS}")
def cluster_noise(spark, d):
    return V.noise_share(_clustered(spark, d)).select("n_clusters", "n_noise", r("pct_clustered").alias("pct_clustered"))


@query()
def leaf_labels(spark, d):
    return V.density_labels(V.knn_graph(_emb(spark, d), "vec_id", "embedding", 64), method="leaf")
