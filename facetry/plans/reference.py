"""Queries over features, samples, texts, labels and models, with the SQL each is held against."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.functions import text as tx
from facetry.operators import activations as ac
from facetry.operators import annotate as an
from facetry.operators import coherence, metrics, sae, sampling, selection, topics
from facetry.operators import features as ft
from facetry.sources import json_io
from facetry.sources.tables import latest, one_row, shared_dir, stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(c, n: int = 6) -> Column:
    return F.round(c, n)


# --- shared inputs ----------------------------------------------------------------------------


def sae_members(s: SparkSession, d: str) -> DataFrame:
    return ft.members(ft.long_weights(table(s, d, "theta"), "doc_id", "theta"))


def topic_weights(s: SparkSession, d: str) -> DataFrame:
    return ft.pair_weights(table(s, d, "topic2doc_dist"), "topic_id", "doc_id", "weight")


def doc_topics(s: SparkSession, d: str) -> DataFrame:
    return ft.long_weights(table(s, d, "doc2topic_dist"), "doc_id", "p")


def articles(s: SparkSession, d: str, *columns: str, only: DataFrame | None = None) -> DataFrame:
    """The latest ``columns`` of each article, or of those in ``only`` (doc_id), which others are left out by before their texts move."""
    rows = table(s, d, "wikitext")
    return latest(rows if only is None else rows.join(only, "doc_id", "left_semi"), ["doc_id"], list(columns))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def labelled_vectors(s: SparkSession, d: str) -> DataFrame:
    """Every vector in the group of its label, weighted by its element of that number."""
    w = F.abs(F.get(F.col("v"), F.col("label"))).cast("double")
    return vectors(s, d).where("label is not null").select(F.col("label").alias("feature_id"), "doc_id", "v", w.alias("weight"))


def verdicts(s: SparkSession, d: str) -> DataFrame:
    """The judgements of a deterministic stand-in for a judge, over stratified positives and negatives of each feature."""
    m = sae_members(s, d)
    docs, feats = m.select("doc_id").distinct(), m.select("feature_id").distinct()
    rows = sampling.sample("stratified", m, m, docs, feats, 20, 10, strata=5)
    digit = F.conv(F.substring(F.md5(F.concat_ws("|", "feature_id", "doc_id")), 1, 4), 16, 10).cast("int") % 10
    reply = F.when(digit < 6, " 1\n").when(digit < 9, "0").otherwise("I cannot tell")
    return rows.select("feature_id", "polarity", "ord", "doc_id", an.verdict(reply).alias("verdict"))


_L = "(select {k}, arg_max_null({v}, loaded_at) as {v} from {t} group by 1)"
C_SAE = f"""sae as (select feature_id, doc_id, weight from (select doc_id, unnest(range(len(theta)))::int as feature_id, unnest(theta) as weight
  from {_L.format(k='doc_id', v='theta', t='theta')}) where weight > 0 and not isnan(weight))"""
C_TD = """td as (select feature_id, doc_id, weight from (select topic_id as feature_id, doc_id, arg_max_null(weight, loaded_at) as weight from topic2doc_dist group by 1, 2)
  where weight is not null and not isnan(weight))"""
C_DT = f"""dt as (select feature_id, doc_id, weight from (select doc_id, unnest(range(len(p)))::int as feature_id, unnest(p) as weight
  from {_L.format(k='doc_id', v='p', t='doc2topic_dist')}) where weight is not null and not isnan(weight))"""
C_ART = "art as (select doc_id, arg_max_null(text, loaded_at) as text, arg_max_null(tokenized_text, loaded_at) as tokenized_text, arg_max_null(supercategory, loaded_at) as supercategory from wikitext group by 1)"
C_KEY = "md5(concat_ws(':', '42', feature_id, doc_id))"
C_VEC = "vec as (select label as feature_id, vec_id as doc_id, embedding::double[] as v, abs(embedding[label + 1])::double as weight from embeddings where label is not null)"
C_STRATA = f"""strata as (select *, ntile({{s}}) over (partition by feature_id order by weight, doc_id) - 1 as stratum from sae),
 drawn as (select *, row_number() over (partition by feature_id, stratum order by {C_KEY}, doc_id) as r from strata),
 strat as (select feature_id, stratum, doc_id, weight, row_number() over (partition by feature_id order by stratum, r) - 1 as ord from drawn where r <= {{q}})"""
C_NEG = """negs as (select * from (select f.feature_id, x.doc_id, row_number() over (partition by f.feature_id order by md5(concat_ws(':', '42', x.doc_id)), x.doc_id) - 1 as ord
  from (select distinct feature_id from sae) f cross join (select distinct doc_id from sae) x where not exists (select 1 from sae m where m.feature_id = f.feature_id and m.doc_id = x.doc_id)) where ord < 10)"""
C_VERD = f"""{C_SAE}, {C_STRATA.format(s=5, q=4)}, {C_NEG},
 chosen as (select feature_id, 'pos' as polarity, ord, doc_id from strat union all select feature_id, 'neg', ord, doc_id from negs),
 verd as (select *, case when k < 6 then 1 when k < 9 then 0 else -1 end as verdict from (select *, ('0x' || substr(md5(concat_ws('|', feature_id, doc_id)), 1, 4))::int % 10 as k from chosen))"""


# --- memberships ------------------------------------------------------------------------------


@query(f"with {C_SAE} select feature_id, doc_id, weight from sae")
def membership_multilabel(s, d):
    return sae_members(s, d)


@query(f"with {C_TD}, n as (select feature_id, doc_id, weight / sum(weight) over (partition by feature_id) as w from td) select doc_id, first(feature_id order by w desc, feature_id) as feature_id from n group by 1")
def membership_argmax_topic2doc(s, d):
    return ft.strongest_feature(ft.share_of_feature(topic_weights(s, d)))


@query(f"with {C_DT} select doc_id, first(feature_id order by weight desc, feature_id) as feature_id from dt group by 1")
def membership_argmax_doc2topic(s, d):
    return ft.strongest_feature(doc_topics(s, d))


def sae_features(s, d) -> DataFrame:
    """(feature_id) of every feature of theta, whether it has members or not."""
    width = table(s, d, "theta").agg(F.max(F.size("theta"))).head()[0] or 0
    return s.range(width).select(F.col("id").cast("int").alias("feature_id"))


C_WIDE = "feats as (select unnest(range((select max(len(theta)) from theta)))::int as feature_id)"


@query(f"with {C_SAE}, {C_WIDE} select feature_id, count(doc_id) as n from feats left join sae using (feature_id) group by 1 order by n desc, feature_id")
def feature_sizes(s, d):
    """Every feature by size, those without members too."""
    return ft.sizes(sae_members(s, d), sae_features(s, d)).orderBy(F.col("n").desc(), "feature_id")


@query(f"with {C_SAE} select count(*) as n from (select feature_id from sae group by 1 having count(*) > 60)")
def large_feature_count(s, d):
    return ft.large_features(sae_members(s, d), 61).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {C_TD}, n as (select feature_id, doc_id, weight / sum(weight) over (partition by feature_id) as w from td), best as (select doc_id, first(feature_id order by w desc, feature_id) as feature_id from n group by 1), "
       "f as (select unnest(range((select max(topic_id) + 1 from topic2doc_dist)))::int as feature_id) select feature_id, coalesce(string_agg(doc_id::varchar, ' ' order by doc_id), '') as doc_ids from f left join best using (feature_id) group by 1")  # fmt: skip
def inverted_index(s, d):
    """The members of every topic, an empty list for one without."""
    most = table(s, d, "topic2doc_dist").agg(F.max("topic_id")).head()[0]
    feats = s.range((-1 if most is None else most) + 1).select(F.col("id").cast("int").alias("feature_id"))
    lists = ft.inverted_index(ft.strongest_feature(ft.share_of_feature(topic_weights(s, d))), feats)
    return lists.withColumn("doc_ids", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), " "))


@query(f"with {C_SAE} select feature_id, doc_id, weight from sae where feature_id in (select feature_id from sae group by 1 having count(*) >= 30)")
def large_feature_filter(s, d):
    return ft.of_large_features(sae_members(s, d), 30)


@query(f"with {C_SAE} select doc_id, max(weight) as weight from sae group by 1")
def doc_max_weight(s, d):
    return ft.highest_weight(sae_members(s, d))


@query(f"with {C_DT} select feature_id, doc_id, round(weight / sum(weight) over (partition by feature_id), 9) as weight from dt")
def topic2doc_normalize(s, d):
    return ft.share_of_feature(doc_topics(s, d)).withColumn("weight", r("weight", 9))


@query(f"with {C_SAE} select feature_id, doc_id, round(weight / greatest(sum(weight) over (partition by doc_id), 1e-6), 9) as weight from sae")
def theta_row_normalize(s, d):
    return ft.share_of_document(sae_members(s, d)).withColumn("weight", r("weight", 9))


@query("""select topic_id, place::int as place, word_id, word from (select topic_id, word_id::int as word_id, row_number() over (partition by topic_id order by p desc, word_id) as place
  from (select topic_id, unnest(range(len(p))) as word_id, unnest(p) as p from topic2word_dist) where p is not null) join vocab using (word_id) where place <= 10""")
def topic_top_words(s, d):
    return ft.top_words(table(s, d, "topic2word_dist"), table(s, d, "vocab"))


# --- samples ----------------------------------------------------------------------------------


@query(f"with {C_SAE} select feature_id, ord::int as ord, doc_id, weight from (select *, row_number() over (partition by feature_id order by {C_KEY}, doc_id) - 1 as ord from sae) where ord < 10")
def sample_random(s, d):
    return sampling.random_members(sae_members(s, d), 10)


@query(f"""with {C_TD}, top as (select * from td qualify row_number() over (partition by feature_id order by weight desc, doc_id desc) <= 10)
 select feature_id, (row_number() over (partition by feature_id order by weight, doc_id) - 1)::int as ord, doc_id, weight from top""")
def sample_topk(s, d):
    return sampling.top_k(topic_weights(s, d), 10)


@query(f"""with {C_SAE} select feature_id, ord::int as ord, doc_id, weight from (select *, row_number() over (partition by feature_id
 order by ln((('0x' || substr({C_KEY}, 1, 8))::bigint::double + 1) / 4294967297.0) / weight desc, doc_id) - 1 as ord from sae) where ord < 10""")
def sample_weighted(s, d):
    return sampling.weighted_members(sae_members(s, d), 10)


@query(f"with {C_SAE}, {C_STRATA.format(s=10, q=2)} select feature_id, ord::int as ord, doc_id, weight, stratum::int as stratum from strat")
def sample_stratified(s, d):
    return sampling.stratified_members(sae_members(s, d), 25, 10)


@query(f"with {C_SAE}, {C_NEG} select feature_id, ord::int as ord, doc_id from negs")
def sample_negative(s, d):
    m = sae_members(s, d)
    return sampling.negatives(m, m.select("doc_id").distinct(), m.select("feature_id").distinct(), 10)


# --- texts ------------------------------------------------------------------------------------


@query("select doc_id, case when len(string_split(text, ' ')) <= 64 then text else array_to_string(string_split(text, ' ')[1:64], ' ') || ' ...' end as text from documents")
def truncate_text(s, d):
    return table(s, d, "documents").select("doc_id", tx.truncate(F.col("text"), 64).alias("text"))


@query("select doc_id, len(string_split(lower(text), ' '))::int as n, md5(array_to_string(string_split(lower(text), ' '), '|')) as words from documents where text is not null")
def tokenize_lower(s, d):
    w = tx.words_lower(F.col("text"))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, "|")).alias("words"))


@query(f"with {C_ART} select distinct unnest(string_split(tokenized_text, ' ')) as word from art where tokenized_text is not null")
def vocabulary(s, d):
    return articles(s, d, "tokenized_text").where("tokenized_text is not null").select(F.explode(F.split("tokenized_text", " ")).alias("word")).distinct()


C_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.ENGLISH_STOP) + "]"


@query(f"with {C_ART} select doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: not list_contains({C_STOP}, w)), ' ') as text from art where text is not null")
def remove_stopwords(s, d):
    return articles(s, d, "text").where("text is not null").select("doc_id", F.array_join(tx.without(F.split("text", " ")), " ").alias("text"))


@query(rf"with {C_ART} select doc_id, regexp_replace(string_split(text, '= =')[1], '^\s+|\s+$', '', 'g') as abstract from art where text is not null")
def extract_abstract(s, d):
    return articles(s, d, "text").where("text is not null").select("doc_id", tx.abstract(F.col("text")).alias("abstract"))


def _chunk_sql(size: int, overlap: int) -> str:
    step = size - overlap if size > overlap else max(1, size // 2)
    return f"""with d as (select doc_id, string_split(text, ' ') as t from documents where text is not null),
 n as (select *, least(greatest(1, ceil((len(t) - {size}) / {step}) + 1), ceil(len(t) / {step}))::bigint as n from d where len(t) > 0),
 i as (select *, unnest(range(n)) as i from n)
 select doc_id, i::int as chunk_idx, len(t[i * {step} + 1 : i * {step} + {size}])::int as n, md5(array_to_string(t[i * {step} + 1 : i * {step} + {size}], ' ')) as digest from i"""


def _chunks(s, d, size: int, overlap: int) -> DataFrame:
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("t"))
    return tx.chunks(rows, "t", size, overlap, ["doc_id"]).select("doc_id", "chunk_idx", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(_chunk_sql(64, 16))
def chunk_corpus(s, d):
    return _chunks(s, d, 64, 16)


@query(_chunk_sql(32, 40))
def chunk_overlap_guard(s, d):
    return _chunks(s, d, 32, 40)


# --- activations ------------------------------------------------------------------------------


def token_acts(s, d) -> DataFrame:
    """The rows of theta as tokens of chunks of 16: pos, token_id and validity follow from the number."""
    w = sae_members(s, d)
    return w.select(F.floor(F.col("doc_id") / 64).cast("int").alias("doc"), (F.floor(F.col("doc_id") / 16) % 4).cast("int").alias("chunk_idx"), (F.col("doc_id") % 16).cast("int").alias("pos"),
                    (F.col("doc_id") % 7).cast("int").alias("token_id"), "feature_id", F.col("weight").alias("act"), (F.col("doc_id") % 16 < 14).alias("valid")).withColumnRenamed("doc", "doc_id")


C_ACT = f"{C_SAE}, act as (select (doc_id // 64)::int as doc_id, ((doc_id // 16) % 4)::int as chunk_idx, (doc_id % 16)::int as pos, (doc_id % 7)::int as token_id, feature_id, weight as act, doc_id % 16 < 14 as valid from sae)"


def _token_agg(expr: str) -> str:
    return f"with {C_ACT} select doc_id, chunk_idx, feature_id, round({expr}, 9) as theta from act group by all"


@query(_token_agg("coalesce(sum(act) filter (valid), 0) / greatest(count(*) filter (valid), 1)"))
def token_agg_mean(s, d):
    return ac.chunk_features(token_acts(s, d), ["doc_id", "chunk_idx"], "mean").withColumn("theta", r("theta", 9))


@query(_token_agg("coalesce(max(act) filter (valid), 0)"))
def token_agg_max(s, d):
    return ac.chunk_features(token_acts(s, d), ["doc_id", "chunk_idx"], "max").withColumn("theta", r("theta", 9))


@query(_token_agg("count(*) filter (valid and act > 0.5) / greatest(count(*) filter (valid), 1)"))
def token_agg_frac_above(s, d):
    return ac.chunk_features(token_acts(s, d), ["doc_id", "chunk_idx"], "frac_above", 0.5).withColumn("theta", r("theta", 9))


def _doc_agg(s, d, how: str) -> DataFrame:
    return ac.document_features(ac.chunk_features(token_acts(s, d), ["doc_id", "chunk_idx"], "max"), how).withColumn("theta", r("theta", 9))


_CHUNK_MAX = f"with {C_ACT}, c as (select doc_id, chunk_idx, feature_id, coalesce(max(act) filter (valid), 0) as theta from act group by all)"


@query(_CHUNK_MAX + " select doc_id, feature_id, round(max(theta), 9) as theta from c group by all")
def doc_agg_max(s, d):
    return _doc_agg(s, d, "max")


@query(_CHUNK_MAX + " select doc_id, feature_id, round(avg(theta), 9) as theta from c group by all")
def doc_agg_mean(s, d):
    return _doc_agg(s, d, "mean")


C_TOPTOK = f"""{C_ACT}, best as (select *, max(act) over (partition by doc_id, chunk_idx, feature_id) as feature_weight,
 row_number() over (partition by doc_id, chunk_idx, feature_id order by act desc, pos)::int as place from act where valid),
 tt as (select doc_id, chunk_idx, feature_id, feature_weight, place, pos, token_id, act from best where place <= 5 and token_id <> 0 and feature_weight > 0)"""


@query(f"with {C_TOPTOK} select * from tt")
def theta_sparse_top_tokens(s, d):
    return ac.top_tokens(token_acts(s, d), ["doc_id", "chunk_idx"], 5, excluded_token=0)


@query(f"with {C_TOPTOK} select doc_id, count(distinct (chunk_idx, feature_id)) as n, round(sum(fw), 6) as total from (select distinct doc_id, chunk_idx, feature_id, feature_weight as fw from tt) group by 1")
def theta_sparse_documents(s, d):
    acts = token_acts(s, d)
    sparse = ac.nested(ac.top_tokens(acts, ["doc_id", "chunk_idx"], 5, excluded_token=0), ["doc_id", "chunk_idx"])
    whole = ac.with_documents(acts.select("doc_id").distinct(), sparse)
    total = F.aggregate(F.transform("theta_sparse", lambda x: x["feature_weight"]), F.lit(0.0), lambda a, x: a + x)
    return whole.where(F.size("theta_sparse") > 0).select("doc_id", F.size("theta_sparse").cast("bigint").alias("n"), r(total).alias("total"))


@query(f"""with {C_SAE}, e as (select p_partkey as feature_id, case when p_partkey % 5 = 0 then ' ' else p_name end as description from part)
 select s.feature_id, n, coalesce(nullif(trim(description), ''), '<no explanation>') as feature_label from (select feature_id, count(*) as n from sae group by 1) s left join e on e.feature_id = s.feature_id""")
def explanation_enrich(s, d):
    e = table(s, d, "part").select(F.col("p_partkey").alias("feature_id"), F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("description"))
    return ac.explain(ft.sizes(sae_members(s, d)), e)


@query("""select p_size as feature_id, first(coalesce(nullif(trim(case when p_partkey % 5 = 0 then ' ' else p_name end), ''), '<no explanation>') order by p_partkey % 16 desc, p_partkey desc) as description from part group by 1""")
def explanation_last_wins(s, d):
    rows = table(s, d, "part").select(F.col("p_size").alias("feature_id"), F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("description"), (F.col("p_partkey") % 16).alias("batch"), F.col("p_partkey").alias("line"))
    return ac.last_explanations(rows)


# --- selection --------------------------------------------------------------------------------


@query("""with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0),
 c as (select query_id, vec_id as doc_id, list_inner_product(q.v, embedding::double[]) as cosine from q, embeddings where vec_id <> query_id)
 select query_id, place::int as place, doc_id, round(cosine, 6) as cosine from (select *, row_number() over (partition by query_id order by round(cosine, 9) desc, doc_id) as place from c) where place <= 10""")
def cosine_topn(s, d):
    v = vectors(s, d).select("doc_id", "v")
    return selection.nearest(v.where("doc_id % 50 = 0"), v, 10).withColumn("cosine", r("cosine"))


@query(f"""with {C_VEC}, x as (select feature_id, unnest(range(64)) as i, unnest(v) * weight as x from vec), sums as (select feature_id, list(x order by i) as s from (select feature_id, i, sum(x) as x from x group by all) group by 1)
 select feature_id, doc_id, round(list_inner_product(v, s), 6) as coverage from vec join sums using (feature_id)""")
def coverage_score(s, d):
    return selection.coverage(labelled_vectors(s, d)).withColumn("coverage", r("coverage"))


def _mmr_sql(k: int, repeat: bool = False) -> str:
    """Unrolled picks: each step takes the best row of each group, then raises the redundancy of the rest."""
    out = f"""with {C_VEC}, x as (select feature_id, unnest(range(64)) as i, unnest(v) * weight as x from vec), sums as (select feature_id, list(x order by i) as s from (select feature_id, i, sum(x) as x from x group by all) group by 1),
 st0 as (select feature_id, doc_id, v, list_inner_product(v, s) as base, 0.0::double as red from vec join sums using (feature_id))"""
    for t in range(k):
        out += f""", p{t} as (select feature_id, {t} as ord, doc_id, v from st{t} qualify row_number() over (partition by feature_id order by base - 0.5 * red desc, doc_id) = 1),
 st{t + 1} as (select s.feature_id, s.doc_id, s.v, s.base, greatest(s.red, list_inner_product(s.v, p.v)) as red from st{t} s join p{t} p using (feature_id) {'' if repeat else 'where s.doc_id <> p.doc_id'})"""
    return out + " " + " union all ".join(f"select feature_id, ord, doc_id from p{t}" for t in range(k))


@query(_mmr_sql(4))
def mmr_select(s, d):
    return selection.covering_picks(labelled_vectors(s, d), 4)


@query(_mmr_sql(3, True))
def mmr_select_repeat(s, d):
    return selection.covering_picks(labelled_vectors(s, d), 3, repeat=True)


@query(f"with {C_VEC} select feature_id, doc_id, round(exp(weight / 0.2), 6) as relevance from vec")
def dpp_relevance(s, d):
    return labelled_vectors(s, d).select("feature_id", "doc_id", r(selection.relevance(F.col("weight"), 0.1)).alias("relevance"))


def _dpp_sql(k: int, start: str) -> str:
    out = f"with {C_VEC}, s0 as (select feature_id, doc_id, exp(weight / 0.2) as w, list_transform(v, lambda x: x * exp(weight / 0.2)) as v from vec), t0 as (select *, list_inner_product(v, v) as d, []::double[] as c from s0)"
    for t in range(k):
        score, root = ("w", "sqrt(p.w)" if start == "compat" else "sqrt(p.d)") if t == 0 else ("d", "sqrt(p.d)")
        dots = " - list_inner_product(s.c, p.c)" if t else ""
        out += f""", p{t} as (select * from t{t} qualify row_number() over (partition by feature_id order by {score} desc, doc_id) = 1),
 e{t} as (select s.*, (list_inner_product(s.v, p.v){dots}) / {root} as e from t{t} s join p{t} p using (feature_id) where s.doc_id <> p.doc_id),
 t{t + 1} as (select feature_id, doc_id, w, v, d - e * e as d, list_append(c, e) as c from e{t})"""
    return out + " " + " union all ".join(f"select feature_id, {t} as ord, doc_id, round(w, 6) as weight, false as degenerate from p{t}" for t in range(k))


def _dpp(s, d, start: str) -> DataFrame:
    rows = labelled_vectors(s, d).withColumn("weight", selection.relevance(F.col("weight"), 0.1))
    return selection.greedy_dpp(rows, 4, start).withColumn("weight", r("weight"))


@query(_dpp_sql(4, "compat"))
def dpp_select(s, d):
    return _dpp(s, d, "compat")


@query(_dpp_sql(4, "exact"))
def dpp_select_exact(s, d):
    return _dpp(s, d, "exact")


C_MVEC = f"{C_SAE}, vec as (select feature_id, doc_id, embedding::double[] as v, weight from sae join embeddings on vec_id = doc_id)"


@query(_dpp_sql(3, "compat").replace(C_VEC, C_MVEC).replace("false as degenerate", "'pos' as polarity"))
def dpp_members(s, d):
    """Diverse members of every feature by their embeddings."""
    found = selection.dpp_samples(sae_members(s, d), vectors(s, d), 3, 0.1)
    return found.withColumn("weight", r("weight"))


# --- metrics ----------------------------------------------------------------------------------


@query(f"""with {C_ART}, d as (select doc_id, string_split(lower(text), ' ') as t from art where text is not null),
 w as (select topic_id, lower(word) as word from (select topic_id, word_id, row_number() over (partition by topic_id order by p desc, word_id) as k from (select topic_id, unnest(range(len(p))) as word_id, unnest(p) as p from topic2word_dist) where p is not null) join vocab using (word_id) where k <= 10),
 win as (select doc_id, unnest(range(greatest(len(t) - 10, 0) + 1)) as s, t from d), total as (select count(*) as n from win),
 hit as (select distinct doc_id, s, word from (select doc_id, s, unnest(list_distinct(t[s + 1 : s + 10])) as word from win) where word in (select word from w)),
 one as (select word, count(*) as c from hit group by 1), two as (select a.word as a, b.word as b, count(*) as c from hit a join hit b using (doc_id, s) where a.word <> b.word group by all),
 pairs as (select x.topic_id, x.word as a, y.word as b, coalesce(two.c, 0) / n + 1e-12 as p, oa.c / n as pa, ob.c / n as pb from w x join w y on x.topic_id = y.topic_id and x.word <> y.word
  join one oa on oa.word = x.word join one ob on ob.word = y.word left join two on two.a = x.word and two.b = y.word, total)
 select topic_id, round(avg(ln(p / (pa * pb)) / -ln(p)), 6) as npmi, count(*) as pairs from pairs group by 1""")
def npmi_coherence(s, d):
    """Over the articles' raw texts."""
    words = ft.top_words(table(s, d, "topic2word_dist"), table(s, d, "vocab")).select("topic_id", F.lower("word").alias("word"))
    docs = articles(s, d, "text").where("text is not null").select(tx.words_lower(F.col("text")).alias("t"))
    return coherence.npmi(docs, "t", words).withColumn("npmi", r("npmi"))


@query(f"""with {C_DT}, {C_ART}, x as (select first(feature_id order by weight desc, feature_id) as pred, doc_id from dt group by 2), j as (select pred, supercategory as truth from x join art using (doc_id) where supercategory is not null),
 c as (select pred, truth, count(*) as n from j group by all), p as (select avg(m / s) as purity from (select max(n) as m, sum(n) as s from c group by pred)), i as (select sum(m) / sum(s) as ip from (select max(n) as m, sum(n) as s from c group by truth))
 select round(purity, 9) as purity, round(ip, 9) as inverse_purity, round(2 / (1 / purity + 1 / ip), 9) as harmonic from p, i""")
def purity(s, d):
    pred = ft.strongest_feature(doc_topics(s, d)).select("doc_id", F.col("feature_id").alias("pred"))
    found = metrics.purity(pred.join(articles(s, d, "supercategory").select("doc_id", F.col("supercategory").alias("truth")), "doc_id"))
    return found.select(*[r(c, 9).alias(c) for c in found.columns])


@query(f"""with {C_VERD}, a as (select feature_id, coalesce(sum(verdict) filter (polarity = 'pos'), 0) as p, count(*) filter (polarity = 'pos') as n, coalesce(sum(verdict) filter (polarity = 'neg'), 0) as q from verd group by 1),
 b as (select feature_id, p / n as r, p / (p + q + 1e-5) as pr from a where n > 0) select feature_id, round(r, 6) as recall, round(pr, 6) as precision, round(2 * pr * r / (pr + r + 1e-5), 6) as f1 from b""")
def label_prf(s, d):
    out = metrics.label_scores(verdicts(s, d))
    return out.select("feature_id", *[r(c).alias(c) for c in ("recall", "precision", "f1")])


C_CONF = f"""{C_VERD}, dw as (select doc_id, max(weight) as w from sae group by 1), x as (select feature_id, coalesce(sum(w) filter (polarity = 'pos' and verdict = 1), 0) as tp, coalesce(sum(w) filter (polarity = 'neg' and verdict = 1), 0) as fp,
 coalesce(sum(w) filter (polarity = 'pos' and verdict <> 1), 0) as fn, coalesce(sum(w) filter (polarity = 'neg' and verdict <> 1), 0) as tn from verd join dw using (doc_id) group by 1),
 conf as (select *, tp / (tp + fp + 1e-5) as precision, tp / (tp + fn + 1e-5) as recall from x), conff as (select *, 2 * precision * recall / (precision + recall + 1e-5) as f1 from conf)"""


@query(f"with {C_CONF} select feature_id, {', '.join(f'round({c}, 6) as {c}' for c in ('tp', 'fp', 'fn', 'tn', 'precision', 'recall', 'f1'))} from conff")
def report_confusion_weighted(s, d):
    out = metrics.confusion(verdicts(s, d), ft.highest_weight(sae_members(s, d)))
    return out.select("feature_id", *[r(c).alias(c) for c in out.columns[1:]])


@query(f"with {C_CONF} select feature_id % 3 as method, {', '.join(f'round(avg({c}), 3) as {c}_mean, round(stddev_pop({c}), 3) as {c}_std' for c in ('precision', 'recall', 'f1'))} from conff group by 1")
def report_method_table(s, d):
    scores = metrics.confusion(verdicts(s, d), ft.highest_weight(sae_members(s, d))).withColumn("method", F.col("feature_id") % 3)
    return metrics.method_table(scores, ["method"])


@query(f"with {C_VERD} select (ord // 10)::int as decile, round(avg(verdict), 6) as recall, count(*) as n from verd where polarity = 'pos' and ord // 10 < 10 group by 1")
def recall_deciles(s, d):
    return metrics.recall_by_decile(verdicts(s, d)).withColumn("recall", r("recall"))


@query(f"with {C_VERD} select feature_id, round(avg((verdict = 1)::int), 6) as consistency from verd where polarity = 'pos' group by 1")
def consistency_score(s, d):
    return metrics.consistency(verdicts(s, d)).withColumn("consistency", r("consistency"))


@query(f"with {C_VERD} select feature_id, round(sum(verdict * weight) / sum(weight), 6) as generalization from verd join sae using (feature_id, doc_id) where polarity = 'pos' group by 1")
def generalization_score(s, d):
    return metrics.generalization(verdicts(s, d), sae_members(s, d)).withColumn("generalization", r("generalization"))


@query(f"""with {C_VERD}, x as (select v.feature_id, m.feature_id as other_id, sum(greatest(verdict, 0) * m.weight) / sum(m.weight) as x from verd v join sae m using (doc_id) where v.polarity = 'neg' and m.feature_id <> v.feature_id group by all)
 select feature_id, round(avg(x), 6) as distinctiveness from x group by 1""")
def distinctiveness_score(s, d):
    v = verdicts(s, d).where("polarity = 'neg'").select("feature_id", "doc_id", F.greatest("verdict", F.lit(0)).alias("verdict"))
    m = sae_members(s, d).select(F.col("feature_id").alias("other_id"), "doc_id", "weight")
    return metrics.distinctiveness(v.join(m, "doc_id")).withColumn("distinctiveness", r("distinctiveness"))


@query("""select count(*) as calls, sum(length(text))::bigint as tokens_in, sum(length(title))::bigint as tokens_out, round(sum(length(text)) * 1.5e-7 + sum(length(title)) * 6e-7, 9) as cost from documents where text is not null and title is not null""")
def llm_cost(s, d):
    usage = table(s, d, "documents").select(F.length("text").alias("tokens_in"), F.length("title").alias("tokens_out"), F.expr("text is not null and title is not null").alias("ok"))
    return metrics.cost(usage, an.PRICE_IN, an.PRICE_OUT, only_ok=True).withColumn("cost", r("cost", 9))


# --- autoencoder and topics -------------------------------------------------------------------


def pre_activations(s, d) -> DataFrame:
    """A linear encoder with fixed weights of +-1: neuron j adds the elements whose number shares an even count of bits with j."""
    cells = vectors(s, d).select("doc_id", F.posexplode("v").alias("i", "x"))
    sign = F.when(F.bit_count(F.col("i").bitwiseAND(F.col("neuron"))) % 2 == 0, 1.0).otherwise(-1.0)
    each = cells.withColumn("neuron", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return each.groupBy("doc_id", "neuron").agg(F.sum(F.col("x").cast("double") * sign).alias("pre")).withColumn("pre", r("pre", 9))


C_PRE = """cells as (select vec_id as doc_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings),
 pre as (select doc_id, neuron::int as neuron, round(sum(x * case when bit_count((i & neuron)::bigint) % 2 = 0 then 1 else -1 end), 9) as pre from cells, (select unnest(range(32)) as neuron) group by all)"""


@query(f"with {C_PRE} select doc_id, neuron, round(greatest(pre, 0), 6) as act from pre qualify row_number() over (partition by doc_id order by pre desc, neuron) <= 8")
def sae_topk_activations(s, d):
    return sae.top_activations(pre_activations(s, d), 8).withColumn("act", r("act"))


@query(f"with {C_PRE}, n as (select count(*) as n from embeddings) select doc_id, neuron, round(act, 6) as act from (select *, greatest(pre, 0) as act, row_number() over (order by greatest(pre, 0) desc, doc_id, neuron) as k from pre), n where k <= 8 * n")
def sae_batch_topk_activations(s, d):
    return sae.batch_activations(pre_activations(s, d), 8).withColumn("act", r("act"))


@query(f"with {C_PRE}, few as (select *, row_number() over (partition by doc_id order by pre desc, neuron) as k from pre), a as (select doc_id, neuron, greatest(pre, 0) as act from few where k <= 4) "
       "select doc_id, md5(string_agg(coalesce(round(act, 6), 0)::decimal(12, 6)::varchar, ' ' order by neuron)) as digest from (select doc_id, neuron::int as neuron from (select distinct doc_id from pre), (select unnest(range(32)) as neuron)) left join a using (doc_id, neuron) group by 1")  # fmt: skip
def sae_dense_codes(s, d):
    """The codes of each row scattered into an array."""
    arrays = sae.dense(sae.top_activations(pre_activations(s, d), 4), 32)
    return arrays.select("doc_id", F.md5(F.array_join(F.transform("theta", lambda x: F.round(x, 6).cast("decimal(12, 6)").cast("string")), " ")).alias("digest"))


@query(f"with {C_PRE} select doc_id, neuron, round(pre, 6) as act from pre where pre > 0.5")
def sae_threshold_activations(s, d):
    return sae.above_threshold(pre_activations(s, d), 0.5).withColumn("act", r("act"))


@query("""with c as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings), m as (select *, avg(x) over (partition by i) as mu from c)
 select round(avg((x - case when abs(x) > 0.1 then x else 0 end) ** 2) / avg((x - mu) ** 2), 6) as nmse from m""")
def sae_normalized_mse(s, d):
    cells = vectors(s, d).select(F.posexplode("v").alias("i", "x")).select("i", F.col("x").cast("double").alias("x"))
    return sae.normalized_mse(cells.withColumn("y", F.when(F.abs("x") > 0.1, F.col("x")).otherwise(F.lit(0.0)))).withColumn("nmse", r("nmse"))


@query("with c as (select unnest(range(64))::int as i, unnest(embedding)::double as x from embeddings) select i, quantile_disc(x, 0.5) as median from c group by 1")
def sae_median_init(s, d):
    return sae.lower_median(vectors(s, d).select(F.posexplode("v").alias("i", "x")).select("i", F.col("x").cast("double").alias("x")))


@query()
def sae_train(s, d):
    """Losses of an autoencoder trained on the vectors, and then all vectors' codes summed up by neuron."""
    rows = vectors(s, d)
    model = sae.train(rows, 96, 8, epochs=200, rate=3e-3, prefixes=(0.25, 0.5))
    codes = sae.activations(rows, model).select(F.posexplode("theta").alias("neuron", "act")).where("act > 0")
    return codes.groupBy("neuron").agg(F.count(F.lit(1)).alias("n"), F.max("act").alias("highest"))


@query("select count(*) as rows, true as sparse, true as falling from embeddings")
def sae_totals(s, d):
    """What must hold of a trained autoencoder: codes for all rows, at most k active, a loss that has fallen."""
    model = sae.train(vectors(s, d), 96, 8, epochs=20, rate=3e-3)
    most = sae.activations(vectors(s, d), model).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(F.filter("theta", lambda x: x > 0))).alias("most"))
    falling = model.history[-1]["val"] < model.history[0]["val"]
    return most.select("rows", (F.col("most") <= 8).alias("sparse"), F.lit(falling).alias("falling"))


@query("select count(distinct doc_id) as records, 0::bigint as uneven, 5 as topics from (select doc_id, arg_max_null(tokenized_text, loaded_at) as t from wikitext group by 1) where t is not null")
def lda_totals(s, d):
    """What must hold of a topic model: every record's topics and every topic's words and records sum to 1."""
    docs = articles(s, d, "tokenized_text").where("tokenized_text is not null").select("doc_id", F.lower("tokenized_text").alias("t"))
    found = topics.fit_topics(docs, "t", 5, max_iterations=10)
    sums = [found[n].groupBy(k).agg(F.sum("p").alias("p")) for n, k in (("doc_topic", "doc_id"), ("topic_word", "topic_id"), ("topic_doc", "topic_id"))]
    uneven = sums[0].select("p").unionByName(sums[1].select("p")).unionByName(sums[2].select("p")).agg(F.count_if(F.abs(F.col("p") - 1) > 1e-6).alias("uneven"))
    counts = found["doc_topic"].agg(F.count_distinct("doc_id").alias("records"), F.count_distinct("topic_id").cast("int").alias("topics"))
    return one_row(counts, uneven)


@query()
def lda_topics(s, d):
    """Ten words of each of ten topics of the wikitext records."""
    docs = articles(s, d, "tokenized_text").where("tokenized_text is not null").select("doc_id", F.lower("tokenized_text").alias("t"))
    found = topics.fit_topics(docs, "t", 10)
    order = Window.partitionBy("topic_id").orderBy(F.col("p").desc(), "word_id")
    top = found["topic_word"].withColumn("place", F.row_number().over(order)).where("place <= 10")
    return found["vocab"].join(F.broadcast(top), "word_id").select("topic_id", "place", "word")


# --- labelling --------------------------------------------------------------------------------


@query(f"""with {C_SAE}, {C_ART}, {C_STRATA.format(s=3, q=1)}, p as (select feature_id, ord, case when len(string_split(text, ' ')) <= 20 then text else array_to_string(string_split(text, ' ')[1:20], ' ') || ' ...' end as t
  from strat join art using (doc_id) where text is not null and feature_id in (select feature_id from sae group by 1 having count(*) >= 30)),
 n as (select *, row_number() over (partition by feature_id order by ord) as k from p)
 select feature_id, string_agg('Document ' || k || ': ' || t, chr(10) order by k) as documents, 'No documents' as others from n group by 1""")
def prompt_build(s, d):
    m = sae_members(s, d)
    rows = sampling.stratified_members(m, 3, 3).withColumn("polarity", F.lit("pos"))
    rows = stored(rows)  # three rows a feature
    docs = articles(s, d, "text", only=rows.select("doc_id")).where("text is not null")
    return an.prompts(rows, docs, 20, ft.large_features(m, 30))


@query(f"""with {C_SAE}, {C_ART}, {C_NEG}, pos as (select feature_id, row_number() over (partition by feature_id order by {C_KEY}, doc_id) - 1 as ord, doc_id from sae),
 texts as (select feature_id, polarity, ord, case when len(string_split(text, ' ')) <= 12 then text else array_to_string(string_split(text, ' ')[1:12], ' ') || ' ...' end as t
   from (select feature_id, 'pos' as polarity, ord, doc_id from pos where ord < 2 union all select feature_id, 'neg', ord, doc_id from negs where ord < 3) join art using (doc_id) where text is not null),
 numbered as (select *, row_number() over (partition by feature_id, polarity order by ord) as k from texts)
 select feature_id, coalesce(string_agg('Document ' || k || ': ' || t, chr(10) order by k) filter (polarity = 'pos'), '') as documents,
   coalesce(string_agg('Document ' || k || ': ' || t, chr(10) order by k) filter (polarity = 'neg'), 'No documents') as others from numbered group by 1""")
def prompt_negatives(s, d):
    m = sae_members(s, d)
    rows = stored(sampling.sample("random", m, m, m.select("doc_id").distinct(), m.select("feature_id").distinct(), 2, 3))
    return an.prompts(rows, articles(s, d, "text", only=rows.select("doc_id")).where("text is not null"), 12)


@query(f"with {C_SAE}, r as (select feature_id, doc_id, row_number() over (partition by feature_id order by {C_KEY}, doc_id) - 1 as ord from sae), t as (select feature_id, doc_id from r where ord < 3) "
       f"select feature_id, (row_number() over (partition by feature_id order by {C_KEY}, doc_id) - 1)::int as ord, doc_id, weight from sae where (feature_id, doc_id) not in (select (feature_id, doc_id) from t) qualify row_number() over (partition by feature_id order by {C_KEY}, doc_id) <= 4")  # fmt: skip
def sample_unseen(s, d):
    """Members that an earlier sample doesn't hold."""
    m = sae_members(s, d)
    return sampling.unseen(m, sampling.random_members(m, 3), 4)


@query(f"with {C_TD}, r as (select feature_id, doc_id, row_number() over (partition by feature_id order by {C_KEY}, doc_id) - 1 as ord from td where weight > 0) "
       "select x.feature_id, r.feature_id as other_id, r.ord::int as ord, r.doc_id from (select distinct feature_id from r) x join r on x.feature_id <> r.feature_id where r.ord < 2")  # fmt: skip
def sample_other_topics(s, d):
    """Two documents of every other topic, for each topic."""
    return sampling.of_other_topics(ft.members(topic_weights(s, d)), 2)


@query("select doc_id, coalesce(try_cast(trim(source) as bigint) is not null, false) as source_is_int, try_cast(trim(case when doc_id % 3 = 0 then ' 12 ' when doc_id % 3 = 1 then '1x' end) as bigint) is not null as is_int from documents")
def is_int(s, d):
    text = F.when(F.col("doc_id") % 3 == 0, " 12 ").when(F.col("doc_id") % 3 == 1, "1x")
    return table(s, d, "documents").select("doc_id", F.coalesce(tx.is_int(F.col("source")), F.lit(False)).alias("source_is_int"), tx.is_int(text).alias("is_int"))


def _label_model(prompt: str) -> str:
    """A deterministic stand-in for a labelling model: JSON for two of three prompts, else words."""
    h = hashlib.md5(prompt.encode()).hexdigest()
    return json.dumps({"name": h[:6], "description": h[6:12]}) if int(h[12:14], 16) % 3 else "cannot say " + h[:4]


def _judge_model(prompt: str) -> str:
    """A deterministic stand-in for a judge: yes, no, or a reply that is no number."""
    k = int(hashlib.md5(prompt.encode()).hexdigest()[:4], 16) % 10
    return " 1\n" if k < 6 else "0" if k < 9 else "I cannot tell"


def labels(s, d, least: int = 30) -> DataFrame:
    """Labels of the features of at least ``least`` members, from three stratified members each."""
    m = sae_members(s, d)
    rows = stored(sampling.stratified_members(m, 3, 3).withColumn("polarity", F.lit("pos")))
    docs = articles(s, d, "text", only=rows.select("doc_id")).where("text is not null")
    return stored(an.annotate(rows, docs, m, _label_model, least=least, max_words=20))


C_TRUNC = "case when len(string_split(text, ' ')) <= {n} then text else array_to_string(string_split(text, ' ')[1:{n}], ' ') || ' ...' end"
C_LABEL = f"""{C_SAE}, {C_ART}, {C_STRATA.format(s=3, q=1)}, lp as (select feature_id, ord, doc_id, {C_TRUNC.format(n=20)} as t from strat join art using (doc_id)
   where text is not null and feature_id in (select feature_id from sae group by 1 having count(*) >= 30)),
 ln as (select *, row_number() over (partition by feature_id order by ord) as k from lp),
 prompts as (select feature_id, string_agg(doc_id::varchar, ' ' order by ord) as pos_docs, '' as neg_docs, replace(replace('{{prompt}}', '<documents>', string_agg('Document ' || k || ': ' || t, chr(10) order by k)), '<others>', 'No documents') as prompt from ln group by 1),
 replies as (select *, md5(prompt) as h from prompts),
 labels as (select feature_id, pos_docs, neg_docs, case when ('0x' || h[13:14])::int % 3 <> 0 then h[1:6] end as name, case when ('0x' || h[13:14])::int % 3 <> 0 then h[7:12] end as description,
   case when ('0x' || h[13:14])::int % 3 = 0 then 'cannot say ' || h[1:4] end as raw, case when ('0x' || h[13:14])::int % 3 = 0 then 'unparsed' else 'ok' end as status from replies)"""
C_LABEL = C_LABEL.replace("{prompt}", an.TEMPLATES["simple"].format(documents="<documents>", others="<others>").replace("'", "''"))


@query(f"with {C_LABEL} select * from labels")
def label_loop(s, d):
    """Gate, prompt, call, parse, further tries, and the raw reply where none could be read."""
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return labels(s, d).select("feature_id", ids("pos_docs"), ids("neg_docs"), "name", "description", "raw", "status")


C_JUDGE = f"""{C_LABEL}, ev as (select *, row_number() over (partition by feature_id order by {C_KEY}, doc_id) - 1 as ord from sae),
 jp as (select e.feature_id, e.ord, e.doc_id, replace(replace(replace('{{prompt}}', '<name>', name), '<description>', description), '<text>', {C_TRUNC.format(n=300)}) as prompt
   from ev e join labels l using (feature_id) join art using (doc_id) where e.ord < 4 and status = 'ok' and text is not null and feature_id in (select feature_id from sae group by 1 having count(*) > 40)),
 jv as (select *, ('0x' || substr(md5(prompt), 1, 4))::int % 10 as k from jp),
 jr as (select feature_id, 'pos' as polarity, ord::int as ord, doc_id, case when k < 6 then 1 when k < 9 then 0 else -1 end as verdict from jv)"""
C_JUDGE = C_JUDGE.replace("{prompt}", an.TEMPLATES["judge_single"].format(name="<name>", description="<description>", text="<text>").replace("'", "''"))


@query(f"with {C_JUDGE} select * from jr")
def judge_loop(s, d):
    """One call for each labelled feature of enough members, polarity and document."""
    m = sae_members(s, d)
    rows = stored(sampling.random_members(m, 4).withColumn("polarity", F.lit("pos")))
    docs = articles(s, d, "text", only=rows.select("doc_id")).where("text is not null")
    return an.judge(rows, docs, labels(s, d), m, _judge_model, above=40)


@query(f"with {C_JUDGE}, a as (select feature_id, sum(verdict) as p, count(*) as n from jr group by 1) select round(avg(p / n), 6) as recall, round(avg(p / (p + 1e-5)), 6) as precision from a")
def judge_averages(s, d):
    """Overall averages of the scores of :func:`judge_loop`."""
    found = metrics.overall(metrics.label_scores(stored(judge_loop(s, d))))
    return found.select(r("recall").alias("recall"), r("precision").alias("precision"))


@query("select doc_id, coalesce(try_cast(regexp_extract(case when doc_id % 4 = 0 then ' 1 ' when doc_id % 4 = 1 then '0' when doc_id % 4 = 2 then '1.' end, '^\\s*([0-9]+)\\s*$', 1) as int), -1) as verdict from documents")
def verdict_parse(s, d):
    reply = F.when(F.col("doc_id") % 4 == 0, " 1\n").when(F.col("doc_id") % 4 == 1, "0").when(F.col("doc_id") % 4 == 2, "1.")
    return table(s, d, "documents").select("doc_id", an.verdict(reply).alias("verdict"))


@query("""select doc_id, case when doc_id % 3 = 0 then title end as name, case when doc_id % 3 = 0 then source end as description, case when doc_id % 3 = 1 then 'no JSON' end as raw,
 case doc_id % 3 when 0 then 'ok' when 1 then 'unparsed' else 'failed' end as status from documents where title is not null""")
def label_json_parse(s, d):
    k = F.col("doc_id") % 3
    reply = F.when(k == 0, F.to_json(F.struct(F.col("title").alias("name"), F.col("source").alias("description")))).when(k == 1, "no JSON")
    return table(s, d, "documents").where("title is not null").select("doc_id", an.label(reply).alias("l")).select("doc_id", "l.*")


# --- files ------------------------------------------------------------------------------------


def _file(s: SparkSession) -> str:
    return f"{shared_dir(s)}/facetry-{uuid.uuid4().hex}.json"


@query(f"""with {C_TD}, top as (select * from td qualify row_number() over (partition by feature_id order by weight desc, doc_id desc) <= 10)
 select feature_id, 'pos' as polarity, (row_number() over (partition by feature_id order by weight, doc_id) - 1)::int as ord, doc_id, weight from top""")
def samples_file(s, d):
    """Samples written to a file and read again."""
    json_io.write_samples(sampling.top_k(topic_weights(s, d), 10).withColumn("polarity", F.lit("pos")), path := _file(s))
    return json_io.read_samples(s, path)


@query(f"with {C_LABEL} select * from labels")
def labels_file(s, d):
    json_io.write_labels(labels(s, d), path := _file(s))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return json_io.read_labels(s, path).select("feature_id", ids("pos_docs"), ids("neg_docs"), "name", "description", "raw", "status")


@query(f"with {C_VERD} select feature_id, polarity, ord::int as ord, doc_id, verdict from verd where feature_id in (select feature_id from verd where polarity = 'pos')")
def evaluation_file(s, d):
    json_io.write_evaluation(an.evaluation(stored(verdicts(s, d))), path := _file(s))
    return json_io.read_verdicts(s, path)


@query("select vec_id as doc_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total, len(embedding)::int as n from embeddings")
def embeddings_file(s, d):
    json_io.write_embeddings(vectors(s, d), path := _file(s))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return json_io.read_embeddings(s, path).select("doc_id", F.round(total, 5).alias("total"), F.size("v").alias("n"))


@query("select topic_id, word_id::int as word_id, p, word from (select topic_id, unnest(range(len(p))) as word_id, coalesce(unnest(p), 0) as p from topic2word_dist) join vocab using (word_id)")
def topic_model_file(s, d):
    """The topics' words written to a topic-model file and read again."""
    cells = table(s, d, "topic2word_dist").select("topic_id", F.posexplode("p").alias("word_id", "p")).select("topic_id", "word_id", F.coalesce("p", F.lit(0.0)).alias("p"))
    docs = doc_topics(s, d).select("doc_id", F.col("feature_id").alias("topic_id"), F.col("weight").alias("p"))
    json_io.write_topic_model({"topic_word": cells, "doc_topic": docs, "topic_doc": docs, "vocab": table(s, d, "vocab")}, path := _file(s))
    found = json_io.read_topic_model(s, path)
    return found["topic_word"].join(found["vocab"], "word_id").select("topic_id", "word_id", "p", "word")


@query(f"with {C_SAE}, {C_ART}, top as (select * from sae qualify row_number() over (partition by feature_id order by weight desc, doc_id desc) <= 5) select feature_id, (row_number() over (partition by feature_id order by weight, doc_id) - 1)::int as ord, doc_id, weight, case when len(string_split(text, ' ')) <= 30 then text else array_to_string(string_split(text, ' ')[1:30], ' ') || ' ...' end as snippet from top left join art using (doc_id)")
def flagship(s, d):
    top = stored(sampling.top_k(sae_members(s, d), 5))  # five rows a feature
    return top.join(articles(s, d, "text", only=top.select("doc_id")).select("doc_id", tx.truncate(F.col("text"), 30).alias("snippet")), "doc_id", "left").select("feature_id", "ord", "doc_id", "weight", "snippet")
