"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).drop("n_repeated")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .privacy import privacy_report

    return privacy_report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score_documents

    return score_documents(table(spark, sf_dir, "documents")).drop("bits_per_byte")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, simhash_components

    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


_WORDS = r"[\x20\x09-\x0D]+"

#: The main text where the article element and five character references are all that a page needs.
_OP1 = r"""with a as (select page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') as h from pages),
b as (select page_id, url, regexp_replace(h, '<[^>]*>', ' ', 'g') as h from a),
c as (select page_id, url, replace(replace(replace(replace(h, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as h from b),
d as (select page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) as text from c)
select page_id, url, text, length(text) as n_chars from d"""

#: By row: several rows may have one doc_id.
_OP2 = rf"""with w as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_WORDS}'), lambda x: x <> '') as ws from documents),
u as (select r, doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
k as (select r, doc_id, i, list(word) over (partition by r order by i rows between current row and 12 following) as win from u),
s as (select r, doc_id, i, array_to_string(win, ' ') as s from k where len(win) = 13),
m as (select s, min(doc_id) as d from s group by s),
c as (select distinct r, i + j as i from (select s.r, s.i from s join m using (s) where m.d < s.doc_id), range(13) as t(j))
select w.doc_id, count(u.i) as n_words, count(c.i) as n_removed, sha256(coalesce(string_agg(u.word, ' ' order by u.i) filter (c.i is null), '')) as kept_sha256
from w left join u using (r) left join c on c.r = u.r and c.i = u.i group by w.r, w.doc_id"""

_OP3 = rf"""with dw as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{_WORDS}'), lambda x: x <> '') as ws from documents),
iw as (select item_id, list_filter(string_split_regex(lower(text), '{_WORDS}'), lambda x: x <> '') as ws from benchmark),
d as (select doc_id, unnest(range(len(ws) - 4)) as pos, ws, len(ws) - 4 as nd from dw where len(ws) >= 5),
ds as materialized (select doc_id, pos, nd, array_to_string(ws[pos + 1:pos + 5], ' ') as s from d),
i as (select item_id, unnest(range(len(ws) - 4)) as p0, ws, len(ws) - 4 as n, len(ws) as len from iw where len(ws) >= 5),
ish as materialized (select item_id, p0, n, len, array_to_string(ws[p0 + 1:p0 + 5], ' ') as s from i),
ic as materialized (select item_id, n, len, s, count(*) as k from ish group by all),
wc as (select doc_id, nd, item_id, n, len, start, s, k, count(*) as here from (select ds.*, item_id, n, len, k, unnest(range(greatest(pos - n + 1, 0), pos + 1)) as start from ds join ic using (s)) group by all),
sh as (select doc_id, nd, item_id, n, len, start, sum(least(here, k)) as shared from wc group by all),
sc as (select doc_id, item_id, start, len, shared / (least(start + n, nd) - start + n - shared) as j from sh),
rk as (select *, row_number() over (partition by doc_id, item_id order by j desc, start) as r from sc where j >= .8)
select doc_id, item_id, cast(start as bigint) as start, cast(len as bigint) as n_words, round(cast(j as double), 6) as similarity from rk where r = 1"""

_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "secret": r"[A-Za-z0-9_+=]{20,}", "term": r"[^\x20\x09-\x0D]+",
}
_FOUND = " union all ".join(f"select doc_id, t, {n} as o, '{k}' as kind, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as g from d" for n, (k, p) in enumerate(_KINDS.items()))
_LUHN = "list_sum(list_transform(range(len(q)), lambda i: case when i % 2 = 0 then cast(reverse(q)[i + 1] as integer) else cast(reverse(q)[i + 1] as integer) * 2 - 9 * cast(cast(reverse(q)[i + 1] as integer) > 4 as integer) end)) % 10 = 0"
_LEAD, _TAIL = r"^[^\p{L}\p{N}]+", r"[^\p{L}\p{N}]+\z"
_CLEAN = rf"regexp_replace(lower(w), '{_LEAD}|{_TAIL}', '', 'g')"


def _near(context: str) -> str:
    return rf"list_transform(string_split_regex(regexp_replace({context}, '^[^\x20\x09-\x0D]+|[^\x20\x09-\x0D]+\z', '', 'g'), '{_WORDS}'), lambda w: {_CLEAN})"


#: Base spans and secrets by pattern, then words by their co-occurrence with them, then the spans of those words.
_OP4 = rf"""with d as (select doc_id, coalesce(text, '') as t from documents), f as ({_FOUND}),
x as (select doc_id, t, o, kind, unnest(m) as v, unnest(g[1:len(m)]) as gap, generate_subscripts(m, 1) as i from f where len(m) > 0),
p as (select doc_id, t, o, kind, v, regexp_replace(v, '[^0-9]', '', 'g') as q, sum(length(gap)) over w + sum(length(v)) over w - length(v) as s from x window w as (partition by doc_id, o order by i)),
ok as materialized (select doc_id, t, o, kind, v, cast(s as bigint) as s, cast(s + length(v) as bigint) as e from p where case kind when 'ip' then list_bool_and(list_transform(string_split(v, '.'), lambda z: cast(z as hugeint) <= 255))
  when 'card' then length(q) between 13 and 19 and {_LUHN} when 'phone' then length(q) between 9 and 15 when 'secret' then len(regexp_extract_all(v, '[0-9]+')) >= 3 and len(regexp_extract_all(v, '[A-Za-z]+')) >= 3 else true end),
nw as (select md5(t) as rid, t, kind, kind || ':' || lower(v) as entity, list_distinct(list_filter(list_concat({_near('substring(t, greatest(s - 60, 0) + 1, s - greatest(s - 60, 0))')}, {_near('substring(t, e + 1, 60)')}), lambda w: w <> '')) as ws from ok where o < 5),
en as materialized (select rid, entity, ws from nw union all select rid, kind, ws from nw),
ne as (select entity, count(distinct rid) as n_entity from en group by entity),
tl as (select distinct rid, entity, unnest(ws) as term from en),
st as (select distinct rid, list_filter(string_split_regex(t, '{_WORDS}'), lambda w: w <> '') as ws from nw),
sh as (select rid, md5(array_to_string(ws[i:i + 4], ' ')) as h from (select rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from st)),
sg as (select rid, min(h) || min(substring(h, 17)) as g from sh group by rid),
nb as materialized (select entity, term, count(distinct rid) as n_both, count(distinct g) as apart from tl join sg using (rid) group by entity, term having n_both >= 5 and apart >= 5 and apart * 3 >= n_both),
aw as (select distinct md5(t) as rid, {_CLEAN.replace('lower(w)', 'lower(v)')} as term from ok where o = 5),
nt as (select term, count(*) as n_term from aw where term in (select term from nb) group by term),
nd as (select count(distinct text) as n from documents),
tm as materialized (select distinct term from nb join ne using (entity) join nt using (term), nd where n_entity < n and ln(n_both * n / (n_term * n_entity)) / ln(n / n_entity) >= .9),
sp as (select doc_id, o, kind, s, e from ok where o < 5 union all
  select doc_id, o, kind, s + length(v) - length(regexp_replace(v, '{_LEAD}', '')), e - length(v) + length(regexp_replace(v, '{_TAIL}', '')) from ok where o = 5 and {_CLEAN.replace('lower(w)', 'lower(v)')} in (select term from tm)),
a as (select doc_id, count(*) filter (o = 0) as n_email, count(*) filter (o = 1) as n_ip, count(*) filter (o = 2) as n_card, count(*) filter (o = 3) as n_phone, count(*) filter (o = 4) as n_secret, count(*) filter (o = 5) as n_term,
  string_agg(kind || ':' || s || ':' || e, ',' order by o, s) filter (o < 4) as base, string_agg(kind || ':' || s || ':' || e, ',' order by o, s) as spans from sp group by doc_id)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_secret, 0) as n_secret, coalesce(n_term, 0) as n_term
from d left join a using (doc_id)"""


_OP11 = rf"""with recursive dw as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}'), lambda x: x <> '') as ws from documents),
sh as materialized (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from dw where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from sh group by doc_id),
e as materialized (select a.doc_id as u, b.doc_id as v from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
r(doc_id, root) as (select doc_id, doc_id from dw union select e.v, r.root from r join e on e.u = r.doc_id where r.root < e.v)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.root) as component_id from r left join n using (doc_id) group by r.doc_id"""

_OP12 = """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
q as (select anchor_id, other_id as positive_id, score as positive_score from p where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank, other_id as negative_id, positive_score, score as negative_score
from q join p using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5"""

#: crc32 byte by byte, from a table that follows from its polynomial.
_OP13 = r"""with recursive z(i, k, v) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from z where k < 8),
tb as (select list(v order by i) as t from z where k = 8),
dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
du as materialized (select doc_id, unnest(ws) as w from dw),
bu as materialized (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
vo as (select w, hex(w) as h from (select w from du union select w from bu)),
cr as materialized (select w, xor(list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as b from vo, tb),
ds as (select b, count(*) as s from du join cr using (w) group by b), bs as (select b, count(*) as t from bu join cr using (w) group by b),
ga as materialized (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from du) + 10000) / ((coalesce(s, 0) + 1)::double * ((select count(*) from bu) + 10000)))) as g from range(10000) r(b) left join ds using (b) left join bs using (b)),
wt as (select doc_id, count(*) as n, floor(sum(g) / count(*)) as weight from du join cr using (w) join ga using (b) group by doc_id),
sc as (select d.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296))) as score, coalesce(weight, 0) as weight from dw d left join wt using (doc_id)),
rk as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as k, 10 * (count(*) over (partition by n_features >= 20)) // 100 as most from sc)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when n_features >= 20 and k <= most then k::bigint end as rank from rk"""


def oracle_sql() -> dict[str, str]:
    return {"op1_main_text": _OP1, "op2_substring_dedup": _OP2, "op3_decontamination": _OP3, "op4_private_data": _OP4, "op11_jaccard_join": _OP11, "op12_hard_negatives": _OP12, "op13_importance_resampling": _OP13}
