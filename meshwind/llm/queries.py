"""The corpus operators as queries over a folder of tables: queries() and oracle_sql()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, backoff, decontaminate, near_dup, pieces, pii, ranked, secrets, token_files, toxicity, url_filter, warc, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_media(webp.store_texts(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op7_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_suffix_array_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(_table(spark, sf_dir, "documents"))


def op11_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(_table(spark, sf_dir, "documents"))


def op12_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(_table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}

SQL["op1_warc_round_trip"] = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as low from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> low then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> low then low end as refers_to
from f
"""

SQL["op3_minhash_lsh_forest"] = r"""
with recursive d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct r, array_to_string(w[i:i + k - 1], ' ') as g from (select r, w, least(5, len(w)) as k from d where len(w) > 0), unnest(generate_series(1, len(w) - k + 1)) as u(i)),
n as materialized (select r, count(*) as n from s group by r),
p as (select a.r as u, b.r as v, count(*) as c from s a join s b on a.g = b.g and a.r < b.r group by all),
l as materialized (select u, v from p join n x on x.r = u join n y on y.r = v where 100 * c >= 85 * (x.n + y.n - c)),
e as materialized (select u, v from l union all select v, u from l),
t(r, q) as (select r, r from n union select t.r, e.v from t join e on e.u = t.q),
c as (select t.r, min(doc_id) as component_id from t join d on d.r = t.q group by t.r)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept from d left join n on n.r = d.r left join c on c.r = d.r
"""

SQL["op4_url_bloom_cascade"] = r"""
with h as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
r(verdict, domain, start) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
l as (select n || '.example.' || t as domain from (values ('casino-win'), ('cheap-pills'), ('spam-farm')) a(n), (values ('com'), ('net'), ('org')) b(t)),
m as (select h.page_id, host, path, (select struct_pack(rule := r.domain || r.start, verdict := r.verdict) from r
    where (host = r.domain or ends_with(host, '.' || r.domain)) and starts_with(path, r.start) order by length(r.domain || r.start) desc limit 1) as best,
  exists (select 1 from l where host = l.domain or ends_with(host, '.' || l.domain)) as hit from h)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, case when hit then 'block' else 'allow' end) as verdict from m
"""

SQL["op7_wu_manber_decontamination"] = r"""
with dw as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bl as (select item_id, w, least(10, len(w)) as k from bw where len(w) > 0),
bp as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as pat from bl, unnest(generate_series(1, len(w) - k + 1)) as g(i)),
ks as (select distinct k from bp),
dp as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as pat from dw, ks, unnest(generate_series(1, len(w) - k + 1)) as g(i)),
hit as (select dp.doc_id, dp.i, dp.k, bp.item_id from dp join bp on dp.k = bp.k and dp.pat = bp.pat),
pos as (select doc_id, count(distinct i + o) as n_hit from hit, unnest(generate_series(0, k - 1)) as g(o) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select dw.doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos on dw.doc_id = pos.doc_id left join its on dw.doc_id = its.doc_id
"""


SQL["op8_stupid_backoff"] = r"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
t as (select r, i, w[i] as b, case when i > 1 then w[i - 1] end as a from d, unnest(generate_series(1, len(w))) as g(i)),
n as (select count(*) as n from t),
o1 as (select r, b as w, count(*) as k from t group by all), c1 as (select w, sum(k) as c from o1 group by w),
o2 as (select r, a, b, count(*) as k from t where a is not null group by all), c2 as (select a, b, sum(k) as c from o2 group by a, b),
l1 as (select r, w, c - k as c from o1 join c1 using (w)),
s as (select o2.r, k, case when c2.c > k then k else 0 end as seen, k * case when c2.c > k then round(ln(c2.c - k) * 1e6) - round(ln(x.c) * 1e6) else round(ln(0.4) * 1e6) + round(ln(greatest(y.c, 0.5)) * 1e6) end as v
  from o2 join c2 on c2.a = o2.a and c2.b = o2.b join l1 x on x.r = o2.r and x.w = o2.a join l1 y on y.r = o2.r and y.w = o2.b
  union all select t.r, 1, 0, round(ln(greatest(l1.c, 0.5)) * 1e6) from t join l1 on l1.r = t.r and l1.w = t.b where t.i = 1),
e as (select r, sum(seen) as seen, sum(v) as v from s group by r),
f as (select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, cast(coalesce(seen, 0) as bigint) as n_seen, (coalesce(v, 0) - (coalesce(len(w), 0) - coalesce(seen, 0)) * (select round(ln(n) * 1e6) from n)) / 1e6 as log_score from d left join e on e.r = d.r)
select doc_id, n_words, n_seen, log_score, case when n_words > 0 then log_score / n_words end as mean_log_score from f
"""

SQL["op12_inverted_treaps"] = r"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
n as (select count(*) as docs, sum(len(w)) as terms from d where len(w) > 0),
m as (select r, doc_id, 100 - 50 + ((50 * len(w) * docs) // terms) as m from d, n where len(w) > 0),
p as materialized (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all),
i as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from p group by term), n),
q as (select row_number() over () as q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as terms from benchmark),
t as (select q, item_id, unnest(terms) as term from q),
s as (select q, item_id, doc_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from t join i using (term) join p using (term) join m using (r) group by all),
b as (select item_id, cast(row_number() over (partition by q order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from b where rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items(), key=lambda x: int(x[0][2:].split("_")[0]) if x[0].startswith("op") else 0) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
