"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from fleetlens.llm.urlfilter import LIMIT, WEIGHTS

_HIT = "regexp_matches(u, '(^|[^a-z0-9]){}([^a-z0-9]|$)')::int"
_STRICT = " + ".join(_HIT.format(t) for t, w in WEIGHTS.items() if w >= LIMIT)
_SOFT = " + ".join(_HIT.format(t) for t, w in WEIGHTS.items() if w < LIMIT)

ORACLES: dict[str, str] = {
    "op9_url_filters": f"""
with parts as (
  select page_id, lower(coalesce(url, '')) as u,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') as raw_host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
hosts as (
  select page_id, u, path,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from parts),
hits as (
  select page_id, host, path, ({_STRICT})::int as strict_hits, ({_SOFT})::int as soft_hits,
    case
      when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
      when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
      when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
      when ('.' || host) like '%.net' and path like '/%' then 'net/'
    end as rule
  from hosts)
select page_id, host, path, rule, strict_hits, soft_hits,
  case when rule in ('net/', 'example.com/de/') then 'block'
       when rule is not null then 'allow'
       when strict_hits > 0 or soft_hits >= {LIMIT} then 'block'
       else 'allow' end as verdict
from hits
""",
    "op8_warc": """
with facts as (
  select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages),
targets as (
  select body, max(page_id) as target from facts where n >= 1000 group by body having count(*) > 1)
select f.page_id, f.n::bigint as payload_bytes, sha1(f.body) as payload_digest,
  case when t.target is null or t.target = f.page_id then 'response' else 'revisit' end as record_type,
  case when t.target <> f.page_id then t.target end as refers_to
from facts f left join targets t on f.body = t.body
""",
    "op6_embedding_near_dedup": """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
smallest as (select a, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, s.component_id,
  e.vec_id = s.component_id as kept
from embeddings e join smallest s on s.a = e.vec_id
""",
}
