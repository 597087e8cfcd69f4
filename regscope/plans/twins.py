"""DuckDB twins of the registered queries (the correctness oracle).

Each twin is plain SQL over the landed tables (pre-registered as views) and
starts from the same derived ``packages`` table. Twins are written for
clarity, not speed: URL features unnest and group, mean distances are brute
force over all keyword x platform pairs, and so on. Floating results are
rounded to 6 places on both sides.
"""

from __future__ import annotations

PACKAGES = r"""
n as (select count(*) as n_pages from pages),
l as (
  select d.doc_id, v.k,
    case when d.doc_id % 7 = 0 then concat('[ref](', p.url, ') ')
         when d.doc_id % 11 = 0 then concat('<a href="', p.url, '">x</a> ')
         else concat(p.url, ' ') end as piece
  from documents d cross join n cross join (values (0), (1), (2), (3)) v(k)
  join pages p on p.page_id = (d.doc_id * (v.k + 1)) % n.n_pages
  where v.k < d.doc_id % 5),
b as (select doc_id, string_agg(piece, '' order by k) as block from l group by doc_id),
packages as (
select d.doc_id as package_id,
  case when d.doc_id % 89 = 0 then null else d.source end as namespace,
  case when d.doc_id % 97 = 0 then null else concat('pkg-', cast(d.doc_id as varchar)) end as name,
  concat_ws(' ', 'package of', d.source, 'in', d.lang) as description,
  case when d.doc_id % 53 = 0 then null else concat(d.text, chr(10), coalesce(b.block, ''),
    case when d.doc_id % 3 = 0 and d.doc_id % 5 > 0 then concat('https://bit.ly/', cast(d.doc_id as varchar), ' ') else '' end,
    case when d.doc_id % 4 = 0 and d.doc_id % 5 > 0 then 'https://hub.docker.com/r/x ' else '' end,
    case when d.doc_id % 9 = 1 then 'https://cdn.example.org/a.png https://cdn.example.org/a.png ' else '' end,
    case when d.doc_id % 6 = 0 then concat(chr(10), '```', chr(10), 'run', chr(10), '```') else '' end) end as full_description,
  (d.doc_id * 7919) % 100003 as pull_count,
  case when d.doc_id % 13 = 0 then 'official' else 'community' end as filter_type,
  case d.doc_id % 4 when 0 then '' when 1 then 'https://www.example.net/x' when 2 then 'https://docs.example.org' end as homepage,
  case when d.doc_id % 5 < 2 then 'git+https://github.com/u/p.git' else '' end as repo_url,
  case d.doc_id % 3 when 0 then concat(d.source, '@example.com') when 1 then concat(d.source, '@mail.example.com') else '' end as user_email,
  e.ts as release_ts, d.lang,
  case when lb.quality = 0 then 'abuse' when lb.quality = 1 then 'non-abuse' end as label
from documents d
left join b on b.doc_id = d.doc_id
left join labels lb on lb.doc_id = d.doc_id
left join events e on e.event_id = d.doc_id),
rank_domain as (select * from (values ('example.com', 120), ('example.net', 45000), ('docker.com', 350),
  ('github.com', 60), ('bit.ly', 900)) t(domain, rank)),
types as (select concat_ws('/', namespace, name) as slug, filter_type from packages
  where namespace is not null and name is not null)
"""

NPMV = r"""
npmv as (select package_id, name, description, full_description as readme, homepage, repo_url,
  namespace as user_name, user_email, release_ts, pull_count, label,
  concat('p', cast(package_id as varchar), '.tgz') as tar_name from packages),
npmg as (select *, case when name is null or name = '' then 'name_n'
  when regexp_matches(coalesce(readme, ''), '^\s*$') then 'rdm_n' else 'score' end as gate from npmv)
"""
NUGETV = r"""
nugv as (select package_id, name as file_name, full_description as description, namespace as author,
  homepage as project_url, case when repo_url = '' then []::varchar[] else [repo_url] end as repository_urls,
  case when package_id % 2 = 0 then 1 else 0 end as license,
  case when full_description is null then 0 else 1 end as readme_tag, release_ts, pull_count, label from packages),
nugg as (select *, case when regexp_matches(coalesce(description, ''), 'https?://[^\s;()"]+') then 'score'
  else 'non-abuse' end as gate from nugv
  where length(regexp_replace(coalesce(description, ''), '^\s+|\s+$', '', 'g')) >= 20)
"""
PRED = r"""
pred as (select package_id, label, case when pull_count % 4 = 0 then 'abuse' else 'non-abuse' end as pred from packages)
"""
MD_RE = r"\[[^\]]+\]\(([^)]+)\)"
HREF_RE = "href=[''\"]?([^''\" >]+)"
URL_RE = "https?://[!$-_a-z]+"
NETLOC_RE = "^https?://([^/?#]*)"
DOMAIN_RE = r"([^.]*\.)?[^.]*$"
IMAGE_SHORT = ("'bit.ly','tinyurl.com','goo.gl','t.co','t.me','t.ly','ow.ly','tiny.cc','tinybit.cc',"
               "'is.gd','page.link','blltly.com','tinurli','shurll'")
IMAGE_INTERNAL = "'docker.com'"

GATED = r"""
gated as (
  select p.*, case
    when p.name is null or p.name = '' then 'null'
    when p.namespace is null or p.namespace = '' then 'null'
    when p.full_description is null or p.full_description = '' then 'no_overview'
    when not regexp_matches(p.full_description, '{url}') then 'overview_no_link'
    when t.filter_type is not null and t.filter_type <> 'community' then 'non-abuse'
    else 'score' end as gate
  from packages p left join types t on t.slug = concat_ws('/', p.namespace, p.name)),
cand as (select package_id, namespace, release_ts, pull_count, full_description,
  concat_ws(' ', name, description, full_description) as text from gated where gate = 'score')
""".replace("{url}", URL_RE)

# URL features at package grain: unnest, classify each occurrence, aggregate.
URL_FEATS = r"""
u as (select package_id, unnest(regexp_extract_all(text, '{url}')) as url from cand),
uc as (select package_id, url, count(*) as n from u group by 1, 2),
uf as (select package_id, url, n,
  regexp_extract(url, '{netloc}', 1) as host,
  regexp_extract(regexp_extract(url, '{netloc}', 1), '{dom}', 0) as dom,
  not regexp_matches(regexp_extract(url, '{netloc}', 1), '[\[\]]') as ok from uc),
ug as (select f.package_id,
  sum(n) as n_urls,
  sum(case when ok and dom not in ({internal}) then n else 0 end) as n_external,
  sum(case when ok and dom in ({short}) then n else 0 end) as n_short,
  count(distinct case when ok then host end) as n_hosts,
  count(case when n > 1 then 1 end) as n_dup_urls,
  sum(case when ok and dom not in ({internal}) then n * (1 - coalesce(r.rank, 1000000) / 1000000.0) else 0 end) as external_score
  from uf f left join rank_domain r on r.domain = f.dom group by f.package_id),
urlf as (select c.package_id,
  coalesce(n_external, 0) / (coalesce(n_urls, 0) + 1) as url_external,
  coalesce(n_short, 0) / (coalesce(n_urls, 0) + 1) as url_short,
  1.0 / (coalesce(n_hosts, 0) + 1) as url_domains,
  coalesce(external_score, 0) / (coalesce(n_external, 0) + 1) as url_rank,
  1.0 / (coalesce(n_dup_urls, 0) + 1) as url_dups
  from cand c left join ug on ug.package_id = c.package_id)
""".replace("{url}", URL_RE).replace("{netloc}", NETLOC_RE).replace("{dom}", DOMAIN_RE) \
   .replace("{internal}", IMAGE_INTERNAL).replace("{short}", IMAGE_SHORT)


def with_ctes(*parts: str, body: str) -> str:
    return "with " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + body


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) as {alias}"


def url_feats_sql(src: str, text: str, internal: list[str], short: list[str], out: str,
                  homepage: str | None = None) -> str:
    """URL-feature CTEs over ``src`` (needs package_id and the text expression).
    ``homepage``: an expression over ``src`` giving the package's own domain,
    counted as internal when not empty."""
    q = lambda xs: ", ".join(f"'{x}'" for x in xs)
    hp = homepage or "''"
    internal_test = f"(dom in ({q(internal)}) or (hp <> '' and dom = hp))"
    return f"""
{out}_u as (select package_id, {hp} as hp, unnest(regexp_extract_all({text}, '{URL_RE}')) as url from {src}),
{out}_c as (select package_id, hp, url, count(*) as n from {out}_u group by 1, 2, 3),
{out}_f as (select package_id, hp, url, n, regexp_extract(url, '{NETLOC_RE}', 1) as host,
  regexp_extract(regexp_extract(url, '{NETLOC_RE}', 1), '{DOMAIN_RE}', 0) as dom,
  not regexp_matches(regexp_extract(url, '{NETLOC_RE}', 1), '[\\[\\]]') as ok from {out}_c),
{out}_g as (select f.package_id, sum(n) as n_urls,
  sum(case when ok and not {internal_test} then n else 0 end) as n_external,
  sum(case when ok and dom in ({q(short)}) then n else 0 end) as n_short,
  count(distinct case when ok then host end) as n_hosts,
  count(case when n > 1 then 1 end) as n_dup_urls,
  sum(case when ok and not {internal_test} then n * (1 - coalesce(r.rank, 1000000) / 1000000.0) else 0 end) as external_score
  from {out}_f f left join rank_domain r on r.domain = f.dom group by f.package_id),
{out} as (select s.package_id,
  coalesce(n_external, 0) / (coalesce(n_urls, 0) + 1) as url_external,
  coalesce(n_short, 0) / (coalesce(n_urls, 0) + 1) as url_short,
  1.0 / (coalesce(n_hosts, 0) + 1) as url_domains,
  coalesce(external_score, 0) / (coalesce(n_external, 0) + 1) as url_rank,
  1.0 / (coalesce(n_dup_urls, 0) + 1) as url_dups
  from {src} s left join {out}_g g on g.package_id = s.package_id)
"""
