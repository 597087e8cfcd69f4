"""npm and NuGet feature matrices (M1 for the other two registries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..profiles import NPM, NUGET
from . import registries as R
from . import twins as TW
from .catalog import register
from .q_maint import _hp
from .q_semantic import kw_sql


def _sem_sql(p: str, src: str, k: int) -> str:
    return f"""
{p}_top as (select package_id, pos, distance, row_number() over (partition by package_id order by pos) as r
  from pd where pos < {k} and package_id in (select package_id from {src})),
{p}_lst as (select package_id, list(distance order by pos) as d from {p}_top where r <= 10 group by 1),
{p}_sem as (select s.package_id, case when l.d is null then list_transform(range(0, 10), lambda i: 1.0::double)
  else list_transform(range(0, 10), lambda i: l.d[(i % len(l.d)) + 1]) end as s
  from {src} s left join {p}_lst l on l.package_id = s.package_id)
"""


def _ctx_sql(src: str, author: str) -> str:
    return f"""
fw as (select *, lag(cb, 1) over win as p1, lag(cb, 2) over win as p2 from {src}
  window win as (partition by {author} order by release_ts, package_id)),
fm as (select package_id, list_concat(own, case when coalesce({author}, '') = '' then cb when p1 is null then cb
  when p2 is null then p1 else list_transform(range(1, len(cb) + 1), lambda i: 0.6 * p1[i] + 0.4 * p2[i]) end) as f from fw)
"""


_ROWS = """select package_id, cast(i - 1 as bigint) as i, round(f[i], 6) as value from (
  select package_id, f, unnest(generate_series(1, len(f))) as i from fm)"""

_NPM_TWIN = TW.with_ctes(TW.PACKAGES, TW.NPMV, f"""
ns as (select package_id, user_name, user_email, release_ts, coalesce(repo_url, '') as repo,
  concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(readme, '')) as text,
  {_hp('homepage')} as hp0, case when coalesce(readme, '') = '' then 0.0 else 1.0 end::double as readme_flag
  from npmg where gate = 'score'),
{TW.url_feats_sql('ns', 'text', C.INTERNAL_HOSTS['npm'], C.SHORT_HOSTS['npm'], 'nu', homepage='hp0')},
{kw_sql('ns', 'text', NPM).strip()},
{_sem_sql('np', 'ns', 20)},
nf as (select s.package_id, s.user_name, s.release_ts,
  case when len(regexp_extract_all(s.text, '(?s)```.*?```|~~~.*?~~~')) = 0 then 1.0
       else 1.0 / len(regexp_extract_all(s.text, '(?s)```.*?```|~~~.*?~~~')) end::double as code_blocks,
  case when s.hp0 = '' and s.repo = '' then 0 when s.hp0 <> '' then (case when s.repo = '' then 0 else 1 end) else 1 end::double as has_repo,
  case when s.hp0 <> '' then coalesce(1 - r1.rank / 1000000.0, 0) else 0 end::double as homepage_rank,
  case when regexp_extract(coalesce(s.user_email, ''), '@(.+)$', 1) = '' then 0
       else coalesce(1 - r2.rank / 1000000.0, 0) end::double as email_rank,
  s.readme_flag
  from ns s left join rank_domain r1 on r1.domain = s.hp0
  left join rank_domain r2 on r2.domain = regexp_extract(coalesce(s.user_email, ''), '@(.+)$', 1)),
fo as (select f.package_id, f.user_name, f.release_ts,
  list_concat([f.code_blocks], m.s, [u.url_external, u.url_short, u.url_domains, u.url_rank, u.url_dups],
              [f.has_repo, f.homepage_rank, f.email_rank, f.readme_flag]) as own
  from nf f join nu u on u.package_id = f.package_id join np_sem m on m.package_id = f.package_id),
fo2 as (select *, own as cb from fo),
{_ctx_sql('fo2', 'user_name')}
""", body=_ROWS)


@register("npm_feature_matrix", _NPM_TWIN)
def q_npm_feature_matrix(spark, sf):
    """M1 (npm): the 40-wide vector of every scored npm package, as rows."""
    ft = R.npm_feature_table(spark, sf)
    return ft.select("package_id", F.posexplode("features").alias("i", "value")).select(
        "package_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


_NUGET_TWIN = TW.with_ctes(TW.PACKAGES, TW.NUGETV, f"""
nb as (select package_id, author, release_ts, license::double as license, readme_tag::double as readme_flag,
  coalesce(project_url, '') as pu, array_to_string(list_transform(repository_urls, lambda u: u || ' '), '') as repo,
  concat(coalesce(file_name, ''), coalesce(description, '')) as text from nugg where gate = 'score'),
{TW.url_feats_sql('nb', 'text', C.INTERNAL_HOSTS['nuget'], C.SHORT_HOSTS['nuget'], 'gu')},
pjs as (select n.package_id, case when n.pu = '' then 0 else coalesce(1 - r.rank / 1000000.0, 0) end as ps
  from nb n left join rank_domain r on r.domain = {_hp('n.pu')}),
ru as (select package_id, unnest(regexp_extract_all(repo, '{TW.URL_RE}')) as u from nb),
rs as (select ru.package_id, avg(coalesce(1 - r.rank / 1000000.0, 0)) as rm from ru
  left join rank_domain r on r.domain = regexp_extract(regexp_extract(ru.u, '{TW.NETLOC_RE}', 1), '{TW.DOMAIN_RE}', 0)
  where not regexp_matches(regexp_extract(ru.u, '{TW.NETLOC_RE}', 1), '[\\[\\]]') group by 1),
rp as (select p.package_id, ((p.ps + coalesce(rs.rm, 0)) / 2)::double as repo_score from pjs p left join rs on rs.package_id = p.package_id),
{kw_sql('nb', 'text', NUGET).strip()},
{_sem_sql('gp', 'nb', 10)},
fo2 as (select b.package_id, b.author, b.release_ts,
  list_concat([b.readme_flag], m.s, [u.url_external, u.url_short, u.url_domains, u.url_rank, u.url_dups],
              [b.license, r.repo_score]) as own,
  list_concat([u.url_external, u.url_short, u.url_domains, u.url_rank, u.url_dups], [r.repo_score, b.readme_flag, b.license], m.s) as cb
  from nb b join gu u on u.package_id = b.package_id join rp r on r.package_id = b.package_id
  join gp_sem m on m.package_id = b.package_id),
{_ctx_sql('fo2', 'author')}
""", body=_ROWS)


@register("nuget_feature_matrix", _NUGET_TWIN)
def q_nuget_feature_matrix(spark, sf):
    """M1 (NuGet): the 36-wide vector of every scored NuGet package, as rows."""
    ft = R.nuget_feature_table(spark, sf)
    return ft.select("package_id", F.posexplode("features").alias("i", "value")).select(
        "package_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))
