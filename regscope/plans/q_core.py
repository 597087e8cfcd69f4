"""Step 1–2 queries: gates, URL features, author context, links, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import image_code_features, npm_code_feature, popularity
from ..operators import links as L
from ..operators.gates import SCORE, gate_funnel, gate_npm, gate_nuget, image_text, npm_text, nuget_text
from ..operators.url_features import URL_FEATURES, url_features, url_rows
from ..profiles import IMAGE, NPM
from ..sources import fixtures as FX
from . import image as IMG
from . import twins as TW
from .catalog import r6, register

# --- step 1: gate, URL features, author context -----------------------------
@register("gate_image", TW.with_ctes(TW.PACKAGES, TW.GATED, body="select package_id, gate from gated"))
def q_gate_image(spark, sf):
    return IMG.gated_packages(spark, sf).select("package_id", "gate")


@register("url_features", TW.with_ctes(TW.PACKAGES, TW.GATED, TW.URL_FEATS, body=
          "select package_id, " + ", ".join(TW.r6(c, c) for c in URL_FEATURES) + " from urlf"))
def q_url_features(spark, sf):
    cand = IMG.candidates(spark, sf)
    f = url_features(cand, FX.rank_domain(spark), profile=IMAGE)
    return f.select("package_id", *[r6(c) for c in URL_FEATURES])


_CTX_TWIN = TW.with_ctes(TW.PACKAGES, TW.GATED, TW.URL_FEATS, r"""
o as (select c.package_id, c.namespace, c.release_ts, f.* exclude (package_id)
  from cand c join urlf f on f.package_id = c.package_id),
w as (select package_id, namespace,
  {lags} from o
  window win as (partition by namespace order by release_ts, package_id))
""".replace("{lags}", ",\n  ".join(
    f"{c}, lag({c}, 1) over win as p1_{c}, lag({c}, 2) over win as p2_{c}" for c in URL_FEATURES)),
    body="select package_id, namespace, " + ", ".join(
        f"round(case when p1_{c} is null then {c} when p2_{c} is null then p1_{c} "
        f"else 0.6 * p1_{c} + 0.4 * p2_{c} end, 6) as ctx_{c}" for c in URL_FEATURES) + " from w")


@register("author_context", _CTX_TWIN)
def q_author_context(spark, sf):
    cand = IMG.candidates(spark, sf)
    f = url_features(cand, FX.rank_domain(spark), profile=IMAGE)
    feats = cand.select("package_id", "namespace", "release_ts").join(f.select("package_id", *URL_FEATURES), "package_id")
    ctx = IMG.with_context(feats, list(URL_FEATURES))
    return ctx.select("package_id", "namespace",
                      *[F.round(F.col("ctx")[i], 6).alias(f"ctx_{c}") for i, c in enumerate(URL_FEATURES)])


@register("author_context_hot", """
with e as (select event_id, case when event_id % 7 = 0 then null else ts end as ts, event_id * 0.5 as f from events),
w as (select event_id, f, lag(f, 1) over win as p1, lag(f, 2) over win as p2 from e
  window win as (order by ts nulls first, event_id))
select event_id, round(case when p1 is null then f when p2 is null then p1 else 0.6 * p1 + 0.4 * p2 end, 6) as ctx from w""")
def q_author_context_hot(spark, sf):
    """W1 for one author who owns every event, some without a time, in many chunks."""
    from ..operators.context import author_context
    from ..sources.tables import table
    e = table(spark, sf, "events").select(
        "event_id", F.lit("all").alias("author"), F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("ts")).alias("ts"),
        F.array((F.col("event_id") * 0.5).cast("double")).alias("f"))
    out = author_context(e, "author", ["ts", "event_id"], "f", id_col="event_id", chunks=200)
    return out.select("event_id", F.round(F.col("ctx")[0], 6).alias("ctx"))


# --- step 2: texts, other gates, links, sinks, row-local features -----------
@register("package_text", TW.with_ctes(TW.PACKAGES, TW.NPMV, body="""
select package_id, concat_ws(' ', name, description, full_description) as image_text,
  concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(full_description, '')) as npm_text,
  concat(coalesce(name, ''), coalesce(full_description, '')) as nuget_text from packages"""))
def q_package_text(spark, sf):
    p = FX.packages(spark, sf)
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return p.select("package_id",
                    image_text(F.col("name"), F.col("description"), F.col("full_description")).alias("image_text"),
                    npm_text(c("name"), c("description"), c("full_description")).alias("npm_text"),
                    nuget_text(F.col("name"), F.col("full_description")).alias("nuget_text"))


@register("gate_npm", TW.with_ctes(TW.PACKAGES, TW.NPMV, body="select package_id, gate from npmg"))
def q_gate_npm(spark, sf):
    return gate_npm(FX.npm_view(spark, sf)).select("package_id", "gate")


@register("gate_nuget", TW.with_ctes(TW.PACKAGES, TW.NUGETV, body="select package_id, gate from nugg"))
def q_gate_nuget(spark, sf):
    return gate_nuget(FX.nuget_view(spark, sf), F.col("description")).select("package_id", "gate")


@register("gate_funnel", TW.with_ctes(TW.PACKAGES, TW.GATED, body="select gate, count(*) as n from gated group by gate"))
def q_gate_funnel(spark, sf):
    return gate_funnel(IMG.gated_packages(spark, sf))


@register("official_lookup", TW.with_ctes(TW.PACKAGES, body="""
select p.package_id, t.filter_type from packages p left join types t on t.slug = concat_ws('/', p.namespace, p.name)"""))
def q_official_lookup(spark, sf):
    p = FX.packages(spark, sf).select("package_id", "namespace", "name")
    t = FX.image_types(spark, sf)
    return (p.join(t, F.concat_ws("/", p["namespace"], p["name"]) == t["slug"], "left")
            .select("package_id", "filter_type"))


@register("missing_overview", TW.with_ctes(TW.PACKAGES, body="""
select package_id, name from packages where full_description is null"""))
def q_missing_overview(spark, sf):
    """P10: packages that lack an overview (the backfill work list)."""
    return FX.packages(spark, sf).where(F.col("full_description").isNull()).select("package_id", "name")


@register("package_links", TW.with_ctes(TW.PACKAGES, TW.GATED, """
h as (select package_id, unnest(list_distinct(regexp_extract_all(full_description, '{href}', 1))) as url from cand)
""".replace("{href}", TW.HREF_RE), body="select package_id, substring(url, 1, 255) as url from h where starts_with(url, 'http')"))
def q_package_links(spark, sf):
    """F2/U3/S11 (image form): distinct href targets of scored packages, cut to 255."""
    cand = IMG.candidates(spark, sf)
    return L.link_rows(cand, "package_id", L.image_links(F.col("full_description")), C.URL_WIDTH["image"])


_NPM_SCORED = """
ns as (select g.*, case when g.gate = 'score' then p.pred else g.gate end as result
  from npmg g join pred p on p.package_id = g.package_id)
"""


def _npm_scored(spark, sf):
    g = gate_npm(FX.npm_view(spark, sf))
    pred = FX.predictions(spark, sf).select("package_id", "pred")
    return (g.join(pred, "package_id")
            .withColumn("result", F.when(F.col("gate") == SCORE, F.col("pred")).otherwise(F.col("gate"))))


@register("result_rows", TW.with_ctes(TW.PACKAGES, TW.NPMV, TW.PRED, _NPM_SCORED, body="""
select package_id,
  case when result = 'name_n' then 'name_null' else substring(name, 1, 95) end as name, result,
  substring(tar_name, 1, 95) as tar_name,
  case when result in ('name_n', 'rdm_n') then null when coalesce(user_name, '') = '' then 'NULL'
       else substring(user_name, 1, 95) end as user_name,
  case when result in ('name_n', 'rdm_n') then null when coalesce(user_email, '') = '' then 'NULL'
       else substring(user_email, 1, 95) end as user_email
from ns"""))
def q_result_rows(spark, sf):
    """S10 (npm form) with the fixed stand-in predictions for scored rows."""
    return L.npm_result_rows(_npm_scored(spark, sf))


@register("image_result_rows", TW.with_ctes(TW.PACKAGES, TW.GATED, TW.PRED, body="""
select g.package_id,
  case when g.name is null or g.name = '' then 'null' else g.name end as name,
  case when g.gate = 'score' then p.pred else g.gate end as result,
  case when g.name is null or g.name = '' or g.namespace is null or g.namespace = '' then 'null'
       else g.namespace end as author
from gated g join pred p on p.package_id = g.package_id"""))
def q_image_result_rows(spark, sf):
    """S10 (image form)."""
    g = IMG.gated_packages(spark, sf)
    pred = FX.predictions(spark, sf).select("package_id", "pred")
    scored = g.join(pred, "package_id").withColumn(
        "result", F.when(F.col("gate") == SCORE, F.col("pred")).otherwise(F.col("gate")))
    return L.image_result_rows(scored)


@register("promoted_urls", TW.with_ctes(TW.PACKAGES, TW.NPMV, TW.PRED, _NPM_SCORED, """
m as (select package_id, unnest(list_distinct(regexp_extract_all(readme, '{md}', 1))) as url
  from ns where result = 'abuse')
""".replace("{md}", TW.MD_RE), body="select package_id, substring(url, 1, 254) as url from m where starts_with(url, 'http')"))
def q_promoted_urls(spark, sf):
    """S11 (npm form): markdown link targets of packages scored 'abuse', cut to 254."""
    ab = _npm_scored(spark, sf).where(F.col("result") == "abuse")
    return L.link_rows(ab, "package_id", L.npm_links(F.col("readme")), C.URL_WIDTH["npm"])


@register("nuget_urls", TW.with_ctes(TW.PACKAGES, TW.NUGETV, """
k as (select package_id, unnest(list_distinct(regexp_extract_all(description, '{md}', 1))) as url from nugg where gate = 'score'
      union all
      select package_id, unnest(list_distinct(regexp_extract_all(description, '{href}', 1))) as url from nugg where gate = 'score'),
j as (select package_id, string_agg(url, chr(10) order by url) as urls from k where starts_with(url, 'http') group by 1)
""".replace("{md}", TW.MD_RE).replace("{href}", TW.HREF_RE), body="""
select g.package_id, coalesce(j.urls, 'no_url') as urls from nugg g left join j on j.package_id = g.package_id
where g.gate = 'score'"""))
def q_nuget_urls(spark, sf):
    """S11 (NuGet form): markdown then href links, newline-joined, 'no_url' if none."""
    g = gate_nuget(FX.nuget_view(spark, sf), F.col("description")).where(F.col("gate") == SCORE)
    return g.select("package_id", L.nuget_url_string(L.nuget_links(F.col("description"))).alias("urls"))


_MD_LINE = ("list_bool_or(list_transform(string_split(coalesce(full_description, ''), chr(10)), lambda l: "
            "starts_with(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '#') or "
            "starts_with(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '* ') or "
            "starts_with(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '>') or "
            "(contains(l, '[') and contains(l, ']') and contains(l, '(') and contains(l, ')'))))")
_HTML = " or ".join(f"contains(coalesce(full_description, ''), '{t}')" for t in C.HTML_TAGS)
_BLOCKS = "len(regexp_extract_all(coalesce(full_description, ''), '(?s)```.*?```|~~~.*?~~~'))"


@register("code_features", TW.with_ctes(TW.PACKAGES, TW.GATED, f"""
cf as (select package_id, coalesce(full_description, '') = '' as empty, ({_MD_LINE}) and not ({_HTML}) as md,
  {_BLOCKS} as blocks from cand)
""", body="""select package_id,
  case when empty then 1.0 when md then 1.0 else 0.0 end::double as code_md,
  round(case when empty then 0.0 when md then (case when blocks = 0 then 1.0 else 1.0 / blocks end) else 1.0 end, 6) as code_blocks
from cf"""))
def q_code_features(spark, sf):
    """Markdown flag and inverse code-block count of scored image packages."""
    cand = IMG.candidates(spark, sf)
    return cand.select("package_id", *image_code_features(F.col("full_description"))).select(
        "package_id", "code_md", r6("code_blocks"))


@register("code_features_npm", TW.with_ctes(TW.PACKAGES, TW.NPMV, body="""
select package_id, round(case when n = 0 then 1.0 else 1.0 / n end, 6) as code_blocks, readme_flag from (
  select package_id, len(regexp_extract_all(concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(readme, '')),
    '(?s)```.*?```|~~~.*?~~~')) as n, case when coalesce(readme, '') = '' then 0 else 1 end as readme_flag
  from npmg where gate = 'score')"""))
def q_code_features_npm(spark, sf):
    """Npm inverse block count over the package text, and the README flag."""
    g = gate_npm(FX.npm_view(spark, sf)).where(F.col("gate") == SCORE)
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    text = npm_text(c("name"), c("description"), c("readme"))
    return g.select("package_id", r6(npm_code_feature(text), "code_blocks"),
                    F.when(c("readme") == "", F.lit(0)).otherwise(F.lit(1)).alias("readme_flag"))


@register("popularity", TW.with_ctes(TW.PACKAGES, body="""
select package_id, round(1.0 / (coalesce(pull_count, 0) + 1), 6) as popularity from packages"""))
def q_popularity(spark, sf):
    """A9."""
    return FX.packages(spark, sf).select("package_id", r6(popularity(F.col("pull_count")), "popularity"))


@register("extract_urls", TW.with_ctes(TW.PACKAGES, TW.GATED, body=f"""
select package_id, cast(pos - 1 as bigint) as pos, url from (
  select package_id, unnest(regexp_extract_all(text, '{TW.URL_RE}')) as url,
         unnest(generate_series(1, len(regexp_extract_all(text, '{TW.URL_RE}')))) as pos from cand)"""))
def q_extract_urls(spark, sf):
    """F1: every URL occurrence of every scored package, with its position."""
    return url_rows(IMG.candidates(spark, sf)).select("package_id", "pos", "url")


_URL_ROWS = f"""
ur as (select package_id, cast(pos - 1 as bigint) as pos, url,
  regexp_extract(url, '{TW.NETLOC_RE}', 1) as netloc,
  regexp_extract(regexp_extract(url, '{TW.NETLOC_RE}', 1), '{TW.DOMAIN_RE}', 0) as domain from (
  select package_id, unnest(regexp_extract_all(text, '{TW.URL_RE}')) as url,
         unnest(generate_series(1, len(regexp_extract_all(text, '{TW.URL_RE}')))) as pos from cand))
"""


@register("url_domains", TW.with_ctes(TW.PACKAGES, TW.GATED, _URL_ROWS, body="""
select package_id, pos, netloc, domain, not regexp_matches(netloc, '[\\[\\]]') as parseable from ur"""))
def q_url_domains(spark, sf):
    """network location, registered domain and parseability per URL."""
    return url_rows(IMG.candidates(spark, sf)).select("package_id", "pos", "netloc", "domain", "parseable")


@register("domain_rank_score", TW.with_ctes(TW.PACKAGES, TW.GATED, _URL_ROWS, body="""
select u.package_id, u.pos, u.domain, round(coalesce(1 - r.rank / 1000000.0, 0), 6) as score
from ur u left join rank_domain r on r.domain = u.domain"""))
def q_domain_rank_score(spark, sf):
    """Rank score of each URL's registered domain (0 if unranked)."""
    from ..sources.tables import rank_score
    rows = url_rows(IMG.candidates(spark, sf)).select("package_id", "pos", "domain")
    ranks = FX.rank_domain(spark)
    return rows.join(ranks, "domain", "left").select("package_id", "pos", "domain",
                                                     r6(rank_score(F.col("rank")), "score"))


@register("url_class", TW.with_ctes(TW.PACKAGES, TW.NPMV, f"""
nu as (select package_id, regexp_extract(regexp_extract(homepage, '{TW.NETLOC_RE}', 1), '{TW.DOMAIN_RE}', 0) as hp,
  unnest(regexp_extract_all(concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(readme, '')), '{TW.URL_RE}')) as url,
  unnest(generate_series(1, len(regexp_extract_all(concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(readme, '')), '{TW.URL_RE}')))) as pos
  from npmg where gate = 'score'),
nd as (select package_id, cast(pos - 1 as bigint) as pos, hp,
  regexp_extract(url, '{TW.NETLOC_RE}', 1) as netloc,
  regexp_extract(regexp_extract(url, '{TW.NETLOC_RE}', 1), '{TW.DOMAIN_RE}', 0) as domain from nu)
""", body="""
select package_id, pos, domain,
  not regexp_matches(netloc, '[\\[\\]]') and not (domain in ('npmjs.com', 'npmjs.org') or (coalesce(hp, '') <> '' and domain = hp)) as external,
  not regexp_matches(netloc, '[\\[\\]]') and domain in ('bit.ly','tinyurl.com','goo.gl','t.co','t.me','t.ly','ow.ly','tiny.cc','tinybit.cc','is.gd','page.link') as short
from nd"""))
def q_url_class(spark, sf):
    """J4 (npm form): external / short per URL; the package's own homepage
    domain counts as internal."""
    from ..functions import urls as U
    from ..operators.url_features import links
    g = gate_npm(FX.npm_view(spark, sf)).where(F.col("gate") == SCORE)
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    found = g.select("package_id", F.coalesce(U.url_domain(F.col("homepage")), F.lit("")).alias("hp"),
                     U.extract_urls(npm_text(c("name"), c("description"), c("readme"))).alias("urls"))
    rows = found.select("package_id", F.posexplode(links(F.col("urls"), NPM, F.col("hp"))).alias("pos", "x"))
    return rows.select("package_id", F.col("pos").cast("long").alias("pos"), F.col("x.dom").alias("domain"),
                       F.col("x.ext").alias("external"), F.col("x.short").alias("short"))


@register("media_urls", TW.with_ctes(TW.PACKAGES, TW.GATED, _URL_ROWS, body="""
select c.package_id,
  count(case when not regexp_matches(u.netloc, '[\\[\\]]') and u.domain not in ('docker.com')
             and regexp_matches(u.url, '{media}') then 1 end) as n_media,
  count(distinct case when not regexp_matches(u.netloc, '[\\[\\]]') and u.domain not in ('docker.com') then u.domain end) as n_external_domains
from cand c left join ur u on u.package_id = c.package_id group by c.package_id""".replace(
    "{media}", "(" + "|".join(s.replace(".", "\\.") for s in C.IMAGE_SUFFIXES) + ")$")))
def q_media_urls(spark, sf):
    """External URLs ending in an image suffix; distinct external domains."""
    f = url_features(IMG.candidates(spark, sf), FX.rank_domain(spark), profile=IMAGE)
    return f.select("package_id", F.col("n_media").cast("long").alias("n_media"),
                    F.col("n_external_domains").cast("long").alias("n_external_domains"))
