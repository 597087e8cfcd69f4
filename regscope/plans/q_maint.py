"""Step 6 queries: normalisers, rank features, maintenance joins, sources/sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import urls as U
from ..operators import model as M
from ..operators import normalise as N
from ..operators.gates import SCORE, corpus_audit, gate_npm, gate_nuget, nuget_text
from ..operators.url_features import media_count
from ..profiles import NUGET
from ..sources import days as D
from ..sources import fixtures as FX
from ..sources.tables import table
from . import twins as TW
from .catalog import r6, register

DOM = TW.DOMAIN_RE
ANY = C.NETLOC_ANY


def _hp(col: str) -> str:
    return (f"case when coalesce({col}, '') = '' then '' else "
            f"regexp_extract(regexp_extract({col}, '{ANY}', 1), '{DOM}', 0) end")


def _dom(col: str) -> str:
    return f"regexp_extract(regexp_extract({col}, '{TW.NETLOC_RE}', 1), '{DOM}', 0)"


# --- P7 / P8 / P9 / P5 ----------------------------------------------------------
@register("npm_manifest", TW.with_ctes(TW.PACKAGES, body=f"""
select package_id, coalesce(name, '') as name, coalesce(description, '') as description,
  coalesce(repo_url, '') as repo_url, {_hp('homepage')} as homepage_domain from packages"""))
def q_npm_manifest(spark, sf):
    """Fields of each package's ``package.json`` text (built from the package row)."""
    p = FX.packages(spark, sf)
    js = F.to_json(F.struct("name", "description", "homepage",
                            F.struct(F.lit("git").alias("type"), F.col("repo_url").alias("url")).alias("repository")))
    return N.npm_manifest(p.select("package_id", js.alias("manifest")), "manifest")


_SIDECAR = ("concat('{''_npmUser'': {''name'': ''', coalesce(namespace, ''), ''', ''email'': ''', "
            "coalesce(user_email, ''), '''}}')")


@register("npm_publisher", TW.with_ctes(TW.PACKAGES, f"""
pp as (select package_id, string_split(regexp_extract({_SIDECAR}, '''_npmUser''.*?\\}}', 0), '''') as parts from packages)
""", body="""
select package_id, case when len(parts) >= 10 then parts[6] else '' end as user_name,
  case when len(parts) >= 10 then parts[10] else '' end as user_email from pp"""))
def q_npm_publisher(spark, sf):
    """Publisher name and e-mail from the sidecar text."""
    p = FX.packages(spark, sf)
    side = F.concat(F.lit("{'_npmUser': {'name': '"), F.coalesce("namespace", F.lit("")), F.lit("', 'email': '"),
                    F.coalesce("user_email", F.lit("")), F.lit("'}}"))
    return p.select("package_id", *N.npm_publisher(side))


def _nuspec_sql():
    return ("case when package_id % 17 = 0 then '<metadata></metadata>' else concat('<metadata><authors>', "
            "coalesce(namespace, ''), '</authors><description>', coalesce(description, ''), "
            "'</description><projectUrl>', coalesce(homepage, ''), '</projectUrl><repository type=\"git\" url=\"', "
            "coalesce(repo_url, ''), '\" />', case when package_id % 2 = 0 then "
            "'<licenseUrl>https://example.org/l</licenseUrl>' else '' end, '</metadata>') end")


def nuspec_text(p):
    d = F.col("package_id")
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    body = F.concat(F.lit("<metadata><authors>"), c("namespace"), F.lit("</authors><description>"), c("description"),
                    F.lit("</description><projectUrl>"), c("homepage"), F.lit('</projectUrl><repository type="git" url="'),
                    c("repo_url"), F.lit('" />'),
                    F.when(d % 2 == 0, F.lit("<licenseUrl>https://example.org/l</licenseUrl>")).otherwise(F.lit("")),
                    F.lit("</metadata>"))
    return F.when(d % 17 == 0, F.lit("<metadata></metadata>")).otherwise(body)


@register("nuspec_fields", TW.with_ctes(TW.PACKAGES, f"""
nx as (select package_id, {_nuspec_sql()} as t from packages),
nr as (select package_id, t, regexp_extract_all(regexp_extract(t, '(?s)<repository(.*?)/>', 1), 'url="(.*?)"', 1) as urls from nx)
""", body="""
select package_id, regexp_extract(t, '(?s)<authors>(.*?)</authors>', 1) as author,
  regexp_extract(t, '(?s)<description>(.*?)</description>', 1) as description,
  regexp_extract(t, '(?s)<projectUrl>(.*?)</projectUrl>', 1) as project_url,
  array_to_string(list_transform(urls, lambda u: u || ' '), '') as repository,
  case when contains(t, '<licenseUrl>') then 1 else 0 end as license from nr"""))
def q_nuspec_fields(spark, sf):
    """Nuspec fields (tags missing on every 17th package)."""
    p = FX.packages(spark, sf)
    return p.select("package_id", *N.nuspec_fields(nuspec_text(p)))


_MEMBERS_SQL = """
mem as (select package_id, 'README.md' as member, concat('README.md:', coalesce(name, '')) as content from packages where package_id % 3 = 0
  union all select package_id, 'readme.md', concat('readme.md:', coalesce(name, '')) from packages where package_id % 4 = 0
  union all select package_id, 'Readme.md', concat('Readme.md:', coalesce(name, '')) from packages where package_id % 5 = 0
  union all select package_id, 'README.MD', concat('README.MD:', coalesce(name, '')) from packages where package_id % 7 = 0),
np as (select package_id, member, content, case member when 'README.md' then 1 when 'readme.md' then 2
  when 'Readme.md' then 3 when 'README.MD' then 4 end as pr from mem),
gp as (select package_id, member, content, case member when 'readme.md' then 1 when 'Readme.md' then 2
  when 'README.md' then 3 end as pr from mem)
"""


def members(p):
    d = F.col("package_id")
    rows = []
    for name, m in (("README.md", 3), ("readme.md", 4), ("Readme.md", 5), ("README.MD", 7)):
        rows.append(F.when(d % m == 0, F.struct(F.lit(name).alias("member"),
                                                 F.concat(F.lit(name + ":"), F.coalesce("name", F.lit(""))).alias("content"))))
    return (p.select("package_id", F.explode(F.array_compact(F.array(*rows))).alias("m"))
            .select("package_id", "m.member", "m.content"))


@register("readme_pick", TW.with_ctes(TW.PACKAGES, _MEMBERS_SQL, body="""
select package_id, 'npm' as registry, arg_min(member, pr) as member, arg_min(content, pr) as content from np where pr is not null group by 1
union all
select package_id, 'nuget', arg_max(member, pr), arg_max(content, pr) from gp where pr is not null group by 1"""))
def q_readme_pick(spark, sf):
    """P5: npm takes the first README spelling present, NuGet the last."""
    mem = members(FX.packages(spark, sf).select("package_id", "name"))
    npm_names = [n.split("/")[-1] for n in C.NPM_README_NAMES]
    a = N.pick_member(mem, "package_id", npm_names).select("package_id", F.lit("npm").alias("registry"), "member", "content")
    b = N.pick_member(mem, "package_id", C.NUGET_README_NAMES, last=True).select(
        "package_id", F.lit("nuget").alias("registry"), "member", "content")
    return a.unionByName(b)


# --- S13 ---------------------------------------------------------------------------
WINDOW = ("2024-01-02 00:00:00", "2024-01-03 23:59:59")


@register("catalog_versions", f"""
select concat('pkg-', cast(user_id as varchar)) as package_name, concat('1.0.', cast(event_id as varchar)) as version,
  case when event_type <> 'error' then 1 else 0 end as status,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as publish_time, cast(1 as bigint) as n_entries
from events where date_trunc('second', ts) between timestamp '{WINDOW[0]}' and timestamp '{WINDOW[1]}'""")
def q_catalog_versions(spark, sf):
    """Catalog leaves (JSON text, one per event) committed in a two-day window."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'Z'")
    leaf = F.to_json(F.struct(
        F.concat(F.lit("pkg-"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("1.0."), F.col("event_id").cast("string")).alias("version"),
        (F.col("event_type") != "error").alias("listed"), iso.alias("created"), iso.alias("commitTimeStamp"),
        F.array(F.struct(F.concat(F.lit("lib/"), F.col("event_type"), F.lit(".dll")).alias("fullName"),
                         F.concat(F.lit("https://example.org/"), F.col("event_id").cast("string")).alias("@id"))).alias("packageEntries")))
    v = N.catalog_versions(ev.select(leaf.alias("leaf")), "leaf", *WINDOW)
    return v.select("package_name", "version", "status", F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss").alias("publish_time"),
                    F.size("download_info").cast("long").alias("n_entries"))


# --- A10 / A11 / A12 ------------------------------------------------------------------
@register("repo_homepage", TW.with_ctes(TW.PACKAGES, TW.NPMV, f"""
x as (select package_id, {_hp('homepage')} as hp, coalesce(repo_url, '') as repo from npmg where gate = 'score')
""", body="""
select x.package_id, case when hp = '' and repo = '' then 0 when hp <> '' then (case when repo = '' then 0 else 1 end) else 1 end as has_repo,
  round(case when hp <> '' then coalesce(1 - r.rank / 1000000.0, 0) else 0 end, 6) as homepage_rank
from x left join rank_domain r on r.domain = x.hp"""))
def q_repo_homepage(spark, sf):
    """A10 (npm): repository flag and homepage rank score."""
    g = gate_npm(FX.npm_view(spark, sf)).where(F.col("gate") == SCORE)
    g = g.select("package_id", N.homepage_domain(F.col("homepage")).alias("homepage_domain"), "repo_url")
    return N.repo_homepage(g, FX.rank_domain(spark)).select("package_id", "has_repo", r6("homepage_rank"))


@register("email_rank", TW.with_ctes(TW.PACKAGES, TW.NPMV, """
x as (select package_id, regexp_extract(coalesce(user_email, ''), '@(.+)$', 1) as d from npmg where gate = 'score')
""", body="""
select x.package_id, round(case when d = '' then 0 else coalesce(1 - r.rank / 1000000.0, 0) end, 6) as email_rank
from x left join rank_domain r on r.domain = x.d"""))
def q_email_rank(spark, sf):
    """A12 (npm): rank score of the publisher e-mail's domain."""
    g = gate_npm(FX.npm_view(spark, sf)).where(F.col("gate") == SCORE).select("package_id", "user_email")
    return N.email_rank(g, "user_email", FX.rank_domain(spark)).select("package_id", r6("email_rank"))


@register("repo_score", TW.with_ctes(TW.PACKAGES, TW.NUGETV, f"""
ns as (select package_id, coalesce(project_url, '') as pu,
  array_to_string(list_transform(repository_urls, lambda u: u || ' '), '') as repo from nugg where gate = 'score'),
pjs as (select n.package_id, case when n.pu = '' then 0 else coalesce(1 - r.rank / 1000000.0, 0) end as ps
  from ns n left join rank_domain r on r.domain = {_hp('n.pu')}),
ru as (select package_id, unnest(regexp_extract_all(repo, '{TW.URL_RE}')) as u from ns),
rs as (select ru.package_id, avg(coalesce(1 - r.rank / 1000000.0, 0)) as rm from ru
  left join rank_domain r on r.domain = {_dom('ru.u')}
  where not regexp_matches(regexp_extract(ru.u, '{TW.NETLOC_RE}', 1), '[\\[\\]]') group by 1)
""", body="""
select p.package_id, round((p.ps + coalesce(rs.rm, 0)) / 2, 6) as repo_score
from pjs p left join rs on rs.package_id = p.package_id"""))
def q_repo_score(spark, sf):
    """A11 (NuGet): mean of project-URL score and mean repository-URL score."""
    g = gate_nuget(FX.nuget_view(spark, sf), F.col("description")).where(F.col("gate") == SCORE)
    g = g.select("package_id", F.coalesce("project_url", F.lit("")).alias("project_url"),
                 F.array_join(F.transform("repository_urls", lambda u: F.concat(u, F.lit(" "))), "").alias("repository"))
    return N.repo_score(g, "package_id", "project_url", "repository", FX.rank_domain(spark)).select(
        "package_id", r6("repo_score"))


# --- maintenance joins -------------------------------------------------------------------
@register("pending", TW.with_ctes(TW.PACKAGES, body="""
select package_id from packages where package_id not in (select doc_id from labels)"""))
def q_pending(spark, sf):
    """Packages not yet recorded (anti-join with the done table)."""
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("package_id"))
    return FX.packages(spark, sf).select("package_id").join(done, "package_id", "left_anti")


@register("backfill_overview", TW.with_ctes(TW.PACKAGES, """
det as (select source as namespace, concat('pkg-', cast(doc_id as varchar)) as name, text as details from documents)
""", body="""
select p.package_id, coalesce(p.full_description, d.details) as overview from packages p
left join det d on d.namespace = p.namespace and d.name = p.name where p.full_description is null"""))
def q_backfill_overview(spark, sf):
    """Packages lacking an overview take it from fetched details (matched on
    namespace and name)."""
    p = FX.packages(spark, sf).where(F.col("full_description").isNull()).select(
        "package_id", "namespace", "name", "full_description")
    det = table(spark, sf, "documents").select(
        F.col("source").alias("namespace"), F.concat(F.lit("pkg-"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("details"))
    return (p.join(det, ["namespace", "name"], "left")
            .select("package_id", F.coalesce("full_description", "details").alias("overview")))


@register("delete_by_ids", TW.with_ctes(TW.PACKAGES, body="""
select package_id, name from packages where package_id not in (select doc_id from labels where toxic = 1)"""))
def q_delete_by_ids(spark, sf):
    """The table without the rows of a delete list."""
    ids = table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("package_id"))
    return FX.packages(spark, sf).select("package_id", "name").join(ids, "package_id", "left_anti")


@register("uploader_reconcile", TW.with_ctes(TW.PACKAGES, """
cnt as (select namespace, count(*) as n from packages where namespace is not null group by 1),
lst as (select source as namespace, count(*) as expected from documents where source is not null group by 1)
""", body="""
select l.namespace, coalesce(c.n, 0) as n, l.expected, case when l.expected = c.n then 1 else 0 end as same
from lst l left join cnt c on l.namespace = c.namespace"""))
def q_uploader_reconcile(spark, sf):
    """Packages counted under each uploader against the uploader's listing. The listing counts
    the raw documents; packages that lost their uploader on the way are missed under it."""
    counted = FX.packages(spark, sf).where(F.col("namespace").isNotNull()).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    listed = (table(spark, sf, "documents").where(F.col("source").isNotNull())
              .groupBy(F.col("source").alias("namespace")).agg(F.count(F.lit(1)).alias("expected")))
    return N.reconcile(counted, listed, "namespace")


@register("month_partitions", TW.with_ctes(TW.PACKAGES, """
ms as (select distinct date_trunc('month', release_ts)::date as m from packages where release_ts is not null),
days as (select unnest(generate_series(m, last_day(m), interval 1 day))::date as day from ms),
cnt as (select release_ts::date as day, count(*) as n from packages group by 1)
""", body="""
select strftime(d.day, '%Y-%m-%d') as day, coalesce(c.n, 0) as n from days d left join cnt c on c.day = d.day"""))
def q_month_partitions(spark, sf):
    """Every calendar day of each month that has releases, with the number of
    packages in that day's folder (real calendar, leap years included)."""
    days = _by_day(spark, sf)
    return D.calendar(D.listed_days(days)).select(F.date_format(D.DAY, "yyyy-MM-dd").alias("day"), "n")


def _by_day(spark, sf):
    import uuid
    from ..session import shared_path
    path = shared_path(spark, "days", uuid.uuid4().hex)
    D.write_days(FX.packages(spark, sf).select("package_id", "name", "namespace", "release_ts"), "release_ts", path)
    return D.read_days(spark, path)


@register("scan_day", TW.with_ctes(TW.PACKAGES, """
ds as (select min(release_ts::date) as d from packages)
""", body="""
select package_id, name, strftime(release_ts::date, '%Y-%m-%d') as day from packages
where release_ts::date between (select d from ds) and (select d from ds) + interval 1 day"""))
def q_scan_day(spark, sf):
    """The packages of the first two days of the table, from their folders alone."""
    days = _by_day(spark, sf)
    first = D.listed_days(days).agg(F.min(D.DAY).alias("d")).first().d  # one value, from the layout
    wanted = days.where(F.col(D.DAY).between(F.lit(first), F.date_add(F.lit(first), 1)))
    return wanted.select("package_id", "name", F.date_format(D.DAY, "yyyy-MM-dd").alias("day"))


# --- sources / sinks -------------------------------------------------------------------------
@register("label_seed", TW.with_ctes(TW.PACKAGES, body="""
select name, 1 as label from packages where coalesce(homepage, '') <> '' and name is not null"""))
def q_label_seed(spark, sf):
    """Names of packages that have a field, with a constant label."""
    return (FX.packages(spark, sf).where((F.coalesce("homepage", F.lit("")) != "") & F.col("name").isNotNull())
            .select("name", F.lit(1).alias("label")))


@register("side_outputs", TW.with_ctes(TW.PACKAGES, TW.NUGETV, f"""
su as (select package_id, unnest(regexp_extract_all(concat(coalesce(file_name, ''), coalesce(description, '')), '{TW.URL_RE}')) as u
  from nugg where gate = 'score'),
sm as (select package_id, count(*) as n from su
  where not regexp_matches(regexp_extract(u, '{TW.NETLOC_RE}', 1), '[\\[\\]]') and {_dom('u')} not in ('nuget.org')
    and regexp_matches(u, '{"(" + "|".join(s.replace(".", chr(92) + ".") for s in C.IMAGE_SUFFIXES) + ")$"}') group by 1)
""", body="""
select g.package_id, g.readme_tag = 1 as has_readme, coalesce(sm.n, 0) > 0 as has_media
from nugg g left join sm on sm.package_id = g.package_id where g.gate = 'score'"""))
def q_side_outputs(spark, sf):
    """Which scored NuGet packages have a README and which link media."""
    g = gate_nuget(FX.nuget_view(spark, sf), F.col("description")).where(F.col("gate") == SCORE)
    media = media_count(U.extract_urls(nuget_text(F.col("file_name"), F.col("description"))), NUGET)
    return g.select("package_id", (F.col("readme_tag") == 1).alias("has_readme"), (media > 0).alias("has_media"))


@register("copy_slice", TW.with_ctes(TW.PACKAGES, body="""
select name, description from packages where full_description is not null order by package_id limit 200 offset 50"""))
def q_copy_slice(spark, sf):
    """A slice of the rows that have an overview, id dropped."""
    p = FX.packages(spark, sf).where(F.col("full_description").isNotNull()).select("package_id", "name", "description")
    return M.slice_rows(p, "package_id", 50, 200).select("name", "description")


@register("scan_packages", TW.with_ctes(TW.PACKAGES, body="select package_id, namespace, name, pull_count from packages"))
def q_scan_packages(spark, sf):
    """A column subset of the package table (only these columns are read)."""
    return FX.packages(spark, sf).select("package_id", "namespace", "name", "pull_count")


def _fresh_table(spark, name):
    import uuid
    from ..session import shared_path
    from ..sources.commits import CommittedTable
    return CommittedTable(spark, shared_path(spark, "committed", f"{name}-{uuid.uuid4().hex}"))


@register("scan_since", TW.with_ctes(TW.PACKAGES, body="""
select package_id, name, case when package_id <= (select max(package_id) // 2 from packages) then 1 else 2 end::bigint as run
from packages where package_id is not null"""))
def q_scan_since(spark, sf):
    """Two runs over a growing table (at first its lower half of ids is there), each
    from the cursor that the run before stored with its rows; ``run`` tells which did a row."""
    from ..sources.commits import ingest
    p = FX.packages(spark, sf).select("package_id", "name")
    done = _fresh_table(spark, "scan")
    half = p.agg(F.floor(F.max("package_id") / 2).alias("h")).scalar()
    for seen in (p.where(F.col("package_id") <= half), p):
        ingest(done, seen, "package_id", lambda rows: rows)
    return done.read().select("package_id", "name", "run")


_READMES = """
rm as (select package_id, name, namespace, release_ts, length(full_description) as n_chars, package_id % 25 = 4 as bad
  from packages where full_description is not null),
rk as (select *, case when bad then 'decode' when coalesce(name, '') = '' then 'name' when coalesce(namespace, '') = '' then 'author'
  when release_ts is null then 'release date' end as reason from rm)
"""


def _committed_readmes(spark, sf, kind):
    """One pass over the README bytes: rows, rejects and undecodable ones, published together."""
    from ..sources import archives as AR
    from ..sources.commits import checked_rows
    m = FX.readme_members(spark, sf)
    rows = m.select("package_id", "name", "namespace", F.to_date("release_ts").alias("release_date"),
                    *AR.decode_utf8_or(F.col("content"), "UTF-16"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    checked = checked_rows(rows, F.col("text").isNull(), {
        "name": filled("name"), "author": filled("namespace"), "release date": F.col("release_date").isNotNull()})
    done = _fresh_table(spark, "readmes")
    done.append(checked.withColumn("n_chars", F.char_length("text").cast("long")).drop("text"))
    return done.read(kind)


@register("commit_rows", TW.with_ctes(TW.PACKAGES, _READMES, body="""
select package_id, name, strftime(release_ts::date, '%Y-%m-%d') as release_date, package_id % 10 = 3 as used_fallback, n_chars
from rk where reason is null"""))
def q_commit_rows(spark, sf):
    """The good rows of a committed run over README bytes."""
    return _committed_readmes(spark, sf, "good").select(
        "package_id", "name", F.date_format("release_date", "yyyy-MM-dd").alias("release_date"), "used_fallback", "n_chars")


@register("commit_rejects", TW.with_ctes(TW.PACKAGES, _READMES, body="select package_id, reason from rk where reason <> 'decode'"))
def q_commit_rejects(spark, sf):
    """The rows of the same run that break a rule of the table, with the first one they break."""
    return _committed_readmes(spark, sf, "reject").select("package_id", "reason")


@register("commit_errors", TW.with_ctes(TW.PACKAGES, _READMES, body="select package_id, name from rk where reason = 'decode'"))
def q_commit_errors(spark, sf):
    """The rows of the same run whose bytes are neither UTF-8 nor UTF-16."""
    return _committed_readmes(spark, sf, "error").select("package_id", "name")


@register("corpus_audit", TW.with_ctes(TW.PACKAGES, TW.NUGETV, body="""
select count(*) as total,
  count_if(length(regexp_replace(coalesce(description, ''), '^\\s+|\\s+$', '', 'g')) < 20)::bigint as short_text,
  count_if(not regexp_matches(coalesce(description, ''), 'https?://[^\\s;()"]+'))::bigint as no_url from nugv"""))
def q_corpus_audit(spark, sf):
    """Total, short texts and texts without a URL over the NuGet descriptions."""
    return corpus_audit(FX.nuget_view(spark, sf), F.col("description"))


# --- S8, S12 -----------------------------------------------------------------------------
@register("load_vectors", """
select concat('w', cast(vec_id as varchar)) as word, cast(len(embedding) as bigint) as n_dims,
  round(embedding[1]::double, 6) as v0, round(list_sum(embedding::double[]), 6) as v_sum from embeddings""")
def q_load_vectors(spark, sf):
    """Word vectors in word2vec text form (written from ``embeddings``, with
    the count/dimension header) read back as ``(word, vec array<float>)``."""
    import uuid
    from ..session import shared_path
    from ..sources.tables import read_word_vectors
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    path = shared_path(spark, "vectors", uuid.uuid4().hex)
    header = emb.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"),
                                 F.max(F.size("embedding")).cast("string")).alias("value"))
    lines = emb.select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")),
                                   F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value"))
    header.unionByName(lines).write.text(path)
    v = read_word_vectors(spark, path)
    d = F.transform("vec", lambda x: x.cast("double"))
    return v.select("word", F.size("vec").cast("long").alias("n_dims"), F.round(d[0], 6).alias("v0"),
                    F.round(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), 6).alias("v_sum"))


@register("sink_batches", TW.with_ctes(TW.PACKAGES, TW.GATED, TW.PRED, body="""
select g.package_id, case when g.gate = 'score' then p.pred else g.gate end as result,
  strftime(g.release_ts::date, '%Y-%m-%d') as release_date
from gated g join pred p on p.package_id = g.package_id"""))
def q_sink_batches(spark, sf):
    """Result rows written per release day with dynamic partition
    overwrite, then the same job run again (a retry): still one row per package."""
    import uuid
    from ..session import shared_path
    from . import image as IMG
    from ..operators.links import write_partitions
    g = IMG.gated_packages(spark, sf)
    pred = FX.predictions(spark, sf).select("package_id", "pred")
    rows = (g.join(pred, "package_id")
            .select("package_id", F.when(F.col("gate") == SCORE, F.col("pred")).otherwise(F.col("gate")).alias("result"),
                    F.date_format(F.to_date("release_ts"), "yyyy-MM-dd").alias("release_date")))
    path = shared_path(spark, "sinks", uuid.uuid4().hex)
    write_partitions(rows, path, "release_date")
    write_partitions(rows, path, "release_date")  # retried run: replaces, never duplicates
    out = spark.read.parquet(path)
    return out.select("package_id", "result", F.col("release_date").cast("string").alias("release_date"))


@register("corpus_audit_strict")
def q_corpus_audit_strict(spark, sf):
    """A19 with the audit's own look-around URL pattern (rows-only: RE2 has no
    look-around; a unit test checks the pattern against Python's engine)."""
    return corpus_audit(FX.nuget_view(spark, sf), F.col("description"), C.URL_AUDIT)
