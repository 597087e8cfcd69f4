"""Step 5 queries: labels, splits, samples, metrics, feature matrix, forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import model as M
from ..profiles import IMAGE, NPM, NUGET
from ..sources import fixtures as FX
from ..sources.tables import label_text, table
from . import image as IMG
from . import scoring as SC
from . import twins as TW
from .catalog import r6, register
from .q_core import _BLOCKS, _HTML, _MD_LINE
from .q_semantic import _KW


def _labelled(spark, sf):
    p = FX.packages(spark, sf).drop("label")
    lab = table(spark, sf, "labels").select(
        F.col("doc_id").alias("package_id"),
        F.when(F.col("quality") == 0, F.lit("abuse")).otherwise(F.lit("non-abuse")).alias("label"))
    return M.labelled(p, lab)


_LAB = """
lab as (select p.package_id, p.name, case when l.quality = 0 then 'abuse' else 'non-abuse' end as label
  from packages p join labels l on l.doc_id = p.package_id)
"""


@register("scan_labels", "select doc_id as package_id, case when toxic = 1 then 'abuse' else 'non-abuse' end as label from labels")
def q_scan_labels(spark, sf):
    """S3: a label table's 0/1 flag as 'abuse' / 'non-abuse' (only 1 is abuse)."""
    return table(spark, sf, "labels").select(F.col("doc_id").alias("package_id"), label_text(F.col("toxic")).alias("label"))


@register("labelled_packages", TW.with_ctes(TW.PACKAGES, _LAB, body="select package_id, name, label from lab"))
def q_labelled_packages(spark, sf):
    """Labels joined to packages by id."""
    return _labelled(spark, sf).select("package_id", "name", "label")


@register("training_set", TW.with_ctes(TW.PACKAGES, _LAB, body="""
select package_id, label from lab where label = 'abuse' union all select package_id, label from lab where label = 'non-abuse'"""))
def q_training_set(spark, sf):
    """Abuse and benign sets stacked, duplicates kept."""
    lab = _labelled(spark, sf).select("package_id", "label")
    return M.training_set(lab.where(F.col("label") == "abuse"), lab.where(F.col("label") == "non-abuse"))


@register("label_counts", TW.with_ctes(TW.PACKAGES, _LAB, body="select label, count(*) as n from lab group by label"))
def q_label_counts(spark, sf):
    """A21."""
    return M.label_counts(_labelled(spark, sf))


@register("split_rows", TW.with_ctes(TW.PACKAGES, _LAB, body="""
select package_id, label, case when substring(md5(cast(package_id as varchar)), 1, 8) < '4ccccccc' then 'test' else 'train' end as split from lab"""))
def q_split_rows(spark, sf):
    """L3: stateless 70/30 split per class."""
    return M.split_rows(_labelled(spark, sf).select("package_id", "label"), "package_id", 0.3)


@register("sample_names", TW.with_ctes(TW.PACKAGES, _LAB, body="""
select label, name from (select label, name, row_number() over (partition by label order by md5(name), name) as r
  from lab where name is not null) where r <= 50"""))
def q_sample_names(spark, sf):
    """L2: 50 reproducible names per class."""
    lab = _labelled(spark, sf).where(F.col("name").isNotNull()).select("label", "name")
    return M.sample_per_group(lab, "label", "name", 50)


@register("slice_rows", TW.with_ctes(TW.PACKAGES, body="select package_id, name from packages order by package_id limit 300 offset 100"))
def q_slice_rows(spark, sf):
    """L1: skip 100, take 300 in package order."""
    return M.slice_rows(FX.packages(spark, sf).select("package_id", "name"), "package_id", 100, 300)


@register("weighted_metrics", TW.with_ctes(TW.PACKAGES, TW.PRED, """
pr as (select label, pred from pred where label is not null),
conf as (select label, pred, count(*) as c from pr group by 1, 2),
cls as (select label as cls from conf union select pred from conf),
per as (select k.cls,
  coalesce((select sum(c) from conf where label = k.cls), 0) as support,
  coalesce((select sum(c) from conf where pred = k.cls), 0) as predicted,
  coalesce((select sum(c) from conf where label = k.cls and pred = k.cls), 0) as tp from cls k),
m as (select support, tp, case when predicted > 0 then tp / predicted else 0 end as p,
  case when support > 0 then tp / support else 0 end as r from per)
""", body="""
select round(sum(tp) / sum(support), 6) as accuracy, round(sum(p * support) / sum(support), 6) as precision,
  round(sum(r * support) / sum(support), 6) as recall,
  round(sum(case when p + r > 0 then 2 * p * r / (p + r) else 0 end * support) / sum(support), 6) as f1 from m"""))
def q_weighted_metrics(spark, sf):
    """A20 on the fixed stand-in predictions of the labelled packages."""
    pred = FX.predictions(spark, sf).where(F.col("label").isNotNull())
    m = M.weighted_metrics(pred)
    return m.select(*[r6(c) for c in ("accuracy", "precision", "recall", "f1")])


_FM = TW.with_ctes(TW.PACKAGES, TW.GATED, TW.URL_FEATS, _KW, f"""
cf as (select package_id, coalesce(full_description, '') = '' as empty, ({_MD_LINE}) and not ({_HTML}) as md,
  {_BLOCKS} as blocks from cand),
cfx as (select package_id, case when empty then 1.0 when md then 1.0 else 0.0 end::double as code_md,
  case when empty then 0.0 when md then (case when blocks = 0 then 1.0 else 1.0 / blocks end) else 1.0 end::double as code_blocks from cf),
top as (select package_id, pos, distance from pd where pos < 10),
lst as (select package_id, list(distance order by pos) as d from top group by 1),
sem as (select c.package_id, case when l.d is null then list_transform(range(0, 10), lambda i: 1.0::double)
  else list_transform(range(0, 10), lambda i: l.d[(i % len(l.d)) + 1]) end as s
  from cand c left join lst l on l.package_id = c.package_id),
fo as (select c.package_id, c.namespace, c.release_ts,
  list_concat([x.code_md, x.code_blocks], s.s, [u.url_external, u.url_short, u.url_domains, u.url_rank, u.url_dups]) as own,
  list_concat([u.url_external, u.url_short, u.url_domains, u.url_rank, u.url_dups], [x.code_md, x.code_blocks], s.s) as cb,
  1.0 / (coalesce(c.pull_count, 0) + 1) as pop
  from cand c join urlf u on u.package_id = c.package_id join cfx x on x.package_id = c.package_id
  join sem s on s.package_id = c.package_id),
fw as (select *, lag(cb, 1) over win as p1, lag(cb, 2) over win as p2 from fo
  window win as (partition by namespace order by release_ts, package_id)),
fm as (select package_id, list_concat(own, case when p1 is null then cb when p2 is null then p1
  else list_transform(range(1, 18), lambda i: 0.6 * p1[i] + 0.4 * p2[i]) end, [pop]) as f from fw),
fl as (select package_id, cast(i - 1 as bigint) as i, f[i] as value from (
  select package_id, f, unnest(generate_series(1, 35)) as i from fm))
""", body="")


@register("feature_matrix", _FM + "select package_id, i, round(value, 6) as value from fl")
def q_feature_matrix(spark, sf):
    """M1: the 35-wide image feature vector of every scored package, as rows."""
    ft = IMG.feature_table(spark, sf)
    return ft.select("package_id", F.posexplode("features").alias("i", "value")).select(
        "package_id", F.col("i").cast("long").alias("i"), r6("value"))


@register("minmax_norm", _FM + """, st as (select i, min(value) as lo, max(value) as hi from fl group by i),
al as (select min(case when hi <> lo then 1 else 0 end) = 1 as ok from st)
select f.package_id, f.i, round(case when al.ok then (f.value - st.lo) / (st.hi - st.lo) else f.value end, 6) as value
from fl f join st on st.i = f.i cross join al""")
def q_minmax_norm(spark, sf):
    """Column-wise min-max scaling of the feature matrix, only when every
    column varies."""
    ft = IMG.feature_table(spark, sf)
    rows = ft.select("package_id", F.posexplode("features").alias("i", "value")).select(
        "package_id", F.col("i").cast("long").alias("i"), "value")
    return M.minmax_long(rows).select("package_id", "i", r6("value"))


def _eval(stored) -> DataFrame:
    """M4: weighted metrics of a stored forest on the test rows kept beside it."""
    return M.weighted_metrics(M.score(stored.model(), stored.rows("test")))


@register("fit_eval")
def q_fit_eval(spark, sf):
    """M2 + M4: the forest of the train side, weighted metrics on the test side."""
    return _eval(SC.forest(spark, sf, IMAGE))


@register("fit_eval_npm")
def q_fit_eval_npm(spark, sf):
    """M2 + M4 (npm): 40 features, trained on three tenths of the labelled rows."""
    return _eval(SC.forest(spark, sf, NPM))


@register("fit_eval_nuget")
def q_fit_eval_nuget(spark, sf):
    """M2 + M4 (NuGet): 36 features."""
    return _eval(SC.forest(spark, sf, NUGET))


@register("score_packages")
def q_score_packages(spark, sf):
    """M3: every scored package labelled by the stored forest."""
    return SC.predictions(spark, sf, IMAGE)


@register("importances")
def q_importances(spark, sf):
    """M5: feature importances by index and name."""
    rows = M.importances(SC.forest(spark, sf, IMAGE).model(), SC.feature_names(IMAGE))
    return spark.createDataFrame(rows, "i long, name string, importance double")


@register("fit_eval_by_author")
def q_fit_eval_by_author(spark, sf):
    """M2 + M4 without leakage: the split is on md5(author), so all packages of
    an author (whose context blends their neighbours) fall on one side."""
    return _eval(SC.forest(spark, sf, IMAGE, split_key="namespace"))


# --- result rows -------------------------------------------------------------------
@register("npm_results")
def q_npm_results(spark, sf):
    """M3 + S10 (npm): result rows with the forest's labels."""
    return SC.npm_sink(spark, sf, SC.predictions(spark, sf, NPM))


@register("nuget_results")
def q_nuget_results(spark, sf):
    """M3 + S10 (NuGet): result rows with the forest's labels."""
    return SC.nuget_sink(spark, sf, SC.predictions(spark, sf, NUGET))


_RUN = "run as (select strftime(max(release_ts), '%Y-%m-%d %H:%M:%S') as run_at from packages)"


def _given(spark, sf):
    return FX.predictions(spark, sf).select("package_id", "pred")


@register("image_sink_rows", TW.with_ctes(TW.PACKAGES, TW.GATED, TW.PRED, _RUN, """
t as (select g.*, case when g.gate = 'score' then p.pred else g.gate end as result, coalesce(g.name, '') = '' as no_name,
  strftime(g.release_ts, '%Y-%m-%d %H:%M:%S') as released from gated g join pred p on p.package_id = g.package_id)
""", body="""
select package_id, case when no_name then 'null' else name end as name, (select run_at from run) as date,
  case when no_name then 'null' else result end as result, cast(package_id as varchar) as docker_id,
  case when no_name or coalesce(namespace, '') = '' then 'null' else namespace end as author,
  case when no_name or released is null then 'null' else released end as date_registered,
  case when no_name or released is null then 'null' else released end as last_updated from t"""))
def q_image_sink_rows(spark, sf):
    """S10 (image form), whole rows, with the fixed stand-in predictions."""
    return SC.image_sink(spark, sf, _given(spark, sf))


@register("npm_sink_rows", TW.with_ctes(TW.PACKAGES, TW.NPMV, TW.PRED, _RUN, """
ns as (select g.*, case when g.gate = 'score' then p.pred else g.gate end as result from npmg g join pred p on p.package_id = g.package_id)
""", body="""
select package_id, case when result = 'name_n' then 'name_null' else substring(name, 1, 95) end as name,
  (select run_at from run) as date, result, substring(tar_name, 1, 95) as tar_name, strftime(release_ts, '%Y-%m-%d') as release_date,
  case when result in ('name_n', 'rdm_n') then null when coalesce(user_name, '') = '' then 'NULL' else substring(user_name, 1, 95) end as user_name,
  case when result in ('name_n', 'rdm_n') then null when coalesce(user_email, '') = '' then 'NULL' else substring(user_email, 1, 95) end as user_email,
  cast(year(release_ts) as integer) as year from ns"""))
def q_npm_sink_rows(spark, sf):
    """S10 (npm form), whole rows, with the fixed stand-in predictions."""
    return SC.npm_sink(spark, sf, _given(spark, sf))


@register("nuget_sink_rows", TW.with_ctes(TW.PACKAGES, TW.NUGETV, TW.PRED, _RUN, """
k as (select package_id, unnest(list_distinct(regexp_extract_all(description, '{md}', 1))) as url from nugg where gate = 'score'
      union all
      select package_id, unnest(list_distinct(regexp_extract_all(description, '{href}', 1))) as url from nugg where gate = 'score'),
j as (select package_id, string_agg(url, chr(10) order by url) as urls from k where starts_with(url, 'http') group by 1)
""".replace("{md}", TW.MD_RE).replace("{href}", TW.HREF_RE), body="""
select g.package_id, case when coalesce(g.file_name, '') = '' then 'null' else g.file_name end as name, (select run_at from run) as time,
  case when g.gate = 'score' then p.pred else g.gate end as result, strftime(g.release_ts, '%Y-%m-%d') as date,
  case when coalesce(g.author, '') = '' then 'null' else g.author end as author, coalesce(j.urls, 'no_url') as urls
from nugg g join pred p on p.package_id = g.package_id left join j on j.package_id = g.package_id"""))
def q_nuget_sink_rows(spark, sf):
    """S10, S11 (NuGet form), whole rows, with the fixed stand-in predictions."""
    return SC.nuget_sink(spark, sf, _given(spark, sf))
