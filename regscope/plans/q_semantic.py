"""Step 4 queries: keywords of the texts and their distances over ``embeddings`` as the vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import semantics as S
from ..profiles import IMAGE, RegistryProfile
from ..sources import fixtures as FX
from . import image as IMG
from . import keywords as K
from . import twins as TW
from .catalog import r6, register
from .q_text import _LEX_WORDS, _STOP, LISTS, TOKEN_RE

WORD_LIST = [w for words in LISTS.values() for w in words]


def _ids_sql(word: str) -> str:
    return f"('0x' || substring(md5({word}), 1, 12))::bigint % ((select n from n_vec) + {K.OUT_OF_VOCABULARY})"


def _list_sql(words: list[str]) -> str:
    rows = ", ".join(f"('{w}')" for w in words)
    return f"select t.word, v.vec_id, v.vec from (values {rows}) t(word) join voc v on v.vec_id = {_ids_sql('t.word')}"


def kw_sql(src: str, text: str, profile: RegistryProfile) -> str:
    """CTEs ``voc``, ``plat``, ``wl``, ``kw`` and ``pd``: the keywords of the rows of ``src``
    and their mean distances to the platform words, pair by pair."""
    tagged = "" if profile.name == "npm" else """
  and token not in (select word from lex where not (starts_with(tag, 'N') or starts_with(tag, 'V')))"""
    return f"""
n_vec as (select count(*) as n from embeddings),
voc as (select vec_id, embedding::double[] as vec from embeddings),
plat as ({_list_sql(C.PLATFORM_WORDS[profile.platform])}),
wl as ({_list_sql(WORD_LIST)}),
{_LEX_WORDS.strip()},
kw_tk as (select package_id, pos, token from (
  select package_id, unnest(regexp_extract_all(lower({text}), '{TOKEN_RE}')) as token,
         unnest(generate_series(1, len(regexp_extract_all(lower({text}), '{TOKEN_RE}')))) as pos from {src})
  where length(token) > 1 and token not in ({_STOP}){tagged}),
kw_tw as (select package_id, token as word, count(*) as n, min(pos) as first_pos from kw_tk group by 1, 2),
kw as (select package_id, rank - 1 as pos, word, {_ids_sql('word')} as vec_id from (
  select package_id, word, row_number() over (partition by package_id order by n desc, first_pos) as rank from kw_tw)
  where rank <= {profile.top_k_words}),
pd as (select k.package_id, k.pos, k.vec_id, avg(1 - list_cosine_similarity(v.vec, p.vec)) as distance
  from kw k join voc v on v.vec_id = k.vec_id cross join plat p group by 1, 2, 3)
"""


_KW = kw_sql("cand", "text", IMAGE)
_VOC = "voc as (select vec_id, embedding::double[] as vec from embeddings)"


def _kw(spark, sf):
    return K.keywords(spark, sf, IMAGE)


def _scored(spark, sf):
    return IMG.candidates(spark, sf).select("package_id")


@register("vector_distance", TW.with_ctes(_VOC, body="""
select a.vec_id, b.vec_id as plat_id, round(1 - list_cosine_similarity(a.vec, b.vec), 6) as distance
from voc a join voc b on b.vec_id = a.vec_id % 20"""))
def q_vector_distance(spark, sf):
    """cosine distance of every vocabulary vector to vector ``id % 20``."""
    v = FX.vectors(spark, sf)
    p = v.where(F.col("vec_id") < 20).select(F.col("vec_id").alias("plat_id"), F.col("vec").alias("pvec"))
    return (v.join(F.broadcast(p), (v["vec_id"] % 20) == p["plat_id"])  # 20 rows by construction
            .select("vec_id", "plat_id", r6(S.cosine_distance(F.col("vec"), F.col("pvec")), "distance")))


@register("in_vocab", TW.with_ctes(TW.PACKAGES, TW.GATED, _KW, body="select k.package_id, k.pos, k.word, k.vec_id from kw k join voc v on v.vec_id = k.vec_id"))
def q_in_vocab(spark, sf):
    """Keywords that have a vector."""
    return S.in_vocab(_kw(spark, sf), FX.vectors(spark, sf)).select("package_id", "pos", "word", "vec_id")


@register("platform_distance", TW.with_ctes(TW.PACKAGES, TW.GATED, _KW, body="select package_id, pos, vec_id, round(distance, 6) as distance from pd"))
def q_platform_distance(spark, sf):
    """A15 (R1): mean distance of each in-vocabulary keyword to the platform words."""
    d = S.platform_distance(_kw(spark, sf), FX.vectors(spark, sf), K.platform_vectors(spark, sf, IMAGE))
    return d.select("package_id", "pos", "vec_id", r6("distance"))


@register("list_distance", TW.with_ctes(TW.PACKAGES, TW.GATED, _KW, """
ld as (select k.package_id, k.pos, min(1 - list_cosine_similarity(v.vec, w.vec)) as distance
  from kw k join voc v on v.vec_id = k.vec_id cross join wl w group by 1, 2),
docs as (select package_id from cand)
""", body="""
select d.package_id, round(coalesce(min(distance), 1), 6) as d_min, round(coalesce(max(distance), 1), 6) as d_max,
  round(coalesce(avg(distance), 1), 6) as d_mean
from docs d left join ld on ld.package_id = d.package_id group by d.package_id"""))
def q_list_distance(spark, sf):
    """Per scored package [min, max, mean] of each keyword's minimum distance to
    the words of the dictionary lists."""
    dist = S.list_distance(_kw(spark, sf), FX.vectors(spark, sf), K.word_vectors(spark, sf, WORD_LIST))
    s = S.list_distance_summary(dist, _scored(spark, sf))
    return s.select("package_id", r6("d_min"), r6("d_max"), r6("d_mean"))


@register("semantic_vector", TW.with_ctes(TW.PACKAGES, TW.GATED, _KW, """
docs as (select package_id from cand),
top as (select package_id, pos, distance from pd where pos < 10),
lst as (select package_id, list(distance order by pos) as d from top group by 1),
pad as (select d.package_id, case when l.d is null then [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]
  else list_transform(range(0, 10), lambda i: l.d[(i % len(l.d)) + 1]) end as v
  from docs d left join lst l on l.package_id = d.package_id)
""", body="""
select package_id, cast(i - 1 as bigint) as i, round(v[i], 6) as value from (
  select package_id, v, unnest(generate_series(1, 10)) as i from pad)"""))
def q_semantic_vector(spark, sf):
    """Ten platform distances per scored package, cyclically padded (rows of
    ``(package_id, i, value)``)."""
    d = S.platform_distance(_kw(spark, sf), FX.vectors(spark, sf), K.platform_vectors(spark, sf, IMAGE))
    sv = S.semantic_vector(d, _scored(spark, sf))
    return sv.select("package_id", F.posexplode("semantic").alias("i", "value")).select(
        "package_id", F.col("i").cast("long").alias("i"), r6("value"))
