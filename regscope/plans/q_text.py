"""Step 3 queries: tokens, stop words, lexicon filter, frequencies, top words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_features as TF
from ..sources.tables import table
from . import image as IMG
from . import keywords as K
from . import twins as TW
from .catalog import register

TOKEN_RE = r"[\p{L}_]+"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in TF.stop_words())

_TOK = f"""
tk as (select package_id, cast(pos - 1 as bigint) as pos, token from (
  select package_id, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) as token,
         unnest(generate_series(1, len(regexp_extract_all(lower(text), '{TOKEN_RE}')))) as pos from cand)),
ct as (select * from tk where length(token) > 1 and token not in ({_STOP}))
"""
_LEX_WORDS = f"""
lex as (select distinct token as word, substring('NVJR', 1 + length(token) % 4, 1) as tag from (
  select unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) as token from documents))
"""
_LEX = f"""
{_LEX_WORDS.strip()},
nv as (select * from ct where token not in (
  select word from lex where not (starts_with(tag, 'N') or starts_with(tag, 'V'))))
"""

# Word lists are arguments in the original (its files are not shipped); these
# are the lists the registered query passes.
LISTS = {"download": ["download", "free", "crack"], "drug": ["pill", "pharmacy"],
         "gambling": ["casino", "bet", "poker"]}


def _cand_tokens(spark, sf):
    return TF.token_rows(IMG.candidates(spark, sf), "package_id", F.col("text"))


@register("tokens", TW.with_ctes(TW.PACKAGES, TW.GATED, _TOK, body="select package_id, pos, token from tk"))
def q_tokens(spark, sf):
    """F6 (split path): every lower-cased letter run of each scored package text."""
    return _cand_tokens(spark, sf)


@register("clean_tokens", TW.with_ctes(TW.PACKAGES, TW.GATED, _TOK, body="select package_id, pos, token from ct"))
def q_clean_tokens(spark, sf):
    """stop words and one-character tokens removed."""
    return TF.clean_tokens(_cand_tokens(spark, sf))


@register("noun_verb_tokens", TW.with_ctes(TW.PACKAGES, TW.GATED, _TOK, _LEX, body="select package_id, pos, token from nv"))
def q_noun_verb_tokens(spark, sf):
    """F8: keep nouns and verbs by a lexicon table (unknown words kept)."""
    return TF.noun_verb_tokens(TF.clean_tokens(_cand_tokens(spark, sf)), K.lexicon(spark, sf)).select(
        "package_id", "pos", "token")


@register("word_freq", TW.with_ctes(TW.PACKAGES, TW.GATED, _TOK, body="""
select package_id, token as word, count(*) as n, min(pos) as first_pos from ct group by 1, 2"""))
def q_word_freq(spark, sf):
    """Per package word counts and first positions."""
    return TF.text_word_freq(IMG.candidates(spark, sf), "package_id", F.col("text"))


@register("top_words", TW.with_ctes(TW.PACKAGES, TW.GATED, _TOK, _LEX, """
tw as (select package_id, token as word, count(*) as n, min(pos) as first_pos from nv group by 1, 2)
""", body="""
select package_id, rank, word, n from (
  select package_id, word, n, row_number() over (partition by package_id order by n desc, first_pos) as rank from tw)
where rank <= 10"""))
def q_top_words(spark, sf):
    """The ten keywords of each scored image package."""
    return TF.text_top_words(IMG.candidates(spark, sf), "package_id", F.col("text"), 10, K.lexicon(spark, sf))


@register("platform_words", TW.with_ctes(f"""
pt as (select source, doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) as token,
  unnest(generate_series(1, len(regexp_extract_all(lower(text), '{TOKEN_RE}')))) as pos from documents),
pf as (select source, token as word, count(*) as n, min(doc_id * 1000000000 + pos) as first from pt
  where regexp_matches(token, '^\\p{{L}}+$') and length(token) > 1 and token not in ({_STOP}) group by 1, 2)
""", body="""
select source, rank, word, n from (
  select source, word, n, row_number() over (partition by source order by n desc, first) as rank from pf)
where rank <= 20"""))
def q_platform_words(spark, sf):
    """Top-20 words per corpus (one corpus per document source)."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return TF.platform_words(docs, "source", F.col("text"), 20)


def _hits_sql():
    parts = []
    for name, words in LISTS.items():
        terms = " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words)
        parts.append(f"cast({terms} as bigint) as {name}_hits")
    return ", ".join(parts)


@register("lexicon_hits", TW.with_ctes(TW.PACKAGES, TW.GATED, body=f"select package_id, {_hits_sql()} from cand"))
def q_lexicon_hits(spark, sf):
    """Dictionary substring counts per list over the scored package texts."""
    return TF.lexicon_hits(IMG.candidates(spark, sf), "package_id", F.col("text"), LISTS)


# --- step 7: language stages ------------------------------------------------------
from ..operators import language as LG  # noqa: E402
from ..operators import model as M  # noqa: E402
from ..sources import fixtures as FX  # noqa: E402

_TG = """
tr as (select * from documents where lang is not null and substring(md5(cast(doc_id as varchar)), 1, 8) >= '4ccccccc'),
tg as (select doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3))) as gram from documents),
g as (select tr.lang, tg.gram, count(*) as c from tg join tr on tr.doc_id = tg.doc_id group by 1, 2),
vv as (select count(distinct gram) as v from g),
nd as (select count(*) as n from tr),
ld as (select lang, count(*) as d from tr group by 1),
lt as (select lang, sum(c) as n from g group by 1),
lg as (select ld.lang, ln(ld.d / (select n from nd)) as prior, ln(lt.n + (select v from vv)) as denom
  from ld join lt on lt.lang = ld.lang),
dc as (select doc_id, gram, count(*) as c from tg group by 1, 2),
inv as (select doc_id, sum(c) as n_in from dc where gram in (select gram from g) group by 1),
hits as (select dc.doc_id, g.lang, sum(dc.c * ln(g.c + 1)) as s from dc join g on g.gram = dc.gram group by 1, 2),
per as (select d.doc_id, l.lang, l.prior + coalesce(h.s, 0) - coalesce(i.n_in, 0) * l.denom as ll
  from documents d cross join lg l left join inv i on i.doc_id = d.doc_id
  left join hits h on h.doc_id = d.doc_id and h.lang = l.lang),
po as (select doc_id, lang, exp(ll - max(ll) over (partition by doc_id)) as e from per),
pp as (select doc_id, lang, e / sum(e) over (partition by doc_id) as p from po),
best as (select doc_id, lang, p, row_number() over (partition by doc_id order by p desc, lang desc) as r from pp)
"""


@register("language_gate", TW.with_ctes(_TG, body="""
select doc_id, lang as lang_pred, round(p, 6) as p_lang, lang = 'en' and p > 0.9 as is_english from best where r = 1"""))
def q_language_gate(spark, sf):
    """F4 (re-aimed): naive Bayes over trigrams, fitted on the 70 % train side of
    ``documents.lang``, applied to every document; English above 0.9."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    train = M.split_rows(docs, "doc_id", 0.3).where(F.col("split") == "train")
    out = LG.score_language(docs, "doc_id", F.col("text"), LG.fit_language_model(train, F.col("text")))
    return out.select("doc_id", "lang_pred", F.round("p_lang", 6).alias("p_lang"), "is_english")


@register("text_for_keywords", TW.with_ctes(TW.PACKAGES, TW.GATED, """
tr as (select package_id, concat('english ', coalesce(full_description, '')) as text_en from packages where lang <> 'en')
""", body="select c.package_id, coalesce(t.text_en, c.text) as kw_text from cand c left join tr t on t.package_id = c.package_id"))
def q_text_for_keywords(spark, sf):
    """keyword text is the supplied translation, of the whole text, for non-English packages."""
    p = FX.packages(spark, sf)
    tr = p.where(F.col("lang") != "en").select("package_id", F.concat(F.lit("english "), F.coalesce("full_description", F.lit(""))).alias("text_en"))
    return LG.text_for_keywords(IMG.candidates(spark, sf), "package_id", "text", tr)


@register("segmented_tokens")
def q_segmented_tokens(spark, sf):
    """F6 b: Viterbi segmentation of each scored package's unspaced text with a
    unigram cost table fitted on ``documents``."""
    docs = table(spark, sf, "documents").select("text")
    costs = LG.word_costs(docs, F.col("text"))
    return LG.segment(IMG.candidates(spark, sf), "package_id", F.col("text"), costs)


_NPM_TOK = f"""
nt as (select package_id, cast(pos - 1 as bigint) as pos, token from (
  select package_id, unnest(regexp_extract_all(lower(t), '{TOKEN_RE}')) as token,
         unnest(generate_series(1, len(regexp_extract_all(lower(t), '{TOKEN_RE}')))) as pos from (
    select package_id, concat_ws(' ', coalesce(name, ''), coalesce(description, ''), coalesce(readme, '')) as t
    from npmg where gate = 'score'))),
nc as (select * from nt where length(token) > 1 and token not in ({_STOP})),
nf as (select package_id, token as word, count(*) as n, min(pos) as first_pos from nc group by 1, 2)
"""


@register("top_words_npm", TW.with_ctes(TW.PACKAGES, TW.NPMV, _NPM_TOK, body="""
select package_id, rank, word, n from (
  select package_id, word, n, row_number() over (partition by package_id order by n desc, first_pos) as rank from nf)
where rank <= 20"""))
def q_top_words_npm(spark, sf):
    """W2 (npm): the twenty keywords of each scored npm package's text."""
    from ..operators.gates import SCORE, gate_npm, npm_text
    g = gate_npm(FX.npm_view(spark, sf)).where(F.col("gate") == SCORE)
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return TF.text_top_words(g, "package_id", npm_text(c("name"), c("description"), c("readme")), 20)
