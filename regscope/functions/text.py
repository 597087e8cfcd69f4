"""Text expressions (A7, A8, F6 split path, F7, F9): Catalyst only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# Unicode-aware whitespace, as a scripting language's strip() sees it.
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _EDGE_SPACE, "")


def is_blank(c: Column) -> Column:
    """Null, '' or whitespace only."""
    return F.char_length(strip(c)) == 0


def code_block_count(text: Column) -> Column:
    """Fenced blocks (``` or ~~~), non-overlapping, dot matches newline."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.CODE_BLOCK), 0))


def markdown_flag(overview: Column) -> Column:
    """Some stripped line starts with '#', '* ' or '>' or holds all of [ ] ( ),
    and the text holds none of the HTML closing tags."""
    def md_line(line: Column) -> Column:
        s = strip(line)
        return (s.startswith("#") | s.startswith("* ") | s.startswith(">")
                | (s.contains("[") & s.contains("]") & s.contains("(") & s.contains(")")))
    lines = F.split(F.coalesce(overview, F.lit("")), "\n", -1)
    any_md = F.exists(lines, md_line)
    any_html = F.lit(False)
    for tag in C.HTML_TAGS:
        any_html = any_html | F.coalesce(overview, F.lit("")).contains(tag)
    return any_md & ~any_html


def image_code_features(overview: Column) -> list[Column]:
    """[1, 0] if empty; markdown -> [1, 1/blocks] (1 if none); else [0, 1]."""
    empty = F.coalesce(overview, F.lit("")) == ""
    md = markdown_flag(overview)
    blocks = code_block_count(overview)
    inv = F.when(blocks == 0, F.lit(1.0)).otherwise(F.lit(1.0) / blocks)
    code_md = F.when(empty, F.lit(1.0)).when(md, F.lit(1.0)).otherwise(F.lit(0.0))
    code_blocks = F.when(empty, F.lit(0.0)).when(md, inv).otherwise(F.lit(1.0))
    return [code_md.alias("code_md"), code_blocks.alias("code_blocks")]


def npm_code_feature(text: Column) -> Column:
    """A8 (npm): 1 / blocks, 1 when there is none."""
    blocks = code_block_count(text)
    return F.when(blocks == 0, F.lit(1.0)).otherwise(F.lit(1.0) / blocks)


def popularity(pull_count: Column) -> Column:
    """1 / (pulls + 1), null pulls count as 0."""
    return F.lit(1.0) / (F.coalesce(pull_count, F.lit(0)) + F.lit(1))


# --- tokenising (F6 split path, F7, F9) -------------------------------------
# Word characters are letters, digits and '_' (Unicode); digits are removed.
# The split path keeps runs of letters and '_' as tokens.
TOKEN = r"[\p{L}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased letter runs, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def squeezed(text: Column) -> Column:
    """The reference's pre-segmentation string: lower case, non-word characters
    and digit runs removed (one unspaced string)."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]|\p{Nd}+", "")


def is_alpha(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")
