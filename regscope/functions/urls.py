"""URL expressions (F1, F3): all Catalyst expressions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


# Trailing characters that the compatible grammar keeps ("(http://bit.ly)"
# yields "http://bit.ly)") and strict mode trims.
STRICT_TRAILING = r"[)>,.;']+$"


def extract_urls(text: Column, pattern: str = C.URL_FEATURE, strict: bool = False) -> Column:
    """All URL matches of ``text``, in order, duplicates kept (null text -> []).

    ``strict=False`` (default) reproduces the original grammar exactly;
    ``strict=True`` also trims trailing ``)>,.;'`` from every match."""
    urls = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    if not strict:
        return urls
    return F.transform(urls, lambda u: F.regexp_replace(u, STRICT_TRAILING, ""))


def extract_links(text: Column, pattern: str) -> Column:
    """Group 1 of every match of a link pattern (markdown target, href value)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)


def has_url(text: Column, pattern: str = C.URL_FEATURE) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern)


def netloc(url: Column) -> Column:
    """Network location: text after ``//`` up to the first ``/``, ``?`` or ``#``."""
    return F.regexp_extract(url, C.NETLOC, 1)


def parseable(host: Column) -> Column:
    """A netloc with a square bracket is rejected by the URL parser (bad IPv6);
    such a URL is skipped by the host-based counts but still counted as a URL."""
    return ~host.rlike(r"[\[\]]")


def registered_domain(host: Column) -> Column:
    """Last two dot-separated labels (no public-suffix list: a.co.uk -> co.uk)."""
    return F.substring_index(host, ".", -2)


def url_domain(url: Column) -> Column:
    return registered_domain(netloc(url))


def media_suffix_regex(suffixes=None) -> str:
    """Case-sensitive 'ends with one of the image suffixes' pattern."""
    import re
    suffixes = suffixes or C.IMAGE_SUFFIXES
    return "(" + "|".join(re.escape(s) for s in suffixes) + ")$"


def in_list(col: Column, values) -> Column:
    return col.isin(list(values))
