"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All that Unicode counts as white space.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, SPACE + "+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers, repeats kept; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


def html_title(html: Column) -> Column:
    """The text of the first title element by pattern, for scans that need nothing else of a page."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return F.btrim(raw)


def is_app_shell(html: Column) -> Column:
    """Whether a page must be rendered: blank, or an application's root without paragraph or article."""
    low = F.lower(html)
    root = low.contains('id="app"') | low.contains('id="root"') | low.contains("__next_data__") | low.contains("data-reactroot")
    return (F.btrim(html) == "") | (root & ~low.contains("<p") & ~low.contains("<article"))


def description_of(texts: Column, least: int = 20, most: int = 247) -> Column:
    """A description from block texts: those of at least ``least`` characters, joined, cut to ``most``; dots follow
    where the result has most - 1 bytes or more."""
    joined = F.btrim(F.array_join(F.filter(F.transform(texts, collapse), lambda x: F.length(x) >= least), " "))
    cut = F.substring(joined, 1, most)
    return F.when(F.octet_length(cut) >= most - 1, F.concat(cut, F.lit("..."))).otherwise(cut)
