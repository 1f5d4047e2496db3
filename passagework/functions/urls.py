"""URL expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(url: Column) -> Column:
    """NULL or empty stays NULL; `https://` goes in front when no http scheme is present."""
    return (
        F.when(url.isNull() | (url == ""), F.lit(None).cast("string"))
        .when(url.startswith("http://") | url.startswith("https://"), url)
        .otherwise(F.concat(F.lit("https://"), url))
    )


def title_from_url(url: Column) -> Column:
    """Last path segment, percent-decoded, underscores shown as spaces.

    `url_decode` turns `+` into a space and fails on a stray `%`, so both are
    escaped first; path parameters (`;…`), query and fragment are dropped.
    """
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"(?s)[?#].*$", "")
    segment = F.element_at(F.split(path, "/", -1), -1)
    segment = F.regexp_replace(segment, r"(?s);.*$", "")
    segment = F.regexp_replace(segment, r"%(?![0-9A-Fa-f]{2})", "%25")
    segment = F.replace(segment, F.lit("+"), F.lit("%2B"))
    return F.replace(F.url_decode(segment), F.lit("_"), F.lit(" "))
