"""URL validation and repair as pure column expressions.

``parse_url`` fails or returns NULL on many broken URLs that this data is full
of, so the parts come from the generic URI grammar instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.bind import let

# Patterns of broken CMS links.
BROKEN_PATH = "field_[a-f0-9]|[a-f0-9]{13}|_[0-9a-f]{8}"
BROKEN_QUERY = r"(?U)\bp=\d"
CONTACT_PATH = "/contact-us/"

_GRAMMAR = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _clean(col: Column) -> Column:
    """What the URI parser sees: no leading ``@``, no edge controls, no tabs or line breaks."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), "^@+", "")
    return F.regexp_replace(text, "^[\\x00-\\x20]+|[\\t\\r\\n]", "")


def _parsed(col: Column, body) -> Column:
    """``body(parts)`` with the parts of the URL read once: scheme, host, one_bracket, path, query."""

    def parts(text: Column) -> Column:
        host = F.regexp_extract(text, _GRAMMAR, 2)
        one_bracket = F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))
        return F.struct(
            F.lower(F.regexp_extract(text, _GRAMMAR, 1)).alias("scheme"),
            F.when(one_bracket, F.lit("")).otherwise(host).alias("host"),
            one_bracket.alias("one_bracket"),
            F.regexp_replace(F.regexp_extract(text, _GRAMMAR, 3), ";[^/]*$", "").alias("path"),
            F.regexp_extract(text, _GRAMMAR, 4).alias("query"),
        )

    return let(_clean(col), lambda text: let(parts(text), body))


def url_scheme(col: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(col), _GRAMMAR, 1))


def url_netloc(col: Column) -> Column:
    """Network location; a lone bracket makes a URL unparseable, shown here as no location."""
    return _parsed(col, lambda p: p["host"])


def url_path(col: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(_clean(col), _GRAMMAR, 3), ";[^/]*$", "")


def strip_at(col: Column) -> Column:
    return F.regexp_replace(col, "^@+", "")


def _has_host(p: Column) -> Column:
    return (p["scheme"] != "") & (p["host"] != "")


def _valid(p: Column) -> Column:
    return _has_host(p) & ~p["path"].rlike(BROKEN_PATH) & ~p["query"].rlike(BROKEN_QUERY)


def is_valid_url(col: Column) -> Column:
    """Scheme and host present, no field id or long hex run in the path, no ``p=<n>`` in the query."""
    return _parsed(col, _valid)


def _root(col: Column, p: Column, path: str) -> Column:
    root = F.concat(p["scheme"], F.lit("://"), p["host"], F.lit(path))
    return F.when((F.coalesce(col, F.lit("")) == "") | p["one_bracket"], F.lit("")).otherwise(root)


def base_url(col: Column) -> Column:
    return _parsed(col, lambda p: _root(col, p, "/"))


def contact_url(col: Column) -> Column:
    return _parsed(col, lambda p: _root(col, p, CONTACT_PATH))


def fix_url(col: Column, fallback: Column | None = None) -> Column:
    """The URL if valid, else its contact page, else the fallback if valid, else empty.

    The contact page of a URL is valid exactly when the URL has a scheme and a
    host, and so is its base URL, so the base URL never gets a turn of its own.
    """
    spare = F.coalesce(fallback, F.lit("")) if fallback is not None else F.lit("")
    last = F.lit("") if fallback is None else F.when(is_valid_url(spare), spare).otherwise(F.lit(""))

    def fixed(p: Column) -> Column:
        return F.when(_valid(p), strip_at(col)).when(_has_host(p), _root(col, p, CONTACT_PATH)).otherwise(last)

    return F.when(F.coalesce(col, F.lit("")) == "", spare).otherwise(_parsed(col, fixed))


def slug_url(site: Column, slug: Column) -> Column:
    """Site URL joined with a slug; the contact page for missing, corrupted or invalid slugs.

    Slashes are trimmed off the slug, so it is either absolute (kept as is) or
    appended to the site.  Dot segments are kept as written.
    """
    with_slash = F.when(F.endswith(site, F.lit("/")), site).otherwise(F.concat(site, F.lit("/")))
    bare = F.regexp_replace(slug, "^/+|/+$", "")
    joined = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), bare).otherwise(F.concat(with_slash, bare))
    good = (F.coalesce(slug, F.lit("")) != "") & ~slug.rlike(BROKEN_PATH)
    made = let(joined, lambda j: F.when(is_valid_url(j), j))
    return F.when(F.coalesce(site, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(F.when(good, made), contact_url(site)))


def title_from_url(url: Column, title: Column | None = None) -> Column:
    """Given title, else the last path segment as words in title case, else the host."""
    from parley.functions.text import title_case

    path = url_path(url)
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    words = title_case(F.translate(last, "-_", "  "))
    made = F.when((path == "") | (path == "/"), url_netloc(url)).otherwise(words)
    return made if title is None else F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(made)


def fix_url_array(urls: Column, fallback: Column | None = None) -> Column:
    """Repair every URL of an array of strings."""
    return F.transform(urls, lambda u: fix_url(u, fallback))


def fix_url_records(records: Column, fallback: Column | None = None) -> Column:
    """Repair the ``url`` field of every struct of an array; other fields stay."""
    return F.transform(records, lambda r: r.withField("url", fix_url(r["url"], fallback)))


def fix_urls(df, cols: list[str], fallback: Column | None = None):
    """Repair URL columns of a DataFrame in one projection."""
    return df.withColumns({c: fix_url(F.col(c), fallback) for c in cols})
