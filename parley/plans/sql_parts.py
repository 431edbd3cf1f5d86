"""DuckDB text for the scalars that several checks share."""

from __future__ import annotations

_URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def clean(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^@+', '')"


def part(c: str, group: int) -> str:
    return f"regexp_extract({clean(c)}, '{_URI}', {group})"


def scheme(c: str) -> str:
    return f"lower({part(c, 1)})"


def host(c: str) -> str:
    return part(c, 2)


def path(c: str) -> str:
    return f"regexp_replace({part(c, 3)}, ';[^/]*$', '')"


def has_host(c: str) -> str:
    return f"({scheme(c)} <> '' and {host(c)} <> '')"


def valid(c: str) -> str:
    return (
        f"({has_host(c)} and not regexp_matches({path(c)}, 'field_[a-f0-9]+|[a-f0-9]{{13,}}|_[0-9a-f]{{8,}}') "
        f"and not regexp_matches({part(c, 4)}, '\\bp=[0-9]+'))"
    )


def root(c: str, tail: str) -> str:
    return f"case when coalesce({c}, '') = '' then '' else concat({scheme(c)}, '://', {host(c)}, '{tail}') end"


def fixed(c: str, fallback: str = "''") -> str:
    return (
        f"case when coalesce({c}, '') = '' then {fallback} when {valid(c)} then {clean(c)} "
        f"when {has_host(c)} then {root(c, '/contact-us/')} when {valid(fallback)} then {fallback} else '' end"
    )


def slug(site: str, name: str) -> str:
    full = f"concat(rtrim({site}, '/'), '/', trim({name}, '/'))"
    return (
        f"case when coalesce({name}, '') = '' or regexp_matches({name}, 'field_[a-f0-9]+|[a-f0-9]{{13,}}|_[0-9a-f]{{8,}}') "
        f"or not {valid(full)} then {root(site, '/contact-us/')} else {full} end"
    )


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def filled(c: str) -> str:
    return f"nullif({strip(c)}, '')"


def strip_html(c: str) -> str:
    tags = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    spaces = f"regexp_replace({tags}, '\\s+', ' ', 'g')"
    return strip(f"regexp_replace({spaces}, '&[^;]+;', ' ', 'g')")


def uuid5(c: str) -> str:
    digest = f"sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({c}))"
    return (
        f"(select concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', "
        f"translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab'), h[18:20], '-', h[21:32]) from (select {digest} as h))"
    )


def cut(c: str, n: int, marker: str) -> str:
    head = int(n * 0.8)
    return f"case when length({c}) <= {n} then {c} else concat(left({c}, {head}), {marker}, right({c}, {n - head})) end"


def brand(brand_name: str, name: str) -> str:
    return f"coalesce({filled(f'''coalesce(nullif({brand_name}, ''), {name})''')}, 'this organisation')"


SITES = """
select t.tenant_id, coalesce(case when o.v like '%/' then o.v else o.v || '/' end, 'https://default.example.com/') as site_url
from b_tenants t left join (
  select tenant_id, arg_min(option_value, option_id) as v from b_options where option_name = 'siteurl' group by 1) o using (tenant_id)
"""

TAGS = f"""
select tenant_id, coalesce({filled('widget_source_type')}, 'primary') as source_type,
  coalesce({filled("coalesce(nullif(brand_name, ''), name)")}, 'website') as source_label, {filled('widget_website_url')} as fallback_url
from b_tenants
"""
