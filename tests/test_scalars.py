"""Column functions against small models in plain Python."""

import ipaddress
import random
import re
import uuid
from difflib import SequenceMatcher
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from parley.functions import html, ids, net, text, urls
from parley.operators import quick_replies
from parley.operators.search import ilike_pattern
from parley.sources import cms

URLS = [
    "", None, "https://a.example.com", "HTTPS://A.example.com/x", "@@https://a.example.com/x", "www.a.example.com/x", "ftp://a/b",
    "https://a.example.com/?p=12", "https://a.example.com/?xp=12", "https://a.example.com/?q=1&p=9", "https://a.example.com/?p=x",
    "https://a.example.com/field_6846a4", "https://a.example.com/field_zz", "https://a.example.com/x/0123456789abc",
    "https://a.example.com/x/0123456789ab", "https://a.example.com/x_deadbeef", "https://a.example.com/x_deadbee",
    "https://a.example.com/ok;field_ab", "https://a.example.com/a;b/field_ab", "http://[::1/x", "http://[::1]/x", "//host/path",
    "http:///path", "1http://x/y", " https://a.example.com/x", "mailto:someone", "not a url", "https://a b/c", "https://a.example.com#p=1",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def collect(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def model_valid(url):
    if not url:
        return False
    try:
        parts = urlparse(url.lstrip("@"))
    except ValueError:
        return False
    if not parts.scheme or not parts.netloc:
        return False
    if re.search(r"field_[a-f0-9]+|[a-f0-9]{13,}|_[0-9a-f]{8,}", parts.path):
        return False
    return not re.search(r"\bp=\d+", parts.query)


def model_root(url, tail):
    if not url:
        return ""
    try:
        parts = urlparse(url.lstrip("@"))
    except ValueError:
        return ""
    return f"{parts.scheme}://{parts.netloc}{tail}"


def model_fix(url, spare):
    if not url:
        return spare or ""
    clean = url.lstrip("@")
    for candidate in (clean, model_root(clean, "/contact-us/"), model_root(clean, "/")):
        if model_valid(candidate):
            return candidate
    return spare if model_valid(spare) else ""


def test_urls(spark):
    df = column(spark, URLS)
    v = F.col("v")
    assert collect(df, urls.is_valid_url(v)) == [model_valid(u) for u in URLS]
    assert collect(df, urls.base_url(v)) == [model_root(u, "/") for u in URLS]
    assert collect(df, urls.contact_url(v)) == [model_root(u, "/contact-us/") for u in URLS]
    for spare in ("https://spare.example.com/", "nonsense", None):
        assert collect(df, urls.fix_url(v, F.lit(spare))) == [model_fix(u, spare) for u in URLS]


def test_url_slug(spark):
    cases = [
        ("https://s.example.com", "a-b", "https://s.example.com/a-b"),
        ("https://s.example.com/", "/a/b/", "https://s.example.com/a/b"),
        ("https://s.example.com/sub/", "x", "https://s.example.com/sub/x"),
        ("https://s.example.com", "", "https://s.example.com/contact-us/"),
        ("https://s.example.com", None, "https://s.example.com/contact-us/"),
        ("https://s.example.com", "field_12ab", "https://s.example.com/contact-us/"),
        ("https://s.example.com", "?p=4", "https://s.example.com/contact-us/"),
        ("https://s.example.com", "https://o.example.com/z", "https://o.example.com/z"),
        ("https://s.example.com", "mailto:x", "https://s.example.com/contact-us/"),
        ("", "a", ""),
        (None, None, ""),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, site string, slug string, want string")
    got = collect(df, urls.slug_url(F.col("site"), F.col("slug")))
    assert got == [c[2] for c in cases]


def test_titles(spark):
    values = ["https://h.example.com/my-first_post/", "https://h.example.com/474.html", "https://h.example.com/", "https://h.example.com", "https://h.example.com/don't-STOP"]

    def model(url):
        parts = urlparse(url)
        if parts.path and parts.path != "/":
            return parts.path.rstrip("/").split("/")[-1].replace("-", " ").replace("_", " ").title()
        return parts.netloc

    df = column(spark, values)
    assert collect(df, urls.title_from_url(F.col("v"))) == [model(u) for u in values]
    assert collect(df, urls.title_from_url(F.col("v"), F.lit("Given")))[0] == "Given"
    assert collect(df, urls.title_from_url(F.col("v"), F.lit("")))[1] == "474.Html"


def test_ids(spark):
    names = ["wp_1", "https://a.example.com/é", ""]
    assert collect(column(spark, names), ids.uuid5(F.col("v"))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_text_cleaning(spark):
    values = ["<p>a  b</p>\n<b>c</b> &amp; d", "x & y; z", "  ", "<a href='x'>", "a < b > c", "Tom &nbsp;&nbsp; Jerry"]

    def model(body):
        body = re.sub(r"<[^>]+>", " ", body)
        body = re.sub(r"\s+", " ", body)
        return re.sub(r"&[^;]+;", " ", body).strip()

    assert collect(column(spark, values), text.strip_html(F.col("v"))) == [model(v) for v in values]


@pytest.mark.parametrize("limit", [1, 2, 10, 37])
def test_truncation(spark, limit):
    values = ["", "a" * limit, "0123456789" * 5, "é" * (limit + 1)]

    def model(body):
        if len(body) <= limit:
            return body
        head = int(limit * 0.8)
        return body[:head] + text.TRUNCATION_MARKER + body[-(limit - head):]

    got = collect(column(spark, values), text.truncate_head_tail(F.col("v"), limit))
    assert got == [model(v) for v in values]
    assert all(len(g) <= limit + len(text.TRUNCATION_MARKER) for g in got)


def test_labels_and_templates(spark):
    assert text.TRUNCATION_MARKER.count("\n") == 2 and len(text.TRUNCATION_MARKER) == 27
    rows = [
        ("Acme", "Acme Inc", "Helper Bot", "https://acme.example"),
        ("", "Acme Inc", "", None),
        (None, None, None, "  "),
        (" ", "Acme Inc", " ", ""),
        ("${website_url}", "n", "h", "w"),
    ]
    template = "Hi from ${assistant_name} - ${brand_name} - ${website_url} ${other}"
    df = spark.createDataFrame([(i, *r, template) for i, r in enumerate(rows)], "i int, b string, n string, h string, w string, t string")
    cols = [F.col(c) for c in ("b", "n", "h", "w")]
    got = collect(df, text.render_template(F.col("t"), *cols))
    assert got == [
        "Hi from Helper Bot - Acme - https://acme.example ${other}",
        "Hi from Acme Inc - Acme Inc -  ${other}",
        "Hi from Assistant - this organisation -  ${other}",
        "Hi from Assistant - this organisation -  ${other}",
        "Hi from h - ${website_url} - w ${other}",
    ]
    assert collect(df, text.brand_label(F.col("b"), F.col("n"))) == ["Acme", "Acme Inc", "this organisation", "this organisation", "${website_url}"]
    assert collect(df.withColumn("t", F.lit(None).cast("string")), text.render_template(F.col("t"), *cols))[0] == ""


def test_small_normalizers(spark):
    df = column(spark, ["  Hello ", None, "\tA@B.c\n", "x" * 65, "x" * 64])
    v = F.col("v")
    assert collect(df, text.norm_trigger(v))[:3] == ["hello", "", "a@b.c"]
    assert collect(df, text.norm_email(v))[2] == "a@b.c"
    assert collect(df, text.valid_visitor_id(v))[1:] == [None, "A@B.c", None, "x" * 64]
    assert collect(column(spark, ["Self-Hosted   Shop -- now"]), text.norm_trigger_text(v)) == ["self hosted shop now"]
    assert collect(column(spark, [0.005, 0.125, 0.995], "double"), text.confidence_pct(v)) == [1, 13, 100]
    assert collect(column(spark, ["https://c/api/assets/x.png", "/a.png", " ", None]), text.asset_path(v)) == ["/api/assets/x.png", "/a.png", None, None]
    assert collect(column(spark, ["Acme & Co.", "--", "É1"]), text.slugify(v)) == ["acme-co", "tenant", "1"]


def test_ipv6_texts(spark):
    """Canonical text and sort key of many forms beside the standard library, without Python in the plan."""
    rng = random.Random(1)
    values = [
        "::", "::1", "1::", "1:0:0:2:0:0:0:3", "::1.2.3.4", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
        "g::1", "12345::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
        ":::", "::1.2.3.256", "64:ff9b::192.0.2.33", "0:0:1:0:0:1:0:0", "::ffff:0:0",
    ]
    for _ in range(150):
        parts = [rng.choice(["0", "0", "0", f"{rng.randrange(65536):x}", f"{rng.randrange(256):04X}"]) for _ in range(8)]
        i = rng.randrange(7)
        j = rng.randrange(i, 8)
        values.append(":".join(parts) if rng.random() < 0.6 else ":".join(parts[:i]) + "::" + ":".join(parts[j + 1 :]))

    def parsed(value):
        try:
            return ipaddress.ip_address(value)
        except ValueError:
            return None

    df = column(spark, values)
    shown = net.canonical_ip(F.col("v"))
    assert collect(df, shown) == [None if parsed(v) is None else str(parsed(v)) for v in values]
    assert collect(df, net.ipv6_key(F.col("v"))) == [None if parsed(v) is None else f"{int(parsed(v)):032x}" for v in values]
    assert "Python" not in df.select(shown)._jdf.queryExecution().executedPlan().toString()


def test_ip(spark):
    values = ["1.2.3.4", "01.2.3.4", "1.2.3", "256.1.1.1", "2001:DB8::0:1", "::ffff:1.2.3.4", "x", None, ""]

    def model(value):
        try:
            return str(ipaddress.ip_address(value))
        except ValueError:
            return None

    df = column(spark, values)
    assert collect(df, net.canonical_ip(F.col("v"))) == [model(v) for v in values]
    assert collect(df, net.ipv4_number(F.col("v")))[:2] == [16909060, None]
    rows = [(0, " 1.2.3.4 , 5.6.7.8", "9.9.9.9"), (1, "unknown", "2001:db8:0::1"), (2, None, "socket"), (3, "", None)]
    pairs = spark.createDataFrame(rows, "i int, f string, p string")
    assert collect(pairs, net.client_ip(F.col("f"), F.col("p"))) == ["1.2.3.4", "2001:db8::1", "socket", None]


def test_dsn(spark):
    dsns = [None, "", "mysql://u:p%40w@DB.example.com:3307/cms", "mysql://h/db", "mysql://u@h:0/db", "mysql://u:a+b%2Fc@[::1]:9/x", "mysql://a@b:c@h/d"]

    def model(dsn):
        if not dsn:
            return (None,) * 5
        p = urlparse(dsn)
        return (
            p.hostname or "", p.port or 3306, p.path.lstrip("/"),
            unquote(p.username) if p.username else None, unquote(p.password) if p.password else None,
        )

    df = column(spark, dsns).withColumns({"source_table_prefix": F.lit("p_"), "source_url_table": F.lit("u")})
    rows = cms.parse_dsn(df, "v").orderBy("i").collect()
    assert [(r.host, r.port, r.database, r.user, r.password) for r in rows] == [model(d) for d in dsns]
    assert {(r.table_prefix, r.url_table) for r in rows} == {("p_", "u")}


def test_similarity_matches_difflib_and_bound_is_safe(spark):
    words = ["hello", "helo", "hallo", "thank you", "thanks", "thank  you", "good morning", "morning good", "h", "", "aaaa", "abab"]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")

    def model(a, b):
        if a == b:
            return 100
        return int(round(100 * SequenceMatcher(None, a, b).ratio())) if a and b else 0

    got = collect(df, quick_replies.similarity_ratio(F.col("a"), F.col("b")))
    assert got == [model(a, b) for a, b in pairs]
    for threshold in (50, 67, 85, 95, 100):
        kept = collect(df, quick_replies.may_reach(F.col("a"), F.col("b"), F.lit(threshold)))
        assert all(k for k, score in zip(kept, got) if score >= threshold)


def test_ilike_pattern():
    assert ilike_pattern("a_b") == "%a_b%"
    assert ilike_pattern(r"50\%") == r"%50\%%"
    assert ilike_pattern(r"a\b") == "%ab%"
    assert ilike_pattern("end\\") == "%end\\%"


def test_page_texts():
    page = (
        "<html><head><title>T</title><style>s</style></head><body><nav>menu</nav><main>m1<article>a1<b>b</b><br>a2</article>m2</main>"
        "<footer>f</footer>&amp;<script>x()</script></body></html>"
    )
    full, main = html.page_texts(page)
    assert full == "Tmenum1a1ba2m2f&"
    assert main == "a1ba2"
    assert html.page_texts("<body>a<nav>n<p>x</nav>b<aside>c</aside></body>tail")[1] == "ab"
    assert html.page_texts("<main>one</main><main>two</main>")[1] == "one"
    assert html.page_texts("plain &lt; text")[1] == "plain < text"
    assert html.page_texts(None) == ("", "")
    assert html.page_texts("<article>a</p>b</article>c")[1] == "ab"


def test_page_text_length_rule(spark):
    long_page = "<nav>" + "n" * 290 + "</nav><article>short text</article> tail"
    rows = [(0, long_page), (1, long_page.replace("n" * 290, "n")), (2, "<p>  </p>")]
    got = html.page_text(spark.createDataFrame(rows, "i int, html string")).orderBy("i").collect()
    assert got[0].content.startswith("nnn") and got[0].content.endswith("tail")
    assert got[1].content == "short text"
    assert got[2].content == ""
