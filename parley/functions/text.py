"""Text scalars: cleaning, casing, truncation, labels and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
TRUNCATION_MARKER = "\n...[content truncated]...\n"
EMBED_MAX_CHARS = 28_000
RETRY_HEAD_CHARS = 5_000
RETRY_TAIL_CHARS = 1_000
SNIPPET_CHARS = 200
GENERIC_BRAND = "this organisation"
GENERIC_ASSISTANT = "Assistant"
ASSET_MARKER = "/api/assets/"
VISITOR_ID_MAX = 64


# White space as Unicode-aware text tools see it; a plain \\s is ASCII.
SPACE_CLASS = r"(?U)[\s\x1c-\x1f]"
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(col: Column) -> Column:
    """Remove leading and trailing white space of any script (``trim`` alone drops spaces only)."""
    return F.btrim(col, F.lit(SPACE))


def _collapse(col: Column, unicode: bool = True) -> Column:
    """White-space runs to one space."""
    return F.regexp_replace(col, f"{SPACE_CLASS}+" if unicode else r"\s+", " ")


def _blank_spans(col: Column, opening: str, closing: str) -> Column:
    """Spans from ``opening`` to the next ``closing``, with something between, to one space.

    Only the text up to the last ``closing`` is searched: after it no span can
    end, and looking for one from every ``opening`` there takes quadratic time.
    """
    tail = F.substring_index(col, closing, -1)
    head = F.left(col, F.length(col) - F.length(tail))
    return F.concat(F.regexp_replace(head, f"{opening}[^{closing}]+{closing}", " "), tail)


def squash_ws(col: Column, unicode: bool = True) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.trim(_collapse(col, unicode))


def strip_html(col: Column, unicode: bool = True) -> Column:
    """Tags to space, white-space runs to one space, entities to space, trim, in this order.

    Entities go last, so doubled spaces may remain and a bare ``&`` swallows the
    text up to the next ``;``.
    """
    one_space = _collapse(_blank_spans(col, "<", ">"), unicode)
    return strip_ws(_blank_spans(one_space, "&", ";"))


def blank_to_null(col: Column) -> Column:
    """White-space-only text becomes NULL; other text is trimmed."""
    return F.nullif(strip_ws(col), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor the empty string (untrimmed)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def title_case(col: Column) -> Column:
    """Upper-case the first letter after every non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def truncate_head_tail(col: Column, max_chars: int | Column, marker: str = TRUNCATION_MARKER) -> Column:
    """Keep the first 80 % and the last 20 % of ``max_chars`` around ``marker`` when longer."""
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    head = F.floor(limit.cast("double") * F.lit(0.8)).cast("int")
    tail = limit.cast("int") - head
    cut = F.concat(F.left(col, head), F.lit(marker), F.right(col, tail))
    return F.when(F.length(col) <= limit, col).otherwise(cut)


def truncate_fixed(col: Column, head: int = RETRY_HEAD_CHARS, tail: int = RETRY_TAIL_CHARS, marker: str = "...") -> Column:
    """The second, harder cut used after a context-length error: applied above ``head`` characters."""
    cut = F.concat(F.left(col, F.lit(head)), F.lit(marker), F.right(col, F.lit(tail)))
    return F.when(F.length(col) > head, cut).otherwise(col)


def embedding_text(title: Column, content: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), content)


def norm_email(col: Column) -> Column:
    """Trimmed, lower-cased e-mail; NULL counts as blank."""
    return F.lower(strip_ws(F.coalesce(col, F.lit(""))))


def norm_trigger(col: Column) -> Column:
    """Quick-reply trigger key: trimmed and lower-cased."""
    return F.lower(strip_ws(F.coalesce(col, F.lit(""))))


def norm_trigger_text(col: Column) -> Column:
    """Classifier text: lower case, hyphen and white-space runs to one space, trimmed."""
    return strip_ws(F.regexp_replace(F.lower(col), r"(?U)[-\s\x1c-\x1f]+", " "))


def valid_visitor_id(col: Column) -> Column:
    """Trimmed visitor id, or NULL when blank or longer than 64 characters."""
    trimmed = blank_to_null(col)
    return F.when(F.length(trimmed) <= VISITOR_ID_MAX, trimmed)


def asset_path(col: Column) -> Column:
    """Cut everything before the asset path marker; blank becomes NULL."""
    trimmed = blank_to_null(col)
    at = F.instr(trimmed, ASSET_MARKER)
    return F.when(at > 0, F.substring(trimmed, at, F.length(trimmed))).otherwise(trimmed)


def brand_label(brand: Column, name: Column) -> Column:
    """Brand, else tenant name, else a generic text; a chosen value that trims to nothing is generic."""
    return F.coalesce(blank_to_null(first_filled(brand, name)), F.lit(GENERIC_BRAND))


def assistant_label(header: Column, brand: Column, name: Column) -> Column:
    return F.coalesce(blank_to_null(first_filled(header, brand, name)), F.lit(GENERIC_ASSISTANT))


def render_template(template: Column, brand: Column, name: Column, header: Column, website: Column) -> Column:
    """Fill the three reply placeholders in one left-to-right pass.

    Splitting at the placeholders first keeps a value that itself looks like a
    placeholder from being replaced again.
    """
    values = F.create_map(
        F.lit("${brand_name}"), brand_label(brand, name),
        F.lit("${assistant_name}"), assistant_label(header, brand, name),
        F.lit("${website_url}"), F.coalesce(strip_ws(website), F.lit("")),
    )
    pattern = r"\$\{(?:brand_name|assistant_name|website_url)\}"
    literals = F.split(template, pattern)
    marks = F.regexp_extract_all(template, F.lit(f"({pattern})"), 1)
    filled = F.transform(marks, lambda m: values[m])
    pieces = F.zip_with(literals, filled, lambda text, value: F.concat(text, F.coalesce(value, F.lit(""))))
    return F.coalesce(F.array_join(pieces, ""), F.lit(""))


def snippet(col: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.concat(F.left(col, F.lit(chars)), F.lit("..."))


def confidence_pct(col: Column) -> Column:
    """Browser rounding: half up."""
    return F.floor(col * 100 + F.lit(0.5))


def slugify(col: Column) -> Column:
    """Lower case, every run outside a-z and 0-9 to ``-``, no edge dashes, never empty."""
    dashed = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("tenant"))


def month_start(ts: Column) -> Column:
    return F.date_trunc("MONTH", ts).cast("timestamp_ntz")


def next_month_start(ts: Column) -> Column:
    return F.add_months(F.date_trunc("MONTH", ts).cast("date"), 1).cast("timestamp_ntz")
