"""Search in chat sessions and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ilike_pattern(term: str) -> str:
    """``%term%`` with the wildcards of the term left active.

    A backslash makes the next character literal.  Spark accepts that only
    before ``%``, ``_`` and itself, so it is dropped before anything else.
    """
    source, out = f"%{term}%", []
    i = 0
    while i < len(source):
        if source[i] == "\\" and i + 1 < len(source):
            out.append(source[i : i + 2] if source[i + 1] in "%_\\" else source[i + 1])
            i += 2
        else:
            out.append(source[i])
            i += 1
    return "".join(out)


def _hits(terms: list[str], test) -> Column:
    return F.array_compact(F.array(*[F.when(test(t), F.lit(t)) for t in terms]))


def search_sessions(sessions: DataFrame, messages: DataFrame, terms: list[str]) -> DataFrame:
    """Sessions each term is found in: title, id, visitor name or e-mail, or any message text.

    All terms are tested in one pass over each table.  Wildcards of a term work
    in message text and are literal elsewhere.  Per session the messages shrink
    to the set of terms found before the join.
    """
    in_text = _hits(terms, lambda t: F.col("content").ilike(ilike_pattern(t)))
    found = (
        messages.select("session_id", F.explode(in_text).alias("term"))
        .groupBy("session_id")
        .agg(F.collect_set("term").alias("_in_text"))
    )
    holds = lambda c, t: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t.lower()))
    own = _hits(
        terms,
        lambda t: holds(F.col("title"), t)
        | F.contains(F.col("session_id").cast("string"), F.lit(t.lower()))
        | holds(F.col("visitor_name"), t)
        | holds(F.col("visitor_email"), t),
    )
    both = F.array_union(own, F.coalesce("_in_text", F.array().cast("array<string>")))
    return sessions.join(found, "session_id", "left").withColumn("term", F.explode(both)).drop("_in_text")
