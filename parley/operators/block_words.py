"""Block-word policy: exact, substring and regex rules per tenant."""

from __future__ import annotations

import functools
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text

#: Syntax that Java and Python read alike under the flags below.
_COMMON_SYNTAX = re.compile(
    r"""(?:
        [^\\\[\](){}.*+?^$|\#&~-]            # plain character
      | \\[dDwWsSbB.\[\](){}*+?^$|\\/-]      # class escape or escaped punctuation
      | \[\^?(?:[^\\\[\]&~|-]|[a-zA-Z0-9]-[a-zA-Z0-9]|\\[dDwWsS.\-\]\[\\])+\]
      | \((?:\?:|(?!\?)) | \)
      | [.*+?|^$\#&~-]
      | \{[0-9]+(?:,[0-9]*)?\}
    )*""",
    re.X,
)

#: Ignore case, Unicode case and classes, and only ``\n`` ends a line.
JVM_FLAGS = "(?iudU)"


def _compile(pattern: str) -> re.Pattern | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return re.compile(pattern, re.IGNORECASE)
    except (re.error, RecursionError, OverflowError):
        return None


@F.pandas_udf(T.StringType())
def regex_engine(patterns: pd.Series) -> pd.Series:
    """``jvm`` for patterns both languages share, ``python`` for the rest, NULL for invalid ones."""

    def engine(pattern):
        if pattern is None or _compile(pattern) is None:
            return None
        return "jvm" if _COMMON_SYNTAX.fullmatch(pattern) else "python"

    return pd.Series([engine(p) for p in patterns], dtype=object)


@F.pandas_udf(T.BooleanType())
def _python_search(messages: pd.Series, patterns: pd.Series) -> pd.Series:
    compiled = {p: _compile(p) for p in set(patterns)}
    return pd.Series([bool(compiled[p].search(m)) for m, p in zip(messages, patterns)], dtype=bool)


def match_block_words(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """First rule per message that matches, by category order, then word order.

    * exact: hash join on (tenant, lower-cased text), after texts longer than
      every exact word have left;
    * substring and regex: one join on the tenant with the tests as a residual,
      so only hits leave it;
    * regexes in syntax that only Python has: Arrow batches, in a branch that
      AQE drops when there are none.  An invalid regex never matches.

    Regex rules see the trimmed text in its own case, ignoring case; the other
    modes compare lower-cased.
    """
    trimmed = text.strip_ws(F.coalesce("content", F.lit("")))
    texts = messages.select("message_id", "tenant_id", trimmed.alias("body")).withColumn("lowered", F.lower("body"))
    words = rules.withColumn("word", text.strip_ws(F.coalesce("word", F.lit("")))).where(F.col("word") != "")
    words = words.select("tenant_id", "category_ord", "category", "match_mode", "word_ord", "word", "response_message")

    exact = words.where(F.col("match_mode") == "exact").withColumn("lowered", F.lower("word"))
    longest = exact.agg(F.coalesce(F.max(F.length("lowered")), F.lit(0))).scalar()
    equal = texts.where(F.length("lowered") <= longest).join(exact, ["tenant_id", "lowered"])

    is_regex = F.col("match_mode") == "regex"
    spoken = words.where(F.col("match_mode").isin("substring", "regex")).withColumn(
        "engine", regex_engine(F.when(is_regex, F.col("word")))
    )
    needle = F.when(F.col("match_mode") == "substring", F.lower("word"))
    # the pattern depends on the verdict, so no plan can compile an unchecked one
    pattern = F.when(F.col("engine") == "jvm", F.concat(F.lit(JVM_FLAGS), F.col("word")))
    in_jvm = spoken.withColumns({"needle": needle, "pattern": pattern}).where(
        F.col("needle").isNotNull() | F.col("pattern").isNotNull()
    )
    hit = F.coalesce(F.contains("lowered", "needle"), F.lit(False)) | F.coalesce(F.rlike("body", F.col("pattern")), F.lit(False))
    searched = texts.join(in_jvm, "tenant_id").where(hit)
    in_python = spoken.where(F.col("engine") == "python")
    walked = texts.join(in_python, "tenant_id").where(_python_search("body", "word"))

    found = ["message_id", "tenant_id", "category_ord", "word_ord", "category", "match_mode", "word", "response_message"]
    hits = functools.reduce(
        DataFrame.unionByName, [part.select(*found) for part in (equal, searched, walked)]
    )
    first = hits.groupBy("message_id", "tenant_id").agg(
        F.min(F.struct("category_ord", "word_ord", "category", "match_mode", "word", "response_message")).alias("f")
    )
    return first.select(
        "message_id", "tenant_id", "f.category", "f.match_mode", F.col("f.word").alias("matched_word"), "f.response_message"
    )
