"""Trigger classifier: exact phrases, variations, keyword combinations.

A trigger set is code, not data: a few categories of phrases.  It compiles to
column expressions, so classifying is one projection without join or shuffle.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.bind import let
from parley.functions.text import norm_trigger_text
from parley.sources.events import to_chat_events

# Scores of the three strategies
EXACT_CONFIDENCE = 1.0
WHOLE_CONFIDENCE = 0.9
LOOSE_BASE, LOOSE_SPAN = 0.7, 0.2
COVERAGE_WEIGHT, PROXIMITY_WEIGHT = 0.6, 0.4
KEYWORD_MIN, KEYWORD_CAP, SPECIAL_CONFIDENCE = 0.5, 0.8, 0.95
MIN_KEYWORDS = MIN_WORDS = 2

_MATCH = "struct<phrase: string, confidence: double>"
_WORD_CHAR = "[A-Za-z0-9_]"


@dataclass(frozen=True)
class Category:
    name: str
    priority: int
    min_confidence: float
    exact: tuple[str, ...] = ()
    variations: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    title: str = ""
    message: str = ""
    buttons: tuple[dict, ...] = field(default=(), hash=False)


@dataclass(frozen=True)
class TriggerSet:
    """Categories plus the shared lists.

    ``benign`` phrases suppress a text unless a ``modifiers`` word occurs.
    A text with ``special_word`` and one of ``special_modifiers`` is a sure
    keyword match in every category.
    """

    categories: tuple[Category, ...]
    benign: tuple[str, ...] = ()
    modifiers: tuple[str, ...] = ()
    special_word: str | None = None
    special_modifiers: tuple[str, ...] = ()


def _norm(phrase: str) -> str:
    return re.sub(r"[-\s]+", " ", phrase.lower()).strip()


def _on_boundaries(text: Column, phrase: str) -> Column:
    """The phrase occurs with an ASCII word boundary at both ends."""
    if not phrase:
        return F.lit(False)
    before = f"(?<!{_WORD_CHAR})" if re.match(_WORD_CHAR, phrase[0]) else f"(?<={_WORD_CHAR})"
    after = f"(?!{_WORD_CHAR})" if re.match(_WORD_CHAR, phrase[-1]) else f"(?={_WORD_CHAR})"
    quoted = re.sub(r"([^\w\s])", r"\\\1", phrase, flags=re.ASCII) if phrase.isascii() else re.escape(phrase)
    return F.contains(text, F.lit(phrase)) & text.rlike(f"{before}{quoted}{after}")


def _match(phrase, confidence) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(phrase).alias("phrase"), as_col(confidence).cast("double").alias("confidence"))


def _first(cases: list[tuple[Column, Column]]) -> Column:
    if not cases:
        return F.lit(None).cast(_MATCH)
    chain = F
    for test, value in cases:
        chain = chain.when(test, value)
    return chain


def exact_match(text: Column, phrases: tuple[str, ...]) -> Column:
    """First phrase on word boundaries; confidence 1."""
    return _first([(_on_boundaries(text, _norm(p)), _match(p, EXACT_CONFIDENCE)) for p in phrases])


def _loose(text: Column, words: list[str]) -> tuple[Column, Column]:
    """All words occur somewhere; nearer first occurrences score higher."""
    found = functools.reduce(Column.__and__, [F.contains(text, F.lit(w)) for w in words])
    at = [F.instr(text, w) for w in words]
    steps = functools.reduce(Column.__add__, [F.abs(b - a) for a, b in zip(at, at[1:])])
    proximity = F.greatest(F.lit(0.0), F.lit(1.0) - steps / F.lit(float(len(words) - 1)) / F.length(text))
    return found, F.lit(LOOSE_BASE) + proximity * F.lit(LOOSE_SPAN)


def variation_match(text: Column, variations: tuple[str, ...]) -> Column:
    """First variation that occurs whole (0.9) or word by word (0.7 to 0.9)."""
    cases = []
    for variation in variations:
        phrase = _norm(variation)
        cases.append((_on_boundaries(text, phrase), _match(variation, WHOLE_CONFIDENCE)))
        words = phrase.split()
        if len(words) >= 2:
            found, confidence = _loose(text, words)
            cases.append((found, _match(variation, confidence)))
    return _first(cases)


def keyword_match(text: Column, words: Column, keywords: tuple[str, ...], special_word: str | None = None, special_modifiers: tuple[str, ...] = ()) -> Column:
    """Keyword combination: struct(matched, phrase, confidence).

    A keyword hits the first word that contains it or is contained in it.  At
    least two hits; 0.6 x share of keywords + 0.4 x nearness, matched from 0.5,
    reported up to 0.8.
    """
    distinct = list(dict.fromkeys(keywords))
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(_norm(k)).alias("needle")) for k in distinct])
    at = lambda k: F.array_position(
        F.transform(words, lambda w: F.contains(w, k["needle"]) | F.contains(k["needle"], w)), True
    )
    hits = (
        F.filter(F.transform(pairs, lambda k: F.struct(k["keyword"].alias("keyword"), (at(k) - 1).alias("at"))), lambda h: h["at"] >= 0)
        if distinct
        else F.array().cast("array<struct<keyword: string, at: bigint>>")
    )
    usual = let(hits, lambda found: _keyword_score(found, F.size(words), len(keywords)))
    if not special_word or not special_modifiers:
        return usual
    special = F.contains(text, F.lit(special_word)) & functools.reduce(
        Column.__or__, [F.contains(text, F.lit(m)) for m in special_modifiers]
    )
    names = F.transform(hits, lambda h: h["keyword"])
    all_names = F.array_join(F.array_union(names, F.array(F.lit(special_word))), ", ")
    sure = F.struct(F.lit(True).alias("matched"), all_names.alias("phrase"), F.lit(SPECIAL_CONFIDENCE).alias("confidence"))
    return F.when(special, sure).otherwise(usual)


def _keyword_score(found: Column, n_words: Column, n_keywords: int) -> Column:
    n = F.size(found)
    # over sorted places every pairwise distance adds up to sum of place * (2i - n + 1)
    places = F.array_sort(F.transform(found, lambda h: h["at"]))
    weighted = F.transform(places, lambda p, i: p * (2 * i - n + 1))
    spread = F.aggregate(weighted, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    average = spread / F.nullif(n * (n - 1) / 2, F.lit(0.0))
    proximity = F.greatest(F.lit(0.0), F.lit(1.0) - average / F.nullif(n_words - 1, F.lit(0)))
    score = n / F.lit(float(max(n_keywords, 1))) * F.lit(COVERAGE_WEIGHT) + proximity * F.lit(PROXIMITY_WEIGHT)
    enough = (n >= MIN_KEYWORDS) & (n_words > 1)
    return let(
        F.when(enough, score).otherwise(F.lit(0.0)),
        lambda confidence: F.struct(
            (enough & (confidence >= KEYWORD_MIN)).alias("matched"),
            F.array_join(F.transform(found, lambda h: h["keyword"]), ", ").alias("phrase"),
            F.least(confidence, F.lit(KEYWORD_CAP)).alias("confidence"),
        ),
    )


def suppressed(text: Column, words: Column, benign: tuple[str, ...], modifiers: tuple[str, ...]) -> Column:
    """Fewer than two words, or a benign phrase without a severity modifier."""
    any_of = lambda phrases: functools.reduce(
        Column.__or__, [F.contains(text, F.lit(_norm(p))) for p in phrases], F.lit(False)
    )
    return (any_of(benign) & ~any_of(modifiers)) | (F.size(words) < MIN_WORDS)


def with_words(messages: DataFrame) -> DataFrame:
    """Add the normalised text and its words."""
    normed = messages.withColumn("_text", norm_trigger_text(F.coalesce("content", F.lit(""))))
    return normed.withColumn("_words", F.split("_text", " "))


def _strategies(category: Category, triggers: TriggerSet) -> list[tuple[str, Column]]:
    """Match of each strategy on ``_text`` and ``_words``, NULL where it does not apply."""
    text, words = F.col("_text"), F.col("_words")
    keywords = keyword_match(text, words, category.keywords, triggers.special_word, triggers.special_modifiers)
    return [
        ("exact", exact_match(text, category.exact)),
        ("variation", variation_match(text, category.variations)),
        ("keywords", let(keywords, lambda k: F.when(k["matched"], _match(k["phrase"], k["confidence"])))),
    ]


def _labelled(category: str, method: str):
    return lambda m: F.when(
        m.isNotNull(), F.struct(F.lit(category).alias("category"), F.lit(method).alias("method"), m.alias("m"))
    )


def _ordered(order: int, method: str):
    """Sorts by confidence, then by the order of the strategies."""
    return lambda m: F.when(
        m.isNotNull(),
        F.struct(m["confidence"].alias("confidence"), F.lit(-order).alias("order"), F.lit(method).alias("method"), m["phrase"].alias("phrase")),
    )


def strategy_matches(messages: DataFrame, triggers: TriggerSet) -> DataFrame:
    """One row per message, category and strategy that matches (before thresholds)."""
    rows = []
    for category in triggers.categories:
        for method, match in _strategies(category, triggers):
            rows.append(let(match, _labelled(category.name, method)))
    exploded = with_words(messages).select("message_id", F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return exploded.select("message_id", "r.category", "r.method", "r.m.phrase", "r.m.confidence")


def _best_strategy(category: Category, position: int, triggers: TriggerSet) -> Column:
    """Winning strategy of a category as a struct that sorts by priority, NULL below the minimum."""
    options = [let(match, _ordered(i, method)) for i, (method, match) in enumerate(_strategies(category, triggers))]
    return let(
        F.greatest(*options),
        lambda best: F.when(
            best["confidence"] >= F.lit(category.min_confidence),
            F.struct(
                F.lit(category.priority).alias("priority"), F.lit(position).alias("position"), F.lit(category.name).alias("category"),
                best["method"].alias("method"), best["phrase"].alias("phrase"), best["confidence"].alias("confidence"),
            ),
        ),
    )


def classify_triggers(messages: DataFrame, triggers: TriggerSet) -> DataFrame:
    """The trigger of each message that has one.

    Per category the best strategy wins (a later one only if strictly better);
    it counts from the category's minimum on; of those the lowest priority
    number wins, the earlier category on a tie.
    """
    staged = with_words(messages).where(~suppressed(F.col("_text"), F.col("_words"), triggers.benign, triggers.modifiers))
    candidates = [_best_strategy(category, i, triggers) for i, category in enumerate(triggers.categories)]
    winner = F.array_min(F.array_compact(F.array(*candidates)))
    return staged.withColumn("_t", winner).where(F.col("_t").isNotNull()).select(
        *messages.columns, "_t.category", "_t.priority", "_t.method", "_t.phrase", "_t.confidence"
    )


def trigger_events(classified: DataFrame, triggers: TriggerSet) -> DataFrame:
    """Chat-event rows of detected triggers."""
    by_name = {c.name: c for c in triggers.categories}

    def look_up(value) -> Column:
        pairs = [F.lit(v) for name, c in by_name.items() for v in (name, value(c))]
        return F.create_map(*pairs)[F.col("category")]

    rows = classified.select(
        F.col("session_id").alias("session_no"),
        F.concat(F.lit("trigger_"), F.col("category")).alias("event_type"),
        F.col("created_at").alias("event_timestamp"),
        F.col("content").alias("user_message_text"),
        look_up(lambda c: c.message).alias("bot_response_text"),
        look_up(lambda c: json.dumps({"type": "trigger", "buttons": list(c.buttons)})).alias("bot_response_source"),
        F.col("method").alias("trigger_detection_method"),
        F.col("confidence").alias("trigger_confidence"),
        F.col("phrase").alias("trigger_matched_phrase"),
    )
    return to_chat_events(rows)
