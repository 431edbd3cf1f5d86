"""Quick replies, block words and triggers against plain-Python models."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from parley.operators import block_words, quick_replies, rules, triggers

TENANT = "tenant_id bigint, brand_name string, name string, widget_header_title string, widget_website_url string"
RULES = "tenant_id bigint, trigger_phrase string, response_template string, similarity_threshold int, priority int, ord int, is_default boolean"


def messages_df(spark, texts):
    rows = [(i, i // 2, 1 + i % 2, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "message_id bigint, session_id bigint, tenant_id bigint, content string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp_ntz")
    )


def model_reply(query, own):
    """own: (trigger, template, threshold, priority) in rule order."""
    q = (query or "").strip().lower()
    best, best_score, best_priority = None, -1, -10_000
    if not q:
        return None
    for trigger, template, threshold, priority in own:
        score = 100 if q == trigger else int(round(100 * SequenceMatcher(None, q, trigger).ratio()))
        if score < (85 if threshold is None else threshold):
            continue
        if score > best_score or (score == best_score and priority > best_priority):
            best, best_score, best_priority = template, score, priority
    return (best, best_score) if best else None


def test_quick_replies(spark):
    own = [
        ("hello", "H", None, 10), ("hallo", "A", 60, 10), ("hullo", "U", None, 3), ("thank you", "", None, 2),
        ("thanks", "T", 50, 2), ("good morning", "M", None, 0), ("good evening", "E", 70, 0),
    ]
    rng = random.Random(2)
    texts = ["  Hello ", "helo", "hallo", "hxllo", "THANK YOU", "thanks!", "thank yu", "good mornin", "good mevening", "", None, "x" * 500, "thanks a lot indeed"]
    texts += ["".join(rng.choice("hello thanks") for _ in range(rng.randrange(1, 9))) for _ in range(120)] + ["hello"] * 60
    messages = messages_df(spark, texts)
    rows = [(t, trig, tmpl, th, pr, i, False) for t in (1, 2) for i, (trig, tmpl, th, pr) in enumerate(own)]
    tenants = spark.createDataFrame([(1, "B", "n", None, None), (2, "B", "n", None, None)], TENANT)
    got = quick_replies.match_quick_replies(messages, spark.createDataFrame(rows, RULES), tenants).collect()
    want = {i: model_reply(t, own) for i, t in enumerate(texts)}
    assert {r.message_id: (r.response, r.score) for r in got} == {i: w for i, w in want.items() if w}
    assert all(abs(r.confidence - r.score / 100) < 1e-12 for r in got)


def test_reply_renders_the_tenants_template(spark):
    tenants = spark.createDataFrame([(1, "BrandX", "BrandX", "", "")], TENANT)
    replies = spark.createDataFrame(
        [(1, "c", "hello", "Hey from ${brand_name}", None, 10, True, 1)],
        "tenant_id bigint, category string, trigger_phrase string, response_template string, similarity_threshold int, priority int, enabled boolean, ord int",
    )
    merged = rules.merge_rules(replies, [], tenants)
    got = quick_replies.match_quick_replies(messages_df(spark, ["hello"]), merged, tenants).collect()
    assert [(r.response, r.confidence) for r in got] == [("Hey from BrandX", 1.0)]


def test_suggestions_keep_rule_order(spark):
    rows = [(1, t, "x", None, 0, i, True) for i, t in enumerate(["hi", "help", "help me", "hello", "who", "how", "thanks"])]
    texts = ["h", "none", "please help me now", "none"]
    got = quick_replies.suggest_phrases(messages_df(spark, texts), spark.createDataFrame(rows, RULES)).orderBy("message_id", "position").collect()
    assert [(r.message_id, r.trigger_phrase) for r in got] == [
        (0, "hi"), (0, "help"), (0, "help me"), (0, "hello"), (0, "who"), (2, "help"), (2, "help me"),
    ]


BLOCK = [
    # (category_ord, mode, [words])
    (1, "exact", ["Bad Topic", "  spaced "]),
    (2, "substring", ["STOP-NOW", "é"]),
    (3, "regex", ["(", r"no\.\s\d{4}", r"(?P<x>a)(?P=x)b", r"^begin.*end$", r"\bword\b", r"[[:bad", r"x{,2}z"]),
]
BLOCK_TEXTS = [
    "bad topic", " BAD TOPIC ", "a bad topic", "spaced", "please stop-now", "É", "no. 1234", "NO. 12", "xAAB", "begin\nend", "Begin the END",
    "a word here", "swordfish", "xxz", "(", "", None, "bad topic stop-now no. 1234",
]


def model_block(text):
    body = (text or "").strip()
    for order, mode, words in BLOCK:
        for word in words:
            candidate = word.strip()
            if mode == "exact":
                hit = body.lower() == candidate.lower()
            elif mode == "substring":
                hit = candidate.lower() in body.lower()
            else:
                try:
                    hit = re.search(candidate, body, re.IGNORECASE) is not None
                except re.error:
                    hit = False
            if hit:
                return mode, candidate
    return None


def test_block_words(spark):
    rows = [
        (t, order, f"c{order}", mode, i, word, f"r{order}")
        for t in (1, 2) for order, mode, words in BLOCK for i, word in enumerate(words)
    ]
    table = spark.createDataFrame(rows, "tenant_id bigint, category_ord int, category string, match_mode string, word_ord int, word string, response_message string")
    got = block_words.match_block_words(messages_df(spark, BLOCK_TEXTS), table).collect()
    want = {i: model_block(t) for i, t in enumerate(BLOCK_TEXTS)}
    assert {r.message_id: (r.match_mode, r.matched_word) for r in got} == {i: w for i, w in want.items() if w}
    engines = table.where("match_mode = 'regex' and tenant_id = 1").orderBy("word_ord").select(block_words.regex_engine("word")).collect()
    assert [e[0] for e in engines] == [None, "jvm", "python", "jvm", "jvm", None, "python"]


def test_other_tenants_rules_do_not_apply(spark):
    table = spark.createDataFrame(
        [(9, 1, "c", "substring", 1, "a", "r")],
        "tenant_id bigint, category_ord int, category string, match_mode string, word_ord int, word string, response_message string",
    )
    assert block_words.match_block_words(messages_df(spark, ["a", "a"]), table).count() == 0


SET = triggers.TriggerSet(
    categories=(
        triggers.Category("alarm", 2, 0.7, exact=("help-me now", "c++", "fire"), variations=("send help fast", "at once"), keywords=("help", "fast", "fire", "one-sided", "one sided")),
        triggers.Category("order", 1, 0.6, exact=("my order",), keywords=("order", "late", "please")),
    ),
    benign=("fire drill",), modifiers=("urgent",), special_word="smoke", special_modifiers=("thick", "black"),
)


def model_norm(text):
    return re.sub(r"[-\s]+", " ", text.lower()).strip()


def model_word(text, phrase):
    return re.search(rf"\b{re.escape(phrase)}\b", text, re.ASCII) is not None


def model_exact(text, phrases):
    return next(((p, 1.0) for p in phrases if model_word(text, model_norm(p))), None)


def model_variation(text, variations):
    for v in variations:
        phrase = model_norm(v)
        if model_word(text, phrase):
            return v, 0.9
        words = phrase.split()
        if len(words) >= 2 and all(w in text for w in words):
            at = [text.index(w) for w in words]
            average = sum(abs(b - a) for a, b in zip(at, at[1:])) / (len(at) - 1)
            return v, 0.7 + max(0, 1 - average / len(text)) * 0.2
    return None


def model_keywords(text, keywords):
    words = text.split(" ")
    names, at = [], []
    for k in keywords:
        needle = model_norm(k)
        for i, w in enumerate(words):
            if (needle in w or w in needle) and k not in names:
                names.append(k)
                at.append(i)
    if SET.special_word in text and any(m in text for m in SET.special_modifiers):
        return ", ".join(names + ([] if SET.special_word in names else [SET.special_word])), 0.95
    if len(names) < 2 or len(words) < 2:
        return None
    gaps = [abs(a - b) for i, a in enumerate(at) for b in at[i + 1:]]
    near = max(0, 1 - (sum(gaps) / len(gaps)) / (len(words) - 1))
    score = len(names) / len(keywords) * 0.6 + near * 0.4
    return (", ".join(names), min(score, 0.8)) if score >= 0.5 else None


def model_classify(raw):
    text = model_norm(raw or "")
    if any(b in text for b in SET.benign) and not any(m in text for m in SET.modifiers):
        return None
    if len(text.split()) < 2:
        return None
    found = []
    for c in SET.categories:
        best = None
        options = (("exact", model_exact(text, c.exact)), ("variation", model_variation(text, c.variations)), ("keywords", model_keywords(text, c.keywords)))
        for method, match in options:
            if match and match[1] > (best[2] if best else 0):
                best = (method, match[0], match[1])
        if best and best[2] >= c.min_confidence:
            found.append((c.priority, c.name, *best))
    return sorted(found, key=lambda f: f[0])[0] if found else None


@pytest.fixture(scope="module")
def trigger_texts():
    rng = random.Random(4)
    words = "help me now c++ fire send fast at once my order late please one-sided smoke thick urgent drill the firefly once-at a xx".split()
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    return made + ["", None, "fire", "Help-Me   NOW", "use c++ today", "c++", "send quick fast help", "fire drill now", "urgent fire drill now", "black smoke here"]


def test_trigger_strategies(spark, trigger_texts):
    got = {}
    for r in triggers.strategy_matches(messages_df(spark, trigger_texts), SET).collect():
        got[(r.message_id, r.category, r.method)] = (r.phrase, round(r.confidence, 9))
    want = {}
    for i, raw in enumerate(trigger_texts):
        text = model_norm(raw or "")
        for c in SET.categories:
            options = (("exact", model_exact(text, c.exact)), ("variation", model_variation(text, c.variations)), ("keywords", model_keywords(text, c.keywords)))
            for method, match in options:
                if match:
                    want[(i, c.name, method)] = (match[0], round(match[1], 9))
    assert got == want


def test_trigger_classifier(spark, trigger_texts):
    got = {}
    classified = triggers.classify_triggers(messages_df(spark, trigger_texts), SET)
    for r in classified.collect():
        got[r.message_id] = (r.priority, r.category, r.method, r.phrase, round(r.confidence, 9))
    want = {}
    for i, raw in enumerate(trigger_texts):
        found = model_classify(raw)
        if found:
            want[i] = (*found[:4], round(found[4], 9))
    assert got == want and len(want) > 50
    events = triggers.trigger_events(classified, SET)
    assert events.count() == len(want)
    assert {r.event_type for r in events.collect()} == {"trigger_alarm", "trigger_order"}
