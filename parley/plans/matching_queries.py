"""Queries over quick replies, block words and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import block_words, quick_replies, rules, triggers
from parley.plans import sql_parts as sql
from parley.plans.access_queries import DEFAULTS, MERGED_SQL
from parley.plans.registry import query

TRIGGERS = triggers.TriggerSet(
    categories=(
        triggers.Category("urgent", 1, 0.7, exact=("stop now",), variations=("at once",), message="We are on it.", buttons=({"text": "Call"},)),
        triggers.Category("order", 2, 0.6, exact=("order no",), keywords=("order", "please"), message="Looking for the order."),
        triggers.Category("common", 3, 0.6, variations=("the of", "die und"), keywords=("the", "and", "of", "thing"), message="Noted."),
    ),
    benign=("thank you", "ing the"),
    modifiers=("at once", "whst"),
    special_word="hello",
    special_modifiers=("sudden", "severe"),
)

_NORMED = r"trim(regexp_replace(lower(content), '[-\s]+', ' ', 'g'))"


@query("trigger_normalize", "select message_id, lower(trim(content)) as trigger_key from b_short_messages")
def trigger_normalize(b):
    return b.short_messages.select("message_id", text.norm_trigger(F.col("content")).alias("trigger_key"))


_BRAND = sql.brand("t.brand_name", "t.name")
_ASSISTANT = f"coalesce({sql.filled('''coalesce(nullif(t.widget_header_title, ''), nullif(t.brand_name, ''), t.name)''')}, 'Assistant')"


def _render(template: str) -> str:
    return (
        f"replace(replace(replace({template}, '${{brand_name}}', {_BRAND}), '${{assistant_name}}', {_ASSISTANT}), "
        f"'${{website_url}}', coalesce({sql.strip('t.widget_website_url')}, ''))"
    )


@query("template_render", f"""
select q.tenant_id, q.ord, {_render('q.response_template')} as response from b_quick_replies q join b_tenants t using (tenant_id)
""")
def template_render(b):
    labels = b.tenants.select("tenant_id", "brand_name", "name", "widget_header_title", "widget_website_url")
    made = text.render_template(*[F.col(c) for c in ("response_template", "brand_name", "name", "widget_header_title", "widget_website_url")])
    return b.quick_replies.join(labels, "tenant_id").select("tenant_id", "ord", made.alias("response"))


def _merged(b):
    return rules.merge_rules(b.quick_replies, DEFAULTS, b.tenants)


@query("similarity_ratio")
def similarity_ratio(b):
    loose = _merged(b).withColumn("similarity_threshold", F.lit(50))
    return quick_replies.score_pairs(b.short_messages, loose).select("tenant_id", "query", "trigger_phrase", "score")


# Within one edit the ratio has a closed form.  Else it is 2 * m / (la + lb), where m is at most the letters both texts
# have, and at least the insertion and deletion distance leaves; pairs that these bounds leave open fail the query.
_COMMON = "list_sum(list_transform(list_distinct(string_split(r.trigger_phrase, '')), lambda c: least(len(q.q) - len(replace(q.q, c, '')), len(r.trigger_phrase) - len(replace(r.trigger_phrase, c, '')))))"


@query("quick_reply_match", f"""
with q as (select message_id, tenant_id, lower(trim(content)) as q from b_short_messages),
r as ({MERGED_SQL}),
sized as (
  select q.message_id, q.tenant_id, q.q, r.*, length(q.q) as la, length(r.trigger_phrase) as lb, {_COMMON} as most
  from q join r on r.tenant_id = q.tenant_id),
near as (select *, levenshtein(q, trigger_phrase) as d from sized where round(200.0 * most / (la + lb)) >= coalesce(similarity_threshold, 85)),
s as (
  select *, case when d <= 1 then cast(round(200.0 * (case when la = lb then la - d else least(la, lb) end) / (la + lb)) as int)
    else error('no closed form for ' || q) end as score from near),
best as (
  select *, row_number() over (partition by message_id order by score desc, priority desc, is_default, ord) as rn
  from s where score >= coalesce(similarity_threshold, 85))
select b.message_id, b.tenant_id, b.trigger_phrase, b.score, b.score / 100.0 as confidence, {_render('b.response_template')} as response
from best b left join b_tenants t on t.tenant_id = b.tenant_id where b.rn = 1
""")
def quick_reply_match(b):
    return quick_replies.match_quick_replies(b.short_messages, _merged(b), b.tenants)


@query("phrase_suggestions", f"""
with q as (select message_id, tenant_id, lower(trim(content)) as q from b_short_messages), r as ({MERGED_SQL})
select message_id, tenant_id, position, trigger_phrase from (
  select q.message_id, q.tenant_id, r.trigger_phrase, row_number() over (partition by message_id order by is_default, priority desc, ord) as position
  from q join r on r.tenant_id = q.tenant_id and (contains(q.q, r.trigger_phrase) or contains(r.trigger_phrase, q.q)))
where position <= 5
""")
def phrase_suggestions(b):
    return quick_replies.suggest_phrases(b.short_messages, _merged(b))


BLOCKED_SQL = """
select message_id, tenant_id, category, match_mode, matched_word, response_message from (
  select m.message_id, m.tenant_id, r.category, r.match_mode, r.word as matched_word, r.response_message,
    row_number() over (partition by m.message_id order by r.category_ord, r.word_ord) as rn
  from b_short_messages m join (select * from b_block_rules where word <> '(') r on r.tenant_id = m.tenant_id and
    case r.match_mode when 'exact' then lower(trim(m.content)) = lower(r.word) when 'substring' then contains(lower(m.content), lower(r.word))
      else regexp_matches(trim(m.content), r.word, 'i') end)
where rn = 1
"""


@query("block_word_match", BLOCKED_SQL)
def block_word_match(b):
    return block_words.match_block_words(b.short_messages, b.block_rules)


@query("trigger_text_normalize", f"select message_id, {_NORMED} as normalized from b_short_messages")
def trigger_text_normalize(b):
    return b.short_messages.select("message_id", text.norm_trigger_text(F.col("content")).alias("normalized"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


_N = f"(select message_id, session_id, tenant_id, created_at, content, {_NORMED} as t, string_split({_NORMED}, ' ') as w from b_short_messages)"
_ANY = "len(list_filter({}, lambda p: contains(t, p))) > 0"
_SUPPRESSED = f"(({_ANY.format(_list(TRIGGERS.benign))} and not {_ANY.format(_list(TRIGGERS.modifiers))}) or len(w) < 2)"


@query("trigger_false_positive", f"select message_id, {_SUPPRESSED} as suppressed from {_N}")
def trigger_false_positive(b):
    staged = triggers.with_words(b.short_messages)
    verdict = triggers.suppressed(F.col("_text"), F.col("_words"), TRIGGERS.benign, TRIGGERS.modifiers)
    return staged.select("message_id", verdict.alias("suppressed"))


def _exact_sql(c) -> str:
    tests = [f"select message_id, {i} as o, '{p}' as phrase from {_N} where regexp_matches(t, '\\b{p}\\b')" for i, p in enumerate(c.exact)]
    return f"select message_id, '{c.name}' as category, 'exact' as method, arg_min(phrase, o) as phrase, 1.0 as confidence from ({' union all '.join(tests)}) group by 1"


def _variation_sql(c) -> str:
    tests = []
    for i, p in enumerate(c.variations):
        words = p.split()
        every = " and ".join(f"contains(t, '{w}')" for w in words)
        steps = " + ".join(f"abs(instr(t, '{y}') - instr(t, '{x}'))" for x, y in zip(words, words[1:]))
        loose = f"0.7 + 0.2 * greatest(0, 1 - ({steps}) / {len(words) - 1}.0 / length(t))"
        tests.append(
            f"select message_id, {i} as o, '{p}' as phrase, case when regexp_matches(t, '\\b{p}\\b') then 0.9 else {loose} end as c "
            f"from {_N} where regexp_matches(t, '\\b{p}\\b') or ({every})"
        )
    return (
        f"select message_id, '{c.name}' as category, 'variation' as method, arg_min(phrase, o) as phrase, arg_min(c, o) as confidence "
        f"from ({' union all '.join(tests)}) group by 1"
    )


def _keyword_sql(c) -> str:
    n = len(c.keywords)
    special = f"contains(t, '{TRIGGERS.special_word}') and {_ANY.format(_list(TRIGGERS.special_modifiers))}"
    return f"""
select message_id, '{c.name}' as category, 'keywords' as method,
  case when s then array_to_string(list_concat(names, case when list_contains(names, '{TRIGGERS.special_word}') then []::varchar[] else ['{TRIGGERS.special_word}'] end), ', ')
    else array_to_string(names, ', ') end as phrase,
  case when s then 0.95 else least(score, 0.8) end as confidence
from (
  select *, len(names) / {float(max(n, 1))} * 0.6 + 0.4 * greatest(0, 1 - (list_sum(list_transform(pos, lambda a: list_sum(list_transform(pos, lambda b: abs(a - b))))) / 2.0
      / (len(pos) * (len(pos) - 1) / 2.0)) / (len(w) - 1)) as score
  from (
    select *, list_filter({_list(c.keywords)}, lambda k: len(list_filter(w, lambda x: contains(x, k) or contains(k, x))) > 0) as names,
      list_transform(list_filter({_list(c.keywords)}, lambda k: len(list_filter(w, lambda x: contains(x, k) or contains(k, x))) > 0),
        lambda k: list_position(list_transform(w, lambda x: contains(x, k) or contains(k, x)), true) - 1) as pos, {special} as s
    from {_N}))
where s or (len(names) >= 2 and len(w) > 1 and score >= 0.5)
"""


def _strategy_sql() -> str:
    parts = []
    for c in TRIGGERS.categories:
        if c.exact:
            parts.append(_exact_sql(c))
        if c.variations:
            parts.append(_variation_sql(c))
        parts.append(_keyword_sql(c))
    return " union all ".join(f"({p})" for p in parts)


def _method_sql(method: str) -> str:
    return f"select message_id, category, method, phrase, round(confidence, 6) as confidence from ({_strategy_sql()}) where method = '{method}'"


def _by_method(b, method):
    found = triggers.strategy_matches(b.short_messages, TRIGGERS).where(F.col("method") == method)
    return found.withColumn("confidence", F.round("confidence", 6))


@query("trigger_exact", _method_sql("exact"))
def trigger_exact(b):
    return _by_method(b, "exact")


@query("trigger_variation", _method_sql("variation"))
def trigger_variation(b):
    return _by_method(b, "variation")


@query("trigger_keywords", _method_sql("keywords"))
def trigger_keywords(b):
    return _by_method(b, "keywords")


_PRIORITY = "case category " + " ".join(f"when '{c.name}' then {c.priority}" for c in TRIGGERS.categories) + " end"
_MINIMUM = "case category " + " ".join(f"when '{c.name}' then {c.min_confidence}" for c in TRIGGERS.categories) + " end"

CLASSIFIED_SQL = f"""
select n.message_id, n.session_id, n.content, n.created_at, category, priority, method, phrase, round(confidence, 6) as confidence from {_N} n join (
  select *, row_number() over (partition by message_id order by priority) as rn2 from (
    select *, {_PRIORITY} as priority, row_number() over (
      partition by message_id, category order by confidence desc, case method when 'exact' then 0 when 'variation' then 1 else 2 end) as rn
    from ({_strategy_sql()}))
  where rn = 1 and confidence >= {_MINIMUM}) x using (message_id)
where rn2 = 1 and not {_SUPPRESSED}
"""


@query("trigger_classify", f"select message_id, category, priority, method, phrase, confidence from ({CLASSIFIED_SQL})")
def trigger_classify(b):
    return triggers.classify_triggers(b.short_messages, TRIGGERS).select(
        "message_id", "category", "priority", "method", "phrase", F.round("confidence", 6).alias("confidence")
    )


_RESPONSE = "case category " + " ".join(f"when '{c.name}' then '{c.message}'" for c in TRIGGERS.categories) + " end"


@query("trigger_event_log", f"""
select session_id as session_no, concat('trigger_', category) as event_type, created_at as event_timestamp, content as user_message_text,
  {_RESPONSE} as bot_response_text,
  case category when 'urgent' then '{{"type": "trigger", "buttons": [{{"text": "Call"}}]}}' else '{{"type": "trigger", "buttons": []}}' end as bot_response_source,
  method as trigger_detection_method, confidence as trigger_confidence, phrase as trigger_matched_phrase
from ({CLASSIFIED_SQL})
""")
def trigger_event_log(b):
    classified = triggers.classify_triggers(b.short_messages, TRIGGERS)
    return triggers.trigger_events(classified, TRIGGERS).drop("bot_response_confidence").withColumn(
        "trigger_confidence", F.round("trigger_confidence", 6)
    )
