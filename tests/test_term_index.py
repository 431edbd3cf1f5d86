"""Search for a table of terms against a plain model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parley.operators import term_index
from parley.operators.search import search_sessions

SESSIONS = "session_id bigint, title string, visitor_name string, visitor_email string"
MESSAGES = "message_id bigint, session_id bigint, content string"


def like(term):
    source, out, i = f"%{term}%".lower(), "", 0
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            i += 1
            c = re.escape(source[i])
        elif c in "%_":
            c = {"%": ".*", "_": "."}[c]
        else:
            c = re.escape(c)
        out += c
        i += 1
    return re.compile(out, re.DOTALL)


def model(sessions, messages, terms):
    out = set()
    for term in {t for t in terms if t is not None}:
        pattern = like(term)
        out |= {(term, s) for _, s, text in messages if text is not None and pattern.fullmatch(text.lower())}
        out |= {(term, s[0]) for s in sessions if any(term.lower() in ("" if f is None else str(f)).lower() for f in (s[1], s[0], *s[2:]))}
    return {(t, s) for t, s in out if s in {x[0] for x in sessions} or s is None}


def pairs(found):
    rows = [(r.term, r.session_id) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frames(spark, sessions, messages, terms):
    return spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(messages, MESSAGES), spark.createDataFrame([(t,) for t in terms], "term string")


AWKWARD_SESSIONS = [(1, "Chat 1", "Ann", "a@x"), (2, None, None, None), (3, "50%_off\\", "", "É@x"), (12, "chat", "50", "b@x")]
AWKWARD_MESSAGES = [
    (1, 1, "Hello there"), (2, 1, None), (3, 2, ""), (4, 2, "50% of a_b\\c"), (5, 3, "line\nbreak ÀÉ 😀x"), (6, 12, "x" * 5000 + "needle"), (7, 12, "Hello there"), (8, 3, "a"),
]
AWKWARD_TERMS = [
    "hello", "HELLO", "", "%", "_", "__", "lo%the", "l_o", "50%", r"50\%", r"a\_b", "a_b", "\\", r"\\c", "é", "😀", "n\nb", "needle", "zzz", "x@", "1", "chat 1", None, "hello",
    "%_", "e\\", "a", r"\h", "e_b", "Àé",
]


def test_awkward_terms_and_texts(spark):
    s, m, t = frames(spark, AWKWARD_SESSIONS, AWKWARD_MESSAGES, AWKWARD_TERMS)
    units = term_index.search_units(s, m)
    got = pairs(term_index.search_terms(units, term_index.postings(units), t))
    want = model(AWKWARD_SESSIONS, AWKWARD_MESSAGES, AWKWARD_TERMS)
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_no_match_is_lost(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("aAbBc %_\\") for _ in range(rng.randrange(n)))
    sessions = [(i, text(9), text(6), text(6)) for i in range(30)]
    messages = [(i, rng.randrange(30), text(25)) for i in range(150)]
    terms = [text(6) for _ in range(60)]
    s, m, t = frames(spark, sessions, messages, terms)
    units = term_index.search_units(s, m).cache()
    want = model(sessions, messages, terms)
    for probes in (1, 3):
        assert pairs(term_index.search_terms(units, term_index.postings(units), t, probes)) == want


def test_pieces_are_not_tried_again(spark):
    """Every piece occurs a thousand times but the last, which comes first: trying all places of each would never end."""
    messages = [(1, 1, "c" + "ab " * 1000), (2, 2, "ab " * 1000 + "c"), (3, 3, "x(a)b.c")]
    terms = ["a%a%a%a%b%c", "a%b%a%b%_", "(a)%.c", "a_b.", "%.c\\"]
    s, m, t = frames(spark, [(i, None, None, None) for i in (1, 2, 3)], messages, terms)
    units = term_index.search_units(s, m)
    got = pairs(term_index.search_terms(units, term_index.postings(units), t))
    assert got == {(terms[0], 2), (terms[1], 1), (terms[1], 2), ("(a)%.c", 3), ("a_b.", 3)}


def test_batches_are_added_and_replaced(spark, tmp_path):
    s, m, t = frames(spark, AWKWARD_SESSIONS, AWKWARD_MESSAGES, ["hello", "needle", "50"])
    index = term_index.TermIndex(spark, str(tmp_path / "terms"))
    index.add(term_index.search_units(s, m.where("message_id < 5")), "first")
    assert ("needle", 12) not in pairs(index.search(t))
    for _ in range(2):
        index.add(term_index.search_units(s.limit(0), m.where("message_id >= 5")), "second")
    assert pairs(index.search(t)) == model(AWKWARD_SESSIONS, AWKWARD_MESSAGES, ["hello", "needle", "50"])
    assert index.search(t.limit(0)).count() == 0


def test_same_sessions_as_compiled_terms(bindings):
    terms = ["ing the", "CHAT 1", "user3", "e_n%o", "Name 7"]
    units = term_index.search_units(bindings.sessions, bindings.messages)
    table = bindings.spark.createDataFrame([(t,) for t in terms], "term string")
    compiled = {(r.term, r.session_id) for r in search_sessions(bindings.sessions, bindings.messages, terms).collect()}
    assert pairs(term_index.search_terms(units, term_index.postings(units), table)) == compiled


def test_few_candidates_are_tested(bindings):
    """Texts that hold the grams asked for are few beside all pairs."""
    units = term_index.search_units(bindings.sessions, bindings.messages).cache()
    index = term_index.postings(units).cache()
    terms = bindings.messages.where("sender_type = 'user'").select(F.expr("substr(content, 4, 14)").alias("term")).where("length(term) = 14").distinct()
    found = term_index.search_terms(units, index, terms)
    assert {(r.term, r.session_id) for r in bindings.messages.join(terms, F.expr("contains(content, term)")).select("term", "session_id").collect()} <= pairs(found)
    grams = term_index._wanted(terms).where("kind = 'message'")
    counts = index.where("kind = 'message'").groupBy("gram").count()
    least = grams.join(counts, "gram").groupBy("term").agg(F.min("count").alias("n")).agg(F.sum("n")).first()[0]
    assert least * 4 < terms.count() * units.where("kind = 'message'").count()


def test_finds_are_not_shuffled(spark):
    """Nor candidates: terms of short pieces fit many texts, so nothing of that number may be dealt out."""
    s, m, t = frames(spark, AWKWARD_SESSIONS, AWKWARD_MESSAGES, AWKWARD_TERMS)
    units = term_index.search_units(s, m)
    found = term_index.search_terms(units, term_index.postings(units), t)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_columns_of_sessions_come_along(spark):
    s, m, t = frames(spark, AWKWARD_SESSIONS, AWKWARD_MESSAGES, AWKWARD_TERMS)
    units = term_index.search_units(s, m)
    tenants = spark.createDataFrame([(1, 7), (2, None), (2, 9), (12, 7)], "session_id bigint, tenant_id bigint")
    got = [tuple(r) for r in term_index.search_terms(units, term_index.postings(units), t, beside=tenants).select("term", "session_id", "tenant_id").collect()]
    want = [(t, x, y) for t, x in model(AWKWARD_SESSIONS, AWKWARD_MESSAGES, AWKWARD_TERMS) for z, y in ((1, 7), (2, None), (2, 9), (12, 7)) if x == z]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chars, block, together", [(20, 1 << 16, 3), (1 << 22, 4, 1), (40, 8, 1024)])
def test_long_sessions_and_many_blocks(spark, monkeypatch, chars, block, together):
    """Sessions of much text are dealt out by unit, terms in blocks, and a session may be read in several batches."""
    for name, value in (("SESSION_CHARS", chars), ("TERM_BLOCK", block), ("_TEXTS", together)):
        monkeypatch.setattr(term_index, name, value)
    s, m, t = frames(spark, AWKWARD_SESSIONS, AWKWARD_MESSAGES, AWKWARD_TERMS)
    units = term_index.search_units(s, m).cache()
    assert pairs(term_index.search_terms(units, term_index.postings(units), t)) == model(AWKWARD_SESSIONS, AWKWARD_MESSAGES, AWKWARD_TERMS)


def test_other_messages_of_sessions_with_repeated_ids(spark):
    """Messages that share an id, or have none, are led by their id as one; the others of their sessions are found as ever."""
    messages = [(None, 1, "apple pie"), (None, 2, "pear pie"), (3, 1, "plum pie"), (4, 2, "plum jam"), (5, None, "plum tart"), (6, None, "plum tart")]
    s, m, t = frames(spark, [(1, "one", None, None), (2, "two", None, None)], messages, ["plum", "appl", "plum%pie", "two", "zzz"])
    units = term_index.search_units(s, m)
    got = pairs(term_index.search_terms(units, term_index.postings(units), t))
    assert got == {("plum", 1), ("plum", 2), ("plum", None), ("appl", 1), ("plum%pie", 1), ("two", 2)}
