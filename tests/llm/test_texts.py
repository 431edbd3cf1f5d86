"""Repetition, language, quality, licences and decontamination of single texts."""

import zlib

import duckdb
import pytest

import parley.llm.queries as queries
from parley.llm import decontamination, language, licences, quality, repetition
from check import table
from tests.conftest import SMALL
from tests.llm import tables


def repetition_model(text):
    w = tables.WORD.findall(text or "")
    windows, covered = {}, set()
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k : k + 3]), []).append(k)
    for at in windows.values():
        if len(at) > 1:
            covered |= {k + j for k in at for j in range(3)}
    longest = 0
    by_text = lambda n: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    while len(set(by_text(longest + 1))) < len(by_text(longest + 1)):
        longest += 1
    lines = [x for x in (text or "").split("\n") if tables.WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), longest if longest >= 3 else 0)


def measured(df):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=repr)


def test_repetition(spark):
    docs = tables.documents(spark, SMALL).limit(120)
    rows = tables.rows_of(docs)
    assert measured(repetition.repetition_rules(docs)) == sorted(((i, *repetition_model(t)) for i, t in rows), key=repr)


def test_repetition_in_awkward_rows(spark):
    rows = [r[:2] for r in tables.awkward() if len(r[1] or "") < 9999] + [(50, "a b c d " * 30), (51, "x " * 500), (52, "#*$ %&| <>\n#*$ %&| <>\n\n")]
    got = repetition.repetition_rules(tables.frame(spark, [(*r, None, None, None) for r in rows]))
    assert measured(got) == sorted(((i, *repetition_model(t)) for i, t in rows), key=repr)
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got.collect()}
    assert verdict[1] == (False, True) and verdict[4] == (True, False) and verdict[51] == (True, False)
    long = tables.sentence(8, 150)
    twice = repetition.repetition_rules(tables.frame(spark, [(1, f"{long} {tables.sentence(9, 160)} {long[:400]}", None, None, None)])).first()
    assert not twice["base_failed"] and twice["covered_words"] > 100 and twice["kept"] == (twice["covered_words"] <= 0.4 * twice["n_words"])


def test_language(spark):
    docs = tables.documents(spark, "/root/testdata/sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    right = [truth[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]
    assert sum(right) >= 0.98 * len(right)
    assert sum(r["rejected"] for r in got) < 0.05 * len(got)


def test_language_of_awkward_rows(spark):
    got = {r["doc_id"]: r for r in language.identify(tables.frame(spark, tables.awkward())).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[6]["lang_pred"] == "und"
    assert got[13]["lang_pred"] in ("en", "fr") and got[None]["held_out"]
    assert len(language.identify(tables.frame(spark, tables.awkward())).collect()) == len(tables.awkward())
    assert language.identify(tables.frame(spark, [])).count() == 0
    unlearnt = language.identify(tables.frame(spark, [(1, "some text", None, None, None)])).first()
    assert (unlearnt["lang_pred"], unlearnt["score"]) == ("und", 0.0)


def test_kneser_ney_beside_plain_model(spark, monkeypatch):
    import numpy as np

    from tests.llm.plain_language import Model, discount_of

    docs = tables.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", "lang")
    texts = [(r["lang"], r["text"]) for r in docs.where("lang is not null and text is not null").collect()]
    models = language.train(docs)
    assert models.names == sorted({lang for lang, _ in texts})
    asked, plain = {97 << 32 | 98 << 16 | c for c in range(97, 123)} | {5, 250 << 48 | 251 << 32 | 252 << 16 | 253}, []
    for name in models.names:
        counts = {}
        for lang, text in texts:
            if lang == name:
                letters = "".join(c if c.isalpha() else " " for c in text.lower())
                for run in letters.split(" "):
                    codes = [0, 0, 0, *map(ord, run), 0] if run else []
                    for i in range(len(codes) - 3):
                        key = sum(c << 16 * (3 - j) for j, c in enumerate(codes[i : i + 4]))
                        counts[key] = counts.get(key, 0) + 1
        grams, n = np.array(list(counts), dtype=np.uint64), np.array(list(counts.values()))
        plain.append(Model(grams, n, discount_of(n)))
        asked |= set(list(counts)[:500])
    monkeypatch.setattr(language, "_PENDING", 50)  # tables of part of a slice
    rows = [(int(np.uint64(g).view(np.int64)),) for g in sorted(asked)]
    got = {r["gram"]: r["h"] for r in language.log_probabilities(spark.createDataFrame(rows, "gram long"), models).collect()}
    assert len(got) == len(asked)
    keys = np.array([g for g, in rows])
    for i, model in enumerate(plain):
        assert np.allclose([got[k][i] for k in keys.tolist()], model.log(keys.view(np.uint64)), rtol=1e-9)
    scored = {r["doc_id"]: r for r in language.entropies(docs, models).collect()}
    for r in docs.where("text is not null").limit(20).collect():
        runs = "".join(c if c.isalpha() else " " for c in r["text"].lower()).split()
        codes = [[0, 0, 0, *map(ord, run), 0] for run in runs]
        each = np.array([sum(c << 16 * (3 - j) for j, c in enumerate(x[i : i + 4])) for x in codes for i in range(len(x) - 3)], dtype=np.uint64)
        want = [-model.log(each).sum() / len(each) for model in plain]
        assert np.allclose(scored[r["doc_id"]]["h"], want, rtol=1e-5)


def test_kneser_ney_sums_to_one(spark):
    import numpy as np

    docs = tables.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", "lang")
    models = language.train(docs)
    letters = [r["gram"] for r in models.seen[1].where("l = 0").collect()]
    for context in (97 << 32 | 98 << 16 | 99, 0, 120 << 32 | 121 << 16 | 122):
        following = spark.createDataFrame([((context << 16) | c,) for c in [*letters, 0xFFF0]], "gram long")
        total = sum(np.exp(r["h"][0]) for r in language.log_probabilities(following, models).collect())
        assert total == pytest.approx(1)  # the last stands for all unseen letters


def test_quality(spark):
    docs, labels = tables.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.quality_scores(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    right = [truth[r["doc_id"]] == r["predicted"] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(right) > 80 and sum(right) >= 0.95 * len(right)


def test_quality_of_awkward_rows(spark):
    docs = tables.frame(spark, tables.awkward())
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (99, 1, 0), (7, 7, 7)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.quality_scores(docs, known).collect()
        assert len(got) == len(tables.awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    return connection


def beside_sql(con, df, name, docs, **others):
    for view, frame in {"documents": docs, **others}.items():
        con.register(view, frame.toPandas())
    cursor = con.execute(queries.ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())


def commented(text, width, mark=" * "):
    words = text.split()
    return "\n".join(mark + " ".join(words[k : k + width]) for k in range(0, len(words), width))


def test_licences_beside_sql(spark, con):
    mit, apache, gpl, full = (licences.TEMPLATES[n] for n in ("MIT-text", "Apache-2.0-header", "GPL-3.0-notice", "MIT-full"))
    extra = [
        (101, f"before\n\n{mit[:150]}\n{mit[150:]}\n\nafter", None, None, None),
        (102, apache.upper() + "\nReleased under the MIT License.", None, None, None),
        (103, "Released under the MIT License", None, None, None),
        (104, "under the License", None, None, None),
        (105, mit[:300], None, None, None),
        (106, "x = 1\n/*\n" + commented(gpl, 8) + "\n */\nint main() { return 0; }", None, None, None),
        (107, f"{tables.sentence(3, 40)} {full} {tables.sentence(4, 40)}", None, None, None),
        (108, commented(full, 11, "# ") + "\nimport os\n" + commented(apache, 9, "// ") + "\nx = 2", None, None, None),
        (109, " ".join(full.split()[:60] + tables.sentence(5, 30).split() + full.split()[60:]), None, None, None),
        (110, "of the software " * 400, None, None, None),
        (111, " ".join([full] * 5), None, None, None),
    ]
    docs = tables.frame(spark, [r for r in tables.awkward() if r[0] is not None] + extra)
    got = licences.scan(docs)
    beside_sql(con, got, "op5_licences", docs.select("doc_id", "text"))
    found = {r["doc_id"]: r for r in got.collect()}
    by_id = {i: r["licence"] for i, r in found.items()}
    assert (by_id[106], found[106]["dice"]) == ("GPL-3.0-notice", 1.0) and "GPL-3.0-header" in found[106]["licences"]
    assert (by_id[107], found[107]["dice"], found[107]["first_word"]) == ("MIT-full", 1.0, 41)
    assert by_id[108] == "MIT-full" and "Apache-2.0-header" in found[108]["licences"].split(",")
    assert found[109]["licences"] == "MIT-full,MIT-text" and found[109]["dice"] < 1 and by_id[110] is None and by_id[111] == "MIT-full"
    assert by_id[101] == "MIT-text" and by_id[103] == "MIT" and by_id[104] is None and by_id[4] is None
    assert licences.scan(tables.frame(spark, [])).count() == 0
    assert licences.scan(docs, templates={}).where("licence is not null").count() == 0


def test_decontamination_beside_sql(spark, con):
    item = tables.sentence(77, 25)
    words = item.split()
    benchmark = spark.createDataFrame(
        [(1, item), (1, item), (2, "Short Item here"), (3, None), (4, ""), (5, "!?"), (10, " ".join(words[3:13])), (11, "Éİ x")], "item_id long, text string"
    )
    extra = [
        (201, f"a b {' '.join(words[2:14]).upper()} c {' '.join(words[1:12])}", None, None, None),
        (202, " ".join(words[:9]), None, None, None),
        (203, "x,short-item...HERE! short item there", None, None, None),
        (204, "éİ x and Éİ X, eİ x", None, None, None),
    ]
    docs = tables.frame(spark, [r for r in tables.awkward() if r[0] is not None] + extra)
    hits = decontamination.find_hits(docs, benchmark)
    beside_sql(con, decontamination.digest(hits), "op8_decontaminate", docs.select("doc_id", "text"), benchmark=benchmark)
    n = {r["doc_id"]: r["n_hit"] for r in hits.collect()}
    assert n[201] == 23 and n[202] == 0 and n[203] == 3 and n[204] == 2
    clean = decontamination.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, k in n.items() if not k}
    text = hits.where("doc_id = 203").join(docs.select("doc_id", "text"), "doc_id").select(decontamination.remove_spans(decontamination.F.col("text"), decontamination.F.col("spans")))
    assert text.first()[0] == "x short item there"


def test_decontamination_without_benchmark(spark):
    docs = tables.frame(spark, tables.awkward())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_hits(docs, none).where("n_hit > 0").count() == 0
    assert decontamination.drop_contaminated(docs, none).count() == len(tables.awkward())
    assert decontamination.find_hits(docs.limit(0), none).count() == 0


def test_native_operators_have_no_python_in_their_plans(spark):
    docs, benchmark = tables.documents(spark, SMALL), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for df in (licences.scan(docs), decontamination.find_hits(docs, benchmark)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "MapIn"))
