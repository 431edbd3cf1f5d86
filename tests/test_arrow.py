"""What Python workers hold at a time does not follow the size of Spark's batches."""

import pytest

from parley.functions import arrow, html
from parley.operators import ingest

DOC = "tenant_id bigint, seq bigint, point_id string, title string, content string, url string, source string, source_type string"


@pytest.mark.parametrize("rows", [0, 1, 600])
def test_texts_are_embedded_in_slices(spark, rows):
    most, good = arrow.SLICE_ROWS, ingest.hashing_embedder(8)

    def bounded(texts):
        if len(texts) > most:
            raise ValueError(f"{len(texts)} texts at a time")
        vectors, _ = good(texts)
        return vectors, [len(texts)] * len(texts)

    docs = spark.createDataFrame([(1, i, f"p{i}", "word", None if i == 5 else "word", "u", "s", "primary") for i in range(rows)], DOC).coalesce(1)
    got = ingest.embed(docs, bounded).collect()
    assert sorted(r.seq for r in got) == list(range(rows))
    assert {r.seq for r in got if r.status == "failed"} == ({5} if rows > 5 else set())
    assert max((r.prompt_tokens for r in got), default=1) == max(1, min(rows, most))


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(i, None if i == 3 else f"<body>a{i}</body>") for i in range(600)], "page_id bigint, html string").coalesce(1)
    got = {r.page_id: (r.full_text, r.main_text) for r in html.with_page_texts(pages).collect()}
    assert got == {i: ("", "") if i == 3 else (f"a{i}", f"a{i}") for i in range(600)}
