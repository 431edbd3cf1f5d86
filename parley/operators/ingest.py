"""Ingestion: documents to vectors to collection, with per-document status and job rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text
from parley.functions.arrow import slices
from parley.operators import documents as docs
from parley.operators.analytics import ingest_summary
from parley.session import materialize
from parley.sources.vectors import upsert_vectors

SUCCEEDED, FAILED = "succeeded", "failed"
RETRIES = 3
#: Fixed value: the usage type of indexing.
INDEX_USAGE = "index_embedding"

#: Texts in, (vectors or None, token counts) out; called for up to ``arrow.SLICE_ROWS`` texts.
EmbedFn = Callable[[list[str]], tuple[list, list[int]]]

_DOC_COLUMNS = ["tenant_id", "seq", "point_id", "title", "content", "url", "source", "source_type", "type", "date", "description"]


def hashing_embedder(dims: int = 64) -> EmbedFn:
    """Deterministic stand-in without network: signed feature hashing of words, unit length."""

    def embed_texts(texts: list[str]) -> tuple[list, list[int]]:
        vectors, tokens = [], []
        for body in texts:
            words = re.findall(r"\w+", body.lower())
            tokens.append(len(words))
            hashes = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.int64)
            vector = np.zeros(dims)
            if len(words):
                np.add.at(vector, hashes % dims, np.where((hashes >> 16) & 1, 1.0, -1.0))
            norm = np.linalg.norm(vector)
            vectors.append((vector / norm).astype(np.float32) if norm > 0 else None)
        return vectors, tokens

    return embed_texts


def cms_documents(posts: DataFrame, sites: DataFrame, tags: DataFrame) -> DataFrame:
    made = docs.build_post_docs(posts, sites, tags)
    return made.withColumns({"seq": F.col("id"), "description": F.lit(None).cast("string")}).select(*_DOC_COLUMNS)


def external_documents(pages: DataFrame, url_rows: DataFrame) -> DataFrame:
    made = docs.build_external_docs(pages, url_rows)
    none = F.lit(None).cast("string")
    return made.withColumns({"seq": F.col("id"), "type": none, "date": none}).select(*_DOC_COLUMNS)


def embed(documents: DataFrame, fn: EmbedFn | None = None, retries: int = RETRIES) -> DataFrame:
    """Add embedding, prompt_tokens and status from a batch function; a failed document has a NULL vector.

    Text is title and content, cut to 28 000 characters before it leaves the
    JVM.  A batch that keeps failing is retried document by document with the
    harder cut, so one bad document does not fail its neighbours.
    """
    fn = fn or hashing_embedder()
    body = text.truncate_head_tail(text.embedding_text(F.col("title"), F.col("content")), text.EMBED_MAX_CHARS, "...")
    head, tail = text.RETRY_HEAD_CHARS, text.RETRY_TAIL_CHARS
    schema = T.StructType(
        [
            *documents.schema,
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("prompt_tokens", T.IntegerType()),
        ]
    )

    def one(body: str):
        shorter = body[:head] + "..." + body[-tail:] if len(body) > head else body
        for attempt in (body, shorter):
            try:
                vectors, tokens = fn([attempt])
                return vectors[0], tokens[0]
            except Exception:  # the document is reported as failed
                continue
        return None, 0

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in slices(frames):
            bodies = [body or "" for body in frame.column("_body").to_pylist()]
            for _ in range(retries):
                try:
                    vectors, tokens = fn(bodies)
                    break
                except Exception:  # retried, then document by document
                    continue
            else:
                pairs = [one(body) for body in bodies]
                vectors, tokens = [p[0] for p in pairs], [p[1] for p in pairs]
            out = frame.drop_columns(["_body"])
            vectors = [None if v is None else np.asarray(v, dtype=np.float32) for v in vectors]
            added = [pa.array(vectors, pa.list_(pa.float32())), pa.array([int(t or 0) for t in tokens], pa.int32())]
            yield pa.RecordBatch.from_arrays([*out.columns, *added], names=[*out.schema.names, "embedding", "prompt_tokens"])

    status = F.when(F.col("embedding").isNull(), FAILED).otherwise(SUCCEEDED)
    return documents.withColumn("_body", body).mapInArrow(batches, schema).withColumn("status", status)


def pending(documents: DataFrame, done: DataFrame) -> DataFrame:
    """Documents of an interrupted run that have no finished row yet."""
    return documents.join(done.select("tenant_id", "source_type", "point_id"), ["tenant_id", "source_type", "point_id"], "left_anti")


def run(documents: DataFrame, path: str, run_id: str, fn: EmbedFn | None = None) -> DataFrame:
    """Embed, replace the touched (tenant, source type) partitions, return one status row per document.

    Vectors are computed once and kept in a written table; the collection and
    the status rows both read it.  A partition whose documents all fail is
    emptied.
    """
    embedded = materialize(embed(documents, fn).withColumn("run_id", F.lit(run_id)), "embedded")
    points = embedded.where(F.col("status") == SUCCEEDED).drop("status", "run_id", "prompt_tokens")
    upsert_vectors(points, path, touched=embedded.select("tenant_id", "source_type"))
    return embedded.select("tenant_id", "source_type", "point_id", "run_id", "prompt_tokens", "status")


def index_usage(statuses: DataFrame) -> DataFrame:
    """Tokens of a run as one usage row per tenant and run; runs without tokens give none."""
    used = statuses.groupBy("tenant_id", "run_id").agg(F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"))
    return used.where("prompt_tokens > 0").select(
        "tenant_id", "run_id", F.lit(INDEX_USAGE).alias("usage_type"), "prompt_tokens", F.lit(0).cast("bigint").alias("completion_tokens"), F.col("prompt_tokens").alias("total_tokens")
    )


def reindex(
    documents: DataFrame, path: str, jobs_path: str, run_id: str, tenants: DataFrame, fn: EmbedFn | None = None, usage_path: str | None = None
) -> None:
    """One run over the documents of all given tenants; appends a job row per tenant, and its usage rows.

    A tenant of whose documents none could be embedded has failed.  A run that
    raises leaves failed job rows with the whole error and raises no further: the
    next run simply replaces the partitions again.
    """
    base = tenants.select("tenant_id").withColumn("run_id", F.lit(run_id))
    try:
        statuses = run(documents, path, run_id, fn)
        if usage_path:
            index_usage(statuses).write.mode("append").parquet(usage_path)
        summary = ingest_summary(statuses)
        jobs = base.join(summary, ["tenant_id", "run_id"], "left").na.fill(0, ["total", "succeeded", "failed"])
        lost = (F.col("total") > 0) & (F.col("succeeded") == 0)
        jobs = jobs.withColumns(
            {"status": F.when(lost, "failed").otherwise("completed"), "error": F.when(lost, F.lit("no document could be embedded"))}
        )
    except Exception as exc:  # recorded on the job, as a scheduler expects
        jobs = base.withColumns(
            {n: F.lit(0).cast("bigint") for n in ("total", "succeeded", "failed")}
            | {"status": F.lit("failed"), "error": F.lit(str(exc))}
        )
    progress = F.to_json(
        F.struct(
            F.col("total").alias("total_items"),
            F.col("total").alias("processed_items"),
            F.col("failed").alias("failed_items"),
            F.col("status").alias("status"),
        )
    )
    jobs.withColumn("progress", progress).write.mode("append").parquet(jobs_path)
