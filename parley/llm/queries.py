"""Registered queries of this subpackage and their SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    decontamination,
    fixity,
    language,
    licences,
    mixing,
    quality,
    repetition,
    resharding,
    rotated_codes,
    sharded_lloyd,
    signature_trees,
    substring,
    whitening,
)

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark, sf_dir):
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_jaccard(spark, sf_dir):
    return signature_trees.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op3_substrings(spark, sf_dir):
    return substring.digest(substring.remove_repeats(_table(spark, sf_dir, "documents"), window=13))


def op4_language(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "documents"))


def op5_licences(spark, sf_dir):
    return licences.scan(_table(spark, sf_dir, "documents"))


def op6_reshard(spark, sf_dir):
    placed = resharding.reshard(_table(spark, sf_dir, "documents"), SHARDS, F.pmod(F.xxhash64("source"), F.lit(6)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op7_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontaminate(spark, sf_dir):
    return decontamination.digest(decontamination.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the pages with changed, lost and added records, as bad disks and stray writes would leave it."""
    kept = pages.where("page_id is null or page_id % 103 <> 5")
    changed = kept.withColumn("html", F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("\x00"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    stray = pages.where("page_id % 107 = 3").withColumn("page_id", F.col("page_id") + 1_000_000_007)
    return changed.unionByName(stray)


def op9_fixity(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return fixity.compare(pages, damaged(pages))


def op10_repetition(spark, sf_dir):
    measured = repetition.repetition_rules(_table(spark, sf_dir, "documents"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"
    )


def op11_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_near_vectors(spark, sf_dir):
    return rotated_codes.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op13_clusters(spark, sf_dir):
    return sharded_lloyd.cluster(_table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_mix,
    op2_jaccard,
    op3_substrings,
    op4_language,
    op5_licences,
    op6_reshard,
    op7_quality,
    op8_decontaminate,
    op9_fixity,
    op10_repetition,
    op11_whitening,
    op12_near_vectors,
    op13_clusters,
)
QUERIES = {f.__name__: f for f in _ALL}

_GAPS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP8_SQL = f"""
with d as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAPS}') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAPS}') as w from benchmark),
g as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram
    from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
x as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as gram
    from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from g))),
h as (select r, x.k, i, item_id from x join g using (k, gram)),
p as (select r, count(distinct pos) as n_hit from (select r, unnest(range(i, i + k)) as pos from h) group by 1),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from h) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (r) left join t using (r)
"""

OP9_SQL = r"""
with base as (select page_id, url, html, page_id // 1024 as file,
    octet_length(encode(format('WARC/1.1{0}WARC-Type: resource{0}WARC-Record-ID: <urn:page:{1}>{0}WARC-Target-URI: {2}{0}Content-Type: text/html{0}Content-Length: {3}{0}{0}',
      chr(13) || chr(10), page_id::varchar, coalesce(url, ''), octet_length(encode(coalesce(html, '')))::varchar))) + octet_length(encode(coalesce(html, ''))) + 4 as length from pages),
stray as (select (page_id + 1000000007) as page_id, file,
    length + (strlen((page_id + 1000000007)::varchar) - strlen(page_id::varchar)) as length from base where page_id % 107 = 3),
laid as (select *, sum(length) over (partition by file order by page_id) - length as o from base),
laid2 as (select page_id, page_id // 1024 as file, length, sum(length) over (partition by page_id // 1024 order by page_id) - length as o from stray)
select file, page_id, case when page_id % 103 = 5 then 'missing' else 'changed' end as kind, o::bigint as "offset", length::bigint as length
from laid where page_id % 103 = 5 or page_id % 101 = 7
union all select file, page_id, 'extra', o::bigint, length::bigint from laid2
"""

ORACLES = {"op5_licences": licences.oracle(), "op8_decontaminate": OP8_SQL, "op9_fixity": OP9_SQL}
