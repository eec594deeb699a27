"""Sequential byte algorithms, which SQL cannot express; tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import checksums
from strataform.operators import apply, chunking, matching, profile, recovery, transforms

from .common import registry, table

QUERIES, ORACLE, query = registry()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query()
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.content_chunks(_docs(spark, sf_dir), "doc_id", "text", 256, 1024, 4096)


@query()
def cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that chunk-level deduplication saves."""
    once = cdc_chunks(spark, sf_dir).groupBy("sha1").agg(F.first("length").alias("length"), F.count("*").alias("n"))
    return once.agg(F.sum(F.col("n")).alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum("length").alias("unique_bytes"))


@query()
def journal_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.journal_fragments(_docs(spark, sf_dir), "doc_id", "text", 4)


_FULL = "p.used + r.size + 80 + 4 * p.n >= 65536"


@query(
    "WITH RECURSIVE r AS (SELECT source, doc_id, strlen(text)::BIGINT AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), "
    "p AS (SELECT source, doc_id, size, i, 0::BIGINT AS block, size AS used, 1 AS n FROM r WHERE i = 1 UNION ALL "
    f"SELECT r.source, r.doc_id, r.size, r.i, p.block + ({_FULL})::INT, CASE WHEN {_FULL} THEN r.size ELSE p.used + r.size END, CASE WHEN {_FULL} THEN 1 ELSE p.n + 1 END FROM p JOIN r ON r.source = p.source AND r.i = p.i + 1) "
    "SELECT source, doc_id, size, block FROM p"
)
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return chunking.packed_blocks(rows, "source", "doc_id", "size", 1 << 16)


@query()
def journal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each text's fragments by the whole packing rule, with the votes of their fragments."""
    columns = "block long, fragments long, bytes long, kind long"
    return apply.table_function(_docs(spark, sf_dir), "doc_id", "text", lambda raw: chunking.journal_blocks(raw, 1 << 13, 3), columns)


@query()
def hash_chain_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_stats(matching.hash_chain_matches(_docs(spark, sf_dir), "doc_id", "text"), "doc_id")


@query()
def rolling_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rolling_repeats(_docs(spark, sf_dir), "doc_id", "text")


@query()
def bwt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.round_trip(_docs(spark, sf_dir), "doc_id", "text", transforms.bwt, transforms.unbwt)


@query()
def e8e9_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.round_trip(_docs(spark, sf_dir), "doc_id", "text", transforms.call_addresses, lambda x: transforms.call_addresses(x, False))


@query()
def lz77_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.round_trip(_docs(spark, sf_dir), "doc_id", "text", transforms.lz77, transforms.unlz77)


@query()
def block_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as self-describing blocks under the bit model."""
    return transforms.round_trip(table(spark, sf_dir, "benchmark"), "item_id", "text", lambda x: transforms.compress_block(x, "cm"), lambda x: transforms.read_block(x)[0])


@query()
def recover_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as archives of 4 KiB blocks, the third damaged, and what reading makes of them: 'ok',
    'corrupted', and 'recovered' for the first good block after a bad one."""

    def archive(raw: bytes) -> list[tuple]:
        return transforms.recover(transforms.blocks_of(raw, 4096, "store", 2))

    rows = apply.table_function(_docs(spark, sf_dir), "doc_id", "text", archive, "n long, offset long, good boolean, output_bytes long")
    return recovery.resync(rows, "doc_id", "n", "good")


@query()
def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.report_json(profile.profile(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


@query()
def crc32_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    return _docs(spark, sf_dir).select("doc_id", checksums.crc32(raw).alias("crc32"), checksums.crc32c(raw).alias("crc32c"))
