"""Deduplicated storage: fragments, pointers, blocks, restore, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import catalog as C
from strataform.operators import dedup as D
from strataform.operators import restore as R

from .common import registry, table

QUERIES, ORACLE, query = registry()

_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), u AS (SELECT sha1(body) AS sha1, MAX(strlen(body))::BIGINT AS usize, COUNT(*) AS copies, MIN({'doc_id': doc_id, 'line': line}) AS p FROM l GROUP BY sha1(body))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lines(table(spark, sf_dir, "documents"))


@query(f"{_LINES} SELECT sha1, usize, copies, p.doc_id AS doc_id, p.line::INT AS line FROM u")
def sha1_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_occurrence(_lines(spark, sf_dir))


@query(f"{_LINES} SELECT sha1, row_number() OVER (ORDER BY p.doc_id, p.line) AS frag_id FROM u")
def fragment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.numbered(D.first_occurrence(_lines(spark, sf_dir)), "doc_id", ["line"], "frag_id").select("sha1", "frag_id")


_SUM = "SUM(usize * n)::BIGINT AS total_bytes, SUM(usize)::BIGINT AS unique_bytes, SUM(n)::BIGINT AS fragments, COUNT(*) AS unique_fragments, round(CASE WHEN SUM(usize) > 0 THEN SUM(usize * n)::DOUBLE / SUM(usize) ELSE 1.0 END, 6) AS ratio"


@query(f"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS body FROM documents), g AS (SELECT body, strlen(body) AS usize, COUNT(*) AS n FROM l GROUP BY body) SELECT {_SUM} FROM g")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(_lines(spark, sf_dir), [])


@query(f"WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS body FROM documents), g AS (SELECT source, body, strlen(body) AS usize, COUNT(*) AS n FROM l GROUP BY ALL) SELECT source, {_SUM} FROM g GROUP BY source")
def dedup_ratio_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("body")), ["source"])


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents")
def sha256_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(raw, 256).alias("sha256"), F.sha1(raw).alias("sha1"))


@query("SELECT sha1(text) AS sha1, COUNT(*) AS copies, MIN(doc_id) AS first_doc FROM documents GROUP BY sha1(text) HAVING COUNT(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy(F.sha1(F.encode("text", "UTF-8")).alias("sha1")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return g.where("copies > 1")


def _pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") + 1).alias("frag_id"), "l_linenumber", "l_suppkey", "l_extendedprice")


def _fragments(spark: SparkSession, sf_dir: str, unknown: bool = True) -> DataFrame:
    size = F.when(F.col("p_partkey") % 97 == 0, -1).otherwise(F.col("p_size")) if unknown else F.col("p_size")
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("frag_id"), size.cast("long").alias("usize"))


_PTR = "WITH p AS (SELECT l_orderkey AS file_id, l_partkey + 1 AS frag_id, l_linenumber, l_suppkey, l_extendedprice FROM lineitem), f AS (SELECT p_partkey + 1 AS frag_id, CASE WHEN p_partkey % 97 = 0 THEN -1 ELSE p_size END::BIGINT AS usize, p_size::BIGINT AS known FROM part), s AS (SELECT file_id, CASE WHEN MIN(usize) < 0 THEN -1 ELSE SUM(usize) END::BIGINT AS size, COUNT(*) AS fragments FROM p JOIN f USING (frag_id) GROUP BY file_id)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sizes(_pointers(spark, sf_dir), _fragments(spark, sf_dir), "file_id")


@query(f"{_PTR} SELECT * FROM s")
def deref_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir)


@query(f"{_PTR} SELECT 'o' || file_id AS path, size FROM s ORDER BY size DESC, path LIMIT 20")
def list_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sizes(spark, sf_dir).select(F.concat(F.lit("o"), F.col("file_id").cast("string")).alias("path"), "size")
    return C.top_n(files, 20)


@query(f"{_PTR} SELECT (SELECT COUNT(DISTINCT o_orderdate) FROM orders)::BIGINT AS versions, (SELECT COUNT(*) FROM orders)::BIGINT AS files, (SELECT COUNT(*) FROM f)::BIGINT AS fragments, (SELECT SUM(size) FROM s WHERE size >= 0)::BIGINT AS bytes")
def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").agg(F.countDistinct("o_orderdate").alias("versions"), F.count("*").alias("files"))
    f = _fragments(spark, sf_dir).agg(F.count("*").alias("fragments"))
    s = _sizes(spark, sf_dir).where("size >= 0").agg(F.sum("size").alias("bytes"))
    key = F.lit(1).alias("k")  # one row each
    return o.select("*", key).join(f.select("*", key), "k").join(s.select("*", key), "k").drop("k")


@query(f"{_PTR} SELECT file_id, frag_id, row_number() OVER w AS pos, COALESCE(SUM(known) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM p JOIN f USING (frag_id) WINDOW w AS (PARTITION BY file_id ORDER BY l_linenumber, frag_id, l_suppkey, l_extendedprice)")
def fragment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _pointers(spark, sf_dir).join(_fragments(spark, sf_dir, False), "frag_id")
    return R.offsets(j, "file_id", ["l_linenumber", "frag_id", "l_suppkey", "l_extendedprice"]).select("file_id", "frag_id", "pos", "offset")


@query("WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d) SELECT user_id, MIN(day)::INT AS first, MAX(day)::INT AS last, COUNT(*) AS n FROM g GROUP BY user_id, k")
def coalesce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day")).distinct()
    return R.runs(d, "user_id", "day")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 64).alias("block_id")).agg(F.min("p_partkey").alias("start"), F.count("*").alias("n"))


_JOIN = "SELECT l.l_orderkey AS file_id, l.l_partkey AS frag_id, l.l_linenumber AS line, b.block_id FROM lineitem l ASOF JOIN (SELECT p_partkey // 64 AS block_id, MIN(p_partkey) AS start FROM part GROUP BY 1) b ON l.l_partkey >= b.start"


@query(_JOIN)
def block_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("frag_id"), F.col("l_linenumber").alias("line"))
    return R.range_join(points, _blocks(spark, sf_dir).select("block_id", "start"), "frag_id", "start", 64).select("file_id", "frag_id", "line", "block_id")


@query(f"SELECT block_id, COUNT(DISTINCT file_id)::BIGINT AS files, MIN(file_id) AS first_file, MAX(file_id) AS last_file FROM ({_JOIN}) GROUP BY block_id")
def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = block_range_join(spark, sf_dir).select("block_id", "file_id").distinct()
    return pairs.groupBy("block_id").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


@query("SELECT p_partkey // 64 AS block_id, COUNT(*) AS frags, (8 + SUM(p_size + 4))::BIGINT AS bsize FROM part GROUP BY 1")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 64).alias("block_id"), F.col("p_size").cast("long").alias("usize"))
    return R.block_sizes(p)


@query("WITH b AS (SELECT p_partkey // 64 AS block_id, MIN(p_partkey) AS start, CASE (p_partkey // 64) % 7 WHEN 3 THEN 0 WHEN 5 THEN COUNT(*) - 1 WHEN 6 THEN COUNT(*) + 1 ELSE COUNT(*) END AS n FROM part GROUP BY 1) SELECT start, n, CASE WHEN n <= 0 THEN 'empty' WHEN nx IS NULL THEN 'last' WHEN start + n = nx THEN 'ok' WHEN start + n < nx THEN 'gap' ELSE 'overlap' END AS status FROM (SELECT *, lead(start) OVER (ORDER BY start) AS nx FROM b)")
def sequence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("block_id") % 7
    n = F.when(kind == 3, 0).when(kind == 5, F.col("n") - 1).when(kind == 6, F.col("n") + 1).otherwise(F.col("n"))
    return C.sequence_checks(_blocks(spark, sf_dir).select("start", n.alias("n"))).select("start", "n", "status")


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, true AS ok FROM documents")
def reassemble_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sums = docs.select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("was"))
    built = R.reassembled(D.lines(docs)).select("doc_id", "n_lines", F.sha1(F.encode("rebuilt", "UTF-8")).alias("now"))
    return sums.join(built, "doc_id").select("doc_id", "n_lines", (F.col("was") == F.col("now")).alias("ok"))


@query("WITH d AS (SELECT source, doc_id, COUNT(*) OVER (PARTITION BY sha1(text)) AS copies FROM documents) SELECT source, COUNT(*) AS files, count_if(copies > 1)::BIGINT AS duplicated FROM d GROUP BY source")
def duplicated_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.sha1(F.encode("text", "UTF-8")).alias("h"))
    each = docs.groupBy("h", "source").agg(F.count("*").alias("n"))
    copies = docs.groupBy("h").agg(F.count("*").alias("copies"))
    return each.join(copies, "h").groupBy("source").agg(F.sum("n").alias("files"), F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("n"))), F.lit(0)).alias("duplicated"))


@query("SELECT source, COUNT(*) AS files, count_if(doc_id % 9 <> 0)::BIGINT AS ok, count_if(doc_id % 9 = 0)::BIGINT AS damaged FROM documents GROUP BY source")
def integrity_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contents, every ninth damaged, against the hashes that were recorded."""
    docs = table(spark, sf_dir, "documents")
    recorded = docs.select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("was"))
    stored = docs.select("doc_id", "source", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("body"))
    return R.verified(stored, recorded, "doc_id", "body").groupBy("source").agg(F.count("*").alias("files"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("damaged"))


@query("SELECT doc_id, doc_id % 4 = 0 AND doc_id % 50 > 0 AS sparse FROM documents")
def sparse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of zero bytes that a restore need not write."""
    zeros = F.unhex(F.repeat(F.lit("00"), (F.col("doc_id") % 50).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, zeros).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return R.zero_runs(rows, "content").select("doc_id", "sparse")


@query(f"{_PTR} SELECT to_json({{'versions': (SELECT COUNT(DISTINCT o_orderdate) FROM orders), 'files': (SELECT COUNT(*) FROM orders), 'fragments': (SELECT COUNT(*) FROM f), 'bytes': (SELECT SUM(size)::BIGINT FROM s WHERE size >= 0)}})::VARCHAR AS report")
def info_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals as one JSON object."""
    return archive_totals(spark, sf_dir).select(F.to_json(F.struct("versions", "files", "fragments", "bytes")).alias("report"))
