"""Adding to a store, pointer arrays, unions of catalogs, listings, numbers: one query an operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import numbers, text
from strataform.operators import catalog as C
from strataform.operators import dedup as D
from strataform.operators import profile as P
from strataform.operators import strategy as S
from strataform.sources import changelog, files

from .common import registry, table

QUERIES, ORACLE, query = registry()

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"
_STORE = f"WITH {_LINES}, u AS (SELECT sha1(body) AS sha1, MIN({{'doc_id': doc_id, 'line': line}}) AS p FROM l WHERE doc_id % 3 <> 0 GROUP BY sha1(body)), s AS (SELECT sha1, row_number() OVER (ORDER BY p.doc_id, p.line) AS frag_id FROM u)"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.lines(table(spark, sf_dir, "documents").where("doc_id % 3 <> 0"))
    return D.numbered(D.first_occurrence(kept), "doc_id", ["line"], "frag_id").select("sha1", "frag_id")


_NEW = """, n AS (SELECT doc_id, line, sha1(body) AS sha1 FROM l WHERE {new}), f AS (SELECT sha1, MIN({{'doc_id': doc_id, 'line': line}}) AS p FROM n WHERE sha1 NOT IN (SELECT sha1 FROM s) GROUP BY sha1),
  g AS (SELECT sha1, row_number() OVER (ORDER BY p.doc_id, p.line) + (SELECT COALESCE(MAX(frag_id), 0) FROM s) AS frag_id FROM f),
  x AS (SELECT n.doc_id, n.line, n.sha1, COALESCE(s.frag_id, g.frag_id)::BIGINT AS frag_id, s.frag_id IS NOT NULL AS known FROM n LEFT JOIN s USING (sha1) LEFT JOIN g USING (sha1))"""


@query(_STORE + _NEW.format(new="doc_id % 3 = 0") + " SELECT doc_id, line::INT AS line, sha1, frag_id, known FROM x")
def dedup_against_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a third of the documents against a store of the others' lines."""
    return D.lookup(D.lines(table(spark, sf_dir, "documents").where("doc_id % 3 = 0")), _store(spark, sf_dir))


_DISK = "d AS (SELECT doc_id, 'd' || doc_id AS path, doc_id + (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS date, strlen(text) AS size FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT 'd' || doc_id AS path, doc_id AS date, strlen(text) AS size FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT COALESCE(a.path, d.path) AS path, d.doc_id, CASE WHEN a.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted' WHEN a.date = d.date AND a.size = d.size THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN d ON a.path = d.path)"


@query(f"{_STORE}, {_DISK}{_NEW.format(new="doc_id IN (SELECT doc_id FROM c WHERE change IN ('added', 'changed'))")} SELECT path, change, array_to_string(p.ptr, ',') AS ptr, COALESCE(p.fragments, 0) AS fragments, COALESCE(p.known, 0) AS known FROM c LEFT JOIN (SELECT doc_id, list(frag_id ORDER BY line) AS ptr, COUNT(*) AS fragments, count_if(known)::BIGINT AS known FROM x GROUP BY doc_id) p USING (doc_id) WHERE change <> 'unchanged'")
def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, difference, fragments, lookup: what a transaction would write."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("size"))
    disk = files.where("doc_id % 5 <> 0").withColumn("date", F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    state = files.where("doc_id % 3 <> 0").select("path", F.col("doc_id").alias("date"), "size")
    out = D.ingest(disk, state, _store(spark, sf_dir))
    return out.withColumn("ptr", F.concat_ws(",", F.transform("ptr", lambda x: x.cast("string")))).withColumn("ptr", F.when(F.col("fragments") > 0, F.col("ptr")))


_FILES = "WITH f AS (SELECT l_orderkey AS file_id, list(l_partkey + 1 ORDER BY l_linenumber, l_partkey) AS ptr FROM lineitem GROUP BY l_orderkey)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber", (F.col("l_partkey") + 1).alias("frag_id"))
    return C.pointer_arrays(p, "file_id", ["l_linenumber"])


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("frag_id"), F.when(F.col("p_partkey") % 97 == 0, -1).otherwise(F.col("p_size")).cast("long").alias("usize"))


@query(f"{_FILES}, p AS (SELECT file_id, unnest(ptr) AS frag_id FROM f WHERE file_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT file_id, CASE WHEN MIN(usize) < 0 THEN -1 ELSE SUM(usize) END::BIGINT AS size, COUNT(*) AS fragments FROM p JOIN (SELECT p_partkey + 1 AS frag_id, CASE WHEN p_partkey % 97 = 0 THEN -1 ELSE p_size END AS usize FROM part) USING (frag_id) GROUP BY file_id")
def selected_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes through pointer arrays, of selected files only."""
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file_id"))
    return C.dereferenced(_files(spark, sf_dir), _fragments(spark, sf_dir), "file_id", wanted)


@query(f"{_FILES} SELECT p_partkey + 1 AS frag_id, file_id, len(ptr) AS n FROM part JOIN f ON ptr[1] = p_partkey + 1")
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_pointer(_fragments(spark, sf_dir), _files(spark, sf_dir)).select("frag_id", "file_id", F.size("ptr").cast("long").alias("n"))


_INDEX = "WITH o AS (SELECT 'c' || c_custkey AS path, c_custkey AS date, c_nationkey AS attr, [c_custkey, c_nationkey] AS ptr FROM customer WHERE c_custkey % 4 <> 0), n AS (SELECT 'c' || c_custkey AS path, c_custkey + (CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) AS date, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS attr, CASE WHEN c_custkey % 11 = 0 THEN [c_custkey] ELSE [c_custkey, c_nationkey] END AS ptr FROM customer WHERE c_custkey % 6 <> 0)"


@query(f"{_INDEX} SELECT COALESCE(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'delete' WHEN o.path IS NULL OR o.date <> n.date OR (o.attr <> 0 AND o.attr IS DISTINCT FROM n.attr) OR o.ptr <> n.ptr THEN 'update' ELSE 'none' END AS write FROM o FULL JOIN n ON o.path = n.path")
def index_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey"))
    path, nation = F.concat(F.lit("c"), F.col("key").cast("string")).alias("path"), F.col("c_nationkey").cast("long")
    whole = F.array("key", nation)
    old = c.where("key % 4 <> 0").select(path, F.col("key").alias("date"), nation.alias("attr"), whole.alias("ptr"))
    new = c.where("key % 6 <> 0").select(path, (F.col("key") + F.when(F.col("key") % 5 == 0, 1).otherwise(0)).alias("date"), F.when(F.col("key") % 3 == 0, nation + 1).otherwise(nation).alias("attr"), F.when(F.col("key") % 11 == 0, F.array("key")).otherwise(whole).alias("ptr"))
    return C.index_writes(old, new)


_CHANGED = "replace(text, ' the ', ' THE ')"


@query(f"SELECT 'd' || doc_id AS path, doc_id % 5 <> 0 AND (doc_id % 2 = 1 OR text = {_CHANGED}) AS equal FROM documents")
def equal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived texts against what is on disk: a fifth is missing, every second one has words in capitals. Fragments are lines."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")

    def hashed(rows: DataFrame) -> DataFrame:
        parts = F.split("text", "\n")
        return rows.select("path", F.transform(parts, lambda x: F.sha1(F.encode(x, "UTF-8"))).alias("hashes"), F.transform(parts, F.octet_length).alias("usizes"))

    disk = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" the "), F.lit(" THE "))).otherwise(F.col("text")))
    return C.equal_contents(hashed(docs), hashed(disk))


_TALK = "WITH s AS (SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS carried FROM conversations), t AS (SELECT conv_id || '/' || carried AS path, list(turn ORDER BY turn) AS ptr FROM s WHERE carried IS NOT NULL GROUP BY 1)"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string"))).alias("name"), F.col("turn").alias("frag_id"))
    return C.appended(rows, "conv_id", "turn", "name", "frag_id")


@query(f"{_TALK} SELECT path, len(ptr) AS fragments, ptr[1]::BIGINT AS first, -1::BIGINT AS size FROM t")
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(spark, sf_dir).select("path", F.size("ptr").cast("long").alias("fragments"), F.element_at("ptr", 1).alias("first"), "size")


@query(f"{_TALK} SELECT path, -1::BIGINT AS size, NULL::BIGINT AS version FROM t UNION ALL SELECT 'u' || user_id, NULL, MAX((date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::BIGINT) FROM events GROUP BY user_id")
def union_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a journal and of a stream in one catalog."""
    log = changelog.from_events(table(spark, sf_dir, "events"))
    return C.union(_talk(spark, sf_dir).select("path", "size"), C.latest_state(log, live_only=False).select("path", "version")).select("path", "size", "version")


@query("SELECT DISTINCT o_custkey AS cust FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def unchanged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intersection of two key sets."""
    here = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cust"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust")).intersect(here)


_PATHS = "WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.' || lang AS path, strlen(text) AS size FROM documents)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))).alias("path"), F.octet_length("text").alias("size"))


@query(_PATHS + ", g AS (SELECT path, size, regexp_extract(path, '[^.]*$') AS ext, LEAST(size // 16384, 16777215) AS bucket FROM f) SELECT path, row_number() OVER (ORDER BY ext, bucket DESC, path) AS place FROM g")
def add_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_order(_paths(spark, sf_dir)).select("path", "place")


@query(_PATHS + " SELECT path, size FROM f ORDER BY path")
def list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.listing(_paths(spark, sf_dir)).select("path", "size")


@query(_PATHS + " SELECT path, regexp_extract(path, '^(.*/)?') AS folder, 'in/' || path AS appended FROM f")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", text.folder(F.col("path")).alias("folder"), text.append_path("in", F.col("path")).alias("appended"))


@query(_PATHS + " SELECT path FROM f WHERE regexp_full_match(path, 'src2/en(/.*)?', 's')")
def renamed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is selected under the new name of a pattern."""
    return _paths(spark, sf_dir).where(text.selected(F.col("path"), ["src1"], renamed=["src2/en"])).select("path")


@query(_PATHS + " SELECT p.name, COUNT(*) AS files, SUM(size)::BIGINT AS bytes FROM f JOIN (SELECT DISTINCT lang || '*' AS name, '^.*/' || lang || '/.*$' AS pattern FROM documents) p ON regexp_matches(path, pattern) GROUP BY p.name")
def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths against a table of patterns, one a language."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    patterns = langs.select(F.concat("lang", F.lit("*")).alias("name"), F.concat(F.lit("^.*/"), "lang", F.lit("/.*$")).alias("pattern"))
    met = _paths(spark, sf_dir).join(F.broadcast(patterns), F.expr("path rlike pattern"))
    return met.groupBy("name").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


@query(_PATHS + ", b AS (SELECT path, size, unnest(range(1, 1 + ((size + 1023) // 1024))) AS part FROM f WHERE size > 0) SELECT path || '.part' || part AS name, ((part - 1) * 1024)::BIGINT AS \"offset\", LEAST(1024, size - (part - 1) * 1024)::BIGINT AS length FROM b")
def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fixed_blocks(_paths(spark, sf_dir), "size", 1024, "path").select("name", "offset", "length")


@query("SELECT source, ('0x' || b)::INT AS byte, COUNT(*) AS n FROM (SELECT source, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY source, b")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.byte_counts(table(spark, sf_dir, "documents"), "source", "text")


@query("SELECT l_linenumber AS level, round(AVG(CASE WHEN l_tax > 0 THEN l_extendedprice / 1e6 / l_tax ELSE 0 END), 6) AS comp_mbps, round(AVG(CASE WHEN l_discount > 0 THEN l_extendedprice / 1e6 / l_discount ELSE 0 END), 6) AS decomp_mbps, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber")
def level_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rates of runs by level; a line item stands for a run."""
    li = table(spark, sf_dir, "lineitem")
    rate = lambda seconds: S.throughput(F.col("l_extendedprice"), F.col("l_quantity"), F.col(seconds))["mbps"]
    out = S.averages(li.select(F.col("l_linenumber").alias("level"), rate("l_tax").alias("comp_mbps"), rate("l_discount").alias("decomp_mbps")))
    return out.select("level", F.round("comp_mbps", 6).alias("comp_mbps"), F.round("decomp_mbps", 6).alias("decomp_mbps"), "n")


@query("SELECT l_orderkey AS run, l_linenumber AS line, CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity ELSE 0 END AS ratio, CASE WHEN l_tax > 0 THEN l_extendedprice / 1e6 / l_tax ELSE 0 END AS mbps, l_suppkey AS s FROM lineitem")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = S.throughput(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line"), *[c.alias(k) for k, c in rates.items()], F.col("l_suppkey").alias("s"))


@query("SELECT p_partkey AS k, length(bin(p_partkey))::INT * (p_partkey > 0)::INT AS bits, bit_count(p_partkey)::INT AS ones, LEAST(4095, GREATEST(0, floor(4096 / (1 + exp(-(p_size * 40 - 1000) / 256.0)))))::BIGINT AS squashed, ((p_partkey + p_size + 512) * 773) % 4294967296 AS hashed, xor(p_partkey, p_partkey >> 16) & 65535 AS folded FROM part")
def number_tricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), numbers.bit_length(k).alias("bits"), numbers.ones(k).alias("ones"), numbers.squash((s * 40 - 1000).cast("double")).alias("squashed"), numbers.context_hash(k, s).alias("hashed"), numbers.hash4(k).alias("folded"),
    )


@query("SELECT doc_id, (list_sum(list_transform(range(0, 4), lambda i: (('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2])::BIGINT) << (8 * i))))::BIGINT AS word FROM documents WHERE strlen(text) >= 4")
def little_endian_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    rows = table(spark, sf_dir, "documents").where(F.octet_length("text") >= 4)
    return rows.select("doc_id", numbers.little_endian(raw, 0, 4).alias("word"))


@query("SELECT reason, COUNT(*) AS n FROM (SELECT CASE WHEN strlen(text) > 2500 THEN 'fragment' WHEN doc_id % 9 = 0 THEN 'negative' ELSE 'sound' END AS reason FROM documents) GROUP BY reason")
def permissive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that break a limit are set aside with their reasons; the scan goes on."""
    size = F.octet_length("text").cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(size > 2500, F.lit(1 << 31)).when(F.col("doc_id") % 9 == 0, -2).otherwise(size).alias("usize"))
    good, bad = changelog.permissive(rows, changelog.violations(F.col("doc_id").cast("string"), F.lit(0), F.col("usize")))
    both = good.select(F.lit("sound").alias("reason")).unionByName(bad.select(F.element_at("reasons", 1).alias("reason")))
    return both.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT 'u' || user_id AS path, NULL::DOUBLE AS attr, COUNT(*) AS records FROM events GROUP BY user_id")
def no_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog.from_events(table(spark, sf_dir, "events")).withColumn("attr", F.lit(None).cast("double"))
    return log.groupBy("path").agg(F.max("attr").alias("attr"), F.count("*").alias("records"))


@query("SELECT (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::BIGINT AS version, SUM(strlen(props))::BIGINT AS data_bytes, SUM(8 + 4 * strlen(event_type))::BIGINT AS index_bytes FROM events GROUP BY 1")
def version_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of data and of index that each transaction added."""
    e = table(spark, sf_dir, "events")
    day = (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("version")
    return e.groupBy(day).agg(F.sum(F.octet_length("props")).cast("long").alias("data_bytes"), F.sum(8 + 4 * F.octet_length("event_type")).cast("long").alias("index_bytes"))


@query()
def directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small tables' files as a directory scan reads them."""
    out = files.scan(spark, sf_dir, recursive=True, glob="[nr]*.parquet")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", F.sha1("content").alias("sha1"))


@query()
def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded records of every class, as content to analyse."""
    return files.corpus(spark, 200).select("kind", "seq", F.octet_length("content").alias("size"), F.sha1("content").alias("sha1"))
