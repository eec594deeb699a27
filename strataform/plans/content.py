"""What content is made of: byte statistics, classes, methods, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import profile as P
from strataform.operators import strategy as S

from .common import registry, table

QUERIES, ORACLE, query = registry()

# SQL building blocks over a relation src(id, body)
_BYTES = """
b AS (SELECT id, unnest(regexp_extract_all(hex(encode(body)), '..')) AS x, generate_subscripts(regexp_extract_all(hex(encode(body)), '..'), 1) - 1 AS i FROM src),
h AS (SELECT id, ('0x' || x)::INT AS v, COUNT(*) AS k FROM b GROUP BY ALL),
r AS (SELECT id, SUM((x = p)::INT) AS runs FROM (SELECT id, x, lag(x) OVER (PARTITION BY id ORDER BY i) AS p FROM b) GROUP BY id),
t AS (SELECT id, SUM(k) AS top8 FROM (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY k DESC, v) AS q FROM h) WHERE q <= 8 GROUP BY id),
n0 AS (SELECT id, SUM(k)::BIGINT AS n FROM h GROUP BY id),
m AS (
  SELECT h.id, MAX(n) AS n, -SUM((k::DOUBLE / n) * log2(k::DOUBLE / n)) AS e, COUNT(*) AS distinct_bytes, MAX(n)::DOUBLE AS d,
    SUM(CASE WHEN v BETWEEN 32 AND 126 OR v IN (9, 10, 13) THEN k ELSE 0 END) AS printable, SUM(CASE WHEN v = 0 THEN k ELSE 0 END) AS zeros,
    SUM(CASE WHEN v = 10 THEN k ELSE 0 END) AS newlines, SUM(CASE WHEN v IN (91, 93, 123, 125) THEN k ELSE 0 END) AS braces,
    SUM(CASE WHEN v = 34 THEN k ELSE 0 END) AS quotes, SUM(CASE WHEN v = 44 THEN k ELSE 0 END) AS commas,
    SUM(CASE WHEN v IN (60, 62) THEN k ELSE 0 END) AS angles, SUM(CASE WHEN v IN (123, 125, 40, 41, 61, 59) THEN k ELSE 0 END) AS code, SUM(v * k)::BIGINT AS sum_bytes
  FROM h JOIN n0 USING (id) GROUP BY h.id),
sig AS (SELECT id, hex(encode(body)) AS hx FROM src),
a AS (
  SELECT src.id, COALESCE(n, 0) AS n, COALESCE(e, 0) AS e, COALESCE(distinct_bytes, 0) AS distinct_bytes, COALESCE(printable, 0) / COALESCE(d, 1) AS pf, COALESCE(zeros, 0) / COALESCE(d, 1) AS zf,
    COALESCE(runs, 0) / COALESCE(d, 1) AS rf, COALESCE(newlines, 0) / (COALESCE(d, 1) / 1024.0::DOUBLE) AS nl, COALESCE(top8, 0) / COALESCE(d, 1) AS tf, COALESCE(braces, 0) / COALESCE(d, 1) AS bf,
    COALESCE(quotes, 0) / COALESCE(d, 1) AS qf, COALESCE(commas, 0) / COALESCE(d, 1) AS cf, COALESCE(angles, 0) / COALESCE(d, 1) AS af, COALESCE(code, 0) / COALESCE(d, 1) AS kf, COALESCE(sum_bytes, 0) AS sum_bytes, COALESCE(top8, 0)::BIGINT AS top8,
    CASE WHEN hx LIKE '4D5A%' THEN 'PE' WHEN hx LIKE '7F454C46%' THEN 'ELF' WHEN hx LIKE '1F8B%' THEN 'gzip' WHEN hx LIKE '789C%' THEN 'zlib' WHEN hx LIKE '89504E470D0A1A0A%' THEN 'png' WHEN hx LIKE 'FFD8FF%' THEN 'jpg'
      WHEN hx LIKE '25504446%' THEN 'pdf' WHEN hx LIKE '504B0304%' THEN 'zip' WHEN hx LIKE '377ABCAF271C%' THEN '7z' WHEN hx LIKE '7573746172%' THEN 'tar' WHEN hx LIKE '5D0000%' THEN 'lzma' ELSE '' END AS subtype
  FROM src LEFT JOIN m USING (id) LEFT JOIN r USING (id) LEFT JOIN t USING (id) JOIN sig USING (id)),
c AS (SELECT *, CASE
    WHEN n = 0 THEN 'UNKNOWN' WHEN subtype <> '' THEN 'EXECUTABLE' WHEN e >= 7.85 AND distinct_bytes >= 200 THEN 'RANDOM' WHEN rf >= 0.3 OR (e < 2 AND tf >= 0.7) THEN 'REPETITIVE'
    WHEN pf >= 0.85 OR (pf >= 0.75 AND nl > 8) THEN CASE WHEN bf >= 0.03 AND qf >= 0.01 AND nl < 15 THEN 'JSON' WHEN af >= 0.03 THEN 'XML' WHEN nl > 40 AND e < 5.5 THEN 'LOG'
      WHEN cf >= 0.01 AND nl > 10 AND e < 5 THEN 'CSV' WHEN pf >= 0.75 AND nl > 8 AND kf >= 0.02 THEN 'SOURCE_CODE' ELSE 'TEXT' END
    WHEN zf < 0.35 THEN 'BINARY' WHEN distinct_bytes < 160 THEN 'DATABASE' ELSE 'MIXED' END AS cls,
    CASE WHEN n = 0 OR e <= 0 THEN 1.0::DOUBLE ELSE LEAST(1000.0::DOUBLE, GREATEST(1.0::DOUBLE, 8.0::DOUBLE / e * CASE WHEN rf > 0.2 THEN 1 + (rf - 0.2::DOUBLE) * 4 ELSE 1.0::DOUBLE END)) END AS ratio FROM a)
"""


def _with(src: str) -> str:
    return f"WITH src AS ({src}), {_BYTES}"


_DOCS = "SELECT doc_id AS id, text AS body FROM documents"


@query(
    _with(_DOCS)
    + """SELECT id AS doc_id, n AS sample_size, round(e, 6) AS entropy, distinct_bytes, round(pf, 6) AS printable_fraction, round(zf, 6) AS zero_fraction, round(rf, 6) AS run_fraction,
  round(nl, 6) AS newline_density, round(tf, 6) AS top8_fraction, cls, subtype, round(ratio, 6) AS estimated_ratio, (e >= 7.9 OR cls = 'RANDOM') AS incompressible FROM c"""
)
def content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    _with(
        "SELECT 'd' || doc_id AS id, text AS body FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT 'e' || event_id, props FROM events"
    )
    + "SELECT CASE id[1] WHEN 'd' THEN 'documents' WHEN 'p' THEN 'pages' WHEN 'c' THEN 'conversations' ELSE 'events' END AS source_table, cls, COUNT(*) AS n FROM c GROUP BY ALL"
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, content in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"), ("events", "event_id", "props")):
        m = P.measured(table(spark, sf_dir, name), key, content)
        one = m.groupBy(P.content_class().alias("cls")).agg(F.count("*").alias("n")).select(F.lit(name).alias("source_table"), "cls", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(_with(_DOCS) + "SELECT id AS doc_id, top8, n AS sample_size FROM a")
def top8_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.measured(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "top8", "sample_size")


@query(
    _with(_DOCS)
    + """, w AS (SELECT id, i % 8 AS p, bit_xor(('0x' || x)::INT) AS v FROM b GROUP BY ALL), f AS (SELECT id, string_agg(printf('%02x', COALESCE(v, 0)), '' ORDER BY q.p) AS fold_xor FROM (SELECT id, unnest(range(8)) AS p FROM src) q LEFT JOIN w USING (id, p) GROUP BY id)
SELECT id AS doc_id, sum_bytes, fold_xor FROM a JOIN f USING (id)"""
)
def byte_xor_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.measured(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "sum_bytes", "fold_xor")


@query(_with("SELECT page_id AS id, html AS body FROM pages") + "SELECT id AS page_id, round(ratio, 6) AS estimated_ratio, (e >= 7.9 OR cls = 'RANDOM') AS incompressible FROM c")
def estimated_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "estimated_ratio", "incompressible")


def _period_sql() -> str:
    one = """
n{k} AS (SELECT src.id, {n1} AS n1 FROM src LEFT JOIN tot USING (id) {join}),
s{k} AS (SELECT id, gap, c, n1, COALESCE(SUM(c) OVER (PARTITION BY id ORDER BY gap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM g{p} JOIN n{k} USING (id) WHERE gap >= 5),
q{k} AS (SELECT id, gap, c, c / (256.0::DOUBLE + n1 - t) AS s, row_number() OVER (PARTITION BY id ORDER BY c / (256.0::DOUBLE + n1 - t) DESC, gap) AS o FROM s{k} WHERE t < n1),
w{k} AS (SELECT id, gap AS period, c, s AS score FROM q{k} WHERE o = 1 AND s > 0.1)"""
    return f"""
WITH src AS ({_DOCS}),
b AS (SELECT id, unnest(regexp_extract_all(hex(encode(body)), '..')) AS x, generate_subscripts(regexp_extract_all(hex(encode(body)), '..'), 1) - 1 AS i FROM src),
g0 AS (SELECT id, i - COALESCE(lag(i) OVER (PARTITION BY id, x ORDER BY i), 0) AS gap FROM b),
g1 AS (SELECT id, gap, COUNT(*) AS c FROM g0 WHERE gap > 0 AND gap < 4096 GROUP BY ALL),
tot AS (SELECT z.id, z.n - COALESCE(y.r, 0) AS n1 FROM (SELECT id, COUNT(*) AS n FROM b GROUP BY id) z LEFT JOIN (SELECT id, SUM(c) AS r FROM g1 WHERE gap <= 3 GROUP BY id) y USING (id)),
{one.format(k=1, p=1, n1="COALESCE(tot.n1, 0)", join="")},
g2 AS (SELECT g1.* FROM g1 LEFT JOIN w1 ON g1.id = w1.id AND g1.gap = w1.period WHERE w1.id IS NULL),
{one.format(k=2, p=2, n1="tot.n1 - w1.c", join="JOIN w1 USING (id)")}
SELECT src.id AS doc_id, COALESCE(w1.period, 0) AS period1, round(COALESCE(w1.score, 0), 6) AS score1, COALESCE(w2.period, 0) AS period2, round(COALESCE(w2.score, 0), 6) AS score2
FROM src LEFT JOIN w1 USING (id) LEFT JOIN w2 USING (id)"""


@query(_period_sql())
def period_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.periods(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, part, ((part - 1) * 4096)::BIGINT AS \"offset\", LEAST(4096, strlen(text) - (part - 1) * 4096)::BIGINT AS length FROM (SELECT doc_id, text, unnest(range(1, CEIL(strlen(text) / 4096.0)::INT + 1))::INT AS part FROM documents)")
def fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return S.fixed_blocks(docs, "size", 4096).select("doc_id", "part", "offset", "length")


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of levels 1 to 9 for each document: R from the bytes of lines repeated within it."""
    docs = table(spark, sf_dir, "documents")
    cls = P.profile(docs, "doc_id", "text").select("doc_id", "cls", "incompressible", "sample_size")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("body")).groupBy("doc_id", F.sha1(F.encode("body", "UTF-8")).alias("h")).agg(F.count("*").alias("k"), F.first(F.octet_length("body")).alias("z"))
    red = lines.groupBy("doc_id").agg(F.sum((F.col("k") - 1) * F.col("z")).cast("long").alias("redundancy"))
    text, exe = F.col("cls").isin("TEXT", "CSV", "JSON", "XML", "LOG", "SOURCE_CODE"), F.col("cls") == "EXECUTABLE"
    out = cls.join(red, "doc_id").withColumn("type", S.block_type(256 * F.col("redundancy") / F.greatest("sample_size", F.lit(1)) * (F.floor(F.col("sample_size") / 256) + 1), F.col("sample_size"), text, exe))
    rows = [F.struct(F.lit(n).alias("level"), S.choose_method(n, F.col("incompressible")).alias("method"), S.expand(n, F.col("type"), text).alias("family")) for n in range(10)]
    return out.withColumn("m", F.explode(F.array(*rows))).select("doc_id", "cls", "type", "m.*")


_METHOD_SQL = (
    _with(_DOCS)
    + """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), l2 AS (SELECT doc_id, line, COUNT(*) AS k FROM l GROUP BY ALL),
red AS (SELECT doc_id AS id, SUM((k - 1) * strlen(line))::BIGINT AS redundancy FROM l2 GROUP BY doc_id),
ty AS (SELECT id AS doc_id, cls, (e >= 7.9 OR cls = 'RANDOM') AS inc, cls IN ('TEXT', 'CSV', 'JSON', 'XML', 'LOG', 'SOURCE_CODE') AS txt,
  (4 * LEAST(255, FLOOR(256 * redundancy / GREATEST(n, 1)::DOUBLE * (FLOOR(n / 256.0) + 1) / (FLOOR(n / 256.0) + 1))) + (cls IN ('TEXT', 'CSV', 'JSON', 'XML', 'LOG', 'SOURCE_CODE'))::INT + 2 * (cls = 'EXECUTABLE')::INT)::BIGINT AS type FROM c JOIN red USING (id)),
me AS (SELECT doc_id, cls, type, level::INT AS level,
  CASE WHEN inc OR level = 0 THEN '0' WHEN level <= 5 THEN level::VARCHAR ELSE '5' || CASE level WHEN 6 THEN 64 WHEN 7 THEN 64 WHEN 8 THEN 128 ELSE 256 END END AS method,
  CASE level WHEN 0 THEN 'store'
   WHEN 1 THEN CASE WHEN type < 40 THEN 'store' WHEN type < 80 THEN 'lz77-1' WHEN type < 128 THEN 'lz77-2' WHEN type < 256 THEN 'lz77-3' WHEN type < 960 THEN 'lz77-4' ELSE 'lz77-5' END
   WHEN 2 THEN CASE WHEN type < 32 THEN 'store' WHEN type < 64 THEN 'lz77-3' ELSE 'lz77-suffix' END
   WHEN 3 THEN CASE WHEN type < 20 THEN 'store' WHEN type < 48 THEN 'lz77-3' WHEN type >= 640 OR txt THEN 'bwt' ELSE 'lz77-cm' END
   WHEN 4 THEN CASE WHEN type < 12 THEN 'store' WHEN type < 24 THEN 'lz77-3' WHEN type < 48 THEN 'lz77-cm' WHEN type < 900 THEN CASE WHEN txt THEN 'cm+word' ELSE 'cm' END ELSE 'bwt' END
   ELSE CASE WHEN txt THEN 'cm-full+word' ELSE 'cm-full' END END AS family
  FROM ty, (SELECT unnest(range(10)) AS level))
"""
)


@query(_METHOD_SQL + "SELECT * FROM me")
def choose_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _methods(spark, sf_dir)


@query(
    _METHOD_SQL
    + ", k AS (SELECT level, family, COUNT(*) AS blocks FROM me GROUP BY ALL) SELECT level, family AS method, blocks FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY blocks DESC, family) AS o FROM k) WHERE o = 1"
)
def dominant_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = _methods(spark, sf_dir).drop("method").withColumnRenamed("family", "method")
    return S.dominant(methods, "level")
