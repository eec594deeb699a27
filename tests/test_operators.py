from pyspark.sql import functions as F

from strataform.operators import catalog, recovery, restore, strategy
from strataform.sources import changelog, files
from strataform.streaming import ingest


def test_catalog(spark):
    log = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "a", 6), (2, 3, "a", 0), (3, 4, "a", 9), (2, 5, "b", 0)], "version long, seq long, path string, date long")
    assert [tuple(r) for r in catalog.latest_state(log).collect()] == [("a", 3, 4, 9)]
    assert catalog.time_travel(log, 2).count() == 0 and catalog.version_at(log, -1) == 2
    assert catalog.latest_state(log.limit(0)).count() == 0


def test_sizes_keep_unknown(spark):
    p = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 9)], "file_id long, frag_id long")
    f = spark.createDataFrame([(1, 10), (2, -1)], "frag_id long, usize long")
    assert {r.file_id: r["size"] for r in catalog.sizes(p, f, "file_id").collect()} == {1: -1, 2: 10}


def test_transactions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, path string")
    assert changelog.append(None, rows, str(tmp_path), 1) and not changelog.append(None, rows.limit(0), str(tmp_path), 2)
    torn = rows.withColumns({"version": F.lit(2).cast("long"), "attempt": F.lit("failed")})
    torn.write.mode("append").partitionBy("version", "attempt").parquet(f"{tmp_path}/records")  # never committed
    assert {r.version for r in changelog.load(spark, str(tmp_path)).collect()} == {1}
    assert changelog.append(None, rows, str(tmp_path), 2) and not changelog.append(None, rows, str(tmp_path), 2)  # a retry, and a replay
    assert sorted((r.version, r.path) for r in changelog.load(spark, str(tmp_path)).collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_until_stops_at_the_transaction(spark):
    t = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "version long, committed_at long")
    assert [catalog.versions_until(t, b) for b in (5, 10, 25, 30)] == [0, 1, 1, 3] and catalog.versions_until(t.limit(0), 5) == 0


def test_permissive(spark):
    rows = spark.createDataFrame([("ok", 1, 5), ("bad", 1, -7)], "name string, attr long, usize long")
    good, bad = changelog.permissive(rows, changelog.violations(F.col("name"), F.col("attr"), F.col("usize")))
    assert good.first().name == "ok" and bad.first().reasons == ["negative"]


def test_files_and_corpus(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_bytes(b"hello")
    assert files.scan(spark, str(tmp_path)).first().content == b"hello" and files.scan(spark, str(tmp_path), recursive=False).count() == 0
    got = files.corpus(spark, 5)
    assert got.count() == 5 * len(files.KINDS) and got.where("content is null").count() == 0


def test_ranges_and_markers(spark):
    points = spark.createDataFrame([(0,), (63,), (64,), (200,)], "x long")
    blocks = spark.createDataFrame([(1, 0), (2, 64), (3, 190)], "b long, s long")
    assert sorted(tuple(r) for r in restore.range_join(points, blocks, "x", "s", 64).select("x", "b").collect()) == [(0, 1), (63, 1), (64, 2), (200, 3)]
    far = spark.createDataFrame([(0,), (300,), (10**9,), (-1,), (5 * 10**8,)], "x long")
    long = spark.createDataFrame([(1, 0), (2, 64), (3, 190), (4, 4 * 10**8), (5, 9 * 10**8)], "b long, s long")
    assert sorted(tuple(r) for r in restore.range_join(far, blocks, "x", "s", 64).select("x", "b").collect()) == [(0, 1), (300, 3), (5 * 10**8, 3), (10**9, 3)]
    assert sorted(tuple(r) for r in restore.range_join(far, long, "x", "s", 64).select("x", "b").collect()) == [(0, 1), (300, 3), (5 * 10**8, 4), (10**9, 5)]
    nexts = {r.s: r.following for r in restore.following(long, "s", 100).collect()}
    assert nexts == {0: 64, 64: 190, 190: 4 * 10**8, 4 * 10**8: 9 * 10**8, 9 * 10**8: None}
    rows = spark.createDataFrame([(1, "zPQa.zPQ"), (2, None), (3, "zP")], "k long, t string")
    assert [tuple(r) for r in recovery.marker_offsets(rows, "k", "t", "zPQ").collect()] == [(1, 0, 0), (1, 1, 5)]
    assert restore.zero_runs(spark.createDataFrame([(bytearray(3),), (bytearray(b"\0a"),), (bytearray(),)], "c binary"), "c").where("sparse").count() == 1


def test_resync(spark):
    rows = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([True, False, False, True, True])], "g long, i long, ok boolean")
    assert [r.status for r in recovery.resync(rows, "g", "i", "ok").orderBy("i").collect()] == ["ok", "corrupted", "corrupted", "recovered", "ok"]


def test_parts_of_a_group_go_on(spark):
    """Narrow parts give the same as one: the state is carried over their borders."""
    rows = spark.createDataFrame([(g, i, i % 4 != 1, (i * 7) % 5) for g in (1, None) for i in range(40)], "g long, i long, ok boolean, d long")
    narrow, wide = ([tuple(r) for r in recovery.resync(rows, "g", "i", "ok", w).select("g", "i", "status").orderBy("g", "i").collect()] for w in (3, 1000))
    assert narrow == wide and sum(s == "recovered" for _, _, s in wide) == 20
    got = {(r.g, r.i): r.adjusted for r in catalog.monotonic_dates(rows.where("g = 1"), "g", ["i"], "d", 3).collect()}
    last = -1
    for i in range(40):
        last = max((i * 7) % 5, last + 1)
        assert got[1, i] == last


def test_strategy(spark):
    one = spark.createDataFrame([(30, False)], "type long, text boolean")
    assert [one.select(strategy.expand(n, F.col("type"), F.col("text"))).first()[0] for n in range(6)] == ["store", "store", "store", "lz77-3", "lz77-cm", "cm-full"]
    assert strategy.model_memory([("cm", 4), ("icm", 2)], 1, 1, header=9) == 64 + 256 + 1024 + 8 + 2 + 4 + 1 + 9
    assert strategy.model_memory([("match", 3, 5), ("mix", 2, 7)]) == 32 + 32 + 112 + 4 + 1 + 4 + 1
    b = strategy.fixed_blocks(spark.createDataFrame([(1, 9), (2, 0)], "k long, size long"), "size", 4)
    assert [(r.part, r.offset, r.length) for r in b.orderBy("part").collect()] == [(1, 0, 4), (2, 4, 4), (3, 8, 1)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = ingest.read_stream(spark, "/root/testdata/sf0.001", "events")
    seen = []
    ingest.commit_batches(stream, lambda df, i: seen.append((i, df.count())), str(tmp_path / "c1"))
    assert sum(n for _, n in seen) == events.count()
    ingest.run_once(ingest.window_counts(stream), str(tmp_path / "out"), str(tmp_path / "c2"))
    want = {(r.start, r.event_type): r.n for r in ingest.window_counts(events).collect()}
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
