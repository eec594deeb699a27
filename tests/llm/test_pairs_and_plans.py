import itertools
import random
import zlib

import numpy as np
import pytest

from strataform.llm import common, jaccard, mixing, neardup, shard
from strataform.llm.shingles import ranked, shingles, similar

NONE = np.zeros(0, np.uint64)


def groups(n, links):
    low = list(range(n))
    for _ in range(n):
        new = [min([low[i], *[low[j] for a in links for i2, j in (a, a[::-1]) if i2 == i]]) for i in range(n)]
        if new == low:
            return low
        low = new


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 40), r.randint(0, 40)) for _ in range(30)] + [(i, i + 1) for i in range(50, 70)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = groups(71, edges)
    assert got == {n: low[n] for e in edges if e[0] != e[1] for n in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_set(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def check_join(docs, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard.join(docs).collect())
    sets = [plain_set(x[1]) for x in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    low = groups(len(rows), links)
    ids = [x[0] for x in rows]
    least = {c: min((ids[i] for i in range(len(rows)) if low[i] == c and ids[i] is not None), default=-1) for c in set(low)}
    want = sorted((ids[i] if ids[i] is not None else -1, len(sets[i]), least[low[i]] if sets[i] else (ids[i] if ids[i] is not None else -1)) for i in range(len(rows)))
    assert got == want


def test_jaccard_join_on_the_fixture(docs, rows, empty):
    check_join(docs, rows)
    assert jaccard.join(empty).count() == 0


def test_jaccard_links_rows_without_ids(spark):
    """Near copies, not equal ones, among rows without ids and rows of one id."""
    w = [f"word{i}" for i in range(60)]
    near = lambda k: " ".join([*w[:k], "other", *w[k + 1 :]])
    far = " ".join(f"far{i}" for i in range(40))
    rows = [(5, " ".join(w)), (None, near(30)), (None, near(10)), (None, far), (None, far + " more"), (7, far.replace("far1 ", "gone ")), (7, "nothing like it at all, whatever"), (8, near(50))]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    none = [(None, x[1]) for x in rows]
    check_join(spark.createDataFrame(none, "doc_id long, text string"), none)
    kept = jaccard.distinct(spark.createDataFrame([*rows, rows[0], (None, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text[:5]) for r in kept) == [(-1, ""), (5, "word0"), (7, "far0 "), (7, "nothi")]


@pytest.mark.parametrize("block", [1500, 5])
def test_jaccard_families(spark, block, monkeypatch):
    """Near copies around the threshold, and a passage all share; small blocks take the other way."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=30)
    rows = []
    for f in range(6):
        base = r.choices(vocabulary, k=r.randint(40, 120))
        for _ in range(9):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w + passage * (f < 3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_join(docs, rows)


def test_region_links_by_brute_force():
    r = random.Random(8)
    for _ in range(30):
        base = r.sample(range(1000), 30)
        sets = [np.array(sorted(set(r.sample(base, r.randint(22, 30)) + r.sample(range(1000, 1100), r.randint(0, 4)))), np.uint64) for _ in range(14)]
        links = jaccard.region_links(list(range(14)), sets, [None] * 14, [None] * 14)
        assert all(similar(sets[a], sets[b]) for a, b in links)
        assert groups(14, links) == groups(14, [p for p in itertools.combinations(range(14), 2) if similar(sets[p[0]], sets[p[1]])])


def test_rank_order_is_one_order():
    a, b = "alpha beta gamma delta epsilon zeta eta", "x alpha beta gamma delta epsilon"
    assert set(ranked(a, NONE)[1].tolist()) & set(ranked(b, NONE)[1].tolist()) and ranked(a, NONE)[0].tolist() == shingles(a).tolist() and len(shingles(a)) == 3
    late = shingles("alpha beta gamma delta epsilon")
    assert ranked(a, late)[1][-1] >> np.uint64(56) == 255 and len(ranked(None, NONE)[1]) == 0


def check_vectors(spark, rows):
    """All pairs by brute force; rows (vec_id, embedding, label) stand for themselves whatever their ids."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, cls string, key int") if len(rows[0]) == 6 else spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    v = [np.array(x[1], np.float32).astype(float) if x[1] and all(y is not None and np.isfinite(y) for y in x[1]) and any(x[1]) else None for x in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= 0.95]
    low, n = groups(len(rows), links), np.bincount(np.array(links).reshape(-1), minlength=len(rows))
    ids = [x[0] for x in rows]
    least = {c: min((ids[i] for i in range(len(rows)) if low[i] == c and ids[i] is not None), default=-1) for c in set(low)}
    want = sorted((-1 if ids[i] is None else ids[i], int(n[i]), least[low[i]], ids[i] is not None and ids[i] == least[low[i]]) for i in range(len(rows)))
    assert got == want
    return df


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    g = np.random.default_rng(3)
    base = g.standard_normal((8, 16))
    rows = [(i, [float(x) for x in base[i % 8] + g.standard_normal(16) * g.choice([0, 0.1, 0.25, 0.4])], i % 2) for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, [], 0), (305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (307, [float("inf")] + [1.0] * 15, 0)]
    df = check_vectors(spark, rows)
    assert block < 2048 or neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """Two orthogonal vectors of one id stay apart; so do rows without an id. Further columns have names the operator uses."""
    more = (1, 5, "x", 2)
    check_vectors(spark, [(i, e, *more) for i, e in ((1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.02, 1.0]), (None, [0.0, -1.0]), (None, [0.01, -1.0]), (None, None), (None, [1.0, 0.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]))])


def test_dense_runs_keep_every_link(spark, monkeypatch):
    """A dense group far larger than ranges, windows and blocks: connected by few links, counted in full."""
    monkeypatch.setattr(neardup, "RANGE_ROWS", 48)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    g = np.random.default_rng(5)
    v = g.standard_normal(16) + 0.03 * g.standard_normal((300, 16))
    df = spark.createDataFrame([(i, [float(y) for y in x], 1) for i, x in enumerate(v)], "cls long, v array<float>, n long")
    found = neardup.links(df, passes=1, window=4)
    assert 299 <= found.count() <= 299 + 6 * 7
    comp = common.components(found).selectExpr("node as cls", "component")
    assert {r.others for r in neardup.degrees(df.join(comp, "cls"), 0.95).collect()} == {299}


@pytest.mark.parametrize("table", ["sf0.01"])
def test_recall_on_the_embeddings(spark, table):
    """Against brute force over the whole table."""
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    rows = df.collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.sqrt((v * v).sum(1))[:, None]
    want = dict(zip((r.vec_id for r in rows), ((v @ v.T >= 0.95).sum(1) - 1).tolist()))
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in want)


# mixing and sharding


def test_apportion_by_brute_force(spark):
    r = random.Random(2)
    for _ in range(4):
        votes, seats = [r.choice([0, 1, 5, 5, 1000, r.randint(1, 300)]) for _ in range(9)], r.randint(0, 60)
        df = spark.createDataFrame(list(enumerate(votes)), "k long, v long")
        from pyspark.sql import functions as F

        got = {x.k: x.quota for x in mixing.apportion(df, "v", F.lit(seats), [], ["k"]).collect()}
        want = dict.fromkeys(range(9), 0)
        for _ in range(seats if sum(votes) else 0):
            want[min(want, key=lambda i: (-votes[i] / (2 * want[i] + 1), i))] += 1
        assert got == want


def test_apportion_hands_on_what_is_above_the_most(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 100, 3), (1, 10, 9), (2, 10, 4), (3, 0, 9)], "k long, v long, most long")
    got = {x.k: x.quota for x in mixing.apportion(df, "v", F.lit(12), [], ["k"], most=F.col("most")).collect()}
    assert sum(got.values()) == 12 and got == {0: 3, 1: 9, 2: 0, 3: 0} or got[0] == 3 and sum(got.values()) == 12


def test_rows_without_ids_are_dealt_over_shards(spark):
    rows = spark.range(600).selectExpr("cast(null as long) as doc_id", "concat('word ', id, ' more of it') as text", "'s' as source")
    got = mixing.mix(rows, shard_rows=50)
    total = got.groupBy().sum("taken").first()[0]
    assert abs(total - 1.5 * 600 * 5) < 12 * 16 and got.where("taken > 2 * size").count() == 0


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = lambda x: len((x[1] or "").encode().split())
    assert sorted(r["size"] for r in got) == sorted(map(sizes, rows))
    total, per = sum(map(sizes, rows)), {}
    for x in rows:
        per[x[3]] = per.get(x[3], 0) + sizes(x)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(per, 0.0)
    for _ in range(200):  # share, cap, share the excess again
        left, open_ = 1.5 * total - sum(target.values()), [s for s in per if target[s] < 2 * per[s]]
        for s in open_:
            target[s] = min(2 * per[s], target[s] + left * weight[s] / sum(weight[o] for o in open_))
    taken = {}
    seen = {id(x): x for x in rows}
    assert len(seen) == len(rows)
    by_target = {round(target[s], 3): s for s in per}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        s = by_target.get(round(r.target, 3))
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in per if list(map(lambda z: round(z, 3), target.values())).count(round(target[s], 3)) == 1)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr) and mixing.mix(empty).count() == 0


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_shards(docs, rows, empty, spark):
    import xxhash

    got = shard.shards(docs, 5, 1 / 16).collect()
    want = sorted((len((x[1] or "").encode()) + 16, zlib.crc32((x[1] or "").encode())) for x in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    # the whole order, by a plain sort of keys (text hash, id; rows alike in both are alike here)
    order = sorted((signed(xxhash.xxh64_intdigest((x[1] or "").encode(), 42)), -(2**63) if x[0] is None else x[0], zlib.crc32((x[1] or "").encode())) for x in rows)
    assert [(-(2**63) if r.doc_id is None else r.doc_id, r.text_crc32) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [x[1:] for x in order]
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shard.shards(empty, 5).count() == 0


@pytest.mark.parametrize("same_id", [False, True])
def test_shards_of_a_hot_text(spark, same_id):
    """Two thirds of the rows share a text, and its id too in the second case."""
    hot = spark.range(4000).selectExpr("case when %s and id %% 3 > 0 then 7 else id end as doc_id" % str(same_id).lower(), "case when id % 3 > 0 then 'one hot text' else concat('t', id) end as text")
    by, slots = {}, {}
    for r in shard.shards(hot, 8).collect():
        by[r.shard] = by.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 8 and max(by.values()) - min(by.values()) < 0.02 * sum(by.values()) / 8 * 2 + 60
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# queries and the pipeline


@pytest.mark.parametrize("name", ["op8_mix_to_targets"])
def test_same_rows_as_sql(spark, duck, name):
    from helpers import SMALL, plain

    from strataform.llm import queries

    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def test_pipeline(spark, docs, empty, tables):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "jaccard_join", "pii", "mixing", "sentencepiece"]
    now = docs
    for name, stage in p.STAGES:
        before = now
        now = common.cut(stage(spark, before, tables), name)
        rows = before.count()
        if name != "sentencepiece":
            assert now.columns == before.columns
        if name == "language_id":
            letters = before.where("text rlike '\\\\p{L}'")
            assert now.count() > 0.9 * letters.count() and now.where("text is null").count() == 0
        if name == "jaccard_join":
            kept = [(r.doc_id, r.component_id) for r in jaccard.join(before).collect()]
            ids = [r.doc_id for r in now.collect()]
            assert set(ids) == {d for d, c in kept if d == c} and len([d for d in ids if d is not None]) == len(set(ids) - {None})
        if name in ("pii", "sentencepiece"):
            assert now.count() == rows
    assert now.where("not lossless").count() == 0 and p.run(spark, tables).count() == now.count()
    out = empty
    for _, stage in p.STAGES:
        out = stage(spark, out, tables)
    assert out.count() == 0


def test_recall_in_a_hot_cone(spark):
    """Pairs among vectors of one common direction, pairwise cosine 0.99, which link with nothing else at 0.9995."""
    g = np.random.default_rng(11)
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    v = np.sqrt(0.01) * unit(g.standard_normal((6000, 64)) * ([0] + [1] * 63))
    v[:, 0] = np.sqrt(0.99)
    w = g.standard_normal((300, 64))
    w = unit(w - (w * v[:300]).sum(1)[:, None] * v[:300])
    rows = np.vstack([v, 0.9997 * v[:300] + np.sqrt(1 - 0.9997**2) * w])
    ids = g.permutation(6300)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, rows)], "cls long, v array<float>")
    got = {tuple(sorted((r.a, r.b))) for r in neardup.links(df, least=0.9995, passes=4).collect()}
    want = {tuple(sorted((int(ids[i]), int(ids[6000 + i])))) for i in range(300)}
    assert len(want & got) > 0.95 * len(want)
    assert [neardup.passes_for(n) for n in (0, 16_384, 100_000, 1_000_000)] == [16, 16, 28, 40]


def test_workers_keep_one_operators_memory():
    """A worker that took over from the Jaccard join forgets its words, older ones too."""
    from strataform.llm import shingles

    for i in range(shingles._WORDS.half + 5):
        shingles._WORDS[f"w{i}"]
    assert shingles._WORDS.older

    common.sole("jaccard", shingles.forget)
    common.sole("other", lambda: None)
    assert not shingles._WORDS and not shingles._WORDS.older
    common._CACHES.clear()


def test_redaction_carries_no_second_text(spark):
    """The stage that replaces the text sends it to the workers once, by small batches."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    docs = spark.createDataFrame([(1, "mail a@b.org", "en")], "doc_id long, text string, lang string")
    out = corpus_pipeline.personal_data(spark, docs.withColumn("n_chars", F.lit(1)), "")
    assert out.first().text == "mail <EMAIL>" and out.columns == ["doc_id", "text", "lang", "n_chars"]
    assert corpus_pipeline.beside_text(docs, corpus_pipeline.carried(docs)[1]) == ("_carried_0", "_carried_2")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
