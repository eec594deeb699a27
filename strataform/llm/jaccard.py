"""Op 6: exact n-gram Jaccard join in the metric space of shingle sets.

Distance is 1 minus Jaccard similarity, which satisfies the triangle inequality.

1. Classes. Documents of one shingle set are one class.
2. Outer regions. Against almost any document, two sets are at distance 1, so documents as
   pivots cannot tell a large corpus apart. The first pivots are therefore one-shingle sets:
   a set's nearest pivots are its own shingles, ranked by one global order: those of long words
   first, which are rare, and frequent ones last. Two sets within
   0.2 of each other have more than the smaller ``n / 20`` pivots in common among each one's first
   ``n - ceil(0.8 n) + n / 20 + 1``: this window is where a set is replicated, and a set
   that shares no more than that with all others together has no partner.
3. Leaders. At a pivot, sets in order of size are parted where sizes alone put the distance
   above 0.2; runs with the same smallest set form one region, led by that set.
4. Inner join. In a region, sets are pivots: a set lies in the cell of its nearest pivot, and
   x is compared with a member m of a cell, if they share an outer pivot and are not yet
   connected, only where ``|d(x, p) - d(m, p)| <= 0.2`` holds.
5. Regions above ``BLOCK`` classes are dealt over blocks, the leader in each; when components
   of the links are known, classes outside the leader's component meet every block of their
   region, block by block, so nothing depends on a region fitting a task.

Only links that connect something new are kept, which is what components need; copies are
never expanded into pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY, WORD, components, cut, drop, marked, read, sole
from .shingles import forget, key, ranked, shingles

PERCENT = 80
BLOCK = 1500
#: The window holds n / MORE further pivots, so that similar sets share more than the smaller one's n / MORE.
MORE = 20
#: A shingle in this share of a partition's documents, and then of all, ranks last.
FREQUENT = 0.002


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows whose last column is a text, one text in Python at a time."""
    sole("shingles", forget)
    for batch in batches:
        *keys, texts = batch.columns
        yield from zip(*(k.to_pylist() for k in keys), (x.as_py() for x in texts))


def one_of_each(docs: DataFrame, wanted: DataFrame, more: list[str]) -> DataFrame:
    """One row of ``docs`` (as from ``marked``) for each row of ``wanted`` (distinct keys, ``_n``: rows
    that have this key, and ``more`` columns). Texts move once, by key; only keys that several
    rows share are aggregated, in each task before the exchange."""
    names = [c for c in docs.columns if c not in KEY]
    met = lambda some: docs.join(some.hint("shuffle_hash"), KEY)
    alone = met(wanted.where("_n = 1")).select(*names, *more)
    whole = F.struct(*[F.col(c) for c in names])
    several = met(wanted.where("_n > 1")).groupBy(*KEY, *more).agg(F.min(whole).alias("_row")).select("_row.*", *more)
    return alone.unionByName(several)


def classify(docs: DataFrame) -> DataFrame:
    """kind 0: (key of the row, n, cls) of every document; kind 1: (cls = shingle, n = documents) of locally frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, held, total, docs_seen = Counter(), [], [], 0, 0

        def count() -> None:
            if held:
                u, c = np.unique(np.concatenate(held), return_counts=True)
                often = c >= 3
                seen.update(dict(zip(u[often].tolist(), c[often].tolist())))
                held.clear()

        def batch(kind: int, ids: list, none: list, marks: list, ns: list, cls: list) -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in ((ids, pa.int64()), (none, pa.bool_()), (marks, pa.int64()), (ns, pa.int64()), (cls, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(ns), pa.int32()), *columns], ["kind", *KEY, "n", "cls"])

        for doc, none, mark, text in texts_of(batches):
            a = shingles(text)
            docs_seen += 1
            held.append(a)
            total += len(a)
            rows.append((doc, none, mark, len(a), key(a)))
            if total >= 1_000_000:
                count()
                total = 0
            if len(rows) >= 5000:
                yield batch(0, *map(list, zip(*rows)))
                rows = []
        count()
        if rows:
            yield batch(0, *map(list, zip(*rows)))
        frequent = [(h, c) for h, c in seen.items() if c >= max(8, FREQUENT * docs_seen)]
        if frequent:
            nothing = [None] * len(frequent)
            yield batch(1, nothing, nothing, nothing, [c for _, c in frequent], [h - (1 << 63) for h, _ in frequent])

    return docs.select(*KEY, "text").mapInArrow(run, "kind int, _id long, _none boolean, _mark long, n long, cls long")


def outer(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(pivot, cls, n): a class's window of outer pivots, once a task; n: its shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, done, pivots, owners, held = sent.value, set(), [], [], 0

        def flush() -> pa.RecordBatch:
            k, n, size = (np.array(x) for x in zip(*owners))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(pivots).view(np.int64)), pa.array(np.repeat(k, size)), pa.array(np.repeat(n, size).astype(np.int32))], ["pivot", "cls", "n"])

        for (text,) in texts_of(batches):
            own, a = ranked(text, late)
            n = len(a)
            if not n:
                continue
            k = key(own)
            if k in done:
                continue
            if len(done) < 1_000_000:
                done.add(k)
            a = a[: n - (-(-PERCENT * n // 100)) + n // MORE + 1]
            pivots.append(a)
            owners.append((k, n, len(a)))
            held += len(a)
            if held >= 200_000:
                yield flush()
                pivots, owners, held = [], [], 0
        if pivots:
            yield flush()

    return docs.select("text").mapInArrow(run, "pivot long, cls long, n int")


def shared(rows: DataFrame) -> DataFrame:
    """Rows (pivot, cls, n) whose pivot holds another class of fitting size beside this one."""
    w = Window.partitionBy("pivot").orderBy("n", "cls")
    rows = rows.withColumns({"before": F.lag(F.struct("cls", "n")).over(w), "after": F.lead(F.struct("cls", "n")).over(w)})
    low = (F.col("before.cls") != F.col("cls")) & (100 * F.col("before.n") >= PERCENT * F.col("n"))
    high = (F.col("after.cls") != F.col("cls")) & (100 * F.col("n") >= PERCENT * F.col("after.n"))
    return rows.where(F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False))).select("pivot", "cls", "n").distinct()


def candidates(rows: DataFrame, rounds: int = 2) -> DataFrame:
    """(leader, cls, pivots): a pivot's classes in order of size, parted where no pair across
    can be similar, under the smallest; classes that share too few pivots with any go first."""
    rows = cut(shared(rows), "shared")
    for _ in range(rounds):
        before = rows
        enough = rows.groupBy("cls", "n").agg(F.count("*").alias("k")).where(F.col("k") > F.floor(F.ceil(F.col("n") * PERCENT / 100) / MORE)).select("cls")
        rows = cut(shared(rows.join(enough, "cls", "left_semi")), "shared")
        drop(before)
    w = Window.partitionBy("pivot").orderBy("n", "cls")
    led = rows.withColumn("before", F.lag("n").over(w))
    opens = F.col("before").isNull() | (100 * F.col("before") < PERCENT * F.col("n"))
    led = led.withColumn("leader", F.last(F.when(opens, F.col("cls")), ignorenulls=True).over(w))
    out = cut(led.where("leader <> cls").groupBy("leader", "cls").agg(F.collect_list("pivot").alias("pivots")), "members")
    drop(rows)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> tuple[float, bool]:
    """Jaccard distance of sorted distinct hashes, and whether they are similar, in whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    union = len(a) + len(b) - both
    return 1 - both / union, 100 * both >= PERCENT * union


def region_links(cls: list[int], sets: list[np.ndarray], pivots: list[np.ndarray | None], comp: list[int | None]) -> list[tuple[int, int]]:
    """Links that connect the classes of one region as far as similarity does. ``pivots``: of
    each class, its outer pivots here, None for all of them; ``comp``: what is connected already."""
    order = sorted(range(len(cls)), key=lambda i: (len(sets[i]), cls[i]))
    cls, sets, pivots = [cls[i] for i in order], [sets[i] for i in order], [pivots[i] for i in order]
    comp = [comp[i] for i in order]
    names: dict = {}
    label = np.array([names.setdefault(c if c is not None else ("own", i), len(names)) for i, c in enumerate(comp)])
    size = np.array([len(s) for s in sets])
    everywhere = [i for i, p in enumerate(pivots) if p is None]
    flat = [(p, i) for i, p in enumerate(pivots) if p is not None]
    keys = np.concatenate([np.asarray(p, np.int64) for p, _ in flat] or [np.zeros(0, np.int64)])
    owner = np.concatenate([np.full(len(p), i) for p, i in flat] or [np.zeros(0, np.int64)]).astype(np.int64)
    by = np.argsort(keys, kind="stable")
    keys, owner = keys[by], owner[by]
    cell, radius, links = np.arange(len(cls)), np.zeros(len(cls)), []
    mask = np.zeros(len(cls), bool)
    for x in range(1, len(cls)):
        if pivots[x] is None:
            near = np.arange(x)
        else:
            mine = np.asarray(pivots[x], np.int64)
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            mask[:] = False
            for s, e in zip(lo.tolist(), hi.tolist()):
                mask[owner[s:e]] = True
            mask[everywhere] = True
            near = np.nonzero(mask[:x])[0]
        near = near[(label[near] != label[x]) & (100 * size[near] >= PERCENT * size[x])]
        met: dict[int, float] = {}
        while len(near):
            m = int(near[-1])
            p = int(cell[m])
            if p not in met:
                met[p], alike = distance(sets[x], sets[p])
                if alike and label[p] != label[x]:
                    links.append((cls[x], cls[p]))
                    label[label == label[x]] = label[p]
                # the cell's members outside the window around x's distance go at once
                gone = (cell[near] == p) & (np.abs(radius[near] - met[p]) > 1 - PERCENT / 100 + 1e-9)
                near = near[~gone & (label[near] != label[x])]
                continue
            near = near[:-1]
            if m == p:
                continue
            d, alike = distance(sets[x], sets[m])
            if alike:
                links.append((cls[x], cls[m]))
                label[label == label[x]] = label[m]
                near = near[label[near] != label[x]]
        if met:
            p = min(met, key=lambda q: (met[q], q))
            if met[p] <= 0.5:
                cell[x], radius[x] = p, met[p]
    return links


def inner(members: DataFrame) -> DataFrame:
    """Links (a, b) of members (task, cls, comp, pivots, text), each task a region or a block of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("shingles", forget)
        now, held, out = None, {}, []

        def join() -> None:
            if len(held) > 1:
                rows = list(held.values())
                out.extend(region_links(list(held), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
            held.clear()

        for batch in batches:
            task, cls, comp = (batch.column(i).to_pylist() for i in range(3))
            for i, t in enumerate(task):
                if t != now:
                    join()
                    now = t
                if cls[i] not in held:
                    p, a = batch.column(3)[i], shingles(batch.column(4)[i].as_py())
                    if key(a) != cls[i]:  # another text of the same id and text hash
                        continue
                    held[cls[i]] = (a, p.values.to_numpy() if p.is_valid else None, comp[i])
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out.clear()
        join()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = members.select("task", "cls", "comp", "pivots", "text").repartition(n, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key of the row, n, cls) of every row of ``docs`` (as from ``marked``), and (cls, component)
    of the classes that are linked with others. Both are tables in the shared folder."""
    first = cut(classify(docs), "classes")
    table = first.where("kind = 0").select(*KEY, "n", "cls")
    total = table.count()
    # at most (mean set size) / FREQUENT rows
    often = first.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, FREQUENT * total)).collect()
    frequent = np.sort(np.array([r.cls + (1 << 63) for r in often], np.uint64))
    members = candidates(outer(docs, frequent))
    sizes = members.groupBy("leader").agg((F.count("*") + 1).alias("k")).withColumn("blocks", F.ceil(F.col("k") / BLOCK))
    sizes = cut(sizes, "sizes")
    # one text for each class that is in a region, by the key of one of its rows
    wanted = members.select("cls").unionByName(sizes.select(F.col("leader").alias("cls"))).distinct()
    least = F.min(F.struct(*KEY, "_n")).alias("_row")
    some = table.join(wanted, "cls", "left_semi").groupBy("cls", *KEY).agg(F.count("*").alias("_n")).groupBy("cls").agg(least).select("cls", "_row.*")
    texts = cut(one_of_each(docs.select(*KEY, "text"), cut(some, "rows"), ["cls"]), "texts")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    task = lambda *x: F.concat_ws(":", F.col("leader"), *x)
    plain = members.join(sizes, "leader").select("leader", "cls", "pivots", task(block).alias("task"))
    led = sizes.select("leader", F.col("leader").alias("cls"), F.lit(None).cast("array<long>").alias("pivots"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).withColumn("task", task("b")).drop("b")
    every = plain.unionByName(led).withColumn("comp", F.lit(None).cast("long"))
    links = cut(inner(every.join(texts, "cls")), "links")
    comp = cut(components(links), "components")
    hot = sizes.where("blocks > 1")
    if not hot.isEmpty():
        # what is outside the leader's component meets all blocks, in blocks of its own
        inside = members.join(hot, "leader").unionByName(hot.select("leader", "k", "blocks", F.col("leader").alias("cls"), F.lit(None).cast("array<long>").alias("pivots")))
        inside = inside.join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
        main = inside.where("cls = leader").select("leader", F.col("comp").alias("main"))
        inside = inside.join(main, "leader").withColumn("out", F.col("comp") != F.col("main")).withColumn("b", block)
        outs = inside.where("out").groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).alias("out_blocks"))
        inside = inside.join(outs, "leader")
        own = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("out_blocks"))
        a = inside.where("out").select("leader", "cls", "pivots", "comp", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        b = inside.select("leader", "cls", "pivots", "comp", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("i"), F.col("b").alias("j"))
        cross = a.unionByName(b).withColumn("task", task("i", "j")).select("task", "cls", "comp", "pivots")
        more = cut(inner(cross.join(texts, "cls")), "links")
        before, comp = comp, cut(components(links.unionByName(more)), "components")
        drop(more, before)
    drop(members, sizes, texts, links)
    return table, comp.select(F.col("node").alias("cls"), "component")


def groups(table: DataFrame, comp: DataFrame, least: Column) -> DataFrame:
    """(cls, found): ``least``, an aggregate that is its own sum (min of ``at``), over each class's whole
    component. Classes are summed up first, and each join is of plain tables, so a hot one can be split."""
    per = table.groupBy("cls").agg(least.alias("at"))
    per = cut(per.join(comp, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), "at"), "per_class")
    best = cut(per.groupBy("component").agg(least.alias("found")), "groups")
    out = cut(per.select("cls", "component").join(best, "component").select("cls", "found"), "found")
    drop(per, best)
    return out


def join(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id linked to it).

    Null texts and texts without words have no shingles and are linked with nothing, each
    its own component. Every row is a document, whether its id or text repeats or its id is
    null: rows of one id with unlike texts lie in different components, and one without an id takes
    the component's smallest id, null where none has one. Shingles are told apart by 64
    bits, sets by 64 bits. Other columns are not read.
    """
    docs = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(*KEY, "text")
    table, comp = classes(docs)
    id_ = F.when(~F.col("_none"), F.col("_id"))
    rows = table.withColumn("at", id_)
    found = groups(rows.where("n > 0"), comp, F.min("at"))
    out = rows.join(found, "cls", "left")
    return out.select(F.col("at").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("at")).alias("component_id"))


def distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id (none last), then the
    least text hash, then the least row. Rows without words all stay. Columns must be orderable; ones named
    as in ``KEY`` are not kept."""
    rows = marked(docs)
    table, comp = classes(rows.select(*KEY, "text"))
    at = F.struct("_none", "_id", "_mark")
    found = groups(table.where("n > 0").withColumn("at", at), comp, F.min("at"))
    # rows of the chosen key are counted, so that only one of them stays
    stay = found.select(F.col("found._id").alias("_id"), F.col("found._none").alias("_none"), F.col("found._mark").alias("_mark")).distinct()
    stay = cut(stay.join(table.groupBy(*KEY).agg(F.count("*").alias("_n")), KEY), "stay")
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return one_of_each(rows, stay, []).unionByName(docs.where(~words))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
