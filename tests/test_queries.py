"""Every query that has SQL gives the SQL's rows; the others run and keep their columns."""

import pytest
from helpers import SMALL, plain

from strataform import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])


def test_round_trips(spark):
    for name in ("bwt_roundtrip", "e8e9_roundtrip", "lz77_roundtrip", "block_codec"):
        assert plans.QUERIES[name](spark, SMALL).where("not ok").count() == 0


def test_chunks_and_fragments_cover_their_texts(spark):
    sizes = {r.doc_id: len(r.text.encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for name in ("cdc_chunks", "journal_fragments"):
        got = {}
        for r in plans.QUERIES[name](spark, SMALL).orderBy("doc_id", "offset").collect():
            assert r.offset == got.get(r.doc_id, 0)
            got[r.doc_id] = r.offset + r.length
        assert got == sizes


def test_entry():
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_texts_over_a_mebibyte_are_measured_whole(spark, tmp_path):
    """The analyzer's queries give their SQL's rows where what follows the first MiB is of other bytes."""
    import duckdb

    text = "plain words " * 90_000 + "\x00\x00;{}" * 100_001
    spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("byte_xor_sum", "content_profile", "top8_mass", "estimated_ratio"):
        df = plans.QUERIES[name](spark, str(tmp_path))
        want = con.execute(plans.ORACLE[name])
        order = [[d[0] for d in want.description].index(c) for c in df.columns]
        assert plain(df.collect()) == plain([[r[i] for i in order] for r in want.fetchall()])
