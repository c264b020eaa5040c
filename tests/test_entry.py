import __spark_entry__ as entry
from tests.conftest import SF_SMALL


def test_entry_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10
    assert tuple(rows[0]) == ("10.0.1.5", "10.0.2.6", 18340)  # expected top pair at sf0.001


def test_every_query_has_oracle_or_is_declared():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    from flowbeam.plans import catalog

    assert set(catalog.QUERIES) <= set(sql)  # every one of these is checked against SQL


def test_queries_match_duckdb_at_small_scale(spark):
    import duckdb

    from scripts.oracle_check import TABLES, digest

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in ("top_pairs_by_bytes", "latest_per_pair", "flow_query_full", "spec_validation",
                 "v5_reject_counts", "multi_spec_query", "keyed_upsert_backfill"):
        df = entry.queries()[name](spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(entry.oracle_sql()[name])
        orows = res.fetchall()
        ocols = [d[0] for d in res.description]
        assert sorted(df.columns) == sorted(ocols), name
        assert digest(df.columns, rows) == digest(ocols, orows), name
