from flowbeam.operators.toptalk import latest_per_pair, pair_bytes, top_pairs, top_pairs_latest
from flowbeam.schema import FLOW_SCHEMA


def flow(src, dst, t, b, sport=1):
    return (src, dst, sport, 2, t, 0, 6, b, 1)


def test_pairs_add_both_directions_and_order(spark):
    rows = [
        flow("10.0.0.2", "10.0.0.1", 1, 5),
        flow("10.0.0.1", "10.0.0.2", 2, 7),     # same pair, other direction
        flow("10.0.0.3", "10.0.0.3", 3, 12),    # self pair
        flow("9.0.0.1", "10.0.0.1", 4, 12),     # text order: "10." < "9."
        flow("10.0.0.5", "10.0.0.6", 5, 2_000_000_000),
        flow("10.0.0.6", "10.0.0.5", 6, 2_000_000_000),  # sum above 2^31 - 1
    ]
    df = spark.createDataFrame(rows, FLOW_SCHEMA)
    got = [tuple(r) for r in top_pairs(df, 10).collect()]
    assert got == [
        ("10.0.0.5", "10.0.0.6", 4_000_000_000),
        ("10.0.0.1", "10.0.0.2", 12),           # ties broken by the addresses
        ("10.0.0.1", "9.0.0.1", 12),
        ("10.0.0.3", "10.0.0.3", 12),
    ]
    assert [tuple(r) for r in top_pairs(df, 1).collect()] == [got[0]]
    assert pair_bytes(df).count() == 4


def test_latest_per_pair_and_keyed_totals(spark):
    rows = [
        flow("a", "b", 10, 100),
        flow("a", "b", 30, 300),
        flow("a", "b", 30, 200, sport=9),   # same time: larger remaining columns win (sport 9)
        flow("b", "a", 20, 50),
        flow("c", "d", 5, 1),
    ]
    df = spark.createDataFrame(rows, FLOW_SCHEMA)
    latest = {(r.src_addr, r.dst_addr): (r.time_ms, r.src_port, r.bytes) for r in latest_per_pair(df).collect()}
    assert latest == {("a", "b"): (30, 9, 200), ("b", "a"): (20, 1, 50), ("c", "d"): (5, 1, 1)}
    assert [tuple(r) for r in top_pairs_latest(df, 5).collect()] == [("a", "b", 250), ("c", "d", 1)]
