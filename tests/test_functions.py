import pytest
from pyspark.sql import functions as F

from flowbeam.functions import (
    be_uint, bytes_to_ip, date_parts, format_time, ip_to_bytes, parse_time, parse_time_literal,
    protocol_name, protocol_number, resolve_protocol, signed32_diff, start_time_ms, uint_to_be,
)
from flowbeam.functions.binary import be_int32, be_int64
from flowbeam.functions.ip import check_ipv4
from flowbeam.functions.pairs import pair_columns


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_ip_round_trip_and_invalid(spark):
    df = spark.createDataFrame(
        [("10.0.1.5",), ("255.255.255.255",), ("0.0.0.0",), ("1.2.3.256",), ("host",), ("01.2.3.4",), (None,)],
        "a string",
    )
    rows = df.select("a", F.hex(ip_to_bytes(F.col("a"))).alias("h"),
                     bytes_to_ip(ip_to_bytes(F.col("a"))).alias("back")).collect()
    got = {r.a: (r.h, r.back) for r in rows}
    assert got["10.0.1.5"] == ("0A000105", "10.0.1.5")
    assert got["255.255.255.255"] == ("FFFFFFFF", "255.255.255.255")
    assert got["0.0.0.0"] == ("00000000", "0.0.0.0")
    for bad in ("1.2.3.256", "host", "01.2.3.4", None):
        assert got[bad] == (None, None)


def test_check_ipv4_driver_side():
    assert check_ipv4("172.168.1.1") == "172.168.1.1"
    for bad in ("", "1.2.3", "1.2.3.256", "::1", "example.org"):
        with pytest.raises(ValueError):
            check_ipv4(bad)


def test_big_endian_reads_and_writes(spark):
    b = F.unhex(F.lit("FFFFFFFE0001F4240000000000000001"))
    r = one(spark, be_uint(b, 0, 4).alias("u32"), be_int32(b, 0).alias("i32"), be_uint(b, 4, 2).alias("u16"),
            be_int64(F.substring(b, 9, 8)).alias("i64"), be_uint(b, 0, 1).alias("u8"))
    assert (r.u32, r.i32, r.u16, r.i64, r.u8) == (4294967294, -2, 1, 1, 255)
    r = one(spark, F.hex(uint_to_be(F.lit(-2), 4)).alias("a"), F.hex(uint_to_be(F.lit(65535), 2)).alias("b"),
            F.hex(uint_to_be(F.lit(-1), 8)).alias("c"), F.hex(uint_to_be(F.lit(300), 1)).alias("d"))
    assert (r.a, r.b, r.c, r.d) == ("FFFFFFFE", "FFFF", "FFFFFFFFFFFFFFFF", "2C")


@pytest.mark.parametrize(
    "secs,nsecs,uptime,first,last,start,duration",
    [
        (1185488138, 123_000_000, 3_000_000_000, 1001, 1501, 1182488139124, 500),   # time
        (1185488138, 0, 3_000_000_000, 2_999_999_000, 2_999_999_000, 1185488137000, 0),  # big first
        (1185488138, 0, 500, 4_294_967_000, 4_294_967_000, 1185488137204, 0),  # uptime wrap
        (1185488138, 0, 4_294_967_100, 4_294_967_000, 204, 1185488137900, 500),  # last wrap
    ],
)
def test_start_time_and_duration(spark, secs, nsecs, uptime, first, last, start, duration):
    L = lambda v: F.lit(v).cast("long")
    r = one(spark, start_time_ms(L(secs), L(nsecs), L(uptime), L(first)).alias("s"),
            signed32_diff(L(last), L(first)).alias("d"))
    assert (r.s, r.d) == (start, duration)


def test_time_format_and_parse(spark):
    r = one(spark, format_time(F.lit(1185488138123)).alias("t"),
            parse_time(F.lit("2007-07-26-22:15:38")).alias("a"), parse_time(F.lit("20070726221538")).alias("b"),
            parse_time(F.lit("2007-7-26-22:15:38")).alias("c"), parse_time(F.lit("2017-02-30-00:00:00")).alias("d"),
            parse_time(F.lit("yesterday")).alias("e"))
    assert r.t == "2007-07-26-22:15:38"
    assert r.a == r.b == 1185488138000
    assert r.c is None and r.d is None and r.e is None
    assert parse_time_literal("2017-04-01-10:00:00") == parse_time_literal("20170401100000") == 1491040800000
    for bad in ("2017-4-1-0:0:0", "2017-02-30-00:00:00", "", "20170401"):
        with pytest.raises(ValueError):
            parse_time_literal(bad)


def test_date_parts_are_utc_and_one_based(spark, monkeypatch):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        r = one(spark, *date_parts(F.lit(1185488138000)))  # 2007-07-26T22:15:38Z
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (r.year, r.month, r.day) == (2007, 7, 26)


def test_protocols(spark):
    df = spark.createDataFrame([(1,), (2,), (6,), (17,), (47,), (200,)], "p int")
    assert [r.n for r in df.select(protocol_name(F.col("p")).alias("n")).collect()] == [
        "ICMP", "IGMP", "TCP", "UDP", "Unknown", "Unknown"]
    texts = spark.createDataFrame([("TCP",), ("tcp",), ("6",), ("udp",), ("300",), ("x",)], "t string")
    assert [r.n for r in texts.select(protocol_number(F.col("t")).alias("n")).collect()] == [6, 6, 6, 17, None, None]
    assert resolve_protocol("TCP") == resolve_protocol("6") == 6
    for bad in ("300", "tcpx", "-1"):
        with pytest.raises(ValueError):
            resolve_protocol(bad)


def test_pair_columns_text_order(spark):
    r = one(spark, *pair_columns(F.lit("9.0.0.1"), F.lit("10.0.0.1")))
    assert (r.addr_a, r.addr_b) == ("10.0.0.1", "9.0.0.1")


def test_split_pair_key(spark):
    from flowbeam.functions.pairs import split_pair_key

    r = one(spark, *split_pair_key(F.lit("203.0.113.234,203.0.113.162")))
    assert (r.addr_a, r.addr_b) == ("203.0.113.234", "203.0.113.162")
