import pytest
from pyspark.sql import functions as F

from flowbeam.operators import aggregates, filters, project, spec
from flowbeam.operators.multispec import multi_spec_query
from flowbeam.schema import FLOW_SCHEMA, SPEC_SCHEMA
from flowbeam.functions.time import parse_time_literal as ms

# Four flows of two sources (addresses as text, times in UTC).
FD = [
    ("198.51.100.1", "198.51.100.2", 1000, 1001, ms("2017-04-01-10:00:00"), 100, 6, 100, 100),
    ("198.51.100.1", "198.51.100.3", 1000, 1001, ms("2017-04-01-10:00:01"), 101, 6, 100, 100),
    ("198.51.100.2", "198.51.100.4", 1000, 1001, ms("2017-04-01-10:00:01"), 101, 6, 100, 100),
    ("198.51.100.2", "198.51.100.4", 1000, 1001, ms("2017-06-01-10:00:01"), 101, 6, 100, 100),
]
APRIL = {"src_addr": "198.51.100.1", "start": "2017-04-01-00:00:00", "end": "2017-05-01-00:00:00"}


@pytest.fixture
def flows(spark):
    return spark.createDataFrame(FD, FLOW_SCHEMA)


def test_reference_spec_returns_fd1_fd2(flows):
    rows = filters.flow_query(flows, spec.FlowSpec.from_params(APRIL)).collect()
    assert sorted(r.dst_addr for r in rows) == ["198.51.100.2", "198.51.100.3"]
    assert aggregates.row_count(filters.flow_query(flows, spec.FlowSpec.from_params(APRIL))).first().flows == 2


def test_bounds_inclusive_and_empty_when_reversed(flows):
    exact = {"start": "2017-04-01-10:00:00", "end": "2017-04-01-10:00:01"}
    assert filters.flow_query(flows, spec.FlowSpec.from_params(exact)).count() == 3
    reversed_ = {"start": "2017-05-01-00:00:00", "end": "2017-04-01-00:00:00"}
    assert filters.flow_query(flows, spec.FlowSpec.from_params(reversed_)).count() == 0


def test_protocol_by_name_or_number(flows):
    for p in ("TCP", "6", "tcp"):
        s = spec.FlowSpec.from_params({**APRIL, "prot": p})
        assert filters.flow_query(flows, s).count() == 2
    assert filters.flow_query(flows, spec.FlowSpec.from_params({**APRIL, "prot": "UDP"})).count() == 0


def test_display_row(flows):
    r = project.to_display(flows).orderBy("time", "dstAddress").first()
    assert r.asDict() == {"srcAddress": "198.51.100.1", "dstAddress": "198.51.100.2", "srcPort": 1000,
                          "dstPort": 1001, "time": "2017-04-01-10:00:00", "duration": 100,
                          "protocol": "TCP", "bytes": 100, "packets": 100}
    doc = project.to_document(project.to_display(flows)).first().value
    assert doc.startswith('{"srcAddress":"198.51.100.1"')
    back = project.from_document(project.to_document(project.to_display(flows)))
    assert back.exceptAll(project.to_display(flows)).count() == 0


VALID = {"name": "q", "type": "FlowQuery", "params": dict(APRIL)}


@pytest.mark.parametrize(
    "change,rule",
    [
        ({"name": ""}, "missing_name"),
        ({"type": "Other"}, "unknown_type"),
        ({"params": {"end": "2017-05-01-00:00:00", "src_addr": "1.2.3.4"}}, "missing_start"),
        ({"params": {**APRIL, "start": "2017-4-1"}}, "bad_start"),
        ({"params": {"start": "20070726215000", "src_addr": "1.2.3.4"}}, "missing_end"),
        ({"params": {**APRIL, "end": "later"}}, "bad_end"),
        ({"params": {"start": APRIL["start"], "end": APRIL["end"]}}, "missing_address"),
        ({"params": {**APRIL, "src_addr": ""}}, "empty_src"),
        ({"params": {**APRIL, "src_addr": "1.2.3.256"}}, "bad_src"),
        ({"params": {**APRIL, "src_addr": "host"}}, "bad_src"),
        ({"params": {**APRIL, "dst_addr": ""}}, "empty_dst"),
        ({"params": {**APRIL, "dst_addr": "x.y"}}, "bad_dst"),
        ({"params": {**APRIL, "src_port": "http"}}, "bad_src_port"),
        ({"params": {**APRIL, "prot": "300"}}, "bad_protocol"),
        ({"params": {**APRIL, "tos": "0"}}, "unknown_param"),
    ],
)
def test_spec_rules_driver_and_table_agree(spark, change, rule):
    job = {**VALID, **change}
    with pytest.raises(spec.SpecError) as err:
        spec.validate_spec(job)
    assert err.value.rule == rule
    df = spark.createDataFrame([("j", job["type"], job["name"], job["params"])], SPEC_SCHEMA)
    assert spec.validate_specs(df).first().validation_error == rule


def test_valid_specs(spark):
    compact = {"name": "n", "type": "FlowQuery",
               "params": {"start": "20070726215000", "end": "20070726220000", "src_addr": "171.54.14.189"}}
    assert spec.validate_spec(compact).start_ms == ms("2007-07-26-21:50:00")
    assert spec.validate_spec({"name": "t", "type": "Test"}) is None
    df = spark.createDataFrame([("a", "FlowQuery", "n", compact["params"]), ("b", "Test", "t", {})], SPEC_SCHEMA)
    assert [r.validation_error for r in spec.validate_specs(df).collect()] == [None, None]


def test_multi_spec_routes(spark, flows):
    specs = spark.createDataFrame(
        [
            ("by_src", ms("2017-04-01-00:00:00"), ms("2017-05-01-00:00:00"), "198.51.100.1", None, None, None, None),
            ("by_dst", ms("2017-01-01-00:00:00"), ms("2017-12-31-00:00:00"), None, "198.51.100.4", None, None, 6),
            ("any", ms("2017-06-01-00:00:00"), ms("2017-06-02-00:00:00"), None, None, None, None, None),
            ("none", ms("2017-04-01-00:00:00"), ms("2017-05-01-00:00:00"), "198.51.100.1", None, None, 9, None),
        ],
        "job_id string, start_ms long, end_ms long, src_addr string, dst_addr string, src_port int, "
        "dst_port int, protocol int",
    )
    for rows in (1_000_000, 0):  # broadcast and shuffle strategies
        got = sorted((r.job_id, r.dst_addr, r.time_ms) for r in multi_spec_query(flows, specs, rows).collect())
        assert [g[0] for g in got] == ["any", "by_dst", "by_dst", "by_src", "by_src"]


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_VALUES = {
    "start": [None, "", "2017-04-01-00:00:00", "20170401000000", "2017-4-1", "yesterday", "2017-02-30-00:00:00"],
    "end": [None, "", "2017-05-01-00:00:00", "20170501000000", "later"],
    "src_addr": [None, "", "10.0.0.1", "1.2.3.256", "host", "255.255.255.255"],
    "dst_addr": [None, "", "10.0.0.2", "01.2.3.4"],
    "src_port": [None, "80", "65535", "65536", "http"],
    "dst_port": [None, "53", "-1"],
    "prot": [None, "TCP", "udp", "17", "300", "x"],
    "tos": [None, "0"],
}


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "", "n"]), st.sampled_from(["FlowQuery", "Test", "Other"]),
                          st.fixed_dictionaries({k: st.sampled_from(v) for k, v in _VALUES.items()})),
                min_size=1, max_size=12))
def test_property_driver_and_table_validation_agree(spark, jobs):
    rows, expected = [], []
    for i, (name, kind, params) in enumerate(jobs):
        params = {k: v for k, v in params.items() if v is not None}
        rows.append((f"j{i}", kind, name, params))
        try:
            spec.validate_spec({"name": name, "type": kind, "params": params})
            expected.append(None)
        except spec.SpecError as err:
            expected.append(err.rule)
    got = {r.job_id: r.validation_error for r in spec.validate_specs(spark.createDataFrame(rows, SPEC_SCHEMA)).collect()}
    assert [got[f"j{i}"] for i in range(len(rows))] == expected
