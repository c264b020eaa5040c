import json
import os

import pytest

from flowbeam.__main__ import main
from flowbeam.schema import FLOW_SCHEMA
from flowbeam.sinks.keyed import upsert_keyed
from tests.wire import pcap_file, udp_frame, v5_packet, v5_record


def test_cli_ingest_query_page_top_lookup(spark, tmp_dir, capsys):
    caps = os.path.join(tmp_dir, "caps")
    os.makedirs(caps)
    pkt = v5_packet([v5_record(src="10.9.8.7", dst="10.1.2.3", sport=4001, dport=53,
                               octets=72, first=9_000, last=9_000, prot=17),
                     v5_record(src="10.9.8.7", dst="198.51.100.7", sport=4002, dport=8080,
                               octets=640, packets=2, first=9_000, last=9_064, prot=6)],
                    uptime=10_000, secs=1185488139)
    with open(os.path.join(caps, "a.pcap"), "wb") as fh:
        fh.write(pcap_file([udp_frame(pkt)]))
    flows, rejects, results = (os.path.join(tmp_dir, d) for d in ("flows", "rejects", "results"))
    assert main(["ingest", caps, flows, rejects], spark=spark) == 0
    assert "flows written: 2, rejects: 0" in capsys.readouterr().out

    main(["query", flows, results, "--job-id", "j1", "--name", "src",
          "--param", "start=20070726221500", "--param", "end=2007-07-26-22:16:00",
          "--param", "src_addr=10.9.8.7"], spark=spark)
    assert "rows: 2" in capsys.readouterr().out
    main(["page", results, "--job-id", "j1", "--limit", "1"], spark=spark)
    doc = json.loads(capsys.readouterr().out.strip())
    assert doc == {"srcAddress": "10.9.8.7", "dstAddress": "10.1.2.3", "srcPort": 4001,
                   "dstPort": 53, "time": "2007-07-26-22:15:38", "duration": 0, "protocol": "UDP",
                   "bytes": 72, "packets": 1}

    main(["top-pairs", flows, "--print", "1"], spark=spark)
    assert capsys.readouterr().out.strip() == "(10.9.8.7,198.51.100.7,640)"

    keyed = upsert_keyed(spark.read.parquet(flows).select(*FLOW_SCHEMA.fieldNames()), os.path.join(tmp_dir, "k"))
    main(["lookup", keyed, "10.9.8.7", "--scan-filter", "false"], spark=spark)
    assert "flows from 10.9.8.7: 2" in capsys.readouterr().out


def test_cli_rejects_bad_arguments(spark, tmp_dir):
    with pytest.raises(SystemExit):
        main(["lookup", tmp_dir, "1.2.3.4", "--scan-filter", "maybe"], spark=spark)
    with pytest.raises(ValueError):
        main(["query", tmp_dir, tmp_dir, "--job-id", "j", "--name", "n", "--param", "start=x"], spark=spark)
