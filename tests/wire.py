"""Byte builders for tests: NetFlow v5 packets and pcap files (written with ``struct``)."""

from __future__ import annotations

import ipaddress
import struct


def v5_record(src="10.0.0.1", dst="10.0.0.2", sport=1000, dport=53, packets=1, octets=100,
              first=1000, last=1500, prot=17, tos=0, tcp_flags=0, nexthop="0.0.0.0",
              input_if=0, output_if=0, src_as=0, dst_as=0, src_mask=0, dst_mask=0):
    return struct.pack(
        ">4s4s4sHHIIIIHHBBBBHHBBH",
        ipaddress.IPv4Address(src).packed, ipaddress.IPv4Address(dst).packed,
        ipaddress.IPv4Address(nexthop).packed, input_if, output_if, packets, octets,
        first, last, sport, dport, 0, tcp_flags, prot, tos, src_as, dst_as, src_mask, dst_mask, 0,
    )


def v5_packet(records, version=5, count=None, uptime=10_000, secs=1_185_488_138, nsecs=0,
              sequence=0, engine_type=0, engine_id=0, sampling=0):
    count = len(records) if count is None else count
    header = struct.pack(">HHIIIIBBH", version, count, uptime, secs, nsecs, sequence,
                         engine_type, engine_id, sampling)
    return header + b"".join(records)


def udp_frame(payload: bytes, vlan=False, ip_options=b"", proto=17, frag=0) -> bytes:
    eth = b"\x00" * 5 + b"\x02" + b"\x00" * 5 + b"\x01"
    eth += (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00"
    ihl = (20 + len(ip_options)) // 4
    l4 = struct.pack(">HHHH", 40000, 2055, 8 + len(payload), 0) + payload if proto == 17 \
        else struct.pack(">HHIIBBHHH", 40000, 2055, 0, 0, 0x50, 0, 0, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x40 | ihl, 0, 20 + len(ip_options) + len(l4), 0, frag,
                     64, proto, 0, b"\x0a\x00\x00\x01", b"\x0a\x00\x00\x02") + ip_options
    return eth + ip + l4


def pcap_file(frames, little_endian=True, nanos=False, link_type=1, ts=1_185_488_138) -> bytes:
    e = "<" if little_endian else ">"
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(e + "IHHiIII", magic, 2, 4, 0, 0, 65535, link_type)
    for i, frame in enumerate(frames):
        out += struct.pack(e + "IIII", ts + i, 123, len(frame), len(frame)) + frame
    return out
