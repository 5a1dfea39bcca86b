import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import op04_matroska as op
from tests.llm.helpers import documents, edge_rows, write


@given(st.binary(max_size=20_000), st.sampled_from(["fixed", "ebml", "xiph"]), st.integers(1, 9), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_round_trip(data, lacing, per_block, per_cluster):
    payload = op.padded(data)
    media = op.mux(payload, per_block=per_block, per_cluster=per_cluster, lacing=lacing)
    parsed = op.demux(media)
    assert op.read_payload(media, parsed) == payload
    assert [p[1] for p in parsed["packets"]] == [k * 12_000_000 for k in range(len(payload) // 576)]
    assert len(parsed["cues"]) == parsed["clusters"]
    for when, _, at, _ in parsed["cues"]:  # every cue names a cluster's first byte
        assert media[at : at + 4] == b"\x1fC\xb6u"
        assert when in [p[1] for p in parsed["packets"]]


def test_lacing_kinds_agree():
    frames = [b"a" * n for n in (1, 300, 255, 17, 1000, 2)]
    for lacing in ("xiph", "ebml"):
        body = op.block_body(frames, 1, -5, lacing)
        got = op._laced(body, 4, len(body), body[3])
        assert [body[a : a + n] for a, n in got] == frames


def test_unknown_sizes_and_block_groups():
    block = op.element(op.BLOCK_GROUP, op.element(op.BLOCK, op.block_body([b"x" * 10], 1, 3, "none")))
    cluster = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + op.uint(op.TIMESTAMP, 100) + block
    tracks = op.element(op.TRACKS, op.element(op.TRACK_ENTRY, op.uint(op.TRACK_NUMBER, 1)))
    data = op.element(op.EBML, b"") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + tracks + cluster + cluster
    parsed = op.demux(data)
    assert parsed["clusters"] == 2 and [(p[1], p[3]) for p in parsed["packets"]] == [(103_000_000, 10)] * 2


@pytest.mark.parametrize("data", [b"\x00", b"\x1aE\xdf\xa3\x8f", b"\x18S\x80g\x82\xec", b"\x18S\x80g\xff\x00"])
def test_damaged_media_are_told(spark, data):
    with pytest.raises(ValueError):  # noqa: PT011
        op.demux(data)
    rows = op.packet_table(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(op.mux(op.padded(b"hi")))), (3, None)], "id long, media binary")).collect()
    assert [r["error"] is None for r in sorted(rows, key=lambda r: r["id"])] == [False, True]


def file_of(clusters, cues=b""):
    tracks = op.element(op.TRACKS, op.element(op.TRACK_ENTRY, op.uint(op.TRACK_NUMBER, 1)))
    return op.element(op.EBML, b"") + op.element(op.SEGMENT, tracks + b"".join(clusters) + cues), len(tracks)


def cluster_of(time, n=1):
    return op.element(op.CLUSTER, op.uint(op.TIMESTAMP, time) + b"".join(op.element(op.SIMPLE_BLOCK, op.block_body([b"x" * 5], 1, k, "none")) for k in range(n)))


def cue_at(time, place):
    return op.element(op.CUE_POINT, op.uint(op.CUE_TIME, time) + op.element(op.CUE_TRACK_POSITIONS, op.uint(op.CUE_TRACK, 1) + op.uint(op.CUE_CLUSTER_POSITION, place)))


def test_times_beyond_64_bits_and_deep_nesting_are_errors_not_crashes(spark):
    nested = b""
    for _ in range(2000):
        nested = op.element(op.BLOCK_GROUP, nested)
    bad = [file_of([cluster_of(2**63)])[0], file_of([cluster_of(2**64 - 1)])[0], op.element(op.SEGMENT, nested), op.element(op.SEGMENT, op.element(op.INFO, op.element(op.DURATION, b"\x7f\xf0" + b"\0" * 6)))]
    rows = op.packet_table(spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate([*bad, op.mux(op.padded(b"fine"))])], "id long, media binary")).collect()
    by = {k: [r for r in rows if r["id"] == k] for k in range(5)}
    assert all(len(by[k]) == 1 and by[k][0]["error"] and by[k][0]["timestamp_ns"] is None for k in range(4)) and by[4][0]["error"] is None


def test_cues_are_matched_by_place(spark):
    """Three clusters, cues for the last and the first, out of order; the second has none. A cue beside a cluster is damage."""
    clusters = [cluster_of(10), cluster_of(20, 2), cluster_of(30)]
    start = file_of([])[1]
    third = start + len(clusters[0]) + len(clusters[1])
    data, _ = file_of(clusters, op.element(op.CUES, cue_at(30, third) + cue_at(10, start)))
    rows = op.packet_table(spark.createDataFrame([(1, bytearray(data))], "id long, media binary")).collect()
    assert [r["cluster"] for r in rows] == [0, 1, 1, 2]
    assert [None if r["cue_offset"] is None else data[r["cue_offset"] : r["cue_offset"] + 4] for r in rows] == [b"\x1fC\xb6u", None, None, b"\x1fC\xb6u"]
    assert rows[0]["cue_offset"] < rows[3]["cue_offset"]
    wrong, _ = file_of(clusters, op.element(op.CUES, cue_at(30, third + 1)))
    assert "no cluster" in op.packet_table(spark.createDataFrame([(1, bytearray(wrong))], "id long, media binary")).collect()[0]["error"]


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_any_damage_is_a_value_error(data):
    media = bytearray(op.mux(op.padded(b"some payload" * 200), per_block=2, per_cluster=1, lacing=data.draw(st.sampled_from(["fixed", "ebml", "xiph"]))))
    for _ in range(data.draw(st.integers(1, 6))):
        media[data.draw(st.integers(0, len(media) - 1))] = data.draw(st.integers(0, 255))
    try:
        parsed = op.demux(bytes(media[: data.draw(st.integers(0, len(media)))]))
    except ValueError:
        return
    assert all(-(2**63) <= p[1] < 2**63 for p in parsed["packets"])


def test_query_on_edge_rows(spark, tmp_path):
    got = op.op4_matroska(spark, write(spark, tmp_path, documents=documents(spark))).collect()
    want = []
    for r in edge_rows():
        data = (r[1] or "").encode()
        p = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        want.append((r[0] is None, r[0] or 0, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by_text.values())
    media = {r["id"]: bytes(r["media"]) for r in op.media_column(documents(spark)).collect()}
    assert hashlib.sha256(media[4]).hexdigest() == next(r["media_sha256"] for r in got if r["doc_id"] == 4)


def test_empty_table(spark, tmp_path):
    assert op.op4_matroska(spark, write(spark, tmp_path, documents=documents(spark, []))).count() == 0
