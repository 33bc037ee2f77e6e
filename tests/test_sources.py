"""Captures, digests and messages read in ranges, against reading them whole."""

import hashlib
import io
import json
import random
import struct

import pytest

from conftest import rows
from netwarden.sources import files, messages, pcap, ranges, streams


def capture(order, packets, tail=b""):
    body = b"".join(struct.pack(order + "IIII", s, us, len(p), len(p) + 4) + p for s, us, p in packets)
    return struct.pack(order + "I", 0xA1B2C3D4) + b"\0" * 20 + body + tail


def made(seed, n, longest=90, payload=None):
    rng = random.Random(seed)
    at = 1_700_000_000
    out = []
    for _ in range(n):
        at += rng.randint(0, 5)
        out.append((at, rng.randint(0, 999_999), payload(rng) if payload else rng.randbytes(rng.randint(0, longest))))
    return out


def fake_headers(rng):
    """Payloads that look like chains of records themselves."""
    return b"".join(struct.pack("<IIII", 1_700_000_000 + k, 5, 8, 8) + b"\1" * 8 for k in range(rng.randint(1, 12)))


@pytest.mark.parametrize("range_bytes", [1 << 20, 700, 97, 40])
def test_ranges_give_the_packets_of_the_whole(spark, tmp_path, range_bytes):
    cases = {
        "le": capture("<", made(1, 80)), "be": capture(">", made(2, 80), b"\1\2\3"), "empty": capture("<", []), "zeros": capture("<", [(0, 0, b"\0" * 60)] * 30),
        "nested": capture("<", made(3, 40, payload=fake_headers)), "long": capture("<", [*made(4, 5), (1_700_000_100, 1, b"x" * 5000), *made(5, 5)]),
        "cut": capture("<", made(6, 10), struct.pack("<IIII", 1_700_000_050, 7, 100, 100) + b"abc"), "inside": capture("<", [(1_700_000_000, 1, capture("<", made(7, 30)))] * 3),
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    got = pcap.numbered(pcap.read_packets(spark, str(tmp_path), range_bytes, piece_bytes=64))
    whole = spark.createDataFrame([(f"{tmp_path}/{n}", bytearray(c)) for n, c in cases.items()], "path string, content binary")
    assert rows(got) == rows(pcap.packet_timestamps(whole))
    assert {r["path"].rpartition("/")[2]: r["packets"] for r in pcap.packet_counts(got).collect()} == {
        "le": 80, "be": 80, "zeros": 30, "nested": 40, "long": 11, "cut": 11, "inside": 3,
    }


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"\n\r\r\n" + b"\0" * 60)
    with pytest.raises(Exception, match="not a classic capture"):
        pcap.read_packets(spark, str(tmp_path))


def test_a_large_file_is_read_by_pieces(tmp_path):
    """A capture of 3 GB, most of it a hole on disk: a range holds a piece at a time."""
    import resource

    path = tmp_path / "large"
    record = 1 << 20
    with open(path, "wb") as out:
        out.write(capture("<", []))
        for k in range(3000):
            out.write(struct.pack("<IIII", 1_700_000_000 + k, k, record, record))
            out.seek(record, 1)
        out.truncate(out.tell())
    size = path.stat().st_size
    assert size > 3_000_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with ranges.opened(str(path)) as handle:
        n = sum(b.num_rows for b in pcap.packets_of(pcap.Pieces(handle, size, 1 << 16), "large", 0, 0, size))
    assert n == 3000
    digest = hashlib.sha256()
    for piece in ranges.chunks(str(path), 0, 1 << 28):
        digest.update(piece)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kilobytes


def test_digests_of_files(spark, tmp_path):
    contents = {"a": b"a", "b/c": b"x" * 3_000_000, "b/d": bytes(range(256))}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rpartition("/")[2]: (r["length"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n.rpartition("/")[2]: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
def test_lines_of_ranges(tmp_path, size):
    path = tmp_path / "p"
    content = b"one\n\ntwo two two\n\n\nthree\n" + b"x" * 60 + b"\nlast\n"
    path.write_bytes(content + b"unfinished")
    end = messages.line_end(str(path), 0, len(content) + 10, piece=4)
    assert end == len(content)
    for begin in (0, 4, 17):
        got = []
        for at in range(begin, end, size):
            got += messages.lines_of(str(path), at, min(at + size, end), end, at == begin)
        assert [line for _, line in got] == content[begin:].split(b"\n")[:-1]
        assert all(content[at : at + len(line)] == line for at, line in got)


def run(stream, out):
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").start()
    try:
        query.processAllAvailable()
        batches = [p for p in query.recentProgress if p.numInputRows]
    finally:
        query.stop()
    return batches


def test_messages_are_taken_once(spark, tmp_path):
    topic, out = tmp_path / "topic", tmp_path / "out"
    topic.mkdir()
    line = lambda k: json.dumps({"k": k}).encode() + b"\n"
    (topic / "p0").write_bytes(b"".join(map(line, range(200))) + b'{"k": 2')  # the last message is still being written
    (topic / "p1").write_bytes(b"bad\n\xff\xfe\n\n" + line(1000))
    read = lambda: streams.message_records(spark, str(topic), ["k"], bytes_per_trigger=300, range_bytes=100, progress=str(tmp_path / "progress"))
    first = run(read(), out)
    assert len(first) > 3  # no batch takes more than it may
    taken = spark.read.parquet(f"{out}/rows")
    assert sorted(int(r["k"]) for r in taken.collect()) == [*range(200), 1000]
    with open(topic / "p0", "ab") as p0:
        p0.write(b"00}\n" + b"".join(map(line, range(201, 230))))
    (topic / "p2").write_bytes(line(2000))
    with open(topic / "p3", "wb") as p3:
        p3.write(b"".join(map(line, range(3000, 3100))))
    assert len(run(read(), out)) > 3  # nor does one of a query that goes on
    assert sorted(int(r["k"]) for r in spark.read.parquet(f"{out}/rows").collect()) == [*range(230), 1000, 2000, *range(3000, 3100)]
    assert run(read(), out) == []


def test_any_offset_can_be_replayed(tmp_path):
    (tmp_path / "p").write_bytes(b"a\nbb\nccc\n")
    reader = messages.MessageReader({"path": str(tmp_path), "rangebytes": "2"})
    got = lambda start, end: [v for part in reader.partitions(start, end) for b in reader.read(part) for v in b.column("value").to_pylist()]
    assert got({}, {"p": 9}) == got({}, {"p": 9}) == ["a", "bb", "ccc"]
    assert got({"p": 2}, {"p": 5}) == ["bb"]
    assert got({"p": 9}, {"p": 9}) == []


def test_small_ranges_share_tasks(spark, tmp_path):
    """2,000 ranges of small files are read by a few tasks, large ranges one each."""
    for k in range(500):
        (tmp_path / f"c{k}").write_bytes(capture("<", made(k, 20)))
    options = {"path": str(tmp_path), "rangebytes": "100", "tasks": "8"}
    found = pcap.CaptureReader(options).partitions()
    assert sum(len(p.ranges) for p in found) >= 2000 and len(found) <= 16
    assert [len(p.ranges) for p in pcap.dealt([("f", k, k << 26, (k + 1) << 26, 1 << 30, None) for k in range(16)], 8, 1 << 26)] == [1] * 16
    got = pcap.read_packets(spark, str(tmp_path), range_bytes=100)
    assert got.rdd.getNumPartitions() <= 64 and got.count() == 500 * 20


def test_a_record_cut_off_by_the_end_is_the_last_guess():
    """Two bytes before a record, whole seconds and a short length look like a record that runs past the end."""
    whole = capture("<", [(1_700_000_000 + k, 0, b"\xde\xad\xbe\xef") for k in range(100)])
    form = struct.Struct("<IIII")
    for start in range(1000, len(whole) - 100):  # a guess reaches 1,040 bytes on
        found = pcap.first_record(pcap.Pieces(io.BytesIO(whole), len(whole)), start, len(whole), form)
        assert (found - 24) % 20 == 0
    cut = whole[:-2]
    assert pcap.first_record(pcap.Pieces(io.BytesIO(cut), len(cut)), len(whole) - 20, len(cut), form) == len(whole) - 20
