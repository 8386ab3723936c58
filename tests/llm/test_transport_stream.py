import hashlib
import zlib

import pytest

from loomgraph.llm import transport_stream as ts


@pytest.mark.parametrize("n", [64, 128, 169, 170, 171, 172, 173, 184, 368, 16_384, 16_448, 200_000, 16_384 * 9])
def test_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    stream = ts.mux(payload)
    assert len(stream) % 188 == 0 and stream[::188] == b"G" * (len(stream) // 188)
    back, stamps, keys, clocks = ts.demux(stream)
    assert back == payload
    units = -(-n // ts.UNIT)
    assert stamps == [i * ts.TICKS for i in range(units)]
    assert keys == list(range(0, units, ts.KEY_EVERY)) and clocks == [i * ts.TICKS for i in keys]


def parsed(stream):
    """A parser of its own: bit strings packet by packet, as the transport-stream layout is written down."""
    bits = lambda raw, at, n: int("".join(f"{b:08b}" for b in raw)[at : at + n], 2)
    pids, units, keys, counter, media = {0: "programs"}, [], [], None, None
    for k in range(0, len(stream), 188):
        p = stream[k : k + 188]
        pid, control = bits(p[:4], 11, 13), bits(p[:4], 26, 2)
        body = p[4:]
        flags = 0
        if control & 2:
            flags = body[1] if body[0] else 0
            body = body[1 + body[0] :]
        if pid in pids:
            section = body[1 + body[0] :]
            entry = section[8 : 3 + bits(section[:3], 12, 12) - 4]
            if pids[pid] == "programs":
                pids[bits(entry[:4], 19, 13)] = "streams"
            else:
                media = bits(entry[4 + bits(entry[2:4], 4, 12) :][1:3], 3, 13)
        elif pid == media:
            assert counter is None or p[3] & 15 == (counter + 1) % 16
            counter = p[3] & 15
            if p[1] & 0x40:
                units.append(b"")
                if flags & 0x40:
                    keys.append(len(units) - 1)
            units[-1] += body
    times = [bits(u[9:14], 4, 3) << 30 | bits(u[9:14], 8, 15) << 15 | bits(u[9:14], 24, 15) for u in units]
    return b"".join(u[9 + u[8] :] for u in units), times, keys


@pytest.mark.parametrize("n", [64, 192, 16_384, 40_000, 16_384 * 9 + 64])
def test_streams_read_the_same_by_a_plain_parser(n):
    payload = bytes((i * i) % 251 for i in range(n))
    assert parsed(ts.mux(payload)) == ts.demux(ts.mux(payload))[:3] and parsed(ts.mux(payload))[0] == payload


def test_every_length():
    for n in range(64, 64 * 30, 64):
        assert ts.demux(ts.mux(bytes(n)))[0] == bytes(n)


def test_damage_is_refused():
    stream = ts.mux(bytes(range(256)) * 10)
    with pytest.raises(ValueError, match="counter"):
        ts.demux(stream[: 188 * 4] + stream[188 * 5 :])
    with pytest.raises(ValueError, match="sync"):
        ts.demux(b"X" + stream[1:])
    with pytest.raises(ValueError, match="table"):
        ts.demux(stream[:10] + b"\xee" + stream[11:])


def test_query_columns(spark):
    texts = [None, "", "abc", "é" * 40, "x" * 64, "long " * 9000, "abc"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in ts.read_back(ts.store(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert got[i].n_bytes == len(raw) and got[i].payload_bytes == len(payload)
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
        payload, times, keys = parsed(ts.mux(payload))
        assert got[i].timestamps == times and got[i].access_points == keys
        assert got[i].media_bytes == len(ts.mux(payload)) and got[i].media_sha256 == hashlib.sha256(ts.mux(payload)).hexdigest()
    assert got[2].media_sha256 == got[6].media_sha256 and got[2].feature == got[6].feature
    odd = spark.createDataFrame([(None, "abc"), (1, "abc"), (1, "abc")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in ts.read_back(ts.store(odd)).collect()) == ["1", "1", "None"]
    assert ts.read_back(ts.store(docs.limit(0))).count() == 0
