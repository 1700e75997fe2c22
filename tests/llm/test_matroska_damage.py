"""Damaged media raise the module's own error, whatever bytes change or go; hand-made bytes are read as the format says."""

import struct

import numpy as np
import pytest

from rubrica.llm import matroska
from rubrica.llm.matroska import MatroskaError


@pytest.mark.parametrize("lacing", [matroska.NO_LACE, matroska.FIXED, matroska.XIPH, matroska.EBML_LACE])
def test_damage_raises_its_own_error(lacing):
    rng = np.random.default_rng(lacing)
    data = matroska.mux(bytes(range(256)) * 9, lacing)
    for _ in range(400):
        bad = bytearray(data)
        for at in rng.integers(0, len(bad), int(rng.integers(1, 4))):
            bad[at] = int(rng.integers(0, 256))
        bad = bytes(bad[: int(rng.integers(1, len(bad) + 1))]) if rng.random() < 0.5 else bytes(bad)
        try:
            matroska.demux(bad)
        except MatroskaError:
            pass


def test_cut_lacing_and_odd_numbers():
    for body in (b"\x02\xff\xff", b"\x01", b"\x01\xff"):
        with pytest.raises(MatroskaError):
            matroska.laced(body, 0, len(body), matroska.XIPH)
    for size in (1, 3, 5, 9):
        with pytest.raises(MatroskaError):
            matroska.real(bytes(9), 0, size)
    assert matroska.real(struct.pack(">f", 1.5), 0, 4) == 1.5 and matroska.real(struct.pack(">d", -2.5), 0, 8) == -2.5 and matroska.real(b"", 0, 0) == 0.0


def test_hand_made_bytes():
    """A segment written byte by byte: one track, one cluster at 5 ms, a simple block with Xiph lacing of three frames."""
    head = bytes.fromhex("1a45dfa3 8b 4282 88".replace(" ", "")) + b"matroska"
    info = bytes.fromhex("1549a966 87 2ad7b1 83 0f4240".replace(" ", ""))
    track = bytes.fromhex("1654ae6b 91 ae 8f d7 81 01 73c5 81 07 83 81 11 86 83".replace(" ", "")) + b"X_Y"
    block = bytes.fromhex("81 0002 82 02 01 02".replace(" ", "")) + b"a" + b"bb" + b"ccc"
    cluster = bytes.fromhex("1f43b675".replace(" ", "")) + bytes([0x80 | 3 + 2 + len(block)]) + bytes.fromhex("e7 81 05 a3".replace(" ", "")) + bytes([0x80 | len(block)]) + block
    body = info + track + cluster
    data = head + bytes.fromhex("18538067") + bytes([0x80 | len(body)]) + body
    got = matroska.demux(data).packets
    assert [data[p.offset : p.offset + p.size] for p in got] == [b"a", b"bb", b"ccc"]
    assert {p.track for p in got} == {1} and got[0].timestamp_ns == 7_000_000
