"""Blosc frames, version 1 and 2 of the format, in numpy: what most version 2 Zarr writers pack chunks with.

A frame is a header, the offset of each block, and the blocks.  A block is one stream,
or one for each byte of an element; a stream stands as it is or packed by an inner
compressor.  Bytes (or bits) of a block's elements were brought together before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

# Fixed values of the format.
HEADER = 16
BYTE_SHUFFLE, STORED, BIT_SHUFFLE, ONE_STREAM = 1, 2, 4, 16
COMPRESSORS = ("blosclz", "lz4", "snappy", "zlib", "zstd")
SHUFFLES = {0: 0, 1: BYTE_SHUFFLE, 2: BIT_SHUFFLE, "noshuffle": 0, "shuffle": BYTE_SHUFFLE, "bitshuffle": BIT_SHUFFLE}
#: Elements of more bytes than this, and blocks of fewer elements, are one stream.
MOST_STREAMS, LEAST_ELEMENTS = 16, 128
FAR = 8191


def _blosclz(raw: bytes, size: int) -> bytes:
    """Literal runs and matches, a control byte each: a small one counts literals, others hold length and distance."""
    out, at, control = bytearray(), 1, raw[0] & 31
    while True:
        if control < 32:
            out += raw[at : at + control + 1]
            at += control + 1
        else:
            length, distance = (control >> 5) + 2, (control & 31) << 8
            if control >> 5 == 7:
                while True:
                    length += raw[at]
                    at += 1
                    if raw[at - 1] != 255:
                        break
            distance += raw[at]
            at += 1
            if distance == FAR:  # all bits set: two more bytes tell how much farther
                distance += raw[at] << 8 | raw[at + 1]
                at += 2
            start = len(out) - distance - 1
            if start < 0:
                raise ValueError("a match begins before the data")
            piece = bytes(out[start : start + length])
            out += (piece * (length // len(piece) + 1))[:length]
        if at >= len(raw):
            break
        control = raw[at]
        at += 1
    if len(out) != size:
        raise ValueError(f"a stream holds {len(out)} bytes, not {size}")
    return bytes(out)


def _zstd(raw: bytes, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)


UNPACK: dict[str, Callable[[bytes, int], bytes]] = {
    "blosclz": _blosclz,
    "lz4": lambda raw, size: pa.Codec("lz4_raw").decompress(raw, size, asbytes=True),
    "snappy": lambda raw, size: pa.Codec("snappy").decompress(raw, size, asbytes=True),
    "zlib": lambda raw, size: zlib.decompress(raw, bufsize=size),
    "zstd": _zstd,
}


def _pack(raw: bytes, name: str) -> bytes:
    if name == "zlib":
        return zlib.compress(raw, 5)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(raw)
    return pa.Codec("lz4_raw" if name == "lz4" else name).compress(raw, asbytes=True)


def shuffled(raw: bytes, width: int, bits: bool = False) -> bytes:
    """All first bytes (or bits) of the elements, all second ones and so on; what is no whole element stays behind."""
    n = len(raw) // width
    if bits and n % 8:
        return raw  # bits are moved for whole groups of eight elements alone
    a = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    if bits:
        a = np.packbits(np.unpackbits(a, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        a = a.T
    return a.tobytes() + raw[n * width :]


def unshuffled(raw: bytes, width: int, bits: bool = False) -> bytes:
    """The inverse of ``shuffled``."""
    n = len(raw) // width
    if bits and n % 8:
        return raw
    a = np.frombuffer(raw, np.uint8, n * width)
    if bits:
        a = np.packbits(np.unpackbits(a.reshape(8 * width, n // 8), axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        a = a.reshape(width, n).T
    return a.tobytes() + raw[n * width :]


def _streams(flags: int, width: int, size: int, whole: bool) -> int:
    split = whole and not flags & ONE_STREAM and width <= MOST_STREAMS and size // width >= LEAST_ELEMENTS
    return width if split else 1


def decompress(frame: bytes) -> bytes:
    """What a frame holds."""
    if len(frame) < HEADER:
        raise ValueError("a Blosc frame is shorter than its header")
    version, _, flags, width, size, block, total = struct.unpack("<BBBBIII", frame[:HEADER])
    if version not in (1, 2) or flags & 8:
        raise ValueError(f"a Blosc frame of version {version} with flags {flags:#x} isn't known")
    if total != len(frame):
        raise ValueError(f"a Blosc frame has {len(frame)} bytes, its header says {total}")
    if flags & STORED:
        return frame[HEADER : HEADER + size]
    if not size:
        return b""
    if flags >> 5 >= len(COMPRESSORS):
        raise ValueError(f"a Blosc frame is packed by compressor {flags >> 5}, which isn't known")
    unpack, width = UNPACK[COMPRESSORS[flags >> 5]], max(width, 1)
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{-(-size // block)}i", frame, HEADER)):
        n = min(block, size - i * block)
        count = _streams(flags, width, n, n == block)
        parts = []
        for _ in range(count):
            held = int.from_bytes(frame[at : at + 4], "little", signed=True)
            raw = frame[at + 4 : at + 4 + held]
            if held < 0 or len(raw) != held:
                raise ValueError("a stream of a Blosc frame is cut off")
            parts.append(raw if held == n // count else unpack(raw, n // count))
            at += 4 + held
        data = b"".join(parts)
        if width > 1 and flags & BYTE_SHUFFLE:
            data = unshuffled(data, width)
        elif n >= width and flags & BIT_SHUFFLE:
            data = unshuffled(data, width, bits=True)
        out.append(data)
    return b"".join(out)


def compress(raw: bytes, width: int, name: str = "lz4", shuffle: int | str = "shuffle", block: int = 1 << 18) -> bytes:
    """A frame of ``raw``, whose elements have ``width`` bytes, by ``lz4``, ``snappy``, ``zlib`` or ``zstd``."""
    flags = COMPRESSORS.index(name) << 5 | SHUFFLES[shuffle]
    block = min(max(block // width * width, width), max(len(raw), 1))
    offsets, body, at = [], [], HEADER + 4 * -(-len(raw) // block)
    for i in range(0, len(raw), block):
        data = raw[i : i + block]
        offsets.append(at)
        if SHUFFLES[shuffle] and width > 1 or SHUFFLES[shuffle] == BIT_SHUFFLE:
            data = shuffled(data, width, SHUFFLES[shuffle] == BIT_SHUFFLE)
        count = _streams(flags, width, len(data), len(data) == block)
        n = len(data) // count
        for j in range(count):
            piece = data[j * n : (j + 1) * n]
            packed = _pack(piece, name)
            packed = piece if len(packed) >= len(piece) else packed
            body.append(len(packed).to_bytes(4, "little") + packed)
            at += len(body[-1])
    if at >= len(raw) + HEADER:  # packing gained nothing
        return struct.pack("<BBBBIII", 2, 1, flags | STORED, width, len(raw), block, len(raw) + HEADER) + raw
    return struct.pack(f"<BBBBIII{len(offsets)}i", 2, 1, flags, width, len(raw), block, at, *offsets) + b"".join(body)
