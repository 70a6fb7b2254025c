"""The codecs of Zarr chunks, undone: what stored bytes hold.

Known are ``transpose``, ``bytes``, ``sharding_indexed``, ``gzip``, ``zlib``,
``zstd``, ``lz4``, ``bz2``, ``lzma``, ``blosc`` and ``crc32c``, whose sum must be right.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import math
import zlib
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa

from terrace.sources import blosc
from terrace.sources.checks import signed, verified

NOWHERE = 2**64 - 1


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def _lz4(raw: bytes) -> bytes:
    return pa.Codec("lz4_raw").decompress(raw[4:], int.from_bytes(raw[:4], "little"), asbytes=True)


UNPACK: dict[str, Callable[[bytes], bytes]] = {
    "gzip": gzip.decompress, "zlib": zlib.decompress, "zstd": _zstd, "lz4": _lz4, "bz2": bz2.decompress, "lzma": lzma.decompress, "crc32c": verified, "blosc": blosc.decompress,
}


def pack(raw: bytes, compressor: str | None, itemsize: int = 1) -> bytes:
    """``raw`` by a compressor that ``write_array`` offers."""
    if compressor is None:
        return raw
    if compressor == "blosc":
        return blosc.compress(raw, itemsize)
    if compressor == "gzip":
        return gzip.compress(raw, 5, mtime=0)  # the same bytes when a task runs again
    import zstandard

    return zstandard.ZstdCompressor().compress(raw)


def require_known(codecs: Sequence[dict[str, Any]]) -> None:
    for c in codecs:
        if c["name"] == "sharding_indexed":
            require_known([*c["configuration"]["codecs"], *c["configuration"].get("index_codecs", [])])
        elif c["name"] not in ("transpose", "bytes", *UNPACK):
            raise ValueError(f"chunks packed by {c['name']} can't be read; known are {', '.join(['transpose', 'bytes', 'sharding_indexed', *UNPACK])}")
        elif c["name"] == "blosc":
            conf = c.get("configuration") or {}
            if conf.get("cname", "lz4") not in (*blosc.COMPRESSORS, "lz4hc"):
                raise ValueError(f"Blosc chunks packed by {conf['cname']} can't be read; known are {', '.join(blosc.COMPRESSORS)}")
            if conf.get("shuffle", 1) not in (*blosc.SHUFFLES, -1):
                raise ValueError(f"Blosc chunks shuffled by {conf['shuffle']!r} can't be read")


def decode(raw: bytes, codecs: Sequence[dict[str, Any]], shape: Sequence[int], dtype: str, fill: Any) -> np.ndarray:
    """The cells of one stored chunk, which has its full shape."""
    orders = [c["configuration"]["order"] for c in codecs if c["name"] == "transpose"]
    for order in orders:
        shape = [shape[i] for i in order]
    data = None
    for c in reversed([c for c in codecs if c["name"] != "transpose"]):
        conf = c.get("configuration") or {}
        if c["name"] == "sharding_indexed":
            data = _shard(raw, conf, shape, dtype, fill)
        elif c["name"] == "bytes":
            data = np.frombuffer(raw, np.dtype(dtype).newbyteorder(">" if conf.get("endian") == "big" else "<")).reshape(shape)
        else:
            raw = UNPACK[c["name"]](raw)
    for order in reversed(orders):
        data = data.transpose(np.argsort(order))
    return data.astype(dtype, copy=False)


def packed_text(values: Sequence[str]) -> bytes:
    """A chunk of text cells, as the codec ``vlen-utf8`` has it: how many, then each one's length and bytes."""
    raw = [v.encode() for v in values]
    return b"".join([len(raw).to_bytes(4, "little"), *(x for r in raw for x in (len(r).to_bytes(4, "little"), r))])


def unpacked_text(raw: bytes) -> list[str]:
    """The inverse of ``packed_text``."""
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n].decode())
        at += 4 + n
    return out


def index_bytes(conf: dict[str, Any], shape: Sequence[int]) -> tuple[int, bool]:
    """How many bytes a shard's index has, and whether it stands at the end."""
    count = math.prod(s // c for s, c in zip(shape, conf["chunk_shape"]))
    sums = sum(c["name"] == "crc32c" for c in conf.get("index_codecs") or [])
    return 16 * count + 4 * sums, conf.get("index_location", "end") == "end"


def read_index(raw: bytes, conf: dict[str, Any], shape: Sequence[int]) -> dict[tuple[int, ...], tuple[int, int]]:
    """Offset and length of each chunk that a shard holds."""
    counts = [s // c for s, c in zip(shape, conf["chunk_shape"])]
    places = decode(raw, conf.get("index_codecs") or [{"name": "bytes"}], [math.prod(counts), 2], "<u8", 0).tolist()
    return {where: (at, n) for where, (at, n) in zip(np.ndindex(*counts), places) if at != NOWHERE}


def written_index(places: Sequence[int]) -> bytes:
    """An index and its sum."""
    return signed(np.array(places, "<u8").tobytes())


def _shard(raw: bytes, conf: dict[str, Any], shape: Sequence[int], dtype: str, fill: Any) -> np.ndarray:
    chunks = conf["chunk_shape"]
    size, at_end = index_bytes(conf, shape)
    out = np.full(shape, fill, dtype)
    for where, (at, n) in read_index(raw[-size:] if at_end else raw[:size], conf, shape).items():
        out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(where, chunks))] = decode(raw[at : at + n], conf["codecs"], chunks, dtype, fill)
    return out
