"""CRC-32C in numpy: many stretches of the bytes side by side, then put together.

The sum's register is linear in the bytes before its first and last inversion, so the
register of two stretches one after the other is that of the first, moved on by as
many zero bytes as the second has, plus (exclusive or) that of the second.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed value: the polynomial, bits reversed.
POLYNOMIAL = 0x82F63B78


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


def _moved(registers: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Registers after some zero bytes, of which ``columns`` are the effect on each bit."""
    out = np.zeros_like(registers)
    for bit in range(32):
        out ^= np.where(registers >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=256)
def _zeros(n: int) -> np.ndarray:
    """The effect of ``n`` zero bytes on each bit of a register."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n == 0:
        return bits
    if n == 1:
        return _table()[bits & np.uint32(255)] ^ bits >> np.uint32(8)
    half = _moved(_zeros(n // 2), _zeros(n // 2))
    return _moved(half, _zeros(1)) if n % 2 else half


def crc32c(data: bytes) -> int:
    n = len(data)
    lanes = 1
    while lanes * lanes * 4 < n:
        lanes *= 2
    width = -(-n // lanes)
    rows = np.zeros(lanes * width, np.uint8)  # zero bytes in front leave an empty register as it is
    rows[lanes * width - n :] = np.frombuffer(data, np.uint8)
    rows = rows.reshape(lanes, width)
    registers = np.zeros(lanes, np.uint32)
    table = _table()
    for i in range(width):
        registers = table[(registers ^ rows[:, i]) & np.uint32(255)] ^ registers >> np.uint32(8)
    while len(registers) > 1:
        registers = _moved(registers[0::2], _zeros(width)) ^ registers[1::2]
        width *= 2
    start = _moved(np.array([0xFFFFFFFF], np.uint32), _zeros(n))
    return int((registers[0] ^ start[0]) ^ np.uint32(0xFFFFFFFF))


def signed(data: bytes) -> bytes:
    """``data`` and its sum, as the codec ``crc32c`` writes them."""
    return data + crc32c(data).to_bytes(4, "little")


def verified(data: bytes) -> bytes:
    """``data`` without its sum, which must be right."""
    if len(data) < 4 or crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("the check sum is wrong")
    return data[:-4]
