"""CRC-32 of any part of a byte string from the running CRCs of two of its prefixes.

Appending bytes to a prefix first moves its CRC by a linear map over GF(2), which depends on the number of
bytes only. So the CRC of a part is the CRC of the prefix that ends with it, with the moved CRC of the prefix
before it cancelled out: ``crc(b) = crc(ab) ^ moved(crc(a), len(b))``.
"""

from __future__ import annotations

import functools

import numpy as np

_POLYNOMIAL = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)
#: Bytes that one lane of a scan takes.
LANE = 256


@functools.cache
def _bytewise() -> np.ndarray:
    """What a byte that falls out of the register leaves behind."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _zero_byte(register: np.ndarray) -> np.ndarray:
    return _bytewise()[register & 255] ^ (register >> 8)


def _applied(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    return (
        tables[0][register & 255] ^ tables[1][register >> 8 & 255] ^ tables[2][register >> 16 & 255] ^ tables[3][register >> 24]
    )


@functools.cache
def _short_moves() -> np.ndarray:
    """[bytes moved over, place of a register byte, its value], for up to 255 bytes."""
    each = np.arange(256, dtype=np.uint32)
    moves = [np.stack([each << np.uint32(8 * k) for k in range(4)])]
    while len(moves) < 256:
        moves.append(_zero_byte(moves[-1]))
    return np.stack(moves)


@functools.cache
def _long_move(power: int) -> np.ndarray:
    """The tables for 256 * 2 ** power bytes."""
    half = _zero_byte(_short_moves()[255]) if power == 0 else _long_move(power - 1)
    return half if power == 0 else _applied(half, half)


def moved(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs after so many bytes each."""
    short, tables = lengths & 255, _short_moves()
    out = (
        tables[short, 0, crcs & 255] ^ tables[short, 1, crcs >> 8 & 255]
        ^ tables[short, 2, crcs >> 16 & 255] ^ tables[short, 3, crcs >> 24]
    )
    longer, power = lengths >> 8, 0
    while longer.any():
        which = np.flatnonzero(longer & 1)
        out[which] = _applied(_long_move(power), out[which])
        longer, power = longer >> 1, power + 1
    return out


class RunningCrcs:
    """The CRCs of all prefixes of a byte string, from one scan over it.

    The bytes are laid out in lanes that are scanned side by side; what the lanes before it leave in a lane's
    register is found in a doubling pass and moved in when a prefix is asked for.
    """

    def __init__(self, data: np.ndarray) -> None:
        lanes = -(-len(data) // LANE)
        laid = np.zeros(lanes * LANE, dtype=np.uint8)
        laid[: len(data)] = data
        columns = np.ascontiguousarray(laid.reshape(lanes, LANE).T)
        self._own = np.zeros((LANE + 1, lanes + 1), dtype=np.uint32)
        table, register = _bytewise(), np.zeros(lanes, dtype=np.uint32)
        for k in range(LANE):
            register = table[(register ^ columns[k]) & 255] ^ (register >> 8)
            self._own[k + 1, :lanes] = register
        before = np.concatenate([[_ALL], register]).astype(np.uint32)
        step = 1
        while step <= lanes:
            before[step:] ^= moved(before[:-step], np.full(lanes + 1 - step, step * LANE))
            step *= 2
        self._before = before

    def at(self, lengths: np.ndarray) -> np.ndarray:
        """CRCs of the prefixes of these lengths."""
        lane, place = lengths // LANE, lengths % LANE
        return moved(self._before[lane], place) ^ self._own[place, lane] ^ _ALL

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRCs of the parts from ``starts`` to ``ends``."""
        return self.at(ends) ^ moved(self.at(starts), ends - starts)
