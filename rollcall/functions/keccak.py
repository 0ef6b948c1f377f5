"""Keccak-256, which neither Spark nor hashlib has (SHA3-256 pads differently)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _round_constants() -> list[int]:
    """By the specification's linear feedback shift register."""
    found, state = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            if state & 1:
                constant |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        found.append(constant)
    return found


def _offsets() -> dict[tuple[int, int], int]:
    """Rotation of each lane."""
    found, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        found[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return found


_RATE = 136
_ROUNDS = np.array(_round_constants(), np.uint64)
# lane x, y is row x + 5 * y
_LEFT = np.array([[_offsets()[x, y]] for y in range(5) for x in range(5)], np.uint64)
_RIGHT = (np.uint64(64) - _LEFT) & np.uint64(63)
_FROM = np.array([0] * 25)
for _x in range(5):
    for _y in range(5):
        _FROM[_y + 5 * ((2 * _x + 3 * _y) % 5)] = _x + 5 * _y


def _permuted(lanes: np.ndarray) -> np.ndarray:
    """The permutation of many states at once: 25 rows of lanes, a column for each state."""
    n = lanes.shape[1]
    for constant in _ROUNDS:
        columns = np.bitwise_xor.reduce(lanes.reshape(5, 5, n), axis=0)
        ahead = np.roll(columns, -1, axis=0)
        mixed = np.roll(columns, 1, axis=0) ^ ((ahead << np.uint64(1)) | (ahead >> np.uint64(63)))
        lanes = (lanes.reshape(5, 5, n) ^ mixed).reshape(25, n)
        moved = ((lanes << _LEFT) | (lanes >> _RIGHT))[_FROM].reshape(5, 5, n)
        lanes = (moved ^ (~np.roll(moved, -1, axis=1) & np.roll(moved, -2, axis=1))).reshape(25, n)
        lanes[0] ^= constant
    return lanes


def keccak_many(texts: list[bytes], pad: bytes = b"\x01") -> list[bytes]:
    """Keccak-256 of each text (SHA3-256 pads with another byte); texts of the same number of blocks and longer ones go through the permutation together."""
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]), reverse=True)
    blocks = np.array([len(texts[k]) // _RATE + 1 for k in order], np.int64)
    lanes, found = np.zeros((25, len(texts)), np.uint64), [b""] * len(texts)
    at, live = 0, len(texts)
    while live:
        parts = []
        for k in range(live):
            part = texts[order[k]][at * _RATE : (at + 1) * _RATE]
            if len(part) < _RATE:
                part = bytearray(part + pad + bytes(_RATE - 1 - len(part)))
                part[-1] |= 0x80
            parts.append(part)
        lanes[:17] ^= np.frombuffer(b"".join(parts), "<u8").reshape(live, 17).T.astype(np.uint64)
        lanes, at = _permuted(lanes), at + 1
        rest = int(np.searchsorted(-blocks, -at, "left"))  # those with more than ``at`` blocks stay
        for k in range(rest, live):
            found[order[k]] = lanes[:4, k].astype("<u8").tobytes()
        lanes, live = lanes[:, :rest].copy(), rest
    return found


def keccak256(data: bytes) -> bytes:
    return keccak_many([data])[0]


@F.pandas_udf(T.StringType())
def keccak_hex(values: pd.Series) -> pd.Series:
    """0x-prefixed Keccak-256 of the UTF-8 text; null stays null."""
    known = values.dropna()
    hashes = pd.Series(["0x" + h.hex() for h in keccak_many([x.encode() for x in known])], known.index, dtype=object)
    return hashes.reindex(values.index).astype(object).where(values.notna(), None)
