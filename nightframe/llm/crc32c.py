"""CRC-32C of many records at once, and the mask of length-delimited record files."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 128
MASK_ADD = 0xA282EAD8


@lru_cache(1)
def _tables():
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0x82F63B78), step >> 1)
    pair = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        pair = step[pair & 0xFF] ^ (pair >> 8)
    shift = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    for _ in range(BLOCK):
        shift = step[shift & 0xFF] ^ (shift >> 8)
    value = np.arange(256)
    by_byte = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            by_byte[k] ^= np.where(value >> bit & 1, shift[8 * k + bit], 0).astype(np.uint32)
    init = [0xFFFFFFFF]
    for _ in range(3):
        init.append(int(step[init[-1] & 0xFF]) ^ (init[-1] >> 8))
    return pair, by_byte, np.array(init, np.uint32)


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of ``data`` (uint8). Rows are padded in front, which a zero register ignores."""
    pair, by_byte, init = _tables()
    n = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint32)
    size = np.diff(offsets)
    blocks = np.maximum(1, -(-size // BLOCK))
    stop = np.cumsum(blocks)
    padded = np.zeros(int(stop[-1]) * BLOCK, np.uint8)
    move = stop * BLOCK - offsets[1:]
    if not ((offsets & 1).any() or (len(data) & 1)):
        padded.view("<u2")[np.repeat(move // 2, size // 2) + np.arange(len(data) // 2)] = np.ascontiguousarray(data).view("<u2")
    else:
        padded[np.repeat(move, size) + np.arange(len(data))] = data
    head = stop * BLOCK - size
    whole = size >= 4
    for k in range(4):
        padded[head[whole] + k] ^= 0xFF
    columns = np.ascontiguousarray(padded.view("<u2").reshape(-1, BLOCK // 2).T)
    part = np.zeros(len(padded) // BLOCK, np.uint32)
    for c in columns:
        part = pair[(part ^ c) & 0xFFFF] ^ (part >> 16)
    order = np.argsort(-blocks, kind="stable")
    first, many = (stop - blocks)[order], blocks[order]
    out = np.zeros(n, np.uint32)
    for k in range(int(many[0])):
        live = int(np.searchsorted(-many, -k, "left"))
        r = out[:live]
        out[:live] = by_byte[0][r & 0xFF] ^ by_byte[1][r >> 8 & 0xFF] ^ by_byte[2][r >> 16 & 0xFF] ^ by_byte[3][r >> 24] ^ part[first[:live] + k]
    crc = np.zeros(n, np.uint32)
    crc[order] = out
    crc[~whole] ^= init[size[~whole]]
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and offset, so that checksums of data with checksums stay sound."""
    crc = crc.astype(np.uint32)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_ADD)
