"""A covering code of 64-bit fingerprints: every fingerprint has an anchor near it, and near fingerprints share one.

The code is a product of binary Golay codes, each over 23 bits: perfect codes, in which every word lies within three bits of exactly one of
4096 codewords. Bits beyond the blocks do not count for the anchor. An anchor is the codewords of all blocks, 12 bits each.

Two fingerprints with at most ``t`` different bits have one between them that is at most ``(t + 1) // 2`` bits from either. So a fingerprint
goes to the anchor of every fingerprint within that distance of it, all of which lie within the covering radius plus the
threshold, and two fingerprints within ``t`` bits meet at the anchor of the one between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np

LENGTH, RADIUS, INFORMATION = 23, 3, 12
GENERATOR = 0b101011100011


def _syndrome(word: int) -> int:
    for k in range(LENGTH - 1, LENGTH - INFORMATION - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - (LENGTH - INFORMATION))
    return word


@cache
def tables(reach: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Syndromes by byte and place; the error of each syndrome; by number of flips the further codewords, as
    differences of codeword numbers, that so many flips lead to and fewer do not (-1 where a syndrome has no more)."""
    unit = [_syndrome(1 << k) for k in range(LENGTH)]
    by_byte = np.zeros((3, 256), dtype=np.int64)
    for place in range(3):
        for byte in range(256):
            for bit in range(8):
                if byte >> bit & 1 and 8 * place + bit < LENGTH:
                    by_byte[place, byte] ^= unit[8 * place + bit]
    flips: list[list[tuple[int, int]]] = []  # by weight: (error, its syndrome)
    for weight in range(max(RADIUS, reach) + 1):
        flips.append([])
        for bits in combinations(range(LENGTH), weight):
            error = syndrome = 0
            for k in bits:
                error, syndrome = error | 1 << k, syndrome ^ unit[k]
            flips[-1].append((error, syndrome))
    leader = np.zeros(1 << (LENGTH - INFORMATION), dtype=np.int64)
    for weight in range(RADIUS + 1):
        for error, syndrome in flips[weight]:
            leader[syndrome] = error
    shift = LENGTH - INFORMATION
    syndromes = np.arange(len(leader))
    known = [set([0]) for _ in syndromes]
    steps = [np.zeros((len(leader), 1), dtype=np.int64)]
    for weight in range(1, reach + 1):
        error, syndrome = np.array(flips[weight]).T
        moved = (error[None, :] ^ leader[syndromes[:, None] ^ syndrome[None, :]] ^ leader[:, None]) >> shift
        new = [sorted(set(row.tolist()) - had) for row, had in zip(moved, known)]
        for row, had in zip(new, known):
            had.update(row)
        padded = np.full((len(leader), max(map(len, new), default=0)), -1, dtype=np.int64)
        for k, row in enumerate(new):
            padded[k, : len(row)] = row
        steps.append(padded)
    return by_byte, leader, steps


def anchors(fingerprints: np.ndarray, threshold: int, blocks: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, anchors): all anchors of each fingerprint (int64), each once."""
    reach = (threshold + 1) // 2
    by_byte, leader, steps = tables(reach)
    words = fingerprints.astype(np.uint64)
    codewords, syndromes = [], []
    for block in range(blocks):
        part = ((words >> np.uint64(LENGTH * block)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        syndrome = by_byte[0][part & 255] ^ by_byte[1][part >> 8 & 255] ^ by_byte[2][part >> 16]
        syndromes.append(syndrome)
        codewords.append((part ^ leader[syndrome]) >> (LENGTH - INFORMATION))
    rows = np.arange(len(words))
    for flips in product(range(reach + 1), repeat=blocks):
        if sum(flips) > reach:
            continue
        at, found = rows, np.zeros(len(rows), dtype=np.int64)
        for block, n in enumerate(flips):
            step = steps[n][syndromes[block][at]]
            keep = step >= 0
            at = np.repeat(at, keep.sum(axis=1))
            found = np.repeat(found, keep.sum(axis=1))
            found = found << INFORMATION | (codewords[block][at] ^ step[keep])
        yield at, found
