"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's rule, in numpy."""

from __future__ import annotations

import numpy as np

FIRST = 7
LANES = 32_768


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (symbols below 511) in lexicographic order.

    Suffixes are ordered by their first 7 symbols; then groups that still tie are refined by the
    rank of what follows the part already compared, which doubles that part each round. Groups of
    one are never touched again.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(FIRST):
        key <<= np.uint64(9)
        key[: max(0, n - k)] |= text[k:].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    fresh = np.ones(n, dtype=bool)
    sorted_key = key[order]
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    del key, sorted_key
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = start
    single = fresh & np.concatenate((fresh[1:], [True]))
    place = np.flatnonzero(~single)  # places of the order that belong to groups of several
    done = FIRST
    while len(place):
        here = order[place]
        then = here + done
        follow = np.zeros(len(here), dtype=np.int64)
        inside = then < n
        follow[inside] = rank[then[inside]] + 1
        group = rank[here]
        pair = (group.astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        by = np.argsort(pair)
        here, pair = here[by], pair[by]
        order[place] = here
        fresh = np.ones(len(here), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))
        rank[here] = place[start]
        single = fresh & np.concatenate((fresh[1:], [True]))
        place = place[~single]
        done *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the order, the length up to ``most`` that its suffix shares with the one before.

    Kasai's rule: going through the text, the length falls by one at most from a suffix to the next, so
    comparison goes on from there. Stretches of the text go side by side, one in each lane.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((text.astype(np.uint16), np.full(most + 8, 600, np.uint16)))
    words = np.zeros(n + most + 4, dtype=np.uint64)
    for k in range(4):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(16 * k)
    lanes = min(LANES, max(1, n // 64))
    width = -(-n // lanes)
    first = np.arange(lanes) * width
    length = np.zeros(lanes, dtype=np.int64)
    out = np.zeros(n, dtype=np.int64)
    for step in range(width):
        i = first + step
        live = np.flatnonzero(i < n)
        i, j = i[live], before[i[live]]
        size = np.maximum(length[live] - 1, 0)
        size[j < 0] = 0
        going = np.flatnonzero((j >= 0) & (size < most))
        while len(going):
            a, b = i[going] + size[going], j[going] + size[going]
            ok = b < n
            differ = words[a] ^ words[np.minimum(b, n)]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 4, np.bitwise_count(low - np.uint64(1)) // 16)
            same = np.minimum(np.where(ok, same, 0), np.minimum(n - np.maximum(a, b), 4))
            size[going] += same
            going = going[(same == 4) & (size[going] < most)]
        size = np.minimum(size, most)
        length[live] = size
        out[i] = size
    return out[order]
