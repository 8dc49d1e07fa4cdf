"""Byte-pair merging of many words at once in flat numpy arrays."""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1) << 60
_MIX = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Which neighbouring symbols merge, at what rank, into what. Symbols are below `size`; others never merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, size: int, tied: np.ndarray | None = None):
        self.size = size
        #: By rank: whether several merged symbols share it. There one merge can come before another of its own round.
        self.tied = np.zeros(int(rank.max(initial=0)) + 1, dtype=bool) if tied is None else tied
        bits = max(10, int(len(rank) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.rank, self.merged = (np.zeros(1 << bits, dtype=np.int64) for _ in range(2))
        keys = left.astype(np.int64) * size + right
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.key[slot[rest]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[put], rank[put], merged[put]
            rest = rest[~np.isin(rest, put)]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, sym: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each symbol with its right neighbour, where same[i] says that both are in one word."""
        rank, merged = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
        at = np.flatnonzero(same & (sym[:-1] < self.size) & (sym[1:] < self.size)) if len(sym) > 1 else np.zeros(0, dtype=np.int64)
        key = sym[at] * self.size + sym[at + 1]
        slot = self._slot(key)
        while len(at):
            held = self.key[slot]
            hit = held == key
            rank[at[hit]], merged[at[hit]] = self.rank[slot[hit]], self.merged[slot[hit]]
            on = ~hit & (held >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & self.mask
        return rank, merged


def merge_rounds(table: MergeTable, sym: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words when no pair is left, and the word of each; own[i], ascending, is the word of sym[i].

    A round finds each word's least rank (a segmented minimum), merges all its leftmost places that don't overlap,
    and closes the gaps. Words without a pair leave the arrays.
    """
    ended: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        rank, merged = table.find(sym, own[:-1] == own[1:])
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[starts, len(sym)])
        least = np.minimum.reduceat(rank, starts)
        done = least == _NONE
        if done.any():
            over = np.repeat(done, sizes)
            ended.append((sym[over], own[over]))
            keep = ~over
            sym, own, rank, merged = sym[keep], own[keep], rank[keep], merged[keep]
            sizes, least = sizes[~done], least[~done]
            if not len(sym):
                break
            starts = np.cumsum(np.r_[0, sizes[:-1]])
        chosen = rank == np.repeat(least, sizes)
        i = np.arange(len(sym))
        chosen &= (i - np.maximum.accumulate(np.where(chosen, -1, i)) - 1) % 2 == 0
        if (shared := table.tied[least]).any():
            first = np.minimum.reduceat(np.where(chosen, i, len(sym)), starts)
            chosen &= ~np.repeat(shared, sizes) | (i == np.repeat(first, sizes))
        sym = np.where(chosen, merged, sym)
        keep = np.r_[True, ~chosen[:-1]]
        sym, own = sym[keep], own[keep]
    if not ended:
        return sym, own
    sym, own = (np.concatenate([x[c] for x in ended]) for c in range(2))
    order = np.argsort(own, kind="stable")
    return sym[order], own[order]
