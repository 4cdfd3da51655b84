"""Byte-level BPE over a rank file, many pieces at once, with segment trees in numpy.

Each piece of text is a row. Its leaves are byte positions; a leaf holds the rank of the pair
that starts there (rank * width + position, so the minimum is the leftmost lowest rank), and
every inner node the minimum of its two children. A merge reads the root, joins two neighbours
and updates three leaves and their ancestors: logarithmic work a merge.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

_NONE = np.int64(1) << 62
#: Leaves (rows * width) that one run of trees may hold.
LEAVES = 1 << 17


class Ranks:
    """A rank file: token bytes by id, and the pairs of ids whose bytes join to a token."""

    def __init__(self, tokens: dict[bytes, int]):
        self.tokens = tokens
        self.bytes = {i: t for t, i in tokens.items()}
        byte_id = np.full(256, -1, np.int64)
        for b in range(256):
            byte_id[b] = tokens.get(bytes([b]), -1)
        if (byte_id < 0).any():
            raise ValueError("the rank file lacks single bytes")
        self.byte_id = byte_id
        pairs = {}
        for token, i in tokens.items():
            for cut in range(1, len(token)):
                left, right = tokens.get(token[:cut]), tokens.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self._build(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table, filled a round of free slots at a time."""
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        slot, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 1
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & (size - 1)
            self.probes += bool(len(rest))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of left's bytes followed by right's, or -1; -1 too where an id is negative."""
        keys = left << 20 | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, as the merges of the rank file give them."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.tokens.get(piece)
            if whole is not None or not piece:
                out[i] = np.array([whole] if piece else [], np.int64)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            step = max(1, LEAVES // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._trees([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _trees(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(width) < length[:, None]
        ids = np.where(inside, self.byte_id[raw], np.int64(-1))
        succ = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        pred = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE)
        rank = np.full((n, width), -1, np.int64)
        rank[:, :-1] = self.joined(ids[:, :-1].reshape(-1).copy(), ids[:, 1:].reshape(-1).copy()).reshape(n, width - 1)
        tree[:, width:] = np.where(rank >= 0, rank * width + np.arange(width), _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        # flat views: position p of row r is r * width + p, its tree node r * 2 * width + width + p
        ids, succ, pred, tree = ids.reshape(-1), succ.reshape(-1), pred.reshape(-1), tree.reshape(-1)
        live = np.arange(n)
        while True:
            root = tree[live * (2 * width) + 1]
            open_ = root < _NONE
            if not open_.all():
                live, root = live[open_], root[open_]
            if not len(live):
                break
            base, at, merged = live * width, root % width, root // width
            here = base + at
            gone = succ[here]
            beyond = succ[base + gone]
            before = pred[here]
            ids[here] = merged
            ids[base + gone] = -1
            succ[here] = beyond
            has, back = beyond < width, before >= 0
            pred[(base + beyond)[has]] = at[has]
            right = np.where(has, ids[base + np.minimum(beyond, width - 1)], -1)
            left = np.where(back, ids[base + np.maximum(before, 0)], -1)
            both = self.joined(np.concatenate([merged, left]), np.concatenate([right, merged]))
            where = np.concatenate([at, before])
            value = np.where(both >= 0, both * width + where, _NONE)
            stem = live * (2 * width)
            tree[stem + width + gone] = _NONE
            tree[stem + width + at] = value[: len(live)]
            tree[(stem + width + before)[back]] = value[len(live) :][back]
            self._climb(tree, np.concatenate([stem, stem, stem[back]]), np.concatenate([gone, at, before[back]]) + width)
        return [row[row >= 0] for row in ids.reshape(n, width)]

    @staticmethod
    def _climb(tree: np.ndarray, stem: np.ndarray, node: np.ndarray) -> None:
        """Renew the ancestors of changed leaves, one level of all rows at a time."""
        while node[0] > 1:
            child = stem + (node & -2)
            node = node >> 1
            tree[stem + node] = np.minimum(tree[child], tree[child + 1])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def ranks_of(path: str) -> Ranks:
    """The rank file at path, read once a worker."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
