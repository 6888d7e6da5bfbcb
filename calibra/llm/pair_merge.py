"""Byte-pair merging of many pre-tokens at once.

`PairMerger` holds the merge rules as sorted pair keys.  `merge` takes a list of byte
strings and applies to each of them, in lockstep, the rule "merge the pair of lowest rank,
leftmost on ties, until none is left".  Strings are grouped by length into matrices of
symbol ids with the rank of the pair that starts at every column; a step merges one pair
per string and looks up only the two pairs that changed.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np

NONE = np.int32(2**31 - 1)
LONGEST = 96
ROWS = 2048


class PairMerger:
    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray,
                 rank: np.ndarray, merged: np.ndarray):
        """byte_ids[b]: id of the single byte b; the pair (left, right) of ids merges into
        `merged` with priority `rank`."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.byte_ids = byte_ids.astype(np.int32)
        self.key, self.rank, self.merged = key[order], rank[order].astype(np.int32), merged[order].astype(np.int32)
        self.first = np.full((256, 256), -1, np.int32)      # entry of each pair of bytes
        grid = self.byte_ids.astype(np.int64)
        self.first[:] = self._find(np.repeat(grid, 256), np.tile(grid, 256)).reshape(256, 256)
        self.pairs: dict[tuple[int, int], int] | None = None

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each pair of ids, -1 where no rule has it."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.key, key), self.key.size - 1)
        return np.where(self.key[at] == key, at, -1).astype(np.int32)

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers, in the order given."""
        out: list[bytes] = [b""] * len(words)
        for group, ids, offsets in self._groups(words):
            data, ends = ids.astype("<i4").tobytes(), (offsets * 4).tolist()
            for i, a, b in zip(group.tolist(), ends, ends[1:]):
                out[i] = data[a:b]
        return out

    def count(self, words: list[bytes]) -> list[int]:
        """Number of ids of each word."""
        out = np.zeros(len(words), np.int64)
        for group, _, offsets in self._groups(words):
            out[group] = np.diff(offsets)
        return out.tolist()

    def _groups(self, words: list[bytes]):
        """(word numbers, their ids in a row, offsets) of groups of like length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        short = order[:np.searchsorted(lengths[order], LONGEST, side="right")]
        for at in range(0, len(short), ROWS):
            group = short[at:at + ROWS]
            ids, left = self._merge_matrix([words[i] for i in group.tolist()], lengths[group])
            yield group, ids[np.arange(ids.shape[1])[None, :] < left[:, None]], np.concatenate([[0], np.cumsum(left)])
        for i in order[len(short):]:
            ids = self._merge_long(words[i])
            yield np.array([i]), ids, np.array([0, ids.size])

    def _merge_matrix(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(lengths.max())
        result = np.zeros((n, max(width, 1)), np.int32)
        left = lengths.copy()
        if width == 0:
            return result, left
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = np.zeros((n, width + 1), np.int32)
        ids[:, :width] = self.byte_ids[raw]
        rank = np.full((n, width + 1), NONE, np.int32)
        entry = np.full((n, width + 1), -1, np.int32)
        if width > 1:
            pair = self.first[raw[:, :-1], raw[:, 1:]]
            pair[np.arange(width - 1)[None, :] >= (lengths - 1)[:, None]] = -1
            entry[:, :width - 1] = pair
            rank[:, :width - 1] = np.where(pair >= 0, self.rank[pair], NONE)
        rows, columns = np.arange(n), np.arange(width + 1)
        live = left.copy()
        while True:
            at = rank.argmin(1)
            r = np.arange(len(rows))
            busy = rank[r, at] < NONE
            if not busy.all():                     # finished words leave the matrix
                done = ~busy
                result[rows[done]] = ids[done][:, :result.shape[1]]
                left[rows[done]] = live[done]
                rows, ids, rank, entry, live, at = (x[busy] for x in (rows, ids, rank, entry, live, at))
                if not rows.size:
                    return result, left
                r = np.arange(len(rows))
            new = self.merged[entry[r, at]]
            pick = columns[None, :] + (columns[None, :] > at[:, None])
            np.minimum(pick, width, out=pick)
            pick += r[:, None] * (width + 1)
            ids, rank, entry = ids.ravel()[pick], rank.ravel()[pick], entry.ravel()[pick]
            ids[r, at] = new
            live = live - 1
            for side in (at - 1, at):              # pairs that the merge changed
                ok = (side >= 0) & (side + 1 < live)
                s = np.maximum(side, 0)
                found = np.where(ok, self._find(ids[r, s], ids[r, np.minimum(s + 1, width)]), -1)
                # side at - 1 does not exist for a merge at column 0: leave column 0 to the other side
                where = side >= 0
                entry[r[where], s[where]] = found[where]
                rank[r[where], s[where]] = np.where(found >= 0, self.rank[found], NONE)[where]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """A very long pre-token: a heap of pairs over a linked list, n log n."""
        if self.pairs is None:
            self.pairs = {(int(k) >> 32, int(k) & 0xFFFFFFFF): e for e, k in enumerate(self.key)}
        n, pairs, rank, merged = len(word), self.pairs, self.rank, self.merged
        ids: list[int | None] = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(rank[e]), i, e) for i in range(n - 1) if (e := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or pairs.get((ids[i], ids[j])) != e:
                continue
            ids[i], ids[j] = int(merged[e]), None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (f := pairs.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (int(rank[f]), a, f))
        return np.array([x for x in ids if x is not None], np.int32)


def from_ranks(rank_of: dict[bytes, int]) -> PairMerger:
    """Rules of a rank file: two tokens merge when their joined bytes are a token, whose
    id is the priority."""
    left, right, rank = [], [], []
    for token, i in rank_of.items():
        for cut in range(1, len(token)):
            a, b = rank_of.get(token[:cut]), rank_of.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(i)
    ids = np.array([rank_of[bytes([b])] for b in range(256)])
    r = np.array(rank, np.int64)
    return PairMerger(ids, np.array(left), np.array(right), r, r)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, the alphabet of byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_byte_bpe(path: str) -> tuple[PairMerger, dict[bytes, int], list[str]]:
    """(merger, byte strings of the vocabulary, special strings) of a byte-level BPE file
    in the tokenizers JSON format."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") \
            or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("a byte-level BPE file without normalizer and prefix space is expected")
    vocab = spec["model"]["vocab"]
    letter = byte_alphabet()
    byte_of = {c: b for b, c in letter.items()}
    rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    merger = PairMerger(np.array([vocab[letter[b]] for b in range(256)]),
                        np.array([vocab[a] for a, _ in rules]), np.array([vocab[b] for _, b in rules]),
                        np.arange(len(rules)), np.array([vocab[a + b] for a, b in rules]))
    strings = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if all(c in byte_of for c in s)}
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    return merger, strings, specials
