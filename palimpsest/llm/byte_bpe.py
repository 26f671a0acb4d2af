"""Operator 8: byte-level BPE by two tiers, a minimal perfect hash for whole pre-tokens and a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm import common

#: Entries that a memo holds at most; what comes later is encoded without being kept.
MEMO = 400_000
_UNTIDY = re.compile(r"\s\s|\A\s|\s\Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def coder(ranks: str, pattern: str) -> Bpe:
    return common.held(("byte-bpe", ranks, pattern), lambda: Bpe(ranks, pattern))


class PerfectHash:
    """A minimal perfect hash of byte strings to their ids.

    Each level hashes the keys that are left into twice as many places and keeps those that are alone in theirs;
    the rank of a kept place among all kept places is the key's slot, so slots have no gaps. A key that isn't in the
    set also falls on some slot or on none, and the key stored there tells. Levels and ids are arrays of 32 bits.
    """

    def __init__(self, ids: dict[bytes, int]):
        left, self.levels, slots, base = list(ids), [], [], 0
        while left:
            size = max(64, 2 * len(left))
            at = np.array([xxhash.xxh64_intdigest(k, len(self.levels)) % size for k in left])
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + base
            self.levels.append((size, array("i", np.where(alone, rank, -1).astype(np.int32).tobytes())))
            kept = sorted((rank[a], k) for a, k in zip(at, left, strict=True) if alone[a])
            slots += [k for _, k in kept]
            base += len(kept)
            left = [k for a, k in zip(at, left, strict=True) if not alone[a]]
        self.keys, self.ids = slots, array("i", [ids[k] for k in slots])

    def get(self, key: bytes) -> int | None:
        for level, (size, slots) in enumerate(self.levels):
            slot = slots[xxhash.xxh64_intdigest(key, level) % size]
            if slot >= 0:
                return self.ids[slot] if self.keys[slot] == key else None
        return None


class Bpe:
    """Ids by the ranks of a tiktoken file; each match of pattern is encoded separately."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = PerfectHash(self.ranks)
        self.pattern = regex.compile(pattern)
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for k, i in self.ranks.items():
            self.table[i] = k
        self.parts: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the pair of least rank, leftmost first, is merged until none is left.

        Bytes are a linked list; the heap holds (rank, place, end of the pair) and entries whose parts have changed
        meanwhile are passed over.
        """
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
        prev = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, z = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != z:
                continue
            end[i], end[mid] = z, 0
            if z < n:
                prev[z] = i
                if (r := ranks.get(piece[i : end[z]])) is not None:
                    heapq.heappush(heap, (r, i, end[z]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:z])) is not None:
                heapq.heappush(heap, (r, p, z))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _token(self, token: str) -> bytes:
        got = self.tokens.get(token)
        if got is None:
            raw = token.encode("utf-8", "surrogatepass")
            one = self.whole.get(raw)
            got = np.array([one] if one is not None else self.merge(raw), "<u4").tobytes()
            if len(self.tokens) < MEMO:
                self.tokens[token] = got
        return got

    def _part(self, part: str) -> bytes:
        return b"".join(map(self._token, self.pattern.findall(part)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        A text is cut before single blanks between other characters; no match of the pattern runs across such a
        place, and what comes before doesn't change the matches after it. Parts seen before are looked up.
        """
        parts = _CUT.split(text) if _UNTIDY.search(text) else text.split(" ")
        memo = self.parts
        got = list(map(memo.get, parts[1:]))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    p = parts[i + 1]
                    got[i] = x = self._part(" " + p)
                    if len(memo) < MEMO:
                        memo[p] = x
        return self._part(parts[0]) + b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs with ids (binary, little-endian unsigned 32-bit); no shuffle.

    A null or empty text has no ids; other columns, null keys and repeated rows pass through, and an input column
    named ids is replaced.
    """

    def make():
        use = coder(ranks, pattern)
        return lambda batch: [[use.encode(t) for t in common.strings(batch)]]

    return common.add_columns(docs, [("ids", T.BinaryType())], make)


def decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs with decoded (binary): the bytes that the column ids stands for; null ids stand for none."""

    def make():
        use = coder(ranks, pattern)
        return lambda batch: [[use.decode(x or b"") for x in batch.column("ids").to_pylist()]]

    return common.add_columns(docs, [("decoded", T.BinaryType())], make)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass; no shuffle.

    ranks: a file of base64 tokens with their ranks, readable on every executor; pattern parts the text. A null or empty
    text has no ids, and the digests are those of no bytes. Very long texts are encoded whole, a part at a time. Other
    columns, null keys and repeated rows pass through; input columns of the three names are replaced. An empty table
    gives an empty result.
    """

    def make():
        use = coder(ranks, pattern)

        def each(batch):
            ids = [use.encode(t) for t in common.strings(batch)]
            return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(use.decode(x)).hexdigest() for x in ids]]

        return each

    return common.add_columns(docs, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make)
