"""Byte-level BPE encoding and decoding with a rank queue in a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame

from .common import DROPS, map_texts

#: Bits of a bottom word of the bitmap; the top word has a bit per bottom word.
WORD_BITS = 10
IN_WORD = (1 << WORD_BITS) - 1
#: Pre-tokens kept per generation and worker.
CACHE_PIECES = 400_000


class RankQueue:
    """Positions by merge rank. A bit per rank that has a bucket, and a bit per word that has a bit,
    so the lowest rank is two find-first-sets away, however many ranks there are. A bucket is a heap:
    of equal ranks the leftmost position comes first."""

    def __init__(self, ranks: int):
        self.top = 0
        self.words = [0] * ((ranks >> WORD_BITS) + 1)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            w = rank >> WORD_BITS
            self.words[w] |= 1 << (rank & IN_WORD)
            self.top |= 1 << w
        else:
            heappush(bucket, at)

    def pop(self) -> tuple[int, int]:
        """Lowest rank and its leftmost position; (-1, -1) when empty."""
        top = self.top
        if not top:
            return -1, -1
        w = (top & -top).bit_length() - 1
        word = self.words[w]
        rank = (w << WORD_BITS) | ((word & -word).bit_length() - 1)
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            word &= word - 1
            self.words[w] = word
            if not word:
                self.top = top & (top - 1)
        return rank, at


class Pieces(dict):
    """Pre-token to packed ids. The last two generations are kept, so frequent ones stay."""

    def __init__(self, bpe: RankBpe):
        super().__init__()
        self.bpe = bpe
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            ids = self.bpe.merge(piece.encode("utf-8", "surrogatepass"))
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = got
        return got


class RankBpe:
    """Encoder and decoder of a rank file (one base64 token and its rank a line) and a pattern."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines.splitlines()) if t}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.tokens, default=0) + 1)
        self.pieces = Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: itself if it is a token, else its bytes after all merges, always the
        pair of lowest rank and of those the leftmost.

        Parts are a linked list over byte positions. A queue entry (rank, position) is stale when
        the pair that begins there has another rank by now: merged parts only grow, so a pair never
        gets back a rank it had. A piece of n bytes takes n pushes and two a merge, whatever its length.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, queue, get = len(piece), self.queue, ranks.get
        after = list(range(1, n + 2))  # start of the next part
        before = list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that begins here
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        while True:
            rank, i = queue.pop()
            if rank < 0:
                break
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[j]
            after[i] = end
            before[end] = i
            pair[j] = -1
            r = get(piece[i : after[end]]) if end < n else None
            if r is None:
                pair[i] = -1
            else:
                pair[i] = r
                queue.push(r, i)
            h = before[i]
            if h >= 0:
                r = get(piece[h:end])
                if r is None:
                    pair[h] = -1
                else:
                    pair[h] = r
                    queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, unpacked(ids)))


def unpacked(ids: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(ids) // 4}I", ids)


_ENCODERS: dict[tuple[str, str], RankBpe] = {}
DROPS[__name__] = _ENCODERS.clear


def encoder(lines: bytes, pattern: str) -> RankBpe:
    """One encoder per vocabulary, pattern and worker."""
    key = hashlib.sha256(lines).hexdigest(), pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = RankBpe(lines, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns of every row, `ids` (packed little-endian unsigned 32-bit integers) and
    `decoded`, the bytes that the ids give back.

    `ranks` is the content of a rank file; every match of `pattern` is encoded by itself, what it
    does not match is left out, and there are no special tokens. Null and empty texts have no ids.
    A task holds a slice of texts; one pre-token may be as long as a text. Rows are mapped one by
    one, so ties, repeated rows and null ids need no rule, and an empty table gives no rows.
    """

    def run(texts: list) -> dict:
        bpe = encoder(ranks, pattern)
        ids = [bpe.encode(t) if t else b"" for t in texts]
        return {"ids": ids, "decoded": list(map(bpe.decode, ids))}

    docs = docs.withColumn("_rank_text", docs[text])
    return map_texts(docs, run, keep, "ids binary, decoded binary", text="_rank_text")
