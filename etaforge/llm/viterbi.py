"""Unigram segmentation into pieces: streaming Viterbi encoding, decoding, and trie-shared counts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame

from .common import DROPS, map_texts

SPACE = "▁"
CACHE_WORDS = 300_000
#: Signs of the runs that a worker remembers, all together, and signs that a decoder takes at a time.
MEMO_SIGNS, CHUNK = 8_000_000, 1 << 16
#: Scores are whole numbers of this part of 1: sums are exact, so equal ones stay equal wherever ids are committed.
SCORE_UNIT = 1 << 32
LEAST, NOTHING = -math.inf, ({}, None, ())
_MODELS: dict = {}


class Pieces:
    """Vocabulary of a sentencepiece file with byte pieces for what it lacks.

    A piece of rank r scores -log(r + 2), Zipf's law, since a merge vocabulary has ranks but no
    probabilities; a byte piece scores worse than any piece. A text is encoded with blanks as the
    space sign and one such sign in front; a space sign of the text itself is marked apart, so
    decoding gives back every text exactly.
    """

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: dict[int, int] = {}
        rank = 0
        self.ids: dict[str, tuple[int, int]] = {}
        self.raw: dict[int, bytes] = {}
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[p] = (round(-math.log(rank + 2) * SCORE_UNIT), i)
                self.raw[i] = p.encode("utf-8")
                rank += 1
        self.longest = max(map(len, self.ids), default=1)
        self.byte_score = round((-math.log(rank + 2) - 10.0) * SCORE_UNIT)
        # By next sign: the longer prefixes of pieces from there, and score and ids of the piece that ends there, if any.
        self.trie: dict = {}
        for p, (score, i) in self.ids.items():
            longer = self.trie
            for c in p:
                node = longer.setdefault(c, [{}, None, ()])
                longer = node[0]
            node[1:] = [score, (i,)]
        # Unless a piece goes on over a space sign behind another sign, all paths meet before such a sign.
        over = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.runs = re.compile(r"(?s).+" if over else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo: dict[str, list[int]] | None = None if over else {}
        self.memo_signs = 0

    def edges(self, signs: str, end: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of every piece that ends before `end`; shorter pieces first."""
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            got = self.ids.get(signs[start:end])
            if got:
                yield start, got[0], (got[1],)
        c = signs[end - 1]
        if c not in self.ids:
            yield end - 1, *self.spelled(c)

    def spelled(self, c: str) -> tuple[int, tuple[int, ...]]:
        """Score and ids of a sign that is no piece, as its bytes."""
        raw = c.encode("utf-8", "surrogatepass")
        return self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)


class StreamingViterbi:
    """Best segmentation of signs that arrive in chunks of any size.

    `open` are the earlier places from which a piece is still open, with their scores and what the trie has
    further on, so none is more than the longest piece back; these and the present place, of score `score`,
    are the surviving ones. `back` holds the backpointers since the last commit. As soon as more of them than the longest piece are held, their paths are followed back at each
    sign; where all pass one boundary, everything before it is final: its ids are returned and
    forgotten. Before a space sign behind another sign only one path is left, which is committed whole;
    the ids between two such places depend on the signs between alone and are remembered. Of equal
    scores the shorter last piece wins.
    """

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.last = ""
        self._restart()

    def _restart(self) -> None:
        self.back: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        self.open: list[tuple[int, int, dict]] = []
        self.score = 0

    def feed(self, chunk: str, end: bool = False) -> list[int]:
        """Ids that become final with this chunk; all of them if it is the last one."""
        out: list[int] = []
        memo, runs = self.p.memo, self.p.runs.findall(chunk)
        for at, run in enumerate(runs):
            if memo is None or (run[0] != SPACE or self.last == SPACE) and self.last:
                out += self._steps(run)  # goes on with what the chunk before left open
            else:
                if len(self.back) > 1:
                    out += self._flush()
                got = memo.get(run)
                if got is not None and (end or at + 1 < len(runs)):
                    out += got
                elif end or at + 1 < len(runs):
                    out += self._remember(run)
                else:
                    out += self._steps(run)  # may go on in the next chunk
            self.last = run[-1]
        if end:
            out += self._flush()
        return out

    def _remember(self, run: str) -> list[int]:
        ids = self._steps(run)
        ids += self._flush()
        if self.p.memo_signs > MEMO_SIGNS:
            self.p.memo.clear()
            self.p.memo_signs = 0
        self.p.memo[run] = ids
        self.p.memo_signs += len(run)
        return ids

    def _steps(self, signs: str) -> list[int]:
        out: list[int] = []
        back, open_, score, trie = self.back, self.open, self.score, self.p.trie
        here, most = len(back) - 1, self.p.longest
        for c in signs:
            best, start, piece, following = LEAST, here, (), []
            for at, base, longer in open_:  # long pieces first
                node = longer.get(c)
                if node is not None:
                    further, s, ids = node
                    if further:
                        following.append((at, base, further))
                    if s is not None and base + s >= best:
                        best, start, piece = base + s, at, ids
            further, s, ids = trie.get(c) or NOTHING
            if s is None:
                s, ids = self.p.spelled(c)
            if score + s >= best:
                best, start, piece = score + s, here, ids
            if further:
                following.append((here, score, further))
            back.append((start, piece))
            open_, score, here = following, best, here + 1
            if here > most:
                cut = self._meeting(open_, here)
                if cut:
                    out += self._path(cut)
                    back[:] = [(0, ()), *((max(0, b - cut), ids) for b, ids in back[cut + 1 :])]
                    open_, here = [(at - cut, base, longer) for at, base, longer in open_], here - cut
        self.open, self.score = open_, score
        return out

    def _meeting(self, open_: list[tuple[int, int, dict]], here: int) -> int:
        """Last boundary that the paths of all surviving places pass; 0 if they share none since the last commit."""
        back, cut = self.back, here
        for other, _, _ in open_:
            while other != cut:
                if other > cut:
                    other = back[other][0]
                else:
                    cut = back[cut][0]
            if not cut:
                break
        return cut

    def _path(self, end: int) -> list[int]:
        parts = []
        while end > 0:
            start, ids = self.back[end]
            parts.append(ids)
            end = start
        return [i for ids in reversed(parts) for i in ids]

    def _flush(self) -> list[int]:
        ids = self._path(len(self.back) - 1)
        self._restart()
        return ids

    def finish(self) -> list[int]:
        ids = self._flush()
        self.last = ""
        return ids


# A space sign of the text becomes MARK + OWN, and MARK itself becomes MARK + MARKED.
MARK, OWN, MARKED = "\ue000", "\ue002", "\ue001"


def to_signs(text: str) -> str:
    """Blanks as space signs, one in front; own space signs are marked apart."""
    if SPACE in text or MARK in text:
        text = text.replace(MARK, MARK + MARKED).replace(SPACE, MARK + OWN)
    return SPACE + text.replace(" ", SPACE)


def from_signs(signs: str) -> str:
    text = signs[1:].replace(SPACE, " ")
    if MARK in text:
        text = text.replace(MARK + OWN, SPACE).replace(MARK + MARKED, MARK)
    return text


def pre_tokens(signs: str) -> list[str]:
    """Cut before each run of space signs: pieces never cross these places."""
    words, at = [], 0
    while at < len(signs):
        end = at
        while end < len(signs) and signs[end] == SPACE:
            end += 1
        nxt = signs.find(SPACE, end)
        nxt = len(signs) if nxt < 0 else nxt
        words.append(signs[at:nxt])
        at = nxt
    return words


def words_of(text: str) -> list[str]:
    signs = to_signs(text)
    if SPACE + SPACE in signs or signs[-1] == SPACE:
        return pre_tokens(signs)
    return [SPACE + w for w in signs[1:].split(SPACE)]


def encode_text(p: Pieces, text: str) -> list[int]:
    """Ids of the whole text by one decoder; none for an empty text."""
    if not text:
        return []
    v, signs = StreamingViterbi(p), to_signs(text)
    out: list[int] = []
    for at in range(0, len(signs), CHUNK):
        out += v.feed(signs[at : at + CHUNK], end=at + CHUNK >= len(signs))
    return out


def decode_ids(p: Pieces, ids: Iterable[int]) -> str:
    raw = b"".join(map(p.raw.__getitem__, ids))
    return from_signs(raw.decode("utf-8", "surrogatepass")) if raw else ""


def counts_by_trie(p: Pieces, words: list[str]) -> dict[str, int]:
    """Pieces of each distinct pre-token; forward scores are computed once per shared prefix.

    Walking the sorted words is a depth-first walk of their trie: what stays on the stack is the
    path of the prefix shared with the word before. A word's end stores its count.
    """
    out: dict[str, int] = {}
    # At each place of the path: its score, its pieces, and the earlier places from which a piece is still open.
    score, count, opened, before, trie = [0], [0], [[]], "", p.trie
    for w in sorted(set(words)):
        shared = 0
        most = min(len(w), len(before))
        while shared < most and w[shared] == before[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :], opened[shared + 1 :]
        here, pieces_here, open_ = score[-1], count[-1], opened[-1]
        for c in w[shared:]:
            best, n, following = LEAST, 0, []
            for base, k, longer in open_:  # long pieces first; of equal scores the shorter last piece wins
                node = longer.get(c)
                if node is not None:
                    further, s, _ = node
                    if further:
                        following.append((base, k, further))
                    if s is not None and base + s >= best:
                        best, n = base + s, k + 1
            further, s, ids = trie.get(c) or NOTHING
            if s is None:
                s, ids = p.spelled(c)
            if here + s >= best:
                best, n = here + s, pieces_here + len(ids)
            if further:
                following.append((here, pieces_here, further))
            here, pieces_here, open_ = best, n, following
            score.append(here)
            count.append(n)
            opened.append(open_)
        out[w], before = count[-1], w
    return out


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, ids (one array per text; none for empty and null texts) and decoded text.

    Null texts decode to null, all others to themselves. A very long text is one row of ids. An empty
    table gives no rows, repeated rows and null ids one row each; columns not in `keep` do not matter.
    Of segmentations of equal score that with the shorter last piece is taken, at every place.
    """

    def run(texts: list) -> dict:
        p = pieces(model)
        ids = [encode_text(p, t or "") for t in texts]
        return {"ids": ids, "decoded": [None if t is None else decode_ids(p, i) for t, i in zip(texts, ids, strict=True)]}

    text = "_text"
    while text in docs.columns:
        text += "_"
    return map_texts(docs.withColumn(text, docs["text"]), run, keep, "ids array<int>, decoded string", text=text)


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row: pre-tokens, and pieces of the best segmentation.

    Null and empty texts have 0 of both. Distinct pre-tokens of a slice of texts share one trie;
    counts of frequent ones are kept for the next slices.
    """

    def run(texts: list) -> dict:
        p = pieces(model)
        cut = [words_of(t) if t else [] for t in texts]
        known = counts_of(model)
        if len(known) > CACHE_WORDS:
            known.clear()
        known.update(counts_by_trie(p, list(set(chain.from_iterable(cut)).difference(known))))
        return {"n_words": [len(ws) for ws in cut], "n_tokens": [sum(map(known.__getitem__, ws)) for ws in cut]}

    return map_texts(docs, run, ("doc_id",), "n_words bigint, n_tokens bigint")


_COUNTS: dict[str, dict[str, int]] = {}


def _drop() -> None:
    _MODELS.clear()
    _COUNTS.clear()


DROPS[__name__] = _drop


def counts_of(model: str) -> dict[str, int]:
    return _COUNTS.setdefault(model, {})
