"""Language identification by bit-sliced Bloom filters over letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mix, ship, take_over

#: A trigram is in a language's filter if its share of that language's trigrams is at least this,
#: so a filter has at most a million members whatever the size of the corpus ...
MIN_SHARE = 1e-6
#: ... and at least this part of the largest share it has in any language.
MIN_PART = 0.2
PROBES = 3
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str) -> np.ndarray:
    """Keys of all runs of three code points whose middle one is a letter; other signs count as blanks."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    code = np.where(is_letter, code, 32).astype(np.uint64)
    key = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    return key[is_letter[1:-1]]


@dataclass
class LanguageFilter:
    names: list[str]
    bits: np.ndarray  # positions x words of 64 languages: bit l of a row is set in language l's filter
    wrong: np.ndarray  # share of false members of each language's filter

    @staticmethod
    def probes(keys: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(keys + np.uint64(0x9E3779B97F4A7C15))
        step = (mix(h) | np.uint64(1)) % np.uint64(size)
        return [((h % np.uint64(size)) + np.uint64(k) * step) % np.uint64(size) for k in range(PROBES)]

    @classmethod
    def build(cls, members: dict[str, np.ndarray], bits_per_key: int = 10) -> LanguageFilter:
        names = sorted(members)
        size = max(1024, bits_per_key * max((len(v) for v in members.values()), default=0)) | 1
        bits = np.zeros((size, max(1, -(-len(names) // 64))), np.uint64)
        for l, name in enumerate(names):
            for at in cls.probes(members[name], size):
                bits[at, l // 64] |= np.uint64(1) << np.uint64(l % 64)
        fill = np.array([(bits[:, l // 64] >> np.uint64(l % 64) & np.uint64(1)).mean() for l in range(len(names))])
        return cls(names, bits, fill**PROBES)

    @classmethod
    def from_counts(cls, rows: list[tuple[str, int, int, int]]) -> LanguageFilter:
        """rows: language, trigram, its count, all trigrams of the language."""
        share: dict[str, dict[int, float]] = {}
        top: dict[int, float] = {}
        for lang, key, n, total in rows:
            p = n / total
            share.setdefault(lang, {})[key] = p
            top[key] = max(p, top.get(key, 0.0))
        return cls.build(
            {
                lang: np.fromiter((k for k, p in own.items() if p >= MIN_SHARE and p >= MIN_PART * top[k]), np.uint64)
                for lang, own in share.items()
            }
        )

    @classmethod
    def learn_texts(cls, texts: list[str], langs: list[str]) -> LanguageFilter:
        rows = []
        for lang in sorted(set(langs)):
            sums: dict[int, int] = {}
            for t, l in zip(texts, langs, strict=True):
                if l == lang:
                    uniq, n = np.unique(trigrams(t), return_counts=True)
                    for k, c in zip(uniq.tolist(), n.tolist(), strict=True):
                        sums[k] = sums.get(k, 0) + c
            total = sum(sums.values())
            rows += [(lang, k, c, total) for k, c in sums.items()]
        return cls.from_counts(rows)

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Language and score: the popcounts less the members expected by chance, as shares.

        `und` with score 0 for null texts, texts without a letter, and where no language was learned.
        Of equal counts the first name wins.
        """
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        shifts = [np.arange(min(64, len(self.names) - lo), dtype=np.uint64) for lo in range(0, len(self.names), 64)]
        for i, t in enumerate(texts):
            uniq, n = np.unique(trigrams(t), return_counts=True) if t else ((), ())
            if not len(uniq) or not self.names:
                continue
            mask = None
            for at in self.probes(uniq, len(self.bits)):
                mask = self.bits[at] if mask is None else mask & self.bits[at]
            hits = np.concatenate([n @ (mask[:, [w]] >> s & np.uint64(1)).astype(np.int64) for w, s in enumerate(shifts)])
            total = n.sum()
            real = np.clip((hits - total * self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0, None)
            best = int(real.argmax())
            langs[i] = self.names[best]
            scores[i] = real[best] / real.sum() if real.sum() > 0 else 1 / len(self.names)
        return langs, scores


def held_out(col: str):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, known: Column | None = None) -> LanguageFilter:
    """Filters from the text and lang of all rows that are not held out, or of those that are `known`.

    Trigrams are counted exactly over all of them; only those of a share of MIN_SHARE or more in a
    language reach the driver, at most a million for a language. Null texts and langs are skipped.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        grams = Grams()

        def rows(most: int) -> Iterator[pa.RecordBatch]:
            for lang, ks, ns in grams.taken(most):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(ks)), pa.array(ks, pa.int64()), pa.array(ns, pa.int64())], ["lang", "gram", "n"]
                )

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256).to_pydict()
                grams.add(part["text"], part["lang"])
            yield from rows(500_000)
        yield from rows(0)

    return from_grams(
        docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (~held_out("doc_id") if known is None else known))
        .select("text", "lang")
        .mapInArrow(count, "lang string, gram long, n long")
    )


class Grams:
    """Trigram counts of each language in one task. Null texts and langs are skipped."""

    def __init__(self):
        self.sums: dict[str, dict[int, int]] = {}
        self.held = 0

    def add(self, texts: list, langs: list) -> None:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(texts, langs, strict=True):
            if text is not None and lang is not None:
                by.setdefault(lang, []).append(trigrams(text))
        for lang, keys in by.items():
            uniq, n = np.unique(np.concatenate(keys), return_counts=True)
            own = self.sums.setdefault(lang, {})
            before = len(own)
            for k, c in zip(uniq.astype(np.int64).tolist(), n.tolist(), strict=True):
                own[k] = own.get(k, 0) + c
            self.held += len(own) - before

    def taken(self, most: int) -> Iterator[tuple[str, list[int], list[int]]]:
        """All counts, which are then forgotten, if more than `most` are held."""
        if self.held <= most:
            return
        for lang, own in self.sums.items():
            items = list(own.items())
            for lo in range(0, len(items), 50_000):
                ks, ns = zip(*items[lo : lo + 50_000], strict=True)
                yield lang, list(ks), list(ns)
        self.sums, self.held = {}, 0


def from_grams(found: DataFrame) -> LanguageFilter:
    """Filters from trigram counts (lang, gram, n), several for a trigram."""
    from ..session import write_through

    counts = write_through(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    if not totals:
        return LanguageFilter.build({})
    totals_df = found.sparkSession.createDataFrame(list(totals.items()), "lang string, t long")
    kept = counts.join(F.broadcast(totals_df), "lang").where(F.col("n") >= MIN_SHARE * F.col("t")).toPandas()
    return LanguageFilter.from_counts(list(zip(kept.lang, kept.gram, kept.n, kept.t, strict=True)))


def predict(docs: DataFrame, filters: LanguageFilter) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(texts: list) -> dict:
        langs, scores = shared.value.predict(texts)
        return {"lang_pred": langs, "score": scores}

    out = map_texts(docs, run, ("doc_id",), "lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
