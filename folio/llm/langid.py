"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the TOP most frequent n-grams of a language, in order. A document's own most frequent
n-grams are compared to each profile by the sum of how far out of place each is; one that the profile lacks counts as
TOP places. Counting runs over whole texts in numpy; what is shuffled are counts by (language, n-gram) only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: n-grams in a profile; longest n-gram.
TOP, N = 400, 3
UNKNOWN = "und"
#: Characters handled at once: bounds the memory of counting.
BLOCK = 1 << 20
_B = 1 << 21  # over the largest code point
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """By code point: whether it is a letter, as str.isalpha() has it."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def squeeze(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters than letters as one space, one at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(is_letter()[c], c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def grams(c: np.ndarray) -> np.ndarray:
    """Codes of the 1- to 3-grams within words (a space marks a word's edge); 21 bits a character."""
    c = c.astype(np.int64)
    one = c[c != 32]
    two = c[:-1] * _B + c[1:]
    three = (two[:-1] * _B + c[2:])[c[1:-1] != 32] if len(c) > 2 else c[:0]
    return np.concatenate([one, two[(c[:-1] != 32) | (c[1:] != 32)], three])


def counted(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and counts; long texts in blocks, so that memory stays bounded."""
    if len(c) <= BLOCK:
        g = np.sort(compact(c))
        edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        return expand(g[edge], c), np.diff(np.append(edge, len(g)))
    parts = [counted(c[a : a + BLOCK]) for a in range(0, len(c) - 2, BLOCK - 2)]
    # blocks overlap by two characters: their 1- and 2-grams there count once
    keys, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(inv, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
    for a in range(BLOCK - 2, len(c) - 2, BLOCK - 2):
        seam = c[a : a + 2].astype(np.int64)
        for x in [*seam[seam != 32], *([seam[0] * _B + seam[1]] if (seam != 32).any() else [])]:
            n[np.searchsorted(keys, x)] -= 1
    return keys, n


def compact(c: np.ndarray) -> np.ndarray:
    """grams(c) over the text's own alphabet, so that codes are small and sort fast."""
    alphabet = _alphabet(c)
    back = np.zeros(int(alphabet[-1]) + 1, np.int64)
    back[alphabet] = np.arange(len(alphabet))
    x, size = back[c], len(alphabet) + 1
    space = back[32] if 32 < len(back) else -1
    word = x != space
    two = (x[:-1] + 1) * size + x[1:] + 1
    three = (two[:-1] * size + x[2:] + 1)[word[1:-1]]
    out = np.concatenate([x[word] + 1, two[word[:-1] | word[1:]], three])
    return out.astype(np.int32) if size**3 < 1 << 31 else out


def _alphabet(c: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(c)) if len(c) and c.max() < 1 << 16 else np.unique(np.append(c, np.uint32(32)))


def expand(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Codes of compact() as codes of grams()."""
    alphabet = np.concatenate([[0], _alphabet(c)]).astype(np.int64)
    size, g = len(alphabet), g.astype(np.int64)
    return (alphabet[g // (size * size)] * _B + alphabet[g // size % size]) * _B + alphabet[g % size]


def spell(code: int) -> str:
    out = ""
    while code:
        out, code = chr(code % _B) + out, code // _B
    return out


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, rank (from 0) of the TOP n-grams of each language, counted over all rows with text and lang.

    Ties in count go to the smaller n-gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts add up over the task; as much as one task can hold goes out when it grows large.
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for name, (k, n) in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k), pa.array(n)], ["lang", "gram", "n"])
            totals.clear()

        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for t, name in zip(b.column(0), b.column(1).to_pylist()):
                by.setdefault(name, []).append(squeeze(t.as_py()))
            for name, parts in by.items():
                held, size = [], 0
                for part in [*parts, None]:
                    if held and (part is None or size + len(part) > BLOCK):
                        keys, n = counted(np.concatenate(held))
                        if name in totals:
                            both, inv = np.unique(np.concatenate([totals[name][0], keys]), return_inverse=True)
                            keys, n = both, np.bincount(inv, np.concatenate([totals[name][1], n]), len(both)).astype(np.int64)
                        totals[name], held, size = (keys, n), [], 0
                    if part is not None:
                        held.append(part)
                        size += len(part)
            if sum(len(k) for k, _ in totals.values()) > 1_000_000:
                yield from out()
        yield from out()

    rows = pick(docs, text=text, lang=lang).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # the limit is on row_number itself, so that each task keeps its first TOP before they meet (WindowGroupLimit)
    best = n.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP)
    return best.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Judge:
    """Distances of one text to all profiles."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.keys = np.unique(np.array([r[1] for r in rows], np.int64))
        self.places = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        at = {x: i for i, x in enumerate(self.langs)}
        for name, gram, rank in rows:
            self.places[at[name], np.searchsorted(self.keys, gram)] = rank

    def __call__(self, text: str | None) -> tuple[str, float]:
        c = squeeze(text) if text else np.zeros(0, np.uint32)
        if len(c) < 3 or not self.langs:
            return UNKNOWN, 0.0
        k, n = counted(c)
        k = k[np.lexsort((k, -n))[:TOP]]
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        i = np.where(self.keys[i] == k, i, len(self.keys))
        place = self.places[:, i]
        away = np.where(place < 0, TOP, np.abs(place - np.arange(len(k)))).sum(1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (TOP * len(k)))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0. A null id counts as empty text, so it is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, learn: DataFrame, doc_id: str = "doc_id", text: str = "text", text_learn: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, by profiles of learn.

    Null text and text without a letter: und, score 0; so is everything if nothing could be learned. Ties
    in distance go to the smaller lang value. The score is 1 - distance / greatest possible distance.
    The profiles collected are TOP rows for each language, whatever the number of documents.
    """
    judge = Judge([tuple(r) for r in profiles(learn, text_learn, lang).collect()])
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    d = pick(docs, doc_id=doc_id, text=text)
    return d.mapInArrow(predict, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
