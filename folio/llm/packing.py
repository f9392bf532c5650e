"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces (the executors tokenize; nothing but lengths and checksums leaves them). Which lengths share
a sequence depends only on how many pieces there are of each length: a histogram of at most CAPACITY entries.
On it the driver plans patterns: an index by sum of single lengths, pairs and triples gives what fills
a gap exactly while the counts last; only where nothing does, the best-fitting length goes in. A pattern is used as often as
its lengths last, so there are about as many patterns as lengths. Pieces then find their place by their
rank within their length, from counts by (length, bucket) and a rank within the bucket.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, pick, text_of

CAPACITY = 4096
END_ID = 1
#: Distinct words in each generation of a Python worker's cache, and characters handed to the tokenizer at once.
CACHE_WORDS, CHUNK = 200_000, 1 << 16
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: The normalizer and splitter of the file whose words are cached; any other file goes to its tokenizer whole.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """Ids of a text as the file's tokenizer gives them without special tokens added, with a cache of words.

    If the file normalizes and splits as KNOWN_NORMALIZER and KNOWN_SPLITTER say, its words never span white space. Then texts of characters
    below U+0250 without the content of an added token take the cached way, where both are reproduced exactly; any other
    text goes to the tokenizer, cut at white space so that its memory stays bounded. Of any other file each text goes to the tokenizer whole.
    """

    LIMIT = 0x250

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.known = parts["normalizer"] == KNOWN_NORMALIZER and parts["pre_tokenizer"] == KNOWN_SPLITTER
        self.added = [t["content"] for t in parts["added_tokens"]]
        kinds = [(chr(c), unicodedata.category(chr(c))[0]) for c in range(self.LIMIT)]
        letters, digits = ("".join(c for c, k in kinds if k == x) for x in "LN")
        space = "".join(chr(c) for c in range(self.LIMIT) if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F))
        # The endings that the file's pattern splits off.
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{re.escape(space)}{letters}{digits}]+").findall
        self.plain = re.compile(rf"[\x00-\x1b\x20-{chr(self.LIMIT - 1)}]*").fullmatch
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache = WordCache(self)

    @property
    def alphabet(self) -> dict[int, str]:
        """The byte-level file's character for each byte: printable ones stand for themselves, the others follow from U+0100."""
        if not hasattr(self, "_alphabet"):
            own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
            others = iter(range(0x100, 0x200))
            self._alphabet = {b: chr(b) if b in own else chr(next(others)) for b in range(256)}
        return self._alphabet

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.known:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not self.plain(text) or any(a in text for a in self.added):
            return b"".join(np.array(self.tok.encode(part, add_special_tokens=False).ids, "<u4").tobytes() for part in chunks(text))
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return b"".join(map(self.cache.__getitem__, self.split(text.lower())))


class WordCache(dict):
    """word -> ids, in two generations: words asked for again outlive those seen once."""

    def __init__(self, tok: WordTokenizer):
        self.model, self.alphabet, self.old = tok.tok.model, tok.alphabet, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            shown = word.translate(self.alphabet) if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))
            ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about size characters, cut at white space only."""
    at = 0
    space = re.compile(r"\s")
    while len(text) - at > size:
        m = space.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. Null or empty text: the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers.get(tokenizer) or _tokenizers.setdefault(tokenizer, WordTokenizer(tokenizer))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.ids(t.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(cut, PIECE)


class Sums:
    """For each sum up to the capacity a length, a pair and a triple of lengths that make it, under availability counts.

    Counts only fall, so an entry that no longer holds is searched anew when it is asked for, and a sum without one stays without.
    """

    def __init__(self, avail: np.ndarray):
        self.avail = avail
        size = len(avail)
        #: By sum: the longest length of a pair, and of a triple, 0 for none. The rest of a triple is the pair of what is left.
        self.pair, self.triple = np.zeros(size, np.int64), np.zeros(size, np.int64)
        have = np.flatnonzero(avail)
        for i, a in enumerate(have):  # ascending: the last entry of a sum has the longest length
            b = have[: i + 1][have[: i + 1] < size - a]
            if avail[a] < 2:
                b = b[b != a]
            self.pair[a + b] = a
        for a in have:
            rest = np.flatnonzero((self.pair[: size - a] > 0) & (self.pair[: size - a] <= a))
            self.triple[a + rest] = a

    def _pair(self, total: int, left: np.ndarray, most: int) -> int:
        """The longest length up to most of a pair with that sum, by lookup of each length's complement."""
        a = np.arange((total + 1) // 2, min(total - 1, most) + 1)
        ok = a[(left[a] > 0) & (left[total - a] > (a * 2 == total))]
        return int(ok[-1]) if len(ok) else 0

    def _triple(self, total: int, left: np.ndarray) -> tuple[int, ...] | None:
        for a in np.flatnonzero(left[:total])[::-1]:
            if 3 * a < total:
                break
            left[a] -= 1
            b = self._pair(total - int(a), left, int(a)) if total - a > 1 and self.pair[total - a] else 0
            left[a] += 1
            if b:
                return int(a), b, total - int(a) - b
        return None

    def fill(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        """One, two or three of the lengths left that sum to gap; left: the counts less what the sequence already has."""
        if left[gap] > 0:
            return (gap,)
        a = int(self.pair[gap])
        if a:
            if left[a] > 0 and left[gap - a] > (a * 2 == gap):
                return a, gap - a
            if b := self._pair(gap, left, gap):
                return b, gap - b
            self.pair[gap] = self._pair(gap, self.avail, gap)
        a = int(self.triple[gap])
        if a:
            found = None
            if left[a] > 0:
                left[a] -= 1
                b = self._pair(gap - a, left, a)
                left[a] += 1
                found = (a, b, gap - a - b) if b else None
            found = found or self._triple(gap, left)
            if found is None:
                again = self._triple(gap, self.avail)
                self.triple[gap] = again[0] if again else 0
            return found
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Intervals (length, first rank, ranks, first sequence, sequences, offset), and the number of sequences.

    Piece r of that length (first <= r < first + ranks) goes to sequence
    first_sequence + (r - first) % sequences, at offset + (r - first) // sequences * length.
    """
    avail = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        avail[length] += n
    used, out, sequences, sums = np.zeros(capacity + 1, np.int64), [], 0, Sums(avail)
    top = capacity
    while True:
        while top and not avail[top]:
            top -= 1
        if not top:
            return out, sequences
        left, pattern, gap = avail.copy(), [top], capacity - top
        left[top] -= 1
        while gap:
            fill = sums.fill(gap, left)
            if fill is None:
                fits = np.flatnonzero(left[1 : gap + 1] > 0)
                if not len(fits):
                    break
                fill = (int(fits[-1]) + 1,)
            pattern += fill
            for x in fill:
                left[x] -= 1
            gap -= sum(fill)
        each = {x: pattern.count(x) for x in dict.fromkeys(pattern)}
        times = int(min(avail[x] // k for x, k in each.items()))
        offset = 0
        for x, k in each.items():
            out.append((x, int(used[x]), k * times, sequences, times, offset))
            used[x] += k * times
            avail[x] -= k * times
            offset += k * x
        sequences += times


def pack(docs: DataFrame, tokenizer: str, work: Workspace, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset: sequences are gapless from offset 0 and hold at most capacity tokens.

    Repeated rows are packed each for itself. What is broadcast is the plan: at most a row for each
    length of each pattern, bounded by the capacity and not by the data.
    """
    spark = docs.sparkSession
    cut = work.keep(pieces(docs, tokenizer, doc_id, text, capacity), "pieces")
    # bucket: about even shares of each length, however many rows have it
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1024))
    cut = cut.withColumn("bucket", bucket)
    by_bucket = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    starts = work.keep(by_bucket.withColumn("before", before), "starts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    intervals, _ = plan(counts, capacity)
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("local", local).join(starts.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local"))
    return _place(spark, ranked, intervals)


def _place(spark: SparkSession, ranked: DataFrame, intervals: list) -> DataFrame:
    table = np.array(sorted(intervals), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        starts = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            x = t[np.searchsorted(starts, length << 44 | rank, "right") - 1] if len(length) else np.zeros((0, 6), np.int64)
            at = rank - x[:, 1]
            times = np.maximum(x[:, 4], 1)
            cols = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(x[:, 3] + at % times), pa.array(x[:, 5] + at // times * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, f"{PIECE}, sequence_id bigint, offset bigint")
