"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order.

A position starts a match if the DEPTH bytes there also start elsewhere. Blocks of text that can hold a match only among themselves
are sorted in suffix order, ties by place, by prefix doubling in numpy. From that order and the common prefixes of neighbours come, for each
position, the previous and the next one in the order that lies earlier in the text; the longer prefix shared with either is its longest
previous factor. Where that is DEPTH or more, the position starts a later copy.

Every window of DEPTH bytes has an anchor, the smallest hash of the GRAM-byte strings in it, so equal windows have equal
anchors. Consecutive windows with one anchor form a range, the bytes it covers a span. Ranges whose anchor
occurs nowhere else are done; where whole spans are equal, all their windows match; only distinct spans of one anchor are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick, text_of
from .shingles import mix, powers

DEPTH, GRAM = 200, 32
#: Windows handled at once, bytes sorted at once; spans of one anchor beyond GROUP are compared window by window instead.
_WINDOWS, _SORTED, GROUP = 1 << 16, 1 << 19, 1024
#: Windows in a block of a large group: those of a block are compared only if the bytes common to the block occur again.
CORE_BLOCK = 43
#: Rows of a batch that are held as Python objects at once.
_ROWS = 256
_BYTE = np.random.default_rng(23).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = np.uint64((1 << 24) - 1)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] from the prefix sums."""
    down = powers(len(total))[1]
    return mix((total[end] - total[start]) * down[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def ranges_of(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, span hash, first window and number of windows of each range; texts: the places where texts begin, and the end.

    No window runs over a text's end.
    """
    none = np.zeros(0, np.int64)
    if len(data) < DEPTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    total = _prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = _hash(total, at, at + GRAM)
    least = _sliding_min((grams & ~_PLACE_BITS) | at.astype(np.uint64), DEPTH - GRAM + 1)
    anchor = (least & _PLACE_BITS).astype(np.int64)
    window = np.arange(len(anchor))
    text = np.searchsorted(texts, window, "right")
    ok = window + DEPTH <= texts[np.minimum(text, len(texts) - 1)]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(anchor)))
    first, n = first[ok[first]], n[ok[first]]
    a = anchor[first]
    span = mix(_hash(total, first, first + n - 1 + DEPTH) + ((a - first) * 1024 + n).astype(np.uint64))
    return grams[a], span, first, n


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, _ROWS):
            yield b.slice(k, _ROWS)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins, with the end."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), at


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, span, key, size, start, n for each range of (key, size, text); a text met again in the task is skipped."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        if not b.num_rows:
            continue
        data, at = _bytes(b.column(2))
        key, size = b.column(0).to_numpy(), b.column(1).to_numpy()
        todo = []
        for k in range(b.num_rows):
            if size[k] >= DEPTH and (key[k], size[k]) not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add((key[k], size[k]))
                todo.append(k)
        out = []
        i = 0
        while i < len(todo):
            # neighbours up to _WINDOWS bytes together; a long text by itself, in parts that share DEPTH - 1 bytes
            j = i + 1
            while j < len(todo) and todo[j] == todo[j - 1] + 1 and at[todo[j] + 1] - at[todo[i]] <= _WINDOWS:
                j += 1
            lo, hi = at[todo[i]], at[todo[j - 1] + 1]
            for part in range(lo, max(lo + 1, hi - DEPTH + 1), _WINDOWS) if j == i + 1 else [lo]:
                end = min(hi, part + _WINDOWS + DEPTH - 1) if j == i + 1 else hi
                edges = np.array([0, end - part]) if j == i + 1 else at[todo[i] : todo[j - 1] + 2] - lo
                anchor, span, first, n = ranges_of(data[part:end], edges)
                owner = np.searchsorted(edges, first, "right") - 1
                k = np.array(todo[i:j])[owner] if len(first) else np.zeros(0, np.int64)
                out.append((anchor, span, key[k], size[k], first + part - at[k], n))
            i = j
        if out:
            anchor, span, k, s, first, n = (np.concatenate(x) for x in zip(*out))
            yield _batch(anchor=anchor.view(np.int64), span=span.view(np.int64), key=k, size=s, start=first.astype(np.int64), n=n.astype(np.int32))


_RANGE = "anchor bigint, span bigint, key bigint, size bigint, start bigint, n int"


class SuffixOrder:
    """The suffixes of data at the places at (ascending), in order of their first depth bytes, ties by place. Past the end come zero bytes.

    sa: the places in that order; lcp: how many bytes each has in common with the one before it (the first: 0), up to depth.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, depth: int = DEPTH):
        data = np.concatenate([data, np.zeros(2 * depth + 8, np.uint8)])
        word, padded = np.zeros(len(data), np.uint64), np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        for i in range(8):
            word |= padded[i : i + len(data)] << np.uint64(56 - 8 * i)
        have, rank = min(8, depth), _ranked(word >> np.uint64(64 - 8 * min(8, depth)))
        self.steps = [(have, rank)]  # ranks of all places by their first have bytes
        while have < depth:
            step = min(have, depth - have)
            after = np.zeros(len(data), np.uint64)
            after[:-step] = rank[step:]
            rank = _ranked(rank << np.uint64(32) | after)
            have += step
            self.steps.append((have, rank))
        self.sa = at[np.argsort(rank[at], kind="stable")]
        self.lcp = np.zeros(len(at), np.int64)
        if len(at) > 1:
            self.lcp[1:] = self._common(self.sa[:-1], self.sa[1:], word, depth)

    def _common(self, a: np.ndarray, b: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common, up to depth: by the ranks of ever shorter prefixes, then by bytes."""
        n = np.zeros(len(a), np.int64)
        for have, rank in reversed(self.steps):
            on = n + have <= depth
            n += np.where(on & (rank[np.where(on, a + n, 0)] == rank[np.where(on, b + n, 0)]), have, 0)
        x, y = word[a + n], word[b + n]
        for size in (4, 2, 1):
            shift = np.uint64(64 - 8 * size)
            same = (x >> shift) == (y >> shift)
            n += np.where(same, size, 0)
            x, y = (np.where(same, v << np.uint64(8 * size), v) for v in (x, y))
        return np.minimum(n, depth)

    def longest_previous(self) -> tuple[np.ndarray, np.ndarray]:
        """In the order of sa: the longest previous factor up to depth, and where it starts (-1: no earlier place)."""
        before, left = _nearest_smaller(self.sa, self.lcp)
        # the same from the other end: prefixes shared with the one after
        after, right = _nearest_smaller(self.sa[::-1], np.append(0, self.lcp[:0:-1]))
        after, right = after[::-1], right[::-1]
        left, right = np.where(before >= 0, left, -1), np.where(after >= 0, right, -1)
        return np.maximum(np.maximum(left, right), 0), np.where(left >= right, before, after)


def _nearest_smaller(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest one before it that is smaller (-1: none), and the least lcp between them.

    By descent over tables of minima of the last 1, 2, 4, ... entries: no loop over entries.
    """
    n = len(sa)
    least, common = [sa], [lcp]
    while 1 << len(least) <= n:
        have = 1 << (len(least) - 1)
        for table in (least, common):
            table.append(np.concatenate([table[-1][:have], np.minimum(table[-1][have:], table[-1][:-have])]))
    at, shared = np.arange(n) - 1, lcp.copy()
    for k in reversed(range(len(least))):
        here = np.maximum(at, 0)
        jump = (at + 1 >= 1 << k) & (least[k][here] > sa)
        shared = np.where(jump, np.minimum(shared, common[k][here]), shared)
        at = np.where(jump, at - (1 << k), at)
    return np.where(at >= 0, sa[np.maximum(at, 0)], -1), shared


def _ranked(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    y = x[order]
    rank = np.empty(len(x), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[False], y[1:] != y[:-1]])).astype(np.uint64) if len(x) else 0
    return rank


def matching(data: np.ndarray, at: np.ndarray, keep_first: bool, depth: int = DEPTH) -> np.ndarray:
    """For the places at (ascending): whether their depth bytes start at an earlier one of them; without keep_first, at any other."""
    order = SuffixOrder(data, at, depth)
    on = order.longest_previous()[0] >= depth if keep_first else np.maximum(order.lcp, np.append(order.lcp[1:], 0)) >= depth
    out = np.zeros(len(at), bool)
    out[np.searchsorted(at, order.sa)] = on
    return out


def _runs(on: np.ndarray, group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive marked windows of one group: group, first, one past the last."""
    i = np.flatnonzero(on)
    if not len(i):
        return i, i, i
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (group[i[1:]] != group[i[:-1]])
    first, last = i[new], i[np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)]
    return group[first], at[first], at[last] + 1


_FOUND = "key bigint, size bigint, lo bigint, hi bigint"


def _sort_spans(keep_first: bool):
    """Rows sorted by anchor, doc_id and start, with many flag and bytes -> runs of matching windows."""

    def sort(rows: list[dict]) -> pa.RecordBatch | None:
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        n = np.array([r["n"] for r in rows])
        begin = np.concatenate([[0], np.cumsum([len(r["bytes"]) for r in rows])[:-1]])
        owner = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        on = matching(data, begin[owner] + inside, keep_first)
        who, lo, hi = _runs(on, owner, np.array([r["start"] for r in rows])[owner] + inside)
        return _batch(key=np.array([rows[i]["key"] for i in who], np.int64), size=np.array([rows[i]["size"] for i in who], np.int64), lo=lo.astype(np.int64), hi=hi.astype(np.int64)) if len(who) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in _small(batches):
            for r in b.to_pylist():
                if r["anchor"] != last and size >= _SORTED:
                    if (out := sort(held)) is not None:
                        yield out
                    held, size = [], 0
                last = r["anchor"]
                held.append(r)
                size += len(r["bytes"])
        if held and (out := sort(held)) is not None:
            yield out

    return run


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted range of (text, wanted)."""
    for b in _small(batches):
        out = {k: [] for k in ("anchor", "doc_id", "key", "size", "start", "n", "large", "bytes")}
        for text, wanted in zip(b.column("text"), b.column("wanted")):
            data = text.as_buffer()
            for w in wanted.as_py():
                for k in ("anchor", "doc_id", "key", "size", "start", "n", "large"):
                    out[k].append(w[k])
                out["bytes"].append(data[w["start"] : w["start"] + w["n"] - 1 + DEPTH].to_pybytes())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        for k in range(0, len(out["n"]), 2000):
            yield _batch(**{name: pa.array(v[k : k + 2000], kind) for (name, v), kind in zip(out.items(), kinds)})


_SPAN = "anchor bigint, doc_id bigint, key bigint, size bigint, start bigint, n int, large boolean, bytes binary"


def _anchor_at(data: np.ndarray) -> int:
    """Where the anchor of a span's first window lies, which is that of all its windows."""
    at = np.arange(DEPTH - GRAM + 1)
    grams = _hash(_prefix_sums(data[:DEPTH]), at, at + GRAM)
    return int(((grams & ~_PLACE_BITS) | at.astype(np.uint64)).argmin())


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For spans of large groups, by blocks of windows [lo, hi): a hash of the bytes that all windows of the block have in common,
    and one of all bytes they cover.

    Places count from the anchor, so a window can only match one of the same block, with the same core.
    """
    for b in _small(batches):
        out = []
        for k, r in enumerate(b.to_pylist()):
            data = np.frombuffer(r["bytes"], np.uint8)
            a, total = _anchor_at(data), _prefix_sums(data)
            first, last = (DEPTH - GRAM - a) // CORE_BLOCK, (DEPTH - GRAM - a + r["n"] - 1) // CORE_BLOCK
            block = np.arange(first, last + 1)
            lo = block * CORE_BLOCK - (DEPTH - GRAM) + a
            core = _hash(total, np.minimum(lo + CORE_BLOCK - 1, a), lo + DEPTH)
            first, end = np.maximum(lo, 0), np.minimum(lo + CORE_BLOCK, r["n"])
            whole = mix(_hash(total, first, end - 1 + DEPTH) + ((a - first) * 1024 + end - first).astype(np.uint64))
            out.append((np.full(len(block), k), block, core.view(np.int64), whole.view(np.int64), first + r["start"], end + r["start"]))
        if out:
            k, block, core, whole, lo, hi = (np.concatenate(x) for x in zip(*out))
            yield _batch(**{c: b.column(c).take(pa.array(k)) for c in ("anchor", "doc_id", "key", "size", "start")}, block=block.astype(np.int32), core=core, whole=whole, lo=lo.astype(np.int64), hi=hi.astype(np.int64))


_CORE = "anchor bigint, doc_id bigint, key bigint, size bigint, start bigint, block int, core bigint, whole bigint, lo bigint, hi bigint"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the spans' wanted blocks by its hash."""
    for b in _small(batches):
        for r in b.to_pylist():
            data = np.frombuffer(r["bytes"], np.uint8)
            at = np.arange(r["n"])
            at = at[np.isin((at - _anchor_at(data) + DEPTH - GRAM) // CORE_BLOCK, r["blocks"])]
            n, h = len(at), _hash(_prefix_sums(data), at, at + DEPTH)
            yield _batch(anchor=np.full(n, r["anchor"], np.int64), window=h.view(np.int64), doc_id=pa.array([r["doc_id"]] * n, pa.int64()), key=np.full(n, r["key"], np.int64), size=np.full(n, r["size"], np.int64), at=(at + r["start"]).astype(np.int64))


def key_of(text: Column, seed: int) -> tuple[Column, Column]:
    """What stands for a text: a 64-bit hash and its size in bytes."""
    return F.xxhash64(F.lit(seed), text), F.octet_length(text).cast("long")


def keyed(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, size, text for each row; key, size, doc_id, copies for each distinct text of DEPTH bytes or more).

    The smallest doc_id stands for equal texts. Two texts are taken for equal only if another 64-bit hash agrees as well; if
    any two of one key do not, all are keyed anew with another seed.
    """
    seed = 0
    while True:
        t = text_of("text")
        key, size = key_of(t, seed)
        texts = docs.select(F.col("doc_id").cast("long"), key.alias("key"), size.alias("size"), t.alias("text"))
        other = F.xxhash64(F.lit(-1 - seed), "text")
        found = texts.filter(F.col("size") >= DEPTH).groupBy("key", "size").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), (F.min(other) != F.max(other)).alias("mixed"))
        found = work.keep(found, f"classes-{seed}")
        if not found.filter("mixed").limit(1).count():
            return texts, found.drop("mixed")
        seed += 1


#: An anchor with more than one in HOT of all ranges is dealt out to SALT tasks; there are fewer than HOT of them.
HOT, SALT = 512, 64


def _shared_ranges(ranges: DataFrame, work: Workspace) -> DataFrame:
    """The ranges whose anchor occurs at another place too. Anchors that hold a large share of all ranges are spread over many tasks."""
    place = F.xxhash64("key", "size", "start")
    anchors = ranges.groupBy("anchor").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.count("*").alias("n")).filter("p <> q").select("anchor", "n")
    anchors = work.keep(anchors, "anchors")
    total = ranges.count()
    hot = [r["anchor"] for r in anchors.filter(F.col("n") * HOT > total).select("anchor").collect()]
    salted = F.col("anchor").isin(hot) if hot else F.lit(False)
    rows = ranges.withColumn("salt", F.when(salted, F.pmod(place, F.lit(SALT))).otherwise(F.lit(0)).cast("int"))
    keys = anchors.select("anchor", F.explode(F.sequence(F.lit(0), F.when(salted, F.lit(SALT - 1)).otherwise(F.lit(0)))).alias("salt"))
    return rows.join(keys, ["anchor", "salt"], "left_semi").drop("salt")


def matches(texts: DataFrame, classes: DataFrame, work: Workspace, keep_first: bool = False) -> DataFrame:
    """key, size, lo, hi: runs [lo, hi) of window starts that match elsewhere (keep_first: earlier), for each distinct text.

    texts and classes: as keyed() gives them.
    """
    ranges = work.keep(texts.select("key", "size", "text").mapInArrow(_find, _RANGE), "ranges")
    shared = _shared_ranges(ranges, work).distinct().join(classes.drop("copies"), ["key", "size"])
    shared = work.keep(shared, "shared")
    work.drop("ranges")
    where = F.struct("doc_id", "key", "size", "start")
    spans = work.keep(shared.groupBy("anchor", "span").agg(F.min(where).alias("first"), F.count("*").alias("places")), "spans")
    # whole spans that occur more than once
    again = shared.join(spans.filter("places > 1"), ["anchor", "span"])
    if keep_first:
        again = again.filter(where != F.col("first"))
    whole = again.select("key", "size", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    # anchors with several spans: one range for each span is sorted with the others
    several = spans.groupBy("anchor").agg(F.count("*").alias("spans")).filter("spans > 1")
    single = spans.join(several, "anchor").select("anchor", "span", "first.*", (F.col("spans") > GROUP).alias("large"))
    single = single.join(shared.select("anchor", "span", "key", "size", "start", "n"), ["anchor", "span", "key", "size", "start"])
    wanted = single.groupBy("doc_id", "key", "size").agg(F.collect_list(F.struct("anchor", "doc_id", "key", "size", "start", "n", "large")).alias("wanted"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("doc_id", "key", "size")]
    rows = texts.alias("t").join(wanted.alias("w"), same[0] & same[1] & same[2]).select("t.text", "w.wanted")
    cut = work.keep(rows.mapInArrow(_cut_spans, _SPAN), "cut")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    small = cut.filter(~F.col("large")).dropDuplicates(["anchor", "key", "size", "start"]).repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "key", "size", "start")
    found = small.mapInArrow(_sort_spans(keep_first), _FOUND)
    large = cut.filter("large").dropDuplicates(["anchor", "key", "size", "start"])
    # blocks that occur whole more than once match as spans do; one of each content is compared with those of the same core
    cores = work.keep(large.mapInArrow(_cores, _CORE), "cores")
    contents = work.keep(cores.groupBy("anchor", "block", "core", "whole").agg(F.min(where).alias("first"), F.count("*").alias("places")), "contents")
    settled = cores.join(contents.filter("places > 1").select("anchor", "block", "core", "whole", "first"), ["anchor", "block", "core", "whole"])
    if keep_first:
        settled = settled.filter(where != F.col("first"))
    settled = settled.select("key", "size", "lo", "hi")
    alike = contents.groupBy("anchor", "block", "core").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "block", "core")
    blocks = contents.join(alike, ["anchor", "block", "core"], "left_semi").groupBy("anchor", "first.key", "first.size", "first.start").agg(F.collect_list("block").alias("blocks"))
    windows = large.join(blocks, ["anchor", "key", "size", "start"]).mapInArrow(_windows, "anchor bigint, window bigint, doc_id bigint, key bigint, size bigint, at bigint")
    spot = F.struct("doc_id", "key", "size", "at")
    twice = windows.groupBy("anchor", "window").agg(F.min(spot).alias("p"), F.max(spot).alias("q")).filter("p <> q")
    large = windows.join(twice, ["anchor", "window"])
    if keep_first:
        large = large.filter(spot != F.col("p"))
    large = large.select("key", "size", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    return work.keep(whole.unionByName(found).unionByName(settled).unionByName(large), "found")


def _remove(data, runs: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of data without the bytes of the windows in runs, and the removed spans."""
    spans: list[list[int]] = []
    for lo, hi in sorted(runs):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi - 1 + DEPTH)
        else:
            spans.append([lo, hi - 1 + DEPTH])
    out, at = [], 0
    for lo, hi in spans:
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]]), [tuple(s) for s in spans]


def dedup(docs: DataFrame, work: Workspace, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 for each row of docs.

    keep_first=False removes every byte of a DEPTH-byte string that starts anywhere else as well; keep_first=True leaves the first place
    (by doc_id, then place). Null text is empty; an empty table gives an empty result. Repeated rows are copies of each other; with keep_first, rows of equal text and equal,
    smallest doc_id all stay. Texts shorter than DEPTH stay as they are. Matches are judged on the input and never cross documents.
    """
    texts, classes = keyed(pick(docs, doc_id=doc_id, text=text), work)
    found = matches(texts, classes, work, keep_first)
    runs = found.groupBy("key", "size").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    plan = classes.join(runs, ["key", "size"], "left").filter((F.col("copies") > 1) | F.col("runs").isNotNull()).select("key", "size", F.col("doc_id").alias("first"), "copies", "runs")
    gone = (F.col("copies") > 1) & (~F.col("doc_id").eqNullSafe(F.col("first")) if keep_first else F.lit(True))
    rows = texts.join(plan, ["key", "size"], "left").select("doc_id", "text", F.coalesce(gone, F.lit(False)).alias("gone"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            size, removed, n, kept = [], [], [], []
            for text_, whole, found_ in zip(b.column("text"), b.column("gone").to_pylist(), b.column("runs").to_pylist()):
                data = (text_.as_buffer() or pa.py_buffer(b"")).to_pybytes()
                left, spans = (b"", [(0, len(data))]) if whole else _remove(data, [(r["lo"], r["hi"]) for r in found_ or ()])
                size.append(len(data))
                removed.append(len(data) - len(left))
                n.append(len(spans))
                kept.append(left)
            yield _batch(doc_id=b.column("doc_id"), n_bytes=pa.array(size, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(n, pa.int64()), kept=pa.array(kept, pa.binary()), kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
