"""n-gram Jaccard self-join by a size-aware heavy-light plan.

Texts with the same shingle set are one class, whatever their number. A small set enumerates its subsets of every size that a
link can leave in common, and equal subsets are links by themselves. A large set is entered in the inverted
lists of its rarest shingles (as many as a link cannot all miss), and lists are scanned for candidates, which
are then compared in full. The boundary between small and large is where enumerating would cost more, by the length of lists measured
in the scan.

The lists are scanned in two rounds, so that a group of near copies costs about its size: first every entry of a list is
compared with one pivot, the class with most support in the lists; after joining what that links, only pairs
that lie in different components are left to compare, all of them. No candidate is dropped in either.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, pick
from .components import components
from .shingles import mix, shingle_sets

#: A link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: A list entry costs as much as a subset's hash, and each other entry of its list as much as COMPARE of them. Lists are measured
#: on every token of one in SAMPLED, by hash.
COMPARE, SAMPLED = 4, 1024
#: Entries of a list that are held at once while lists are made.
PIECE = 1 << 20
#: Shingles found in at least LOCAL sets of a task are counted; the most frequent FREQUENT of them sort last in
#: every set, by frequency, so that they seldom head a list. This orders the work only: any order gives the same links.
LOCAL, FREQUENT = 4, 1 << 18
_COUNT_AT = 1 << 21
#: Lists of up to so many entries are looked through for entries that can link with no other.
SMALL_LIST = 32
#: Ids of texts to fetch are broadcast up to this number; beyond it they are joined by shuffle.
BROADCAST_IDS = 1 << 21


def least_common(n: int, m: int) -> int:
    """The smallest intersection with which sets of n and m link."""
    return -(-THRESHOLD * (n + m) // (100 + THRESHOLD))


def prefix(n: int) -> int:
    """So many of its first shingles that any set linked with one of n has one of them."""
    return n - -(-THRESHOLD * n // 100) + 1


def enumerated(n: int) -> int:
    """Subsets that a small set of n enumerates."""
    return sum(math.comb(n, k) for k in range(n - -(-THRESHOLD * n // 100) + 1))


def boundary(company: float) -> int:
    """The largest small size: enumerating costs no more than list entries would, which meet company others each."""
    n = 1
    while enumerated(n + 1) <= prefix(n + 1) * (1 + COMPARE * company):
        n += 1
    return n


def _digest(s: np.ndarray) -> int:
    """64 bits for a sorted set; with the set's size it is the key of a class."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s)))
        return int(mix(np.array([np.bitwise_xor.reduce(x) + np.add.reduce(s)], np.uint64))[0].astype(np.int64))


def scan(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, cid, n, text_key for each document; kind 1: token, count of shingles frequent within a task; kind 2: of sampled ones, all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held, size = [], 0

        def frequent():
            t, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            often, sampled = n >= LOCAL, t % np.uint64(SAMPLED) == 0
            kind = np.repeat(np.array([1, 2], np.int32), [often.sum(), sampled.sum()])
            t, n = (np.concatenate([x[often], x[sampled]]) for x in (t, n))
            held.clear()
            return _batch(kind=kind, doc_id=pa.nulls(len(t), pa.int64()), token=t.view(np.int64), n=n.astype(np.int64), text_key=pa.nulls(len(t), pa.int64()))

        for b in batches:
            cid, n = [], []
            for s in shingle_sets(b.column(1)):
                key = _digest(s), len(s)
                cid.append(key[0])
                n.append(key[1])
                if key not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            yield _batch(kind=np.zeros(len(n), np.int32), doc_id=b.column(0), token=np.array(cid, np.int64), n=np.array(n, np.int64), text_key=b.column(2))
            if size > _COUNT_AT:
                yield frequent()
                size = 0
        yield frequent()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "kind int, doc_id bigint, token bigint, n bigint, text_key bigint")


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], list(columns))


def _subset_tokens(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the subsets of a small set, with their sizes."""
    n, out, sizes = len(s), [], []
    with np.errstate(over="ignore"):
        x = mix(s + np.uint64(1))
        for k in range(n - -(-THRESHOLD * n // 100) + 1):
            m = n - k
            for gone in itertools.combinations(range(n), k):
                keep = np.ones(n, bool)
                keep[list(gone)] = False
                out.append(np.add.reduce(x[keep]) + np.uint64(m))
                sizes.append(m)
        return mix(np.array(out, np.uint64)), np.array(sizes, np.int64)


def entries(docs: DataFrame, frequent: np.ndarray, limit: int) -> DataFrame:
    """token, cid, n, pos: list entries (pos >= 0) of large sets, subsets (pos = -size) of small ones.

    A class met again in the same task is not entered again; classes met in several tasks are made one when lists are read.
    frequent: tokens, the most frequent first; bounded by FREQUENT. limit: the largest small size.
    """
    by_value = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[by_value], by_value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = sent.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            parts: list[tuple[np.ndarray, int, int, np.ndarray]] = []
            for s in shingle_sets(b.column(0)):
                n = len(s)
                key = _digest(s), n
                if not n or key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                if n <= limit:
                    t, m = _subset_tokens(s)
                    parts.append((t, *key, -m))
                if n > limit * THRESHOLD / 100:
                    p = prefix(n)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = known[at] == s
                        if often.any():
                            last = s[often][np.argsort(-place[at[often]])]  # the rarest of them first
                            s = np.concatenate([s[~often][:p], last])
                    parts.append((s[:p], *key, np.arange(p)))
            if parts:
                lengths = [len(x[0]) for x in parts]
                yield _batch(token=np.concatenate([x[0] for x in parts]).view(np.int64), cid=np.repeat(np.array([x[1] for x in parts], np.int64), lengths), n=np.repeat(np.array([x[2] for x in parts], np.int32), lengths), pos=np.concatenate([x[3] for x in parts]).astype(np.int32))

    return docs.select("text").mapInArrow(run, "token bigint, cid bigint, n int, pos int")


def _lists(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Whole lists, several at a time, from batches sorted by token (the first of names).

    A list of more than most entries comes in pieces; the flag says that the first list goes on from the piece before.
    """
    held: list[dict[str, np.ndarray]] = []
    size, goes_on = 0, False

    def joined():
        return {k: np.concatenate([h[k] for h in held]) for k in names}

    for b in batches:
        if not b.num_rows:
            continue
        x = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
        if goes_on and not held and x[names[0]][0] != last:
            goes_on = False
        held.append(x)
        size += b.num_rows
        if held[0][names[0]][0] == x[names[0]][-1]:  # one list so far
            if most and size > most:
                last = x[names[0]][-1]
                yield joined(), goes_on
                held, size, goes_on = [], 0, True
            continue
        x = joined()
        cut = int(np.flatnonzero(x[names[0]] != x[names[0]][-1])[-1]) + 1
        yield {k: v[:cut] for k, v in x.items()}, goes_on
        held, goes_on = [{k: v[cut:] for k, v in x.items()}], False
        size = len(held[0][names[0]])
    if held:
        yield joined(), goes_on


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of lists with two classes or more, each class once; with the number of classes.

    Reads rows sorted by token, n and cid. In lists of up to SMALL_LIST entries, those that can link with no other are left out. Of a list
    in pieces every entry stays, with the number of its piece.
    """
    names = ("token", "n", "cid", "pos")
    for x, goes_on in _lists(batches, names, PIECE):
        t, n, c = x["token"], x["n"], x["cid"]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (c[1:] != c[:-1])
        x = {k: v[first] for k, v in x.items()}
        t = x["token"]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(start, len(t)))
        each = np.repeat(size, size)
        on = each > 1
        for k in range(2, min(SMALL_LIST, int(size.max(initial=0))) + 1):
            at = start[size == k][:, None] + np.arange(k)  # lists of k entries, one a row
            if len(at):
                n_, p_ = x["n"].astype(np.int64)[at], x["pos"][at]
                can = _possible(n_[:, :, None], p_[:, :, None], n_[:, None, :], p_[:, None, :]) & ~np.eye(k, dtype=bool)
                on[at] = can.any(2)
        if goes_on:
            on[: size[0]] = True
        if on.any():
            yield _batch(token=t[on], cid=x["cid"][on], n=x["n"][on], pos=x["pos"][on], size=each[on].astype(np.int64))


def _possible(n1, p1, n2, p2) -> np.ndarray:
    """Whether sets of these sizes that first meet at these places of their prefixes can link; for subsets (p < 0) whether they do."""
    need = -(-THRESHOLD * (n1 + n2) // (100 + THRESHOLD))
    most = np.where(p1 < 0, -p1, 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1))
    return (most >= need) & ((p1 < 0) == (p2 < 0)) & np.where(p1 < 0, p1 == p2, True)


_PAIR = "a bigint, an int, b bigint, bn int, sure boolean"


def _pairs(c, n, d, m, sure) -> pa.RecordBatch:
    """Pairs of the classes (c, n) and (d, m), the smaller first."""
    swap = (c > d) | ((c == d) & (n > m))
    first = lambda x, y: np.where(swap, y, x)
    return _batch(a=first(c, d), an=first(n, m).astype(np.int32), b=first(d, c), bn=first(m, n).astype(np.int32), sure=sure)


def _pair_batch(c, n, p, i, j) -> pa.RecordBatch:
    return _pairs(c[i], n[i], c[j], n[j], p[i] < 0)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each entry with its list's pivot: the class of most support. Rows sorted by token, support (most first), n, cid; only the pivot is held."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t, c, n, p = (b.column(k).to_numpy(zero_copy_only=False) for k in ("token", "cid", "n", "pos"))
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        at = np.repeat(start, np.diff(np.append(start, len(t))))
        other = np.arange(len(t)) != at
        pivot = [x[at] for x in (c, n, p)]
        if last is not None and t[0] == last[0]:  # the list began in a batch before
            end = start[1] if len(start) > 1 else len(t)
            other[0] = True
            for x, value in zip(pivot, last[1:]):
                x[:end] = value
        last = (t[-1], *(x[-1] for x in pivot))
        on = other & _possible(n.astype(np.int64), p, pivot[1].astype(np.int64), pivot[2])
        if on.any():
            yield _pairs(pivot[0][on], pivot[1][on], c[on], n[on], p[on] < 0)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a list that lie in different components, but for those with the pivot. Rows sorted as for _star."""
    for x, _ in _lists(batches, ("token", "cid", "n", "pos", "root", "root_n")):
        t = x["token"]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
        for lo, hi in zip(start[:-1] + 1, start[1:]):  # past the pivot
            if hi - lo < 2:
                continue
            order = lo + np.argsort(x["n"][lo:hi], kind="stable")
            c, n, p, r, rn = (x[k][order] for k in ("cid", "n", "pos", "root", "root_n"))
            if ((r == r[0]) & (rn == rn[0])).all():
                continue
            wide = n.astype(np.int64)
            stop = np.searchsorted(wide, wide * 100 // THRESHOLD, "right")
            out: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for k in range(len(c) - 1):
                j = np.arange(k + 1, stop[k])
                j = j[((r[j] != r[k]) | (rn[j] != rn[k])) & _possible(wide[k], p[k], wide[j], p[j])]
                if len(j):
                    out.append((np.full(len(j), k), j))
                    size += len(j)
                if size > 50_000:
                    yield _pair_batch(c, n, p, *(np.concatenate(z) for z in zip(*out)))
                    out, size = [], 0
            if out:
                yield _pair_batch(c, n, p, *(np.concatenate(z) for z in zip(*out)))


def _outline(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of a power of two of buckets, about four each; up to 255."""
    bits = max(2, (len(s) // 4).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose outlines allow a link: no intersection exceeds the sum of the buckets' smaller counts."""
    for b in batches:
        keep = []
        for s, t, n, m in zip(b.column("s"), b.column("t"), b.column("an").to_pylist(), b.column("bn").to_pylist()):
            x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (s, t))
            full = x.max() == 255 or y.max() == 255
            x, y = x.astype(np.int64), y.astype(np.int64)
            size = min(len(x), len(y))
            x, y = x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)
            keep.append(full or int(np.minimum(x, y).sum()) >= least_common(n, m))
        yield _batch(a=b.column("a"), an=b.column("an"), b=b.column("b"), bn=b.column("bn")).filter(pa.array(keep, pa.bool_()))


def _sets(docs: DataFrame, wanted: DataFrame, work: Workspace, label: str, outline: bool = False) -> DataFrame:
    """cid, n, tokens (or their outline) of the wanted classes (cid, n, rep): the texts of their representatives, hashed again.

    A class without any doc_id has no representative to name: for those, all texts without one are hashed.
    """
    ids = work.keep(wanted.select(F.col("rep").alias("doc_id")).distinct(), f"{label}-ids")
    n, nameless = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    if n <= BROADCAST_IDS:  # 16 MB of ids at most; then texts need no shuffle
        ids = F.broadcast(ids)
    text = docs.join(ids, "doc_id", "left_semi").select("text")
    if nameless:
        text = text.unionByName(docs.filter("doc_id IS NULL").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [s for s in shingle_sets(b.column(0)) if len(s)]
            yield _batch(cid=np.array([_digest(s) for s in got], np.int64), n=np.array([len(s) for s in got], np.int32), tokens=pa.array([(_outline(s) if outline else s).tobytes() for s in got], pa.binary()))

    return text.mapInArrow(run, "cid bigint, n int, tokens binary").dropDuplicates(["cid", "n"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for s, t in zip(b.column("s"), b.column("t")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t))
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int(np.count_nonzero(y[at] == x))
            keep.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
        yield _batch(a=b.column("a"), an=b.column("an"), b=b.column("b"), bn=b.column("bn")).filter(pa.array(keep, pa.bool_()))


_LINK = "a bigint, an int, b bigint, bn int"


def _compare(docs: DataFrame, classes: DataFrame, pairs: DataFrame, work: Workspace, label: str) -> DataFrame:
    """The pairs that link: those that equal subsets make sure of, and those whose sets say so."""
    pairs = work.keep(pairs.groupBy("a", "an", "b", "bn").agg(F.max("sure").alias("sure")), f"{label}-pairs")
    open_ = pairs.filter(~F.col("sure")).drop("sure")

    def both(rows: DataFrame, name: str, outline: bool) -> DataFrame:
        ends = rows.select(F.col("a").alias("cid"), F.col("an").alias("n")).unionByName(rows.select(F.col("b").alias("cid"), F.col("bn").alias("n"))).distinct()
        sets = work.keep(_sets(docs, classes.join(ends, ["cid", "n"], "left_semi"), work, name, outline), f"{name}-sets")
        first = sets.select(F.col("cid").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("s"))
        second = sets.select(F.col("cid").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("t"))
        return rows.join(first, ["a", "an"]).join(second, ["b", "bn"]).select("a", "an", "b", "bn", "s", "t")

    # outlines are a 32nd of the sets: most pairs go by them
    open_ = work.keep(both(open_, f"{label}-near", True).mapInArrow(_near, _LINK), f"{label}-open")
    found = both(open_, label, False).mapInArrow(_linked, _LINK)
    links = work.keep(found.unionByName(pairs.filter("sure").drop("sure")), f"{label}-links")
    work.drop(f"{label}-sets", f"{label}-near-sets", f"{label}-open", f"{label}-pairs")
    return links


def join(docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row of docs.

    Null text and text without words have no shingles and link with nothing: component_id is their own doc_id. Repeated
    rows are equal sets and so linked. A null doc_id links as others do, but counts for no component's smallest. An
    empty table gives an empty result. Texts of any length are hashed in blocks.
    """
    return _join(docs, work, doc_id, text).drop("text_key")


def _join(docs: DataFrame, work: Workspace, doc_id: str, text: str) -> DataFrame:
    """join() with text_key, a hash of the row's text."""
    docs = pick(docs, doc_id=doc_id, text=text)
    scanned = work.keep(scan(docs), "scan")
    slim = scanned.filter("kind = 0").select("doc_id", F.col("token").alias("cid"), F.col("n").cast("int").alias("n"), "text_key")
    often = scanned.filter("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
    often = often.select("token", "n").toPandas().sort_values(["n", "token"], ascending=[False, True])
    frequent, least_frequent = often["token"].to_numpy(np.int64).view(np.uint64), float(often["n"].min()) if len(often) else 0.0
    classes = slim.filter("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("rep"))
    classes = work.keep(classes, "classes")
    # how many others an entry meets in its list, on average, where shingles are not so frequent that they come last
    rare = scanned.filter("kind = 2").groupBy("token").agg(F.sum("n").cast("double").alias("n"))
    if len(frequent) == FREQUENT:
        rare = rare.filter(F.col("n") <= least_frequent)
    met = rare.agg(F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).first()[0]
    lists = entries(docs, frequent, boundary(met or 0.0)).repartition("token").sortWithinPartitions("token", "n", "cid", "pos")
    lists = work.keep(lists.mapInArrow(_shared, "token bigint, cid bigint, n int, pos int, size bigint"), "lists")
    # lists of small sets by subset need no pivot of support; support is how much company a class has in its lists
    support = lists.groupBy("cid", "n").agg(F.sum(F.least("size", F.lit(1 << 30)) / F.col("n")).alias("support"))
    lists = work.keep(lists.join(support, ["cid", "n"]), "supported")
    work.drop("lists")
    order = ["token", F.desc("support"), "n", "cid"]
    star = lists.select("token", "cid", "n", "pos", "support").repartition("token").sortWithinPartitions(*order).mapInArrow(_star, _PAIR)
    links = _compare(docs, classes, star, work, "star")
    node = lambda c, n: F.struct(F.col(c).alias("cid"), F.col(n).alias("n"))
    as_edges = lambda d: d.select(node("a", "an").alias("a"), node("b", "bn").alias("b"))
    roots = components(as_edges(links), work, "first").select(F.col("node.cid").alias("cid"), F.col("node.n").alias("n"), F.col("root.cid").alias("root"), F.col("root.n").alias("root_n"))
    rooted = lists.join(roots, ["cid", "n"], "left").withColumns({"root": F.coalesce("root", "cid"), "root_n": F.coalesce("root_n", "n")})
    # a list within one component has nothing left to compare, nor has one of two classes, which the pivot covered
    open_ = rooted.groupBy("token").agg(F.min(F.struct("root", "root_n")).alias("lo"), F.max(F.struct("root", "root_n")).alias("hi"), F.count("*").alias("k")).filter("lo <> hi and k > 2").select("token")
    rooted = rooted.join(open_, "token", "left_semi")
    across = rooted.select("token", "cid", "n", "pos", "support", "root", "root_n").repartition("token").sortWithinPartitions(*order).mapInArrow(_across, _PAIR)
    more = _compare(docs, classes, across, work, "across")
    roots = components(as_edges(links.unionByName(more)), work, "last")
    work.drop("supported")
    roots = roots.select(F.col("node.cid").alias("cid"), F.col("node.n").alias("n"), F.col("root.cid").alias("root"), F.col("root.n").alias("root_n"))
    named = classes.join(roots, ["cid", "n"], "left").withColumns({"root": F.coalesce("root", "cid"), "root_n": F.coalesce("root_n", "n")})
    least = named.groupBy("root", "root_n").agg(F.min("rep").alias("component_id"))
    named = work.keep(named.join(least, ["root", "root_n"]).select("cid", "n", "component_id"), "named")
    return slim.join(named, ["cid", "n"], "left").select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with their columns.

    Rows repeated with id and text stay once. Where an id is repeated with several texts, each goes by its own component. Rows without words, and
    rows without an id, stay.
    """
    found = _join(docs, work, doc_id, text)
    named, kept_key, text_key = fresh(docs, "_kept", "_kept_key", "_text_key")
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias(named), F.col("text_key").alias(kept_key)).distinct()
    own = F.col(f"`{doc_id}`")
    keyed = docs.withColumn(text_key, F.xxhash64(f"`{text}`"))
    rows = keyed.join(kept, (own == F.col(named)) & (F.col(text_key) == F.col(kept_key)), "left_semi").dropDuplicates([doc_id, text_key]).drop(text_key)
    return rows.unionByName(docs.filter(own.isNull()))
