"""Document quality and toxicity by hierarchical empirical Bayes.

A document has evidence of its own, from a logistic classifier on text features. Its host and its path have posteriors: grouped
sums of labels (where known) or classifier probabilities, shrunk towards the level above, hosts to the global rate and paths to their
host, by a concentration estimated from how much groups differ. Sparse sites thus say little. A document takes part in neither of its own
two posteriors. Its log odds are its own plus, by a weight fit to all labelled rows, what its path adds to the global rate.

The classifier is fit on a bounded sample of labelled rows: SAMPLE rows, those with the smallest hash of doc_id, one half
to find telling words and the other to fit weights. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick, text_of

#: Labelled rows that the classifier is fit on, at most; telling words kept for each label; rows a word must be in.
SAMPLE, WORDS, SUPPORT = 20_000, 2_000, 5
#: Weights of a site's log odds that are tried; documents are kept below TOXIC and from QUALITY on.
WEIGHTS = tuple(k / 8 for k in range(13))
TOXIC, QUALITY = 0.5, 0.5
TARGETS = ("quality", "toxic")
_PUNCTUATION = ".,;:!?\"'()[]{}*#%&$|<>-"
_SYMBOL = "#*$%&|<>"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def features(text: str, evidence: list[dict[str, float]]) -> list[float]:
    """Shape of the text, and for each target the summed and the strongest log ratio of its distinct words."""
    words = words_of(text)
    n, distinct = len(words), set(words)
    chars = sum(map(len, words))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(np.count_nonzero((data >= 65) & (data <= 90)))
    digits = int(np.count_nonzero((data >= 48) & (data <= 57)))
    symbols = sum(map(text.count, _SYMBOL))
    cry = text.count("!!")
    lines = text.count("\n") + 1
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    out = [float(np.log1p(n)), chars / max(n, 1), min(symbols / max(n, 1), 3), upper / max(chars, 1), digits / max(chars, 1), cry / max(n, 1), len(distinct) / max(n, 1), repeated / max(n, 1), float(np.log1p(lines)), float(n < 5)]
    bare = {w.strip(_PUNCTUATION) for w in distinct}
    for table in evidence:
        found = [table[w] for w in bare if w in table] if table else []
        out += [max(-20.0, min(20.0, sum(found))), max(found, default=0.0), min(found, default=0.0)]
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first is the intercept. Features come standardized."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Telling words and, for each target, standardized weights; or the smoothed rate where labels have one value or are missing."""

    def __init__(self):
        self.evidence: list[dict[str, float]] = [{}, {}]
        self.mean = self.scale = None
        self.weights: list[np.ndarray | float] = [0.5, 0.5]

    def __call__(self, text: str) -> list[float]:
        if self.mean is None:
            return [float(w) for w in self.weights]
        x = (np.array(features(text, self.evidence)) - self.mean) / self.scale
        return [w if isinstance(w, float) else float(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))) for w in self.weights]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def train(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int = SAMPLE) -> Model:
    """Fit on at most sample rows of docs (doc_id, text) that have a label (doc_id, quality, toxic); each target on the rows labelled for it.

    What reaches the driver: sample ids, 2 * WORDS words, and the features of half the sample. docs is read once.
    """
    spark, model = docs.sparkSession, Model()
    chosen = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.join(F.broadcast(chosen), "doc_id").select("text", *(F.col(t).cast("double") for t in TARGETS), (F.xxhash64("doc_id", F.lit("half")) % 2 == 0).alias("first"))
    known = work.keep(known, "known")
    sums_of = [f(t).alias(f"{t}_{n}") for t in TARGETS for n, f in (("n", F.count), ("s", F.sum))]
    total = {r["first"]: r for r in known.groupBy("first").agg(*sums_of).collect()}  # two rows
    count_of = lambda rows, t: (sum(r[f"{t}_n"] for r in rows), sum(r[f"{t}_s"] or 0.0 for r in rows))
    if not total:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[float]] = {}
            for text, q, t in _rows(b):
                add = (q is not None, q or 0.0, t is not None, t or 0.0)
                for w in {w.strip(_PUNCTUATION) for w in words_of(text)}:
                    c = counts.setdefault(w, [0.0, 0.0, 0.0, 0.0])
                    for i, x in enumerate(add):
                        c[i] += x
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.float64()) for i in range(4))], ["word", "quality_n", "quality_s", "toxic_n", "toxic_s"])

    if True in total:
        columns = ("quality_n", "quality_s", "toxic_n", "toxic_s")
        sums = known.filter("first").select("text", *TARGETS).mapInArrow(count, "word string, quality_n double, quality_s double, toxic_n double, toxic_s double")
        sums = work.keep(sums.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns)).filter(F.greatest("quality_n", "toxic_n") >= SUPPORT), "words")
        for k, t in enumerate(TARGETS):
            n, yes = count_of([total[True]], t)
            ratio = F.log((F.col(f"{t}_s") + 0.5) / (yes + 1.0)) - F.log((F.col(f"{t}_n") - F.col(f"{t}_s") + 0.5) / (n - yes + 1.0))
            telling = sums.filter(F.col(f"{t}_n") >= SUPPORT).select("word", ratio.alias("r")).filter("abs(r) > 1").orderBy(F.desc(F.abs("r")), "word").limit(WORDS)
            model.evidence[k] = {r["word"]: r["r"] for r in telling.collect()}
    sent = spark.sparkContext.broadcast(model.evidence)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(features(text, sent.value), q, t) for text, q, t in _rows(b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], ["x", *TARGETS])

    got = known.filter("not first").select("text", *TARGETS).mapInArrow(measured, "x array<double>, quality double, toxic double").collect()
    for k, t in enumerate(TARGETS):
        n, yes = count_of(total.values(), t)
        model.weights[k] = (yes + 1) / (n + 2)
    if got:
        x = np.array([r["x"] for r in got])
        model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        for k, t in enumerate(TARGETS):
            on = np.array([r[t] is not None for r in got])
            y = np.array([r[t] for r in got if r[t] is not None])
            if 0 < y.sum() < len(y):
                model.weights[k] = fit((x[on] - model.mean) / model.scale, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, host, path, quality, toxic: the classifier's own probabilities."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [sent.value(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([x[k] for x in p], pa.float64()) for k in range(2))], ["doc_id", "host", "path", *TARGETS])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, "doc_id bigint, host string, path string, quality double, toxic double")


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """a left join b on keys, where null is a key as any other; the columns of a, then those of b without keys."""
    on = None
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = c if on is None else on & c
    return a.alias("a").join(b.alias("b"), on, "left").select("a.*", *(F.col(f"b.{c}") for c in b.columns if c not in keys))


def posteriors(scored: DataFrame, target: str) -> tuple[DataFrame, float, float, float]:
    """host, path, n, s, host_n, host_s: counts and sums of each path and its host; with the global rate and the concentrations of hosts and paths.

    The concentration at a level is what a beta prior with the groups' variance would have, by the method of moments; where groups
    do not differ more than chance, it is large and groups say nothing.
    """
    s = scored.withColumn("y", F.coalesce(F.col(f"label_{target}"), F.col(target)))
    paths = s.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    rate = hosts.agg(F.sum("host_s") / F.sum("host_n")).first()[0]
    rate = 0.5 if rate is None else rate

    def concentration(groups: DataFrame, n: str, observed: Column, around: Column) -> float:
        # sum of n (observed - around)^2, less what chance gives, over sum of n: variance between groups
        v = groups.agg(F.sum(F.col(n) * (observed - around) ** 2).alias("w"), F.sum(n).alias("n"), F.sum(around * (1 - around)).alias("c"), (F.sum(F.col(n) * around) / F.sum(n)).alias("m")).first()
        if not v["n"]:
            return 1.0
        between = max((v["w"] - v["c"]) / v["n"], 1e-9)
        return min(max(v["m"] * (1 - v["m"]) / between - 1, 1.0), 1e6)

    k_host = concentration(hosts, "host_n", F.col("host_s") / F.col("host_n"), F.lit(rate))
    both = _same(paths, hosts, "host")
    host_rate = (F.col("host_s") + k_host * F.lit(rate)) / (F.col("host_n") + k_host)
    k_path = concentration(both, "n", F.col("s") / F.col("n"), host_rate)
    return both, rate, k_host, k_path


def without(own: Column, rate: float, k_host: float, k_path: float) -> Column:
    """The posterior rate of a row's path from all rows but itself: it is left out of its path and of the host that the path is shrunk to."""
    host = (F.col("_host_s") - own + k_host * F.lit(rate)) / (F.col("_host_n") - 1 + k_host)
    return (F.col("_s") - own + k_path * host) / (F.col("_n") - 1 + k_path)


def _weights(sited: DataFrame) -> list[float]:
    """For each target the weight of the site's log odds under which the labelled rows are likeliest; 0 without labels. One aggregate."""
    logs = []
    for t in TARGETS:
        y = F.col(f"label_{t}")
        for k, w in enumerate(WEIGHTS):
            odds = _logit(F.col(t)) + w * F.col(f"site_{t}")
            # log of the probability of y, written so that it cannot overflow
            logs.append(F.sum(y * odds - F.greatest(odds, F.lit(0.0)) - F.log1p(F.exp(-F.abs(odds)))).alias(f"{t}_{k}"))
    got = sited.agg(*logs).first()
    best = lambda t: max(range(len(WEIGHTS)), key=lambda k: (round(got[f"{t}_{k}"], 9), -k)) if got[f"{t}_0"] is not None else 0
    return [WEIGHTS[best(t)] for t in TARGETS]


def classify(docs: DataFrame, labels: DataFrame, work: Workspace, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality, toxic (posterior probabilities), own_quality, own_toxic (the classifier's), path_quality, path_toxic, keep.

    labels: doc_id, quality, toxic (0 or 1; repeated ids count by their mean; a null is no label for that target). Null text counts as
    empty; null host or path is a site of its own. Without labels every probability is the smoothed rate 0.5. Repeated rows are scored alike.
    An empty table gives an empty result.
    """
    d = pick(docs.withColumns({"_host": host, "_path": path}), doc_id=doc_id, text=text, host="_host", path="_path")
    d = d.select(F.col("doc_id").cast("long"), text_of("text").alias("text"), F.col("host").cast("string"), F.col("path").cast("string"))
    one = labels.groupBy("doc_id").agg(*(F.avg(t).alias(t) for t in TARGETS))
    model = train(d, one.select("doc_id", *(F.round(t).alias(t) for t in TARGETS)), work, sample)
    named = one.select("doc_id", *(F.col(t).alias(f"label_{t}") for t in TARGETS))
    scored = work.keep(score(d, model).join(named, "doc_id", "left"), "scored")
    out = scored
    for t in TARGETS:
        sites, rate, k_host, k_path = posteriors(scored, t)
        sites = work.keep(sites.select("host", "path", *(F.col(c).alias(f"_{c}") for c in ("n", "s", "host_n", "host_s"))), f"sites_{t}")
        mine = without(F.coalesce(F.col(f"label_{t}"), F.col(t)), rate, k_host, k_path)
        out = _same(out, sites, "host", "path").withColumn(f"path_{t}", mine).withColumn(f"site_{t}", _logit(F.col(f"path_{t}")) - _logit(F.lit(rate)))
        out = out.drop("_n", "_s", "_host_n", "_host_s")
    out = work.keep(out, "sited")
    for t, w in zip(TARGETS, _weights(out)):
        out = out.withColumn(f"post_{t}", 1 / (1 + F.exp(-(_logit(F.col(t)) + w * F.col(f"site_{t}")))))
    keep = (F.col("post_quality") >= QUALITY) & (F.col("post_toxic") < TOXIC)
    return out.select("doc_id", F.col("post_quality").alias("quality"), F.col("post_toxic").alias("toxic"), F.col("quality").alias("own_quality"), F.col("toxic").alias("own_toxic"), "path_quality", "path_toxic", keep.alias("keep"))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, in lower case; null where there is none."""
    m = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    p = F.regexp_extract(url, r"^[^/?#]*//[^/?#]*/([^/?#]+)", 1)
    return F.nullif(F.lower(m), F.lit("")), F.nullif(F.lower(p), F.lit(""))
