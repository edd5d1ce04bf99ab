"""Quality classification by hierarchical empirical Bayes.

1. A document classifier gives each text a probability of being good (of quality,
   and not toxic): two logistic regressions over counts of byte and word kinds and
   over log odds of words, fitted on a bounded sample of labelled documents.
2. Grouped aggregation over all documents sums these probabilities by site (host)
   and by path within a site.
3. A site's posterior mean shrinks its own mean towards the global one, a path's
   towards its site's, the more so the fewer documents they have.  The strengths are
   estimated from the spread of the means at each level (method of moments).
4. A document's posterior is the classifier's odds times the odds of its path
   relative to the global ones; documents below ``THRESHOLD`` are rejected.

The table of sites and paths is joined by key, so Spark broadcasts it only while it
is small.  Null hosts and paths are values like any other; null texts are empty and
rejected, as is every text without a word.  Without labels everything with a word is
kept; with labels of one kind only, that kind is not learned.  Of several labels of a
document the worse counts.  Rows with equal or null keys are judged each for its own
text; a null key has no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, settle, tidied, utf8
from .decontaminate import Words

#: At most about so many labelled documents are learned from (by a hash of the key).
MAX_TRAIN_DOCS = 20_000
BUCKETS = 1 << 18
THRESHOLD = 0.5
#: Added to word counts; a word seen once or twice says little.
SMOOTH = 2.0
_SLICE = 1 << 20
_KINDS = np.zeros((8, 256), np.int64)
_KINDS[0, 65:91] = 1  # capitals
_KINDS[1, 97:123] = 1
_KINDS[2, 48:58] = 1
_KINDS[3, [9, 10, 11, 12, 13, 32]] = 1
_KINDS[4, [ord(c) for c in "*$%&#@^~=+<>{}[]\\_`"]] = 1  # symbols
_KINDS[5, [ord(c) for c in "!?"]] = 1
_KINDS[6, [ord(c) for c in "|/"]] = 1
_KINDS[7, 128:] = 1


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x)))
    return total[at[1:]] - total[at[:-1]]


def features(texts: pa.Array, odds: np.ndarray | None = None) -> tuple[np.ndarray, Words]:
    """A row of numbers for each text; ``odds`` are the two columns of word log odds."""
    raw, off = utf8(texts)
    w = Words(texts)
    n, at = np.maximum(np.diff(off), 1), w.text_at
    words = np.maximum(np.diff(at), 1)
    cols = [_sums(k[raw], off) / n for k in _KINDS]
    same = np.zeros(len(w.hash), np.int64)
    same[1:] = w.hash[1:] == w.hash[:-1]
    if len(same):
        same[at[:-1][at[:-1] < len(same)]] = 0
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((w.hash, of))
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (of[order][1:] != of[order][:-1])
    double = np.zeros(len(raw), np.int64)  # a symbol or mark twice in a row
    double[1:] = (raw[1:] == raw[:-1]) & (_KINDS[4:7].sum(0)[raw[1:]] > 0)
    cols += [_sums(same, at) / words, _sums(fresh, at) / words, _sums(double, off) / words, _sums(w.end - w.start, at) / words, np.log1p(np.diff(at)), (np.diff(at) == 0).astype(float)]
    if odds is not None:
        bucket = (w.hash >> np.uint64(46)).astype(np.int64)
        for column in odds.T:
            v = column[bucket].astype(np.float64)
            top = np.full(len(texts), -9.0)
            np.maximum.at(top, of, v)
            cols += [np.maximum(top, -9), _sums(v, at) / words, _sums((v > 3).astype(float), at) / words, np.log1p(_sums((v > 2).astype(float), at))]
    return np.stack(cols, 1).astype(np.float64), w


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the constant comes last."""
    x = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        pen = np.full(len(b), ridge)
        pen[-1] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


class Model:
    """Word log odds, scaling and weights; its size is fixed."""

    def __init__(self, odds: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.odds, self.mean, self.scale, self.weights = odds, mean, scale, weights

    def good(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text to be of quality and not toxic."""
        x, w = features(texts, self.odds)
        p = np.ones(len(texts))
        for b in self.weights:
            z = np.clip((x - self.mean) / self.scale, -8, 8) @ b[:-1] + b[-1]
            p *= 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p[np.diff(w.text_at) == 0] = 0.0
        return p


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", toxic: str = "toxic", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("k"), F.col(quality).cast("int").alias("q"), F.col(toxic).cast("int").alias("x")).dropna().groupBy("k").agg(F.min("q").alias("q"), F.max("x").alias("x"))
    n = known.count()
    if n > max_docs:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(max_docs / n * (1 << 30)))
    # a bounded number of short rows: broadcast, so that texts stay where they are
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k").select("t", "q", "x")
    sample = settle(sample.where("t is not null").repartition(12))

    def words(it):
        total = np.zeros((BUCKETS, 4), np.int64)
        docs_of = np.zeros(4, np.int64)
        for b in it:
            for part in chunks(b, "t", _SLICE):
                w = Words(part.column(0))
                of = np.repeat(np.arange(len(part)), np.diff(w.text_at))
                pairs = np.unique(of << 18 | (w.hash >> np.uint64(46)).astype(np.int64))
                q, x = part.column(1).to_numpy(), part.column(2).to_numpy()
                for k, kind in enumerate((q > 0, q <= 0, x <= 0, x > 0)):
                    total[:, k] += np.bincount(pairs[kind[pairs >> 18]] & (BUCKETS - 1), minlength=BUCKETS)
                    docs_of[k] += kind.sum()
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), *(pa.array(np.append(total[some, k], docs_of[k])) for k in range(4))], ["bucket", "a", "b", "c", "d"])

    counts = sample.mapInArrow(tidied(words), "bucket long, a long, b long, c long, d long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in "abcd"]).toArrow()  # at most BUCKETS rows
    table = np.zeros((BUCKETS + 1, 4))
    table[counts.column("bucket").to_numpy()] = np.stack([counts.column(c).to_numpy() for c in "abcd"], 1)
    size = table[-1]
    rate = (table[:-1] + SMOOTH * size / max(1.0, size[:2].sum())) / np.maximum(size + SMOOTH, 1)
    # column 0 speaks for low quality, column 1 for toxicity
    with np.errstate(divide="ignore", invalid="ignore"):  # of a kind that no label has
        odds = np.stack((np.log(rate[:, 1] / rate[:, 0]), np.log(rate[:, 3] / rate[:, 2])), 1)
    odds[:, [not size[:2].all(), not size[2:].all()]] = 0.0
    odds[table[:-1, :2].sum(1) < 3] = 0.0
    odds = np.clip(odds, -9, 9).astype(np.float32)
    shared = spark.sparkContext.broadcast(odds)

    def rows(it):
        for b in it:
            for part in chunks(b, "t", _SLICE):
                x, _ = features(part.column(0), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1), part.column(2)], ["f", "q", "x"])

    got = sample.mapInArrow(tidied(rows), "f array<double>, q int, x int").toArrow()  # bounded, like the sample
    if not got.num_rows:
        return Model(odds, np.zeros(1), np.ones(1), [])
    x = np.stack(got.column("f").to_pylist())
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    y = [got.column("q").to_numpy() > 0, got.column("x").to_numpy() <= 0]
    return Model(odds, mean, scale, [_fit(z, v.astype(float)) for v in y if 0 < v.sum() < len(v)])


def evidence(docs: DataFrame, model: Model, text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """(row, h, p, e): all columns of each document as a struct, its host and path, and
    the classifier's probability.  Only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in tidied(lambda it: it)(texts):
            b = pa.RecordBatch.from_arrays([b], ["t"])
            yield pa.array(np.concatenate([np.zeros(0), *(shared.value.good(part.column(0)) for part in chunks(b, "t", _SLICE))]))

    return docs.select(F.struct("*").alias("row"), F.col(host).cast("string").alias("h"), F.col(path).cast("string").alias("p"), good(F.col(text)).alias("e"))


def _logit(c):
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    return F.log(c / (1 - c))


def site_posteriors(scores: DataFrame) -> DataFrame:
    """(h, p, shift): the log odds of each path relative to the global ones, from
    documents' hosts ``h``, paths ``p`` and probabilities ``e``."""
    paths = scores.groupBy("h", "p").agg(F.count("*").alias("n"), F.sum("e").alias("s"))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    tot = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs"), F.count("*").alias("hosts")).first()
    if not tot or not tot.gn:
        return paths.select("h", "p", F.lit(0.0).alias("shift"))
    mu = tot.gs / tot.gn

    def strength(groups: DataFrame, n: str, s: str, m) -> float:
        """Prior sample size of a Beta whose means spread as much as the groups' do."""
        v = groups.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - m) ** 2).alias("ss"), F.sum(m * (1 - m)).alias("noise"), F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * m * (1 - m)).alias("v")).first()
        var = max(1e-9, (v.ss - v.noise) / v.n)
        return min(1e6, max(2.0, v.v / v.n / var - 1))

    k_host = strength(hosts, "hn", "hs", F.lit(mu))
    hosts = hosts.select(F.col("h").alias("hh"), ((F.col("hs") + k_host * mu) / (F.col("hn") + k_host)).alias("hm"))
    both = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).select("h", "p", "n", "s", "hm")
    k_path = strength(both, "n", "s", F.col("hm"))
    return both.select("h", "p", (_logit((F.col("s") + k_path * F.col("hm")) / (F.col("n") + k_path)) - _logit(F.lit(mu))).alias("shift"))


def posterior(scores: DataFrame, sites: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``posterior`` and ``keep`` to rows with ``h``, ``p`` and ``e``."""
    # null hosts and paths are equal to themselves inside a struct's text
    on = F.to_json(F.struct("h", "p"))
    s = sites.select(on.alias("site"), "shift")
    out = scores.withColumn("site", on).join(s, "site", "left").drop("site")
    post = F.when(F.col("e") <= 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-(_logit(F.col("e")) + F.coalesce("shift", F.lit(0.0))))))
    return out.withColumn("posterior", post).withColumn("keep", F.col("posterior") >= threshold)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """(key, host, path, evidence, posterior, keep): a row for each document."""
    scores = evidence(docs, train(docs, labels, text, key), text, host, path).select(F.col("row")[key].alias("k"), "h", "p", "e")
    scores = settle(scores)
    out = posterior(scores, site_posteriors(scores))
    return out.select(F.col("k").alias(key), F.col("h").alias("host"), F.col("p").alias("path"), F.col("e").alias("evidence"), "posterior", "keep")


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """The documents that are kept, with all their columns.  Texts are scored twice
    (for the sites, then for the documents) rather than shuffled."""
    rows = evidence(docs, train(docs, labels, text, key), text, host, path)
    sites = settle(site_posteriors(settle(rows.select("h", "p", "e"))))
    return posterior(rows, sites).where("keep").select("row.*")
