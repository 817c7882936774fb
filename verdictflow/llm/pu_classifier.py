"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk.

A small network is fitted to trusted positives (label 1) against unlabelled text with an estimated class prior pi.  With
a loss l, the risk is pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)); where the bracket falls below zero its gradient is
reversed, which keeps the network from pushing unlabelled positives down.

pi is estimated from positives and unlabelled rows alone, no negative label is read: networks that separate halves of
them score the other halves, and of all thresholds the one is taken where the share of unlabelled rows above it, over
that of positives, is least, allowing for the samples' sizes (best bin estimation).

Features are built-in expressions over the whole text, scores a built-in expression over the features.  Only the fit
sees a sample: at most MAX_POSITIVE positives and MAX_UNLABELLED unlabelled rows of the training folds, the first by a
hash of doc_id; those bounds are the documented parameters.

Edge cases: null and empty texts have all features 0 and are scored; a null doc_id is never trained on and is not held
out; rows whose labels contradict each other are not trusted; repeated rows are scored each; without any usable positive
all scores are 0.5; an empty table gives an empty table; clashing column names in docs are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_of, words_of
from .quality_rules import stop_forms

MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
HIDDEN = 12
#: Passes over the unlabelled rows; more of them where those are few.
EPOCHS, LEAST_STEPS = 60, 800
BATCH = 1024
RATE = 0.01
SEED = 11
#: Times that the rows are halved to estimate the prior.
SPLITS = 3
FOLDS, HELD_OUT = 3, 1


def features(docs: DataFrame, text: Column) -> tuple[DataFrame, list[str]]:
    """docs with the feature columns f0, f1, ..., doubles without nulls."""
    df = docs.withColumn("__t", text).withColumn("__w", words_of(F.col("__t")))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x != ""))
    t, w, h, lines = F.col("__t"), F.col("__w"), F.col("__h"), F.col("__l")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.greatest(F.size(w), F.lit(1)).cast("double")
    share = lambda other: F.length(F.regexp_replace(t, other, "")) / chars
    pairs = F.array_distinct(F.zip_with(h, F.slice(h, 2, 2**30), lambda a, b: F.xxhash64(a, b)))
    made = [
        F.log1p(F.size(w).cast("double")),
        F.length(F.array_join(w, "")) / words,
        share(r"[^#*$%&|<>@^~_=+/\\{}\[\]]+") * 10,
        share(r"[^!?]+") * 10,
        share(r"[^|]+") * 10,
        share(r"\P{Lu}+") * 3,
        share(r"[^0-9]+") * 5,
        share(r"[^.,;:]+") * 10,
        F.size(F.array_distinct(h)) / words,
        F.size(pairs) / words,
        (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1)),
        F.log1p(F.size(lines).cast("double")),
        F.size(F.filter(w, lambda x: x.isin(stop_forms()))) / words,
        F.size(F.filter(w, lambda x: F.length(x) == 1)) / words,
        F.size(F.filter(w, lambda x: F.length(x) > 14)) / words,
    ]
    names = [f"f{i}" for i in range(len(made))]
    df = df.withColumns({n: F.when(t == "", F.lit(0.0)).otherwise(c.cast("double")) for n, c in zip(names, made, strict=True)})
    return df.drop("__t", "__w", "__h", "__l"), names


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the training folds; contradicting rows are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__q")).where("quality = __q").drop("__q")


class Network:
    """One hidden layer of tanh; plain arrays."""

    def __init__(self, n: int, rng: np.random.Generator) -> None:
        self.w1, self.b1 = rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)

    def params(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w1 + self.b1)
        return h, h @ self.w2 + self.b2[0]

    def grads(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Of sum(g * output)."""
        back = np.outer(g, self.w2) * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED, share: float | None = None) -> Network:
    """Adam on the non-negative risk, with the logistic loss l(z) = log(1 + exp(-z)).

    share, prior unless given, is how many positives the unlabelled rows hold: 0 separates them from the positives.
    """
    share = prior if share is None else share
    rng = np.random.default_rng(seed)
    net = Network(positive.shape[1], rng)
    first, second, step = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    n_batches = max(1, -(-len(unlabelled) // BATCH))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // n_batches))):
        order_u, order_p = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
        for b in range(n_batches):
            u, p = unlabelled[order_u[b::n_batches]], positive[order_p[b % len(order_p) :: n_batches]]
            (hu, zu), (hp, zp) = net.forward(u), net.forward(p)
            bracket = np.mean(np.logaddexp(0, zu)) - share * np.mean(np.logaddexp(0, zp))
            minus = [a - c for a, c in zip(net.grads(u, hu, sigmoid(zu) / len(u)), net.grads(p, hp, share * sigmoid(zp) / len(p)), strict=True)]
            if bracket < 0:
                total = [-m for m in minus]
            else:
                total = [a + m for a, m in zip(net.grads(p, hp, -prior * sigmoid(-zp) / len(p)), minus, strict=True)]
            step += 1
            for k, (q, g) in enumerate(zip(net.params(), total, strict=True)):
                g = g + 1e-4 * q
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                q -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows, by the best bin: above it, unlabelled rows are as good as all
    positive.  Each half is scored by a network of the other half; the halves are dealt by a hash of the row, so a row
    that is positive and unlabelled is in one half.  With too few rows for halves, one half."""
    kept = np.arange(1, 101) / 100
    above = []
    for turn in range(SPLITS):
        of_p, of_u = (np.array([hashlib.blake2b(x.tobytes(), digest_size=1, key=b"%d" % (seed + turn)).digest()[0] & 1 for x in rows]) for rows in (positive, unlabelled))
        for half in (0, 1):
            p, u, test_p, test_u = positive[of_p == half], unlabelled[of_u == half], positive[of_p != half], unlabelled[of_u != half]
            if not min(map(len, (p, u, test_p, test_u))):
                continue
            net = fit(p, u, 1.0, seed, share=0.0)
            zp, zu = np.sort(net.forward(test_p)[1]), np.sort(net.forward(test_u)[1])
            least = zp[np.minimum(len(zp) - 1, np.floor((1 - kept) * len(zp) + 1e-9).astype(int))]
            above.append(1 - np.searchsorted(zu, least) / len(zu))
    if not above:
        return 0.5
    slack = math.sqrt(math.log(4 / doubt) / 2) * (len(unlabelled) ** -0.5 + len(positive) ** -0.5)
    share = np.mean(above, 0)
    best = np.argmin((share + slack) / kept)
    return float(np.clip(share[best] / kept[best], 1 / (len(unlabelled) + 2), 1 - 1 / (len(unlabelled) + 2)))


def first_by_hash(rows: DataFrame, most: int, names: list[str]) -> np.ndarray:
    """The ``most`` rows whose ids hash lowest.  Hashes beyond twice their share are left out first, so that tasks don't
    each send ``most`` rows to the driver."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 31))
    n = rows.count()
    near = rows.where(draw < math.ceil((1 << 31) * min(1.0, 2 * most / max(n, 1))))
    return near.orderBy(draw, "doc_id").limit(most).select(names).toPandas().to_numpy(float)


def train(scored: DataFrame, names: list[str], labels: DataFrame) -> tuple[Column, float]:
    """The score as an expression over the features, and the class prior."""
    trusted = trusted_labels(labels).where("quality = 1").select("doc_id")
    pool = scored.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", *names)
    unlabelled = first_by_hash(pool, MAX_UNLABELLED, names)
    positive = first_by_hash(pool.join(trusted, "doc_id", "left_semi"), MAX_POSITIVE, names)
    if not len(positive):
        return F.lit(0.5), 0.5
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    positive, unlabelled = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    prior = estimate_prior(positive, unlabelled)
    net = fit(positive, unlabelled, prior)
    z = [F.least(F.greatest((F.col(n) - float(m)) / float(s), F.lit(-8.0)), F.lit(8.0)) for n, m, s in zip(names, mean, scale, strict=True)]
    hidden = []
    for k in range(HIDDEN):
        total = F.lit(float(net.b1[k]))
        for i in range(len(names)):
            total = total + F.col(f"__z{i}") * float(net.w1[i, k])
        hidden.append(F.tanh(total))
    out = F.lit(float(net.b2[0]))
    for k in range(HIDDEN):
        out = out + F.col(f"__h{k}") * float(net.w2[k])
    return (z, hidden, F.lit(1.0) / (F.lit(1.0) + F.exp(-out))), prior


def score(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """keep, held_out, score, predicted.  docs has doc_id and __text; the features are written once and read three times."""
    df, names = features(docs, text_of("__text"))
    df = stored(df.select(*keep, *names), "pu-features")
    model, _ = train(df, names, labels)
    if isinstance(model, Column):
        df = df.withColumn("score", model)
    else:
        z, hidden, out = model
        df = df.withColumns({f"__z{i}": c for i, c in enumerate(z)}).withColumns({f"__h{k}": c for k, c in enumerate(hidden)}).withColumn("score", out)
    return df.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text"))
    return score(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good, with their own columns."""
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", F.col("text").alias("__text"))
    return score(rows, table(spark, sf_dir, "labels"), ["__row", "doc_id"]).where("predicted = 1").select("__row.*")
