"""Mixing sources to target weights with soft memberships.

1. A softmax classifier, fitted on at most `train_rows` labelled documents (chosen by a hash of the id), gives every
   document a posterior p over the domains.
2. Nonnegative rates r are fitted so that the expected domain token totals t_k = sum r * tokens * p_k match targets:
   projected gradient on the least squares |t - T|, scaled by the inverse of G = sum tokens * p p' over the rows whose
   rate is above 0 (and under `ceiling`, if one is asked for), so that a step is r <- clip(r - p . G^-1 (t - T)), halved
   until it comes nearer.  A step is exact unless more rates reach a bound.  mixing_report() says what was reached;
   where that isn't the target by more than `close`, a warning says so too.
   It needs only the k totals and G, one distributed sum; the rates are a function of p and the steps so far, so no
   state is kept by document.
3. Unless a total is given, it is the one at which the domain `whole` is to have all of its tokens; where that domain has
   no mass or target, it is the largest at which no domain's expected tokens need exceed what there is.

Defined cases
* A null or wordless text has 0 tokens; it takes no part in the totals and gets a rate by its posterior alike.
* Null labels are left out; of several labels of one id the first domain in DOMAINS counts.  With no labels all
  posteriors are equal.  A domain without any mass is left out of the fit.  Empty tables give empty tables.
* resample() writes floor(rate + u) copies of a row, u a hash of id and text in [0, 1): repeated rows fare alike.
  Other columns pass through resample(), whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinnabar.llm.common import give_back, key_columns, materialize, whole_id
from cinnabar.llm.textkern import distinct_per_row, groups, span_hashes, utf8, word_spans

DOMAINS = ["toxic", "low", "high"]
TARGETS = {"high": 0.86, "low": 0.13, "toxic": 0.01}
WHOLE = "high"
#: A part of the total by which the reached totals may differ from the targets without a warning.
CLOSE = 1e-3
SLOTS = 1 << 18
#: Numbers about a text beside its words.
SHAPE = 6


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when((quality == 1) & (toxic == 0), "high")


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a group of texts: rows and slots of their distinct words, as they are and
    in lower case without marks and digits; SHAPE numbers for each text, and word counts."""
    raw, offs = utf8(column)
    upper = np.zeros(256, np.float32)
    upper[65:91] = 1
    marks = np.zeros(256, np.float32)
    marks[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[[*range(33, 65), *range(91, 97), *range(123, 127)]] = 32
    for i, j in groups(offs):
        part, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, rows = word_spans(part, at)
        tokens = np.bincount(rows, minlength=j - i)
        some, words, _ = distinct_per_row(rows, span_hashes(part, starts, ends))
        distinct = np.bincount(some, minlength=j - i)
        size = np.maximum(1, np.diff(at))

        def share(weight: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(weight[part], dtype=np.float64)])
            return (sums[at[1:]] - sums[at[:-1]]) / size  # noqa: B023

        shape = np.stack([share(upper), share(marks), distinct / np.maximum(1, tokens), np.log1p(tokens) / 8, np.log1p(size / np.maximum(1, tokens)) / 4, np.ones(j - i)], axis=1)
        plain = fold[part]
        starts, ends, rows = word_spans(plain, at)
        folded, more, _ = distinct_per_row(rows, span_hashes(plain, starts, ends, 1))
        slots = (np.concatenate([words, more]) >> np.uint64(30)).astype(np.int64)
        yield np.concatenate([some, folded]), slots, shape, tokens


class Classifier:
    """Softmax regression on hashed words and text shape."""

    def __init__(self, classes: int) -> None:
        self.word = np.zeros((SLOTS, classes), np.float32)
        self.shape = np.zeros((SHAPE * 3, classes))

    @staticmethod
    def bend(shape: np.ndarray) -> np.ndarray:
        return np.concatenate([shape, shape**2, np.sqrt(np.abs(shape))], axis=1)

    def logits(self, rows: np.ndarray, slots: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = self.bend(shape) @ self.shape
        weights = self.word[slots]
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(rows, weights[:, k], minlength=len(shape))
        return out

    def posterior(self, rows: np.ndarray, slots: np.ndarray, shape: np.ndarray) -> np.ndarray:
        x = self.logits(rows, slots, shape)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def fit(self, rows: np.ndarray, slots: np.ndarray, shape: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.08, decay: float = 1e-3) -> None:
        """Adam on the full batch; words of fewer than 5 texts get no weight."""
        n, classes = len(label), self.word.shape[1]
        seen = np.bincount(slots, minlength=SLOTS)
        use = seen[slots] >= 5
        rows, ids = rows[use], np.flatnonzero(seen >= 5)
        slot = np.searchsorted(ids, slots[use])
        bent, want = self.bend(shape), np.eye(classes)[label]
        w = [np.zeros((len(ids), classes)), self.shape.copy()]
        first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for step in range(1, steps + 1):
            x = bent @ w[1]
            for k in range(classes):
                x[:, k] += np.bincount(rows, w[0][slot, k], minlength=n)
            x = np.exp(x - x.max(axis=1, keepdims=True))
            miss = (x / x.sum(axis=1, keepdims=True) - want) / n
            grad = [np.stack([np.bincount(slot, miss[rows, k], minlength=len(ids)) for k in range(classes)], axis=1) + decay * w[0], bent.T @ miss]
            for i, g in enumerate(grad):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                w[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
        self.word[ids], self.shape = w[0], w[1]


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 6000) -> Classifier:
    """labels: doc_id, quality, toxic.  At most train_rows labelled documents reach the driver, as features."""
    known = labels.select(whole_id("doc_id").alias("i"), domain(F.col("quality"), F.col("toxic")).alias("k")).where("i is not null and k is not null")
    rank = F.array_position(F.array(*[F.lit(d) for d in DOMAINS]), F.col("k"))
    known = known.groupBy("i").agg(F.min(rank).cast("int").alias("k"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(train_rows)
    rows = docs.select(whole_id(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot_bytes, shape_bytes = [], []
            for some, slots, shape, _ in features(b.column("t")):
                order = np.argsort(some, kind="stable")
                slots, ends = slots[order], np.searchsorted(some[order], np.arange(len(shape) + 1))
                slot_bytes += [slots[s:e].astype(np.int32).tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
                shape_bytes += [x.tobytes() for x in shape]
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("k"), pa.array(slot_bytes, pa.binary()), pa.array(shape_bytes, pa.binary())], names=["i", "k", "s", "x"])
        give_back()

    got = rows.mapInArrow(run, "i long, k int, s binary, x binary").orderBy("i", "s").limit(train_rows).toArrow()
    model = Classifier(len(DOMAINS))
    if got.num_rows:
        slots = [np.frombuffer(x.as_py(), np.int32) for x in got.column("s")]
        shape = np.array([np.frombuffer(x.as_py()) for x in got.column("x")])
        model.fit(np.repeat(np.arange(len(slots)), [len(s) for s in slots]), np.concatenate(slots).astype(np.int64), shape, got.column("k").to_numpy() - 1)
    return model


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key of each row (__n, __d, __h), tokens, and a posterior p_<domain> of each domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            p, n = [np.empty((0, len(DOMAINS)))], [np.empty(0, np.int64)]
            for rows, slots, shape, tokens in features(b.column("__t")):
                p.append(own.posterior(rows, slots, shape))
                n.append(tokens)
            every = np.round(np.concatenate(p), 9)
            yield pa.RecordBatch.from_arrays([b.column("__n"), b.column("__d"), b.column("__h"), pa.array(np.concatenate(n)), *[pa.array(np.ascontiguousarray(every[:, k])) for k in range(len(DOMAINS))]], names=["__n", "__d", "__h", "tokens", *[f"p_{d}" for d in DOMAINS]])
        give_back()

    keyed = docs.select(*key_columns(id_col, text_col), F.col(text_col).alias("__t"))
    return keyed.mapInArrow(run, "__n boolean, __d long, __h long, tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def rate(steps: list[np.ndarray], ceiling: float | None = None) -> Column:
    """The rate of a document as a function of its posterior, after these steps."""
    r = F.lit(1.0)
    for step in steps:
        move = sum((F.col(f"p_{d}") * float(step[k]) for k, d in enumerate(DOMAINS)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), r - move)
        r = r if ceiling is None else F.least(F.lit(float(ceiling)), r)
    return r


def _pass(p: DataFrame, steps: list[np.ndarray], ceiling: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Under the rates after these steps: each domain's expected tokens, and the Gram matrix of the rows with a rate inside its bounds."""
    names, k = [f"p_{d}" for d in DOMAINS], len(DOMAINS)
    most = np.inf if ceiling is None else ceiling

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            tokens = b.column("tokens").to_numpy(zero_copy_only=False).astype(float)
            r = np.ones(len(tokens))
            for step in steps:
                r = np.clip(r - x @ step, 0.0, most)
            total += (r * tokens) @ x
            free = (r > 0) & (r < most)
            gram += x[free].T @ (x[free] * tokens[free, None])
        yield pa.RecordBatch.from_pydict({"k": np.arange(k + k * k, dtype=np.int32), "x": np.concatenate([total, gram.ravel()])})

    sums = p.select("tokens", *names).mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(k + k * k)
    for row in sums:
        out[row["k"]] = row["x"]
    return out[:k], out[k:].reshape(k, k)


def fit_rates(
    p: DataFrame, targets: dict[str, float], total: float | None = None, whole: str = WHOLE, most: int = 40, close: float = 1e-6, ceiling: float | None = None
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The steps of the fit, the target totals and the totals reached.  Only sums over all rows reach the driver."""
    mass, gram = _pass(p, [], ceiling)
    weight = np.array([targets.get(d, 0.0) for d in DOMAINS])
    weight = weight / weight.sum()
    live = (mass > 0) & (weight > 0)
    if not live.any():
        return [], np.zeros(len(DOMAINS)), mass
    if total is None:
        least = (mass / np.where(live, weight, 1.0))[live].min()
        main = DOMAINS.index(whole)
        total = float(mass[main] / weight[main] if live[main] else least)
    goal = weight * total
    steps: list[np.ndarray] = []
    now = mass
    while len(steps) < most and np.abs(now - goal).sum() > close * goal.sum():
        step = np.linalg.pinv(gram, rcond=1e-6) @ (now - goal)
        miss, passes = np.abs(now - goal).sum(), 0
        while True:  # halved until it comes nearer
            after, free = _pass(p, [*steps, step], ceiling)
            passes += 1
            gain = miss - np.abs(after - goal).sum()
            if gain > 0 or passes == 6:
                break
            step = step / 2
        if gain <= close * 1e-3 * goal.sum():
            break
        steps.append(step)
        now, gram = after, free
    return steps, goal, now


def mixing_fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, total: float | None = None, ceiling: float | None = None
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(__n, __d, __h, tokens, p_<domain>..., rate) of every document, the target totals and those reached."""
    model = fit_classifier(docs, labels, id_col, text_col)
    p = materialize(posteriors(docs, model, id_col, text_col), "posteriors")
    steps, goal, reached = fit_rates(p, targets, total, ceiling=ceiling)
    if np.abs(goal - reached).sum() > CLOSE * goal.sum() > 0:
        far = ", ".join(f"{d}: {r:.0f} for {g:.0f}" for d, g, r in zip(DOMAINS, goal, reached, strict=True))
        warnings.warn(f"the rates don't meet the targets: {far}", stacklevel=2)
    return p.withColumn("rate", F.round(rate(steps, ceiling), 9)), goal, reached


def mixing_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(__n, __d, __h, tokens, p_<domain>..., rate) of every document."""
    return mixing_fit(docs, labels, id_col, text_col, **options)[0]


def mixing_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(domain, goal, reached, gap) in expected tokens."""
    _, goal, reached = mixing_fit(docs, labels, id_col, text_col, **options)
    rows = [(d, float(g), float(r), float(r - g)) for d, g, r in zip(DOMAINS, goal, reached, strict=True)]
    return docs.sparkSession.createDataFrame(rows, "domain string, goal double, reached double, gap double")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, each row as often as its rate says."""
    rates = mixing_rates(docs, labels, id_col, text_col, **options).select("__n", "__d", "__h", F.col("rate").alias("__r"))
    rates = rates.dropDuplicates(["__n", "__d", "__h"])
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *key_columns(id_col, text_col))
    u = F.pmod(F.xxhash64("__d", "__h", F.lit(2)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.floor(F.col("__r") + u).cast("int")
    joined = rows.join(rates, ["__n", "__d", "__h"]).withColumn("__copies", copies).where("__copies > 0")
    return joined.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
