"""Mixing documents to target shares of domain tokens, with soft domain membership.

A sparse naive Bayes classifier over hashed words is counted from half of the labelled
documents; on the other half its summed log odds are scaled by a multinomial logistic model,
so that the posteriors it gives every document hold on average. Rates r_d >= 0 are then fitted so that the expected
tokens per domain, sum_d r_d * n_d * p_dk, meet the target shares of the token budget: least
squares over all documents by projected gradient from r = 1. A step needs only the domain sums
and the Gram matrix of the documents with a positive rate, one aggregate; the gradient is
scaled by n_d and by that K x K matrix, so that a few steps suffice. A rate follows from the
steps' K numbers, so no state per document is kept between steps.

Only built-in column functions run; the driver holds K * (buckets) counts and K x K sums.
The classifier uses at most ``sample`` labelled documents (by hash of the id); counts,
posteriors and rates cover every document. Null and empty texts have no tokens, the average
posterior of their length and no part in the sums; a null id is a document like any other, as are repeated
rows. Documents without labels are scored by the classifier like the rest. Labels with a null
id or without any mark are left out; of several for one id the alphabetically first counts.
Without labels all domains are equally likely and all rates the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbeam.llm.frames import stored

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}
BUCKETS, ENDINGS = 16384, 64
_SPACE = " \t\n\x0b\f\r"


def domain_of() -> Column:
    """Domain of a row of the labels table."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for null and blank texts."""
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _ending_slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.right(word, F.lit(1))), F.lit(ENDINGS)).cast("int") + BUCKETS


@dataclass
class Mixture:
    """Fitted classifier and the steps that the rates follow from."""

    weights: list[list[float]]  # log odds of each later domain against the first, per slot
    scale: list[list[float]]  # per domain, coefficients of _evidence()
    targets: list[float] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)
    sums: list[float] = field(default_factory=list)


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = 20_000, smoothing: float = 1.0, least_z: float = 5.0, least_odds: float = 1.0) -> Mixture:
    """Naive Bayes on up to ``sample`` labelled documents. Slots weigh nothing unless their share
    differs by ``least_z`` standard errors and by a factor of e ** ``least_odds``: the many slight
    differences (of language, of length) would add up to certainty on long documents."""
    marked = labels.select("doc_id", domain_of().alias("domain")).filter("doc_id is not null and domain is not null")
    marked = marked.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id_"), "domain")
    rows = stored(
        docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id_"))
        .select("domain", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("counted"), "text"), "mix-labelled")
    words = rows.filter("counted").select("domain", words_of(F.col("text")).alias("words"))
    counts = np.zeros((len(DOMAINS), BUCKETS + ENDINGS))
    word = words.select("domain", F.explode("words").alias("w"))
    slots = word.select("domain", F.explode(F.array(_slot(F.col("w")), _ending_slot(F.col("w")))).alias("slot"))
    for r in slots.groupBy("domain", "slot").agg(F.count("*").alias("n")).collect():  # domains x slots at most
        counts[DOMAINS.index(r["domain"]), r["slot"]] = r["n"]
    weights = []
    for part in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + ENDINGS)):
        c = counts[:, part]
        total = c.sum(axis=1, keepdims=True)
        share = (c + smoothing) / (total + smoothing * c.shape[1])
        pooled = (c + c[0] + smoothing) / np.maximum(total + total[0], 1)
        spread = np.sqrt(np.maximum(pooled * (1 / np.maximum(total, 1) + 1 / max(total[0, 0], 1)), 1e-30))
        clear = np.abs(share - share[0]) >= least_z * spread
        odds = np.log(share / share[0])
        clear &= np.abs(odds) >= least_odds
        weights.append(np.where(clear & (total > 0) & (total[0] > 0), odds, 0.0))
    w = np.concatenate(weights, axis=1)
    model = Mixture([list(map(float, x)) for x in w[1:]], [])
    other = _with_evidence(rows.filter("not counted"), model, F.col("text")).select("domain", *_EVIDENCE).limit(sample)
    seen = other.collect()  # the bounded sample again
    x = np.array([[1.0, *r[1:]] for r in seen], float).reshape(len(seen), len(_EVIDENCE) + 1)
    y = np.array([DOMAINS.index(r["domain"]) for r in seen], np.int64)
    return Mixture(model.weights, fit_scale(x, y).tolist())


def fit_scale(x: np.ndarray, y: np.ndarray, steps: int = 600, penalty: float = 1e-4) -> np.ndarray:
    """Multinomial logistic coefficients (domains x evidence), so that posteriors hold on average."""
    k = len(DOMAINS)
    out = np.zeros((k, x.shape[1]))
    if not len(y):
        return out
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread[0] = 0.0, 1.0
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    rate = 2.0 / (np.linalg.eigvalsh(z.T @ z / len(z))[-1] + penalty)
    share = (np.bincount(y, minlength=k) + 1) / (len(y) + k)
    w = np.zeros((x.shape[1], k))
    w[0] = np.log(share)
    for _ in range(steps):
        p = np.exp((a := z @ w) - a.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (z.T @ (p - np.eye(k)[y]) / len(z) + penalty * w * (np.arange(len(w)) > 0)[:, None])
    out = (w / spread[:, None]).T
    out[:, 0] -= (mean[1:] / spread[1:]) @ w[1:]
    return out


def _vector(values: list[float]) -> Column:
    """An array literal (folded once) from one string."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _fold(weights: Column) -> Column:
    """Sum of the weights of a document's slots; an ending counts a quarter, as it repeats most."""
    return F.aggregate("slots_", F.lit(0.0), lambda acc, s: acc + F.get(weights, s["a"]) + F.get(weights, s["b"]) * 0.25)


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as values: as a generator's output they are
    not substituted into those expressions and computed again for every use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


#: Evidence of a document beside a constant: summed log odds, these per root of the length, and length.
_EVIDENCE = ("sum_1", "sum_2", "mean_1", "mean_2", "length")


def _with_evidence(docs: DataFrame, model: Mixture, text: Column) -> DataFrame:
    slots = F.transform(words_of(text), lambda w: F.struct(_slot(w).alias("a"), _ending_slot(w).alias("b")))
    rows = _computed(docs, slots_=slots)
    sums = {f"sum_{j}": _fold(_vector(w)) for j, w in enumerate(model.weights, 1)}
    rows = _computed(rows, n_tokens=F.size("slots_").cast("long"), **sums).drop("slots_")
    root = F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
    return rows.withColumns({"mean_1": F.col("sum_1") / root, "mean_2": F.col("sum_2") / root, "length": F.log1p("n_tokens")})


def with_posteriors(docs: DataFrame, model: Mixture, text: Column) -> DataFrame:
    """Adds ``n_tokens`` and the posteriors ``p_<domain>`` to ``docs``."""
    rows = _with_evidence(docs, model, text)
    scores = {f"score_{j}": sum((F.col(n) * c for n, c in zip(_EVIDENCE, w[1:])), F.lit(w[0])) for j, w in enumerate(model.scale)}
    rows = _computed(rows, **scores)
    top = F.greatest(*scores)
    odds = [F.exp(F.col(s) - top) for s in scores]
    return _computed(rows, **{f"p_{d}": o / sum(odds[1:], odds[0]) for d, o in zip(DOMAINS, odds)}).drop(*scores, *_EVIDENCE)


def _posteriors() -> list[Column]:
    return [F.col(f"p_{d}") for d in DOMAINS]


def rate_of(steps: list[list[float]]) -> Column:
    """The rate after the steps so far: 1, then max(0, r - posterior . step) for each."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((p * x for p, x in zip(_posteriors(), step)), F.lit(0.0)))
    return rate


def fit_rates(rows: DataFrame, model: Mixture, targets: dict[str, float], budget: float = 1.0, most_steps: int = 25, close: float = 3e-4, most_growth: float = 3.0) -> Mixture:
    """Fit the rates on (n_tokens, p_<domain>); the budget is a multiple of all tokens.

    A target above ``most_growth`` times a domain's tokens is lowered to that and the rest goes
    to the other domains in proportion, so that a nearly absent domain is not repeated endlessly.
    """
    k, p = len(DOMAINS), _posteriors()
    share = np.array([targets.get(d, 0.0) for d in DOMAINS], float)
    steps: list[list[float]] = []
    goal = None
    for _ in range(most_steps):
        r = rows.withColumn("r", rate_of(steps))
        n = F.col("n_tokens")
        sums = [F.sum(n * F.col("r") * p[j]) for j in range(k)]
        active = F.when(F.col("r") > 0, n).otherwise(0)
        gram = [F.sum(active * p[i] * p[j]) for i in range(k) for j in range(k)]
        values = [float(x or 0) for x in r.agg(F.sum("n_tokens"), *sums, *gram).first()]
        have, g = np.array(values[1 : k + 1]), np.array(values[k + 1 :]).reshape(k, k)
        if goal is None:
            goal = share / max(share.sum(), 1e-12) * values[0] * budget
            scarce = goal > most_growth * have
            goal[scarce] = most_growth * have[scarce]
            rest = goal[~scarce].sum()
            if rest > 0:
                goal[~scarce] *= (values[0] * budget - goal[scarce].sum()) / rest
        model = Mixture(model.weights, model.scale, goal.tolist(), steps, have.tolist())
        if np.abs(have - goal).max() <= close * max(values[0], 1):  # of all tokens
            break
        # each domain in units of its tokens: eigenvalues lie in 0..1, small ones are not overshot
        unit = 1 / np.sqrt(np.maximum(g.sum(axis=1), 1e-9))
        values_, basis = np.linalg.eigh(g * np.outer(unit, unit))
        inverse = (basis / np.maximum(values_, 0.1)) @ basis.T
        steps = [*steps, (unit * (inverse @ (unit * (have - goal)))).tolist()]
    return model


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Whole copies whose expectation is the rate: the fraction is settled by a hash of the id."""
    u = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + u).cast("int")


def fit_mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = 20_000) -> tuple[Mixture, DataFrame]:
    """The fitted mixture, and (doc_id, n_tokens, p_<domain>) of every document."""
    model = fit_classifier(docs, labels, sample)
    rows = with_posteriors(docs.select("doc_id", "text"), model, F.col("text")).drop("text")
    rows = stored(rows, "mix-posteriors")
    return fit_rates(rows, model, targets), rows


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = 20_000) -> DataFrame:
    """Per row: doc_id, n_tokens, p_<domain>, rate, copies."""
    model, rows = fit_mixture(docs, labels, targets, sample)
    rows = rows.withColumn("rate", rate_of(model.steps))
    return rows.select(
        "doc_id", "n_tokens", *_posteriors(), "rate", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = 20_000) -> DataFrame:
    """Each document in as many copies as its rate gives, all columns unchanged."""
    model, _ = fit_mixture(docs, labels, targets, sample)
    rows = with_posteriors(docs.select(F.struct("*").alias("row")), model, F.col("row.text"))
    copies = copies_of(rate_of(model.steps), F.col("row.doc_id"))
    # a sequence from 1 up to 0 would run downwards
    repeats = F.when(copies > 0, F.sequence(F.lit(1), copies))
    return rows.select("row", F.explode(repeats).alias("copy")).select("row.*")
