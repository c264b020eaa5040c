"""Quality classifier as a sparse ensemble of rules over text statistics.

Small regression trees are boosted on a bounded sample of labelled documents; every path from
a root to a node is a rule, a conjunction of comparisons. A logistic model with an L1 penalty
is fitted over the rules (proximal gradient), which leaves few of them with a weight. The
rules are compiled into one Spark column expression over the statistics, evaluated for all
documents; the model is a few comparisons and travels with the plan.

At most ``sample`` labelled rows (by hash of the id) are fitted on, on the driver. Labels,
language, source and id are no inputs. Null and empty texts have zero statistics and are
scored like any other; null and repeated ids are scored row by row. Without labelled rows, or
with one class only, the score is the smoothed share of label 1.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbeam.llm.frames import map_rows, stored
from flowbeam.llm.stats import NAMES, SCHEMA, text_stats

#: Inputs of the rules: name and expression over the counts.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _ratio("word_chars", "n_words"),
    "symbols": lambda: _ratio("n_symbols", "word_chars"),
    "bangs": lambda: _ratio("n_bangs", "word_chars"),
    "capitals": lambda: _ratio("n_upper", "word_chars"),
    "digits": lambda: _ratio("n_digits", "word_chars"),
    "punctuation": lambda: _ratio("n_punct", "word_chars"),
    "dup_lines": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeats": lambda: _ratio("n_repeat_words", "n_words"),
    "distinct": lambda: _ratio("n_distinct", "n_words"),
    "top_word": lambda: _ratio("n_top", "n_words"),
    "words_per_line": lambda: _ratio("n_words", "n_lines"),
}


def _ratio(part: str, whole: str) -> Column:
    return (F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool  # value > threshold, else value <= threshold
    threshold: float


Rule = tuple[Condition, ...]


@dataclass
class RuleModel:
    bias: float
    rules: list[Rule]
    weights: list[float]

    def column(self) -> Column:
        """Score in 0..1 over columns named like FEATURES."""
        names = list(FEATURES)
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            holds = F.lit(True)
            for c in rule:
                value = F.col(names[c.feature])
                holds = holds & (value > c.threshold if c.above else value <= c.threshold)
            total = total + F.when(holds, F.lit(w)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow_tree(x: np.ndarray, target: np.ndarray, edges: list[np.ndarray], depth: int, least: int):
    """Least-squares tree: paths of all its nodes with their rows, and the fitted values."""
    binned = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]  # bin <= i: value <= edge i
    paths: list[tuple[Rule, np.ndarray]] = []
    fitted = np.zeros(len(x))

    def split(rows: np.ndarray, path: Rule, left: int) -> None:
        fitted[rows] = target[rows].mean()
        if not left or len(rows) < 2 * least:
            return
        best, total = None, target[rows].sum()
        floor = total * total / len(rows) + 1e-9
        for f, e in enumerate(edges):
            if not len(e):
                continue
            n = np.cumsum(np.bincount(binned[f][rows], minlength=len(e) + 1))[:-1]
            s = np.cumsum(np.bincount(binned[f][rows], target[rows], len(e) + 1))[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), -np.inf)
                i = int(gain.argmax())
                if gain[i] > floor and (best is None or gain[i] > best[0]):
                    best = (gain[i], f, i)
        if best is None:
            return
        _, f, i = best
        low = binned[f][rows] <= i
        for side, above in ((rows[low], False), (rows[~low], True)):
            rule = (*path, Condition(f, above, float(edges[f][i])))
            paths.append((rule, side))
            split(side, rule, left - 1)

    split(np.arange(len(x)), (), depth)
    return paths, fitted


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and sparse weights by accelerated proximal gradient."""
    n, m = r.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t = w.copy(), b, 1.0
    rate = 4.0 / (1.0 + np.linalg.eigvalsh(r.T @ r / n)[-1])
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(r @ vw + vb))) - y
        new = vw - rate * (r.T @ g / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = vb - rate * g.mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return float(b), w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, penalty: float = 1e-3, seed: int = 5) -> RuleModel:
    """Rules from boosted trees on the rows of ``x``, weighted by a lasso."""
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), [], [])
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    f = np.zeros(len(y))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        part = rng.permutation(len(y))[: max(50, len(y) // 2)]
        residual = y - 1 / (1 + np.exp(-f))
        paths, _ = grow_tree(x[part], residual[part], edges, depth, max(5, len(part) // 200))
        # the step of a row is that of the deepest path it follows
        step = np.zeros(len(y))
        for rule, _ in paths:
            rows = holds(rule, x)
            step[rows] = residual[rows].mean() if rows.any() else 0.0
            found.setdefault(tuple(sorted(rule, key=lambda c: (c.feature, c.above, c.threshold))))
        f += 2.0 * step
    rules = list(found)
    if not rules:
        return fit_rules(x[:0], y[:0])
    r = np.column_stack([holds(rule, x) for rule in rules]).astype(float)
    bias, w = lasso_logistic(r, y, penalty)
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(bias, [rules[i] for i in used], [float(w[i]) for i in used])


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for c in rule:
        ok &= x[:, c.feature] > c.threshold if c.above else x[:, c.feature] <= c.threshold
    return ok


def held_out() -> Column:
    """The default split by doc_id: crc32 of its text mod 4 is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def held_out_id(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the FEATURES of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = map_rows(docs, ["doc_id", "text"], lambda: lambda i, t: (i, *text_stats(t)), f"doc_id {kind}, {SCHEMA}")
    return counts.select("doc_id", *NAMES).select("doc_id", *(make().alias(n) for n, make in FEATURES.items()))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> RuleModel:
    """Fit on up to ``sample`` labelled rows that are not held out; several labels of an id: the least."""
    marked = labels.filter("doc_id is not null and quality is not null").filter(~held_out())
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id_"), F.col("quality").alias("label_"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id_"))
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.length("text").alias("n"), "text", "label_")).alias("v")).select("doc_id", "v.text", "v.label_")
    rows = stored(statistics_with(texts), "rule-sample").orderBy("doc_id").collect()  # ``sample`` at most
    x = np.array([[r[n] for n in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r["label_"] for r in rows], float)
    return fit_rules(x, y, **options)


def statistics_with(texts: DataFrame) -> DataFrame:
    kind = texts.schema["doc_id"].dataType.simpleString()
    counts = map_rows(texts, ["doc_id", "label_", "text"], lambda: lambda i, y, t: (i, y, *text_stats(t)), f"doc_id {kind}, label_ int, {SCHEMA}")
    return counts.select("doc_id", "label_", *(make().alias(n) for n, make in FEATURES.items()))


def score_quality(docs: DataFrame, model: RuleModel, cutoff: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = statistics(docs).withColumn("score", model.column())
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
