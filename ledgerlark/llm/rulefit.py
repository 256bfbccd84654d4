"""Quality scores by a sparse ensemble of rules.

Statistics of a text are Spark expressions. Boosted shallow trees over the statistics of a bounded sample of
labelled rows propose rules: every path from a root to a node is a conjunction of bounds. A lasso
logistic regression gives most rules the weight 0; the others become one Spark column, so the whole
score of a document is an expression without Python.

The sample is at most max_examples labelled rows, by a seeded hash of doc_id, the same at every size.
Null and empty texts have statistics 0. Labels that are null don't count; a doc_id labelled twice has
the higher label. Rows that repeat a doc_id are scored each. Without labels of both kinds the score
is the one share there is (0.5 without any). Empty tables give empty tables; extra columns
don't matter. Very long texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import WORD, text_of
from ledgerlark.llm.toxicity import sampled

SPACE = r"[\x20\x09-\x0D]+"
STATISTICS = ("words", "word_length", "symbols", "bars", "shouts", "stops", "digits", "upper", "letters", "distinct", "same_lines", "line_words")


@dataclass(frozen=True)
class Settings:
    max_examples: int = 12_000
    trees: int = 40
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    least: float = 0.004
    penalty: float = 0.002
    steps: int = 400
    seed: int = 11


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and STATISTICS of text, doubles.

    What several statistics share is a column of a projection below, so it is computed once.
    """
    text = text_of()
    n_chars = F.char_length(text)
    tokens = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def count(characters: str) -> Column:
        return n_chars - F.char_length(F.translate(text, characters, ""))

    raw = {
        "_tokens": tokens,
        "_lines": lines,
        "_solid": F.char_length(F.regexp_replace(text, SPACE, "")),
        "_symbols": count("#*$%&<>"),
        "_bars": count("|"),
        "_shouts": count("!"),
        "_stops": count(".,;:?"),
        "_digits": count("0123456789"),
        "_upper": n_chars - F.char_length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "_letters": n_chars - F.char_length(F.regexp_replace(text, r"\p{L}+", "")),
    }
    below = docs.select(*(F.col(k) for k in keep), *(c.alias(n) for n, c in raw.items()))
    sizes = {"_words": F.size("_tokens"), "_distinct": F.size(F.array_distinct("_tokens")), "_rows": F.size("_lines"), "_unlike": F.size(F.array_distinct("_lines"))}
    below = below.select(*keep, *(n for n in raw if n not in ("_tokens", "_lines")), *(c.alias(n) for n, c in sizes.items()))

    def share(x: str | Column, of: str) -> Column:
        return F.when(F.col(of) > 0, (F.col(x) if isinstance(x, str) else x) / F.col(of)).otherwise(0).cast("double")

    out = {
        "words": F.col("_words").cast("double"),
        "word_length": share("_solid", "_words"),
        "symbols": share("_symbols", "_words"),
        "bars": share("_bars", "_words"),
        "shouts": share("_shouts", "_words"),
        "stops": share("_stops", "_words"),
        "digits": share("_digits", "_solid"),
        "upper": share("_upper", "_solid"),
        "letters": share("_letters", "_solid"),
        "distinct": share("_distinct", "_words"),
        "same_lines": share(F.col("_rows") - F.col("_unlike"), "_rows"),
        "line_words": share("_words", "_rows"),
    }
    return below.select(*keep, *(out[n].alias(n) for n in STATISTICS))


Rule = tuple[tuple[int, float, float], ...]


def _tree(bins: np.ndarray, target: np.ndarray, rows: np.ndarray, n_bins: int, depth: int, least: int, path: dict, out: list, fit: np.ndarray, everyone: np.ndarray) -> None:
    """Grow one regression tree on target; adds each node's path to out and leaf means to fit."""
    if path:
        out.append(dict(path))
    mean = target[rows].mean() if len(rows) else 0.0
    best = (1e-9, -1, 0)
    if depth and len(rows) >= 2 * least:
        total, n = target[rows].sum(), len(rows)
        for f in range(bins.shape[1]):
            count = np.cumsum(np.bincount(bins[rows, f], minlength=n_bins))[:-1]
            left = np.cumsum(np.bincount(bins[rows, f], target[rows], n_bins))[:-1]
            fine = (count >= least) & (n - count >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fine, left**2 / count + (total - left) ** 2 / (n - count) - total**2 / n, 0)
            cut = int(np.argmax(gain))
            if gain[cut] > best[0]:
                best = (float(gain[cut]), f, cut)
    _, f, cut = best
    if f < 0:
        fit[everyone] += mean
        return
    low, high = path.get(f, (-1, n_bins - 1))
    for new, mine, all_ in (((low, min(high, cut)), rows[bins[rows, f] <= cut], everyone[bins[everyone, f] <= cut]), ((max(low, cut), high), rows[bins[rows, f] > cut], everyone[bins[everyone, f] > cut])):
        _tree(bins, target, mine, n_bins, depth - 1, least, path | {f: new}, out, fit, all_)


def rules_of(x: np.ndarray, y: np.ndarray, settings: Settings) -> list[Rule]:
    """Distinct conjunctions of (statistic, above, at most) from the paths of boosted trees."""
    rng = np.random.default_rng(settings.seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, settings.bins)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    logit = np.full(len(y), np.log(share / (1 - share)))
    paths: list[dict] = []
    everyone = np.arange(len(y))
    for _ in range(settings.trees):
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        p = 1 / (1 + np.exp(-logit))
        step = np.zeros(len(y))
        _tree(bins, y - p, rows, settings.bins, settings.depth, max(5, int(settings.least * len(y))), {}, paths, step, everyone)
        logit += settings.rate * step / max(1e-3, float((p * (1 - p)).mean()))
    out: dict[Rule, None] = {}
    for path in paths:
        rule = []
        for f, (low, high) in sorted(path.items()):
            rule.append((f, float(cuts[f][low]) if low >= 0 else -np.inf, float(cuts[f][high]) if high < len(cuts[f]) else np.inf))
        out[tuple(rule)] = None
    return list(out)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=bool)
    for k, rule in enumerate(rules):
        for f, low, high in rule:
            out[:, k] &= (x[:, f] > low) & (x[:, f] <= high)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty on standardised columns, by FISTA."""
    mean, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-9)
    s = (z - mean) / scale
    n, k = s.shape
    rate = 4.0 * n / max(float(np.linalg.norm(s, 2) ** 2) + n, 1.0)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(s @ v + c, -40, 40))) - y
        u = v - rate * (s.T @ r) / n
        new = np.sign(u) * np.maximum(np.abs(u) - rate * penalty, 0)
        shifted = c - rate * float(r.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), shifted + (t - 1) / t2 * (shifted - b)
        w, b, t = new, shifted, t2
    return float(b - (w / scale) @ mean), w / scale


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        logit = self.intercept + holds(list(self.rules), x) @ np.array(self.weights) if self.rules else np.full(len(x), self.intercept)
        return 1 / (1 + np.exp(-logit))

    def column(self) -> Column:
        """The score as an expression over columns named like the statistics."""
        logit = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            bounds = [F.col(self.names[f]) > low for f, low, _ in rule if np.isfinite(low)] + [F.col(self.names[f]) <= high for f, _, high in rule if np.isfinite(high)]
            every = bounds[0]
            for more in bounds[1:]:
                every = every & more
            logit = logit + F.when(every, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def train(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], settings: Settings = Settings()) -> Model:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Model(names, (), (), float(np.log(share / (1 - share))))
    rules = rules_of(x, y, settings)
    z = holds(rules, x)
    support = z.mean(axis=0)
    rules = [r for r, s in zip(rules, support, strict=True) if settings.least <= s <= 1 - settings.least]
    b, w = lasso(holds(rules, x).astype(np.float64), y, settings.penalty, settings.steps)
    kept = [(r, float(a)) for r, a in zip(rules, w, strict=True) if abs(a) > 1e-6]
    return Model(names, tuple(r for r, _ in kept), tuple(a for _, a in kept), b)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings()) -> Model:
    examples = sampled(docs, labels, "quality", usable, settings.max_examples, settings.seed)
    rows = statistics(examples, ("doc_id", "label")).toPandas().sort_values("doc_id", kind="stable")
    return train(rows[list(STATISTICS)].to_numpy(np.float64), rows["label"].to_numpy(np.float64), STATISTICS, settings)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the statistics of each row."""
    stats = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return stats.select("doc_id", model.column().alias("score"), *STATISTICS)
