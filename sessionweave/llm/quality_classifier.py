"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each text are numeric columns. On a bounded sample of labelled rows, small regression trees are boosted over the
statistics' quantiles; every path from a root to a node is a conjunction of thresholds, that is, a rule. A logistic model with a
lasso penalty keeps a few of the rules, and the model is compiled into one Spark column expression that scores all rows.

The sample is at most `most_labelled` labelled rows (those whose hashed ids are least); everything else covers all rows.

Nulls and edge cases: a null or empty text has zero for each statistic and is scored like any other; labels that are null are not
learnt from; a document with several labels counts once for each; without labels of both kinds all scores equal the labels'
mean, 0.5 without any; repeated documents each give a row; an empty table gives no rows. The score reads the text alone; a column to
carry that is named like a result is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, slices, source_of

#: (statistic index, whether above, threshold), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]

NAMES = ("n_chars", "n_words", "word_length", "upper", "digits", "marks", "symbols", "bars", "shouts", "distinct", "short", "line_repeats", "stops", "longest_word", "stutter")
STATISTICS = tuple(f"stat_{n}" for n in NAMES)
_GROUPS = {
    "upper": range(65, 91), "digits": range(48, 58), "marks": b".,;:'\"()-", "symbols": b"#*$%&<>@^~", "bars": b"|", "shouts": b"!?", "stops": b".",
}


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    bytes_of = np.bincount(np.repeat(np.arange(n), sizes) * 256 + data, minlength=n * 256).reshape(n, 256)
    chars = sizes - bytes_of[:, 0x80:0xC0].sum(axis=1)
    share = lambda group: bytes_of[:, list(_GROUPS[group])].sum(axis=1) / np.maximum(chars, 1)
    out = {g: share(g) for g in ("upper", "digits", "marks", "symbols", "bars", "shouts")}
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    spaces = bytes_of[:, [0x20, *range(0x09, 0x0E)]].sum(axis=1)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    out |= {
        "n_chars": np.log1p(chars),
        "n_words": np.log1p(counts),
        "word_length": (chars - spaces) / np.maximum(counts, 1),
        "distinct": np.array([len(set(w)) for w in words]) / np.sqrt(np.maximum(counts, 1)),
        "short": np.array([sum(len(x) <= 3 for x in w) for w in words]) / np.maximum(counts, 1),
        "line_repeats": 1 - np.array([len(set(x)) for x in lines]) / np.maximum(n_lines, 1),
        "stops": bytes_of[:, 46] / np.maximum(counts, 1),
        "longest_word": np.log1p([max(map(len, w), default=0) for w in words]),
        "stutter": np.array([sum(a == b for a, b in zip(w, w[1:], strict=False)) for w in words]) / np.maximum(counts, 1),
    }
    out["line_repeats"][n_lines == 0] = 0
    return np.column_stack([out[n] for n in NAMES]).astype(np.float64)


def statistics(docs: DataFrame, text_col: str, keep_text: bool = True) -> DataFrame:
    """docs, with or without the text, and one double more for each of STATISTICS."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            found = statistics_of(as_bytes(part.column(text_col)))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *(pa.array(found[:, k].copy()) for k in range(len(STATISTICS)))], names=[*(f.name for f in kept), *STATISTICS])

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(s, T.DoubleType()) for s in STATISTICS)]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree's paths as rules, and its fitted values."""
    rules: list[Rule] = []
    fitted = np.zeros(len(target))

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        best = (1e-9, -1, -1)
        if len(path) < depth and len(rows) >= 2 * least:
            total, n = target[rows].sum(), len(rows)
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                count = np.cumsum(np.bincount(bins[rows, f], minlength=len(edges) + 1))[:-1]
                left = np.cumsum(np.bincount(bins[rows, f], target[rows], len(edges) + 1))[:-1]
                fair = (count >= least) & (n - count >= least)
                gain = np.where(fair, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), f, k))
        if best[1] < 0:
            fitted[rows] = target[rows].mean()
            return
        _, f, k = best
        above = bins[rows, f] > k
        grow(rows[~above], (*path, (f, False, float(cuts[f][k]))))
        grow(rows[above], (*path, (f, True, float(cuts[f][k]))))

    grow(np.arange(len(target)), ())
    return rules, fitted


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.all([x[:, f] > t if above else x[:, f] <= t for f, above, t in rule], axis=0)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, rounds: int = 400, seed: int = 7) -> RuleModel:
        if len(y) == 0 or y.min() == y.max():
            mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
            return cls((), (), float(np.log(mean / (1 - mean))))
        rng = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
        bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])  # bin k: at most cut k
        margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
        for _ in range(trees):
            rows = rng.permutation(len(y))[: max(200, len(y) // 2)]
            gradient = y - _sigmoid(margin)
            rules, _ = _tree(bins[rows], cuts, gradient[rows], depth, max(5, len(rows) // 200))
            leaves = [r for r in rules if not any(len(o) > len(r) and o[: len(r)] == r for o in rules)]
            for r in leaves:
                held = _holds(r, x)
                if held.any():
                    margin[held] += 0.5 * gradient[held].sum() / max(1e-3, (_sigmoid(margin[held]) * (1 - _sigmoid(margin[held]))).sum())
            found |= dict.fromkeys(rules)
        rules = list(found)
        if not rules:  # too few rows to split
            return cls((), (), float(np.log(y.mean() / (1 - y.mean()))))
        z = np.column_stack([_holds(r, x) for r in rules])  # a byte each, as the driver holds them all
        kept = np.unique(z, axis=1, return_index=True)[1]  # rules that hold for the same rows are one
        z, rules = z[:, kept], [rules[k] for k in kept]
        weights, b = cls._lasso(z, y, penalty, rounds)
        return cls(tuple(r for r, w in zip(rules, weights, strict=True) if w), tuple(float(w) for w in weights if w), float(b))

    @staticmethod
    def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradient steps; the intercept isn't penalised."""
        a = np.ones((len(y), z.shape[1] + 1))
        a[:, :-1] = z
        v = np.ones(a.shape[1])
        for _ in range(20):
            v = a.T @ (a @ v)
            v /= np.linalg.norm(v)
        step = 4 * len(y) / (v @ (a.T @ (a @ v)))
        w, ahead, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
        for _ in range(rounds):
            new = ahead - step / len(y) * (a.T @ (_sigmoid(a @ ahead) - y))
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        return w[:-1], w[-1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + sum((w * _holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x))))

    def column(self) -> Column:
        """The score as an expression over the columns STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for f, above, threshold in rule:
                met = met & ((F.col(STATISTICS[f]) > threshold) if above else (F.col(STATISTICS[f]) <= threshold))
            total = total + F.when(met, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", most_labelled: int = 20_000) -> RuleModel:
    """A model of the labels outside the held-out fold. Only the sample's texts are measured."""
    known = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null").where(~held_out("id"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    sample = statistics(texts, "text", False).orderBy("id", "label", *STATISTICS).limit(most_labelled).toPandas()
    return RuleModel.fit(sample[list(STATISTICS)].to_numpy(np.float64), (sample["label"].to_numpy() > 0).astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.3, most_labelled: int = 20_000, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, held_out, score, predicted, and the columns to carry along, which may be the text."""
    model = fit_quality(docs, labels, id_col, text_col, label_id_col, label_col, most_labelled)
    source, name, carried = source_of(docs, id_col, text_col, carry, ("held_out", "score", "predicted"))
    scored = statistics(source, "t", text_col in carry).withColumn("score", model.column())
    return scored.select(*name, F.coalesce(held_out("i"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carried)
