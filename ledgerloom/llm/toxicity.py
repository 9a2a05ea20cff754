"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and the beginnings of its words, four
to eight letters long (so that inflected and derived forms count), each also
for being that of two different words. Which words and beginnings it may use is decided by a chi-square over the labelled rows; the words that name
groups of people are always among them. Each labelled sentence with such a word
is paired with copies in which it is swapped for another, and some sentences
without one with a copy that mentions a group in passing; the squared change of the
model's logit within a pair is penalised, so a mention of a group by itself does
not move the score.

Fitting uses at most ``max_rows`` labelled rows, taken by the hash of their id; all
texts are scored, whole, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that name groups of people, in the languages of the corpus.
IDENTITY = tuple(
    """african american arab asian atheist atheists bisexual black blacks blind buddhist catholic catholics chinese
    christian christians deaf disabled elderly european female females gay gays hindu hindus homosexual homosexuals
    immigrant immigrants indian islam jew jewish jews latina latino lesbian lesbians lgbt male males man men mexican
    migrant migrants muslim muslims native old protestant queer refugee refugees trans transgender white whites woman
    women young femme femmes homme hommes juif juifs musulman musulmans chrétien chrétiens immigré immigrés noir noirs
    étranger étrangers frau frauen mann männer jude juden muslime christen ausländer flüchtling flüchtlinge schwarze
    mujer mujeres hombre hombres judío judíos musulmán musulmanes cristiano cristianos inmigrante inmigrantes negro
    negros extranjero extranjeros""".split()
)

STRIPPED = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"
STARTS = range(4, 9)  # letters of a beginning


@dataclass(frozen=True)
class Model:
    """Weights by feature (see ``features``), and the bias."""

    weights: dict[str, float]
    bias: float


def tokens(text: str | None) -> set[str]:
    """Distinct words of a text: lowered, without signs at either end."""
    found = {w.strip(STRIPPED) for w in set((text or "").lower().split())}
    found.discard("")
    return found


def features(found: set[str]) -> set[str]:
    """``word``, ``start*`` and, where two words begin so, ``start**``."""
    starts = Counter(w[:n] for w in found for n in STARTS if len(w) > n)
    return found | {f"{s}*" for s in starts} | {f"{s}**" for s, n in starts.items() if n > 1}


def held_out(id_col: str, folds: int = 5) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(text, label) of at most about ``max_rows`` labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id")
    )
    count = known.count()
    if count > max_rows:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / count))
    # at most about max_rows rows of 12 bytes
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id").select(
        "text", F.col("_label").alias("label")
    )


def _vocabulary(rows: DataFrame, size: int, min_rows: int, min_chi: float) -> list[str]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = features(tokens(text))
                every.update(own)
                if label:
                    toxic.update(own)
            names = list(every)
            yield pa.RecordBatch.from_pydict({
                "name": pa.array(names, pa.string()), "n": pa.array([every[x] for x in names], pa.int64()),
                "t": pa.array([toxic[x] for x in names], pa.int64()),
            })

    whole = rows.agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("t")).first()
    if not whole["n"] or not whole["t"] or whole["t"] == whole["n"]:
        return []
    sums = rows.mapInArrow(count, "name string, n long, t long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    expected = F.col("n") * (whole["t"] / whole["n"])
    rate = whole["t"] / whole["n"]
    chi = F.pow(F.col("t") - expected, 2) / (F.col("n") * (rate * (1 - rate)) * (1 - F.col("n") / (whole["n"] + 1)))
    best = sums.filter(F.col("n") >= min_rows).withColumn("chi", chi).filter(F.col("chi") >= min_chi)
    best = best.orderBy(F.col("chi").desc(), "name").limit(size)
    return [r["name"] for r in best.select("name").collect()]


def _examples(rows: DataFrame, place: dict[str, int]) -> list[tuple[list[int], int]]:
    """(features present, label) of the labelled rows, in an order that does not depend on the tasks."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(place[f] for f in features(tokens(t)) if f in place) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], names=["own", "label"])

    got = rows.mapInArrow(pick, "own array<int>, label int").collect()  # max_rows short lists
    return sorted((list(r["own"]), r["label"]) for r in got)


def counterfactuals(examples: list[list[int]], place: dict[str, int], swaps: int, seed: int) -> tuple[list[list[int]], list[list[int]]]:
    """Feature lists before and after an identity word is swapped, or mentioned in passing."""
    rng = np.random.default_rng(seed)
    groups = [sorted(place[f] for f in features({w})) for w in IDENTITY]
    words = {place[w]: i for i, w in enumerate(IDENTITY)}
    before, after = [], []
    for own in examples:
        named = [words[f] for f in own if f in words]
        gone = {f for i in named for f in groups[i]}
        for other in rng.integers(0, len(groups), swaps if named else 1):
            before.append(own)
            after.append(sorted((set(own) - gone) | set(groups[other])))
    return before, after


class _Sparse:
    """Rows of present features, for sums of weights and their gradients."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.at = np.array([f for r in rows for f in r], dtype=np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=self.width)


def fit(
    examples: list[tuple[list[int], int]], place: dict[str, int], fairness: float = 10.0, ridge: float = 1e-4,
    steps: int = 600, rate: float = 0.1, swaps: int = 2, seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam: log loss + ridge + ``fairness`` * mean squared logit change."""
    width = len(place)
    x = _Sparse([f for f, _ in examples], width)
    y = np.array([label for _, label in examples], dtype=np.float64)
    one, two = (_Sparse(rows, width) for rows in counterfactuals([f for f, _ in examples], place, swaps, seed))
    theta = np.zeros(width + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w = theta[:-1]
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + theta[-1], -40, 40)))
        change = two.dot(w) - one.dot(w)
        pull = 2 * fairness * change / max(1, one.n)
        grad = np.append(x.back((p - y) / x.n) + ridge * w + two.back(pull) - one.back(pull), (p - y).mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 20_000, vocabulary: int = 2_000, min_rows: int = 3, min_chi: float = 12.0,
) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold.

    With no labelled row, or labels of one kind only, the model has no weights and
    scores every text with the share of label 1 (0 without labels).
    """
    rows = labelled(docs, labels, id_col, text_col, label_col, max_rows)
    chosen = _vocabulary(rows, vocabulary, min_rows, min_chi)
    if not chosen:
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    for w in IDENTITY:
        chosen += [f for f in sorted(features({w})) if f not in chosen]
    place = {f: i for i, f in enumerate(chosen)}
    weights, bias = fit(_examples(rows, place), place)
    return Model({f: float(weights[i]) for f, i in place.items()}, bias)


def scorer(model: Model) -> Callable[[str | None], float]:
    """The model as a function of a text. Beginnings without a weight are never counted."""
    weights = model.weights
    known = {f.rstrip("*") for f in weights if f.endswith("*")}
    by_four: dict[str, list[str]] = {}
    for start in known:
        by_four.setdefault(start[: STARTS[0]], []).append(start)

    def score(text: str | None) -> float:
        found = tokens(text)
        total = model.bias + sum(weights[w] for w in sorted(found & weights.keys()))
        starts: Counter = Counter()
        for w in found:
            for start in by_four.get(w[: STARTS[0]], ()):
                if len(w) > len(start) and w.startswith(start):
                    starts[start] += 1
        for start in sorted(starts):
            total += weights.get(f"{start}*", 0.0)
            if starts[start] > 1:
                total += weights.get(f"{start}**", 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    return score


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and ``name``: the score of every whole text; a null text scores like an empty one."""
    columns = [c for c in docs.columns if c != name]
    docs = docs.select(*columns)
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            scores = [score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {name} double")


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options
) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` in 0..1 and ``predicted`` (1 from 0.5 on).

    Labels count only for rows whose crc32 of the id as text is not divisible by 5.
    Only the text is scored. A null id is never held out nor learnt from; null
    labels are not learnt from; repeated rows score alike. Other columns are
    ignored. An empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, **options)
    slim = docs.select(F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    scored = with_score(slim, model)
    return scored.select(
        F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
