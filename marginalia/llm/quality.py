"""Operator 9. Quality classifier by co-training of a text and a metadata view."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, discard, written

#: Labelled rows that the models are fitted on, at most; rounds; pseudo-labels that a view hands over per round and class.
SAMPLE, ROUNDS, HANDED = 12_000, 4, 300
HASHED = 64
STOP = frozenset(("the of and to in is that a for de la le les que der die und el los en").split())  # function words of the four languages
UPPER, LOWER, DIGIT, SYMBOL, SPACE = range(5)


def _classes() -> np.ndarray:
    kinds = np.full(256, LOWER, np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = UPPER if c.isupper() else DIGIT if c.isdigit() else LOWER if c.isalpha() else SPACE if b in (32, 9, 10, 11, 12, 13) else SYMBOL
    return kinds


CLASSES = _classes()


def text_view(text: str | None) -> np.ndarray:
    """Shares and logarithms that describe the words and signs of the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(len(words), 1)
    kinds = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=5) / max(len(data), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = set(words)
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    ends = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    odd = float((CLASSES[ends] == SYMBOL).mean()) - float(np.isin(ends, (44, 46)).mean()) if len(ends) else 0.0
    pieces = [len(distinct) / n, repeats, pairs, float(lengths.mean()) / 10 if len(words) else 0.0, float(lengths.std()) / 10 if len(words) else 0.0, sum(w.lower() in STOP_BYTES for w in words) / n, odd, data.count(b"|") / n, data.count(b"!") / n, data.count(b".") / n, data.count(b",") / n, data.upper() == data and bool(data)]
    return np.array([1.0, *kinds, *map(float, pieces), np.log1p(len(words)) / 10], np.float64)


STOP_BYTES = frozenset(w.encode() for w in STOP)


def page_view(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What the page says of itself and how it is laid out: language, source, stated length, lines."""
    lines = [len(x) for x in re.split(r"\n", text or "")]
    stated = float(n_chars or 0)
    rest = [np.log1p(max(stated, 0)) / 10, np.log1p(len(lines)) / 10, np.log1p(max(lines)) / 10, np.log1p(sum(lines) / len(lines)) / 10, sum(x < 20 for x in lines) / len(lines), (text or "").count(" ") / max(stated, len(text or ""), 1), float(n_chars is None)]
    out = np.zeros(HASHED)
    for x in (f"lang={lang}", f"source={source}", f"both={lang},{source}"):
        out[xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % HASHED] += 1
    return np.concatenate([[1.0], rest, np.square(rest), out])


class Logistic:
    """Ridge logistic regression by Newton's method on scaled columns, then Platt scaling on rows kept aside."""

    def __init__(self, penalty: float) -> None:
        self.penalty, self.platt = penalty, (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.mean[0], self.scale[0] = 0, 1
        z = (x - self.mean) / self.scale
        self.w = _newton(z, y, weight, self.penalty)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        raw = self.raw(x)
        b, a = _newton(np.stack([np.ones(len(raw)), raw], 1), y, np.ones(len(raw)), 1e-2)
        self.platt = (max(float(a), 0.0), float(b))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w, -30, 30)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.platt[0] + self.platt[1]


def _newton(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class CoTrained:
    """Two calibrated views. The combined log odds are their sum less the prior's, as of views that are independent given the class."""

    text: Logistic | None
    page: Logistic | None
    prior: float
    handed: tuple[int, int] = (0, 0)

    @property
    def trained(self) -> bool:
        return self.text is not None and self.page is not None

    def score(self, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        """NaN without a model."""
        if self.text is None or self.page is None:
            return np.full(len(t), np.nan)
        prior = np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(self.text.logit(t) + self.page.logit(p) - prior, -30, 30)))


#: Log odds beyond which a view is sure of a row.
SURE = 3.9
#: From the models and the rows given to each view so far: for each view its new rows (id, label, text view, page view).
Surest = Callable[[dict[str, "Logistic"], dict[str, dict]], dict[str, list[tuple[object, float, np.ndarray, np.ndarray]]]]


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, surest: Surest, *, rounds: int = ROUNDS, penalty: float = 1.0) -> CoTrained:
    """Fits both views on the labelled rows; in each round a view labels those unlabelled rows not yet given that it is surest of, for
    the other view. Every fifth labelled row is kept aside for calibration."""
    prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    if len(set(y.tolist())) < 2:
        return CoTrained(None, None, prior)
    aside = np.arange(len(y)) % 5 == 0
    views = {"text": text, "page": page}
    given: dict[str, dict] = {"text": {}, "page": {}}
    models: dict[str, Logistic] = {}

    def fit(name: str) -> None:
        more = [*given[name].values()]
        x = np.concatenate([views[name][~aside], *[v[None] for _, v in more]])
        target = np.concatenate([y[~aside], np.array([label for label, _ in more], np.float64)])
        models[name] = Logistic(penalty).fit(x, target, np.concatenate([np.ones((~aside).sum()), np.full(len(more), 0.5)]))
        # so few labels that a part lacks a class are all used twice
        models[name].calibrate(*((views[name][aside], y[aside]) if len(set(y[aside].tolist())) == 2 else (views[name], y)))

    for name in views:
        fit(name)
    for _ in range(rounds):
        more = surest(models, given)
        for name, rows in more.items():
            given[name] |= {i: (label, t if name == "text" else p) for i, label, t, p in rows}
        if not any(more.values()):
            break
        for name in views:
            fit(name)
    return CoTrained(models["text"], models["page"], prior, (len(given["text"]), len(given["page"])))


def surest_of(pool: DataFrame, handed: int = HANDED) -> Surest:
    """Of all rows of the pool (doc_id, x), at most `handed` a class and view that the other view is surest of, those given to it before
    left out. A narrow pass keeps so many of each partition, the rest is decided on these."""
    other = {"text": "page", "page": "text"}
    n = len(text_view(""))
    kind = T.StructType([T.StructField("to", T.StringType()), T.StructField("label", T.DoubleType()), T.StructField("sure", T.DoubleType()), T.StructField("tie", T.StringType()), pool.schema["doc_id"], pool.schema["x"]])

    def surest(models: dict[str, Logistic], given: dict[str, dict]) -> dict[str, list[tuple[object, float, np.ndarray, np.ndarray]]]:
        shared = pool.sparkSession.sparkContext.broadcast((models, {k: set(v) for k, v in given.items()}))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, gone = shared.value
            top: dict[tuple[str, float], list[tuple]] = {(to, label): [] for to in other for label in (0.0, 1.0)}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column("doc_id").to_pylist(), batch.column("x").to_pylist()
                rows = np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1)
                for to, by in other.items():
                    logit = models[by].logit(rows[:, :n] if by == "text" else rows[:, n:])
                    for k in np.flatnonzero(np.abs(logit) > SURE).tolist():
                        if ids[k] not in gone[to]:
                            top[to, float(logit[k] > 0)].append((-abs(float(logit[k])), xxhash.xxh64_hexdigest(str(ids[k])), ids[k], x[k]))
                for key in top:
                    top[key] = sorted(top[key], key=lambda r: r[:2])[:handed]
            rows = [(to, label, *r) for (to, label), found in top.items() for r in found]
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], schema)

        found = written(pool.mapInArrow(best, kind), "quality-surest")
        tops = [found.where((F.col("to") == to) & (F.col("label") == label)).orderBy("sure", "tie").limit(handed) for to in other for label in (0.0, 1.0)]
        got = reduce(DataFrame.unionByName, tops).collect()  # at most 4 * handed rows of some hundred numbers
        discard(found)
        out: dict[str, list[tuple]] = {to: [] for to in other}
        for r in sorted(got, key=lambda r: (r["to"], r["label"], r["sure"], r["tie"])):
            v = np.frombuffer(bytes(r["x"]), np.float64)
            out[r["to"]].append((r["doc_id"], r["label"], v[:n], v[n:]))
        return out

    schema = to_arrow_schema(kind)
    return surest


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    t, p = [], []
    for text, lang, source, n in zip(*(batch.column(c) for c in ("text", "lang", "source", "n_chars")), strict=True):
        text = text.as_py()
        t.append(text_view(text))
        p.append(page_view(text, lang.as_py(), source.as_py(), n.as_py()))
    return np.array(t), np.array(p)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.concatenate(_views(batch), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS) -> CoTrained:
    """Fits the two views on at most `sample` labelled documents, chosen by a digest of their ids, and on what each view hands over of
    all unlabelled ones. The numbers of all documents are written once, so the rounds read no text."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label_col).cast("double")).alias("y"))
    rows = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.mapInArrow(_features, T.StructType([docs.schema["doc_id"], T.StructField("x", T.BinaryType())]))
    rows = written(rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id", "left"), "quality-views")
    got = rows.where("y is not null").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample).toArrow()  # at most sample rows of some hundred numbers
    order = np.argsort([xxhash.xxh64_hexdigest(str(i)) for i in got.column("doc_id").to_pylist()], kind="stable")
    n = len(text_view(""))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float64).reshape(len(order), -1 if len(order) else n)[order]
    y = np.array(got.column("y").to_pylist(), np.float64)[order]
    model = co_train(x[:, :n], x[:, n:], y, surest_of(rows.where("y is null").select("doc_id", "x")), rounds=rounds)
    discard(rows)
    return model


def score(docs: DataFrame, model: CoTrained, *, threshold: float = 0.5, with_text: bool = True) -> DataFrame:
    """Adds quality_score, keep and trained to every document, from its whole text and columns; a narrow pass without a shuffle.

    Null text, language, source or length count as empty, as a value of their own, or as missing; repeated rows score alike; an empty
    table gives no rows; without labels of both classes there is no model: trained is false, the score null, and everything is kept;
    columns of the three names are replaced."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("quality_score", "keep", "trained")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if with_text or f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(*_views(batch)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(s, pa.float64(), mask=np.isnan(s)), pa.array(np.isnan(s) | (s >= threshold)), pa.array(np.full(len(s), shared.value.trained))], [*names, "quality_score", "keep", "trained"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType()), T.StructField("trained", T.BooleanType())]))
