"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of all its subwords: the 1- to 4-letter grams of each word with its ends marked, hashed into
``BUCKETS`` rows. Embeddings and softmax are trained together by stochastic gradient descent in numpy on the driver, on a bounded sample: at
most ``per_language`` labelled rows a language, those with the smallest hash of their id. What the driver gets of them are counts of
buckets. A fifth of the sample trains nothing and calibrates: a temperature that makes the softmax's top value a probability, and
the rejection threshold, below which no more than one in ``keep`` of the rows predicted rightly there falls (and never above one half).

Prediction covers whole texts. Since the average is linear, each distinct word contributes a fixed vector of class sums, computed once per
task in a bounded cache.

Defined results: null text or text without a letter: ``und``, score 0, rejected. Without any labelled row all are ``und``. Empty table: empty
result. Repeated rows each get their row. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import common

UNKNOWN = "und"
LOG_BUCKETS, GRAMS = 14, 4
BUCKETS = 1 << LOG_BUCKETS
WORDS = re.compile(r"[^\W\d_]+")
OUT = "lang_pred string, score double, rejected boolean"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of all grams of all words, and which word each is of."""
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, owners = [], []
    h = np.zeros(len(points), dtype=np.uint64)
    for k in range(min(GRAMS, len(points))):
        h = h[: len(points) - k] * np.uint64(0x100000001B3) + points[k:] + np.uint64(1)
        inside = owner[: len(h)] == owner[k:]
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((x >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64)[inside])
        owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and how often each occurs."""
    found = Counter(WORDS.findall((text or "").lower()))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 2
    buckets, owner = subwords(list(found))
    total = np.bincount(buckets, weights=np.array(list(found.values()))[owner], minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.int64)


def packed(buckets: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Buckets in two bytes each, counts in one if all are below 256, else in four."""
    return buckets.astype("<u2").tobytes(), counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(buckets, "<u2"), np.frombuffer(counts, "u1" if 2 * len(counts) == len(buckets) else "<u4")


class Model:
    """Class sums per bucket (embeddings times weights), biases, temperature, threshold and class names."""

    def __init__(self, names: list[str], sums: np.ndarray, bias: np.ndarray, scale: float = 1.0, threshold: float = 0.0):
        self.names, self.sums, self.bias, self.scale, self.threshold = names, sums, bias, scale, threshold

    def scores(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) * self.scale
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], dim: int = 16, epochs: int = 6, rate: float = 0.5, keep: int = 1000, seed: int = 1) -> Model:
    """rows: buckets, counts, label."""
    names = sorted({r[2] for r in rows})
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    label = {name: k for k, name in enumerate(names)}
    data = [(at, n, label[y]) for at, n, y in rows if len(at)]  # as narrow as they came: shares are worked out where they are used
    order = rng.permutation(len(data))
    held, used = order[: len(data) // 5], order[len(data) // 5 :]
    embed = rng.uniform(-1, 1, (BUCKETS, dim)) / dim
    weights, bias = np.zeros((dim, len(names))), np.zeros(len(names))
    steps, done = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            at, n, y = data[i]
            share = n / n.sum()
            mean = share @ embed[at]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            now = rate * (1 - done / steps)
            back = weights @ p
            weights -= now * np.outer(mean, p)
            bias -= now * 0.1 * p
            embed[at] -= (now * len(at) ** 0.5) * share[:, None] * back
            done += 1
    model = Model(names, embed @ weights, bias)
    if len(held):
        means = np.stack([data[i][1] / data[i][1].sum() @ model.sums[data[i][0]] for i in held])
        truth = np.array([data[i][2] for i in held])

        def loss(scale: float) -> float:
            model.scale = scale
            return -np.log(np.maximum(model.scores(means)[np.arange(len(truth)), truth], 1e-12)).mean()

        model.scale = min(np.geomspace(0.05, 50, 60), key=loss)
        p = model.scores(means)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        if len(right):
            model.threshold = float(min(0.5, right[len(right) // keep]))
    return model


def held_out(ident: Column) -> Column:
    """A third of the rows by their id: those that a model is measured on and not trained on."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500) -> Model:
    """Learns from labelled rows that are not held out, at most per_language of each language."""
    first = Window.partitionBy("_y").orderBy(F.pmod("_k", F.lit(1 << 31)), "_k")
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    labelled = labelled.select(F.col(text_col).alias("_t"), F.col(lang_col).alias("_y"), F.xxhash64(F.col(id_col).cast("string")).alias("_k"))
    sizes = labelled.groupBy("_y").agg(F.count("*").alias("_n"))  # one row a language
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 200) / F.col("_n"))
    near = labelled.join(F.broadcast(sizes), "_y").where(F.pmod("_k", F.lit(1 << 31)) < share * float(1 << 31))  # about twice as many as are wanted
    sample = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_language).select("_t", "_y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [packed(*counted(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([n for _, n in pairs], pa.binary()), batch.column(1)], ["at", "n", "y"])

    got = sample.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(common.tidy(count), "at binary, n binary, y string").toArrow()
    rows = sorted(zip(*(got.column(k).to_pylist() for k in (2, 0, 1)), strict=True))  # an order of the rows' own: they come in any
    del got
    model = train([(*unpacked(a, n), y) for y, a, n in rows])
    del rows
    common.trim()  # the driver goes on without what the sample took
    return model


class Predictor:
    """Texts -> (language, score, rejected), with a bounded cache of words."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most = model, most
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.names) + 1))

    def _learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if self.place and len(self.place) + len(new) > self.most:
            self.place.clear()
            new = list(dict.fromkeys(words))
        while len(self.place) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        buckets, owner = subwords(new)
        rows = np.arange(len(self.place), len(self.place) + len(new))
        for k in range(len(self.model.names)):
            self.table[rows, k] = np.bincount(owner, weights=self.model.sums[buckets, k], minlength=len(new))
        self.table[rows, -1] = np.bincount(owner, minlength=len(new))
        self.place.update(zip(new, rows.tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each text."""
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        for lo in range(0, len(texts) if self.model.names else 0, 256):  # a part at a time is Python objects
            words = {k: WORDS.findall(t.lower()) for k, t in enumerate(texts[lo : lo + 256], lo) if t}
            part = [k for k, own in words.items() if any(c.isalpha() for w in own for c in w)]
            if not part:
                continue
            flat = [w for k in part for w in words[k]]
            try:
                at = list(map(self.place.__getitem__, flat))
            except KeyError:
                self._learn(flat)
                at = list(map(self.place.__getitem__, flat))
            starts = np.cumsum([0, *(len(words[k]) for k in part[:-1])])
            total = self._sums(np.array(at), starts)
            p = self.model.scores(total[:, :-1] / total[:, -1:])
            best = p.argmax(axis=1)
            for k, b in zip(part, best.tolist(), strict=True):
                names[k] = self.model.names[b]
            scores[part] = p.max(axis=1)
            rejected[part] = scores[part] < self.model.threshold
        return names, scores, rejected

    def _sums(self, at: np.ndarray, starts: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Sums of the table's rows, from each start to the next; a long stretch is summed in parts."""
        if len(at) <= most:
            return np.add.reduceat(self.table[at], starts, axis=0)
        ends = [*starts[1:].tolist(), len(at)]
        return np.stack([sum(self.table[at[k : min(k + most, e)]].sum(axis=0) for k in range(s, e, most)) for s, e in zip(starts.tolist(), ends, strict=True)])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected beside their own columns. Columns of these three names are replaced; any other name is kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(OUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one, texts = Predictor(held.value), None
        for texts in batches:
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "rejected"), one(texts.tolist()), strict=True)))
        del one, texts
        common.trim()

    own, names = common.numbered(docs.drop("lang_pred", "score", "rejected"))
    text = F.col(own.columns[names.index(text_col)])
    return own.withColumn("p", run(text)).select(*own.columns, "p.*").toDF(*names, "lang_pred", "score", "rejected")
