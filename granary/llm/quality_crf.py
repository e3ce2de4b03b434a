"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is a few binned features of the line
and of its neighbours; the chain couples labels of adjacent lines. A document's
quality is the mean of its lines' forward-backward marginals, weighted by their length,
passed through a logistic curve. A labelled document labels its lines; SAMPLE
labelled documents at most (those with the smallest hash of the id) fit the
weights on the driver, from binned features alone. Scoring is one pass where the rows lie.

Null texts count as empty, a single empty line, and are scored too, as are rows with a null
id, which have no label. Repeated rows are scored each, equal texts alike. A text of n lines is scored
whole, in log2(n) steps over all its lines. Null labels and labels of absent documents teach nothing; of
repeated labels the larger counts. Without both labels every score is the share of label 1 (0.5 without
any). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from granary.llm.carried import bundled

#: Labelled documents that fit the weights, at most.
SAMPLE = 3000
#: Lines of a document that takes part in the fit, at most; so the driver gets 3,000,000 lines of 17 bytes at most.
LINES = 1000
STEPS, RATE, RIDGE = 60, 0.25, 1e-3
OTHER, LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL = range(7)
EDGES = {
    "length": np.array([1, 8, 20, 40, 80, 160, 320, 640, 1280, 5000]),
    "upper": np.array([0.01, 0.05, 0.15, 0.4, 0.8]),
    "digit": np.array([0.002, 0.02, 0.05, 0.15, 0.4]),
    "stop": np.array([0.002, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2]),
    "symbol": np.array([0.0005, 0.002, 0.006, 0.015, 0.04, 0.1, 0.25]),
    "word": np.array([1.5, 3, 4, 5, 6, 7, 9, 13]),
    "repeat": np.array([0.15, 0.3, 0.45, 0.6, 0.75, 0.9]),
    "end": np.array([0.5, 1.5]),
    "again": np.array([0.5]),
}
#: Bins of each feature; the last stands for a missing neighbour.
WIDTH = 1 + max(len(x) for x in EDGES.values()) + 1
N = len(EDGES)


def classes() -> np.ndarray:
    """The class of each character of the basic plane, and of all others at the end."""
    kinds = {"Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Mn": LOWER, "Mc": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT}
    out = np.full(0x10001, SYMBOL, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        out[c] = kinds.get(kind, SPACE if kind[0] == "Z" or c in (9, 10, 11, 12, 13) else STOP if chr(c) in ".,;:!?'\"-()" else SYMBOL)
    return out


_classes: list[np.ndarray] = []


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of each line (lines by features), length weight of each line, and number of lines of each text."""
    if not _classes:
        _classes.append(classes())
    lines = [t.split("\n") for t in texts]
    flat = [x for some in lines for x in some]
    n_lines = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer(("\n".join(flat) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes[0][np.minimum(points, 0x10000)]
    length = np.array([len(x) for x in flat], np.int64)
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    share = {c: np.add.reduceat((kind == c).astype(np.int32), starts) for c in (LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL)}
    size, letters = np.maximum(length, 1), share[LOWER] + share[UPPER]
    repeat, again, at = np.empty(len(flat)), np.zeros(len(flat)), 0
    for some in lines:
        seen: set[str] = set()
        for x in some:
            words = x.split()
            repeat[at] = len(set(words)) / len(words) if words else 1
            if x in seen and words:
                again[at] = 1
            seen.add(x)
            at += 1
    last = kind[np.maximum(starts + length - 1, 0)]
    words = share[SPACE]  # a line's spaces and its end
    values = {
        "length": length, "upper": share[UPPER] / np.maximum(letters, 1), "digit": share[DIGIT] / size, "stop": share[STOP] / size, "symbol": share[SYMBOL] / size,
        "word": (length - words + 1) / words, "repeat": repeat, "end": np.where(length == 0, 0, np.where(last == STOP, 1, 2)), "again": again,
    }
    bins = np.stack([np.digitize(values[k], e) for k, e in EDGES.items()], axis=1).astype(np.uint8)
    return bins, (length + 1).astype(np.float64), n_lines


def rows_of(bins: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Indexes into the weights: of the line, of the line before and of the line after (or of a missing one)."""
    code = (np.arange(N) * WIDTH + bins).astype(np.int16)
    missing = np.arange(N, dtype=np.int16) * WIDTH + WIDTH - 1
    before, after = np.roll(code, 1, axis=0), np.roll(code, -1, axis=0)
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    before[first] = missing
    after[first + n_lines - 1] = missing
    return np.concatenate([code, before + np.int16(N * WIDTH), after + np.int16(2 * N * WIDTH)], axis=1)


def log_odds(weights: np.ndarray, bins: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """The sum of the weights that rows_of names, for each line, without a table of them."""
    own, before, after = (np.zeros(len(bins)) for _ in range(3))
    w = weights.reshape(3, N, WIDTH)
    for k in range(N):
        own += w[0, k][bins[:, k]]
        before += w[1, k][bins[:, k]]
        after += w[2, k][bins[:, k]]
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    before, after = np.roll(before, 1), np.roll(after, -1)
    before[first], after[first + n_lines - 1] = w[1, :, -1].sum(), w[2, :, -1].sum()
    return own + before + after


def products(m: np.ndarray, longest: int) -> np.ndarray:
    """For each place the product of the 2 x 2 matrices up to it, of `longest` of them at least, each scaled to a largest entry of 1.

    By doubling, so a text of n lines takes log2(n) steps. A matrix with equal rows cuts off what lies before it, but for a scale.
    m: the four entries (rows by columns) by places.
    """
    step = 1
    while step < longest:
        a, b = m[:, :, :-step], m[:, :, step:]
        new = a[:, :1] * b[None, 0] + a[:, 1:] * b[None, 1]
        m = np.concatenate([m[:, :, :step], new / new.max(axis=(0, 1))], axis=2)
        step *= 2
    return m


def marginals(u: np.ndarray, n_lines: np.ndarray, link: np.ndarray, pairs: bool = False):
    """P(good) of each line, and the expected counts of adjacent label pairs, by forward-backward over all texts at once.

    u: log odds of good for each line; link: 2 x 2 scores of adjacent labels.
    """
    if not len(u):
        return np.empty(0), (np.empty(0, np.int64), np.empty((0, 2, 2)))
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    last, longest = first + n_lines - 1, int(n_lines.max())
    node = np.exp(np.stack([np.minimum(-u, 0), np.minimum(u, 0)]))
    edge = np.exp(link - link.max())
    into = edge[:, :, None] * node[None]  # from the label of the line before
    into[:, :, first] = node[:, first]
    a = products(into, longest).sum(axis=0)
    a /= a.max(axis=0)
    onto = np.ones_like(into)  # to the label of the line after, transposed and from the end
    onto[:, :, :-1] = edge.T[:, :, None] * node[:, None, 1:]
    onto[:, :, last] = 1.0
    b = products(np.ascontiguousarray(onto[:, :, ::-1]), longest).sum(axis=0)[:, ::-1]
    b = b / b.max(axis=0)
    s = a * b
    p = s[1] / np.maximum(s.sum(axis=0), 1e-300)
    if not pairs:
        return p, None
    inner = np.ones(len(u), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    joint = a[:, i].T[:, :, None] * edge[None] * (node[:, i + 1] * b[:, i + 1]).T[:, None, :]
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    return p, (i, joint)


def quality(p: np.ndarray, weight: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text, as log odds."""
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]]).astype(int)
    mean = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


class Model:
    """Weights of the field and the logistic curve over its result."""

    def __init__(self, weights: np.ndarray, link: np.ndarray, slope: float, shift: float):
        self.weights, self.link, self.slope, self.shift = weights, link, slope, shift

    def score(self, texts: list[str]) -> np.ndarray:
        bins, weight, n_lines = features(texts)
        p, _ = marginals(log_odds(self.weights, bins, n_lines), n_lines, self.link)
        return 1 / (1 + np.exp(-(self.slope * quality(p, weight, n_lines) + self.shift)))

    @classmethod
    def constant(cls, share: float) -> Model:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros(3 * N * WIDTH), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))

    @classmethod
    def train(cls, bins: np.ndarray, weight: np.ndarray, n_lines: np.ndarray, label: np.ndarray) -> Model:
        """Gradient ascent (Adam) on the penalised likelihood of the lines' labels, each text counting the same."""
        if not len(label) or label.min() == label.max():
            return cls.constant(float(label.mean()) if len(label) else 0.5)
        at, y = rows_of(bins, n_lines), np.repeat(label, n_lines).astype(float)
        each = np.repeat(1 / np.sqrt(n_lines), n_lines)
        each /= each.sum()
        theta = np.zeros(3 * N * WIDTH + 4)
        m = v = np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            link = theta[-4:].reshape(2, 2)
            p, (i, joint) = marginals(log_odds(theta[:-4], bins, n_lines), n_lines, link, pairs=True)
            g = np.bincount(at.ravel(), np.repeat(each * (y - p), at.shape[1]), 3 * N * WIDTH)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), each[i])
            g = np.concatenate([g, (seen - (joint * each[i, None, None]).sum(axis=0)).ravel()]) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, link = theta[:-4], theta[-4:].reshape(2, 2)
        x = quality(marginals(log_odds(weights, bins, n_lines), n_lines, link)[0], weight, n_lines)
        slope, shift = 1.0, 0.0
        for _ in range(30):  # Newton steps of a logistic curve with a weak prior
            q = 1 / (1 + np.exp(-(slope * x + shift)))
            w = q * (1 - q) + 1e-9
            g = np.array([(x * (label - q)).sum() - slope + 1, (label - q).sum()])
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            d = np.linalg.solve(h, g)
            slope, shift = slope + float(np.clip(d[0], -1, 1)), shift + float(np.clip(d[1], -1, 1))
        return cls(weights, link, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` of the labelled rows given; those of more than LINES lines are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)  # so it may be broadcast

    def work(batches):
        for batch in batches:
            for text, y in zip(pc.fill_null(batch.column(0), "").to_pylist(), batch.column(1).to_pylist(), strict=True):
                bins, weight, _ = features([text])
                yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary()), pa.array([y], pa.int32())], ["bins", "weight", "y"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y")
    # an id that repeats gives more rows than its one label; of them all, `sample` at most are taken, by a hash of the text
    few = texts.filter(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < LINES).orderBy(F.xxhash64("text", "y"), "text", "y").limit(sample)
    got = few.mapInArrow(work, "bins binary, weight binary, y int").collect()
    got = sorted((bytes(r[0]), bytes(r[1]), r[2]) for r in got)  # the fit doesn't depend on the order of rows
    parts = [np.frombuffer(b, np.uint8).reshape(-1, N) for b, _, _ in got]
    if not parts:
        return Model.constant(0.5)
    return Model.train(np.concatenate(parts), np.concatenate([np.frombuffer(w) for _, w, _ in got]), np.array([len(b) for b in parts]), np.array([y for _, _, y in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id and score, the probability of label 1, for every row and whole text; with carry, row and text (see carried) and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.link, model.slope, model.shift))

    def work(batches):
        own = Model(*shared.value)
        for batch in batches:
            texts, out, a, size = pc.fill_null(batch.column("text"), "").to_pylist(), [], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size > 1 << 20 or k == len(texts) - 1:
                    out.append(own.score(texts[a : k + 1]))
                    a, size = k + 1, 0
            found = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
            names = ["row", "text"] if carry else [id_col]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], [*names, "score"])

    rows = bundled(docs, text_col) if carry else docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    fields = [f for f in rows.schema.fields if carry or f.name != "text"]
    return rows.mapInArrow(work, StructType([*fields, StructField("score", DoubleType())]))
