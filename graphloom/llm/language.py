"""Operator 3, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 code points of the lower-case text) in DIM slots. Document frequencies are counted over
all training documents. A text's vector is its relative n-gram counts times inverse document frequencies. The weights are
trained by follow-the-regularised-leader with elastic-net penalties on a sample of labelled documents bounded by `sample`
rows per language; a part of the sample that training does not see sets the temperature of the softmax. Scoring reads
whole texts and needs a table look-up per n-gram.

All languages are learned, however many. Up to FAN of them are the classes of one model. More are split, in alphabetical
order, into FAN parts and these again: each part with a model of its own over its parts or languages, trained in a task of
its own on at most NODE_ROWS rows, and a text goes down the likeliest branch, its score being the product on the way.

Defined cases: null texts and texts without a letter are `und` with score 0; if nothing could be learned, every text is;
documents without a label teach nothing; rows are predicted one by one,
so repeated rows get equal results; an empty table gives an empty result; ties go to the alphabetically first language;
other columns are carried, but those named lang_pred or score give way to the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import mixed
from .common import cut

BITS = 14
DIM = 1 << BITS
ORDERS = (1, 2, 3)
SAMPLE = 600  # documents of each language that training takes at most
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-5
FAN = 32  # classes of a model
BROADCAST = 100_000  # languages and their models that go to every task; more are joined by shuffle
NODE_ROWS = 9600  # rows a model is trained on, at most


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of the texts one after another, and the bounds of each text's."""
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lens = np.array([len(r) for r in raw], np.int64)
    whole = np.concatenate(raw).astype(np.uint64) if raw else np.zeros(0, np.uint64)
    ends = np.cumsum(lens)
    parts = []
    gram = np.zeros(len(whole), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(whole) - n + 1
        if m <= 0:
            break
        gram = (gram[:m] << np.uint64(21)) | whole[n - 1 :]  # a code point has 21 bits
        parts.append((n, (mixed(gram ^ mixed(np.uint64([n]))) >> np.uint64(64 - BITS)).astype(np.int64)))
    slots, bounds = [], [0]
    for a, b in zip(ends - lens, ends, strict=True):
        own = [p[a : b - n + 1] for n, p in parts if n in ORDERS and b - n + 1 > a]
        slots += own
        bounds.append(bounds[-1] + sum(map(len, own)))
    return (np.concatenate(slots) if slots else np.zeros(0, np.int64)), np.array(bounds)


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (slot, n): in how many of the task's documents a slot occurs; slot -1 counts the documents."""
    n, total = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            slots, _ = features([text])
            seen = np.zeros(DIM, bool)
            seen[slots] = True
            n += seen
            total += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(n[at], total), pa.int64())], names=["slot", "n"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(idf: np.ndarray, sizes: dict[str, int]):
    """An applyInArrow function: a model's sample (text, lang, o, node, class) to weights (slot, w: one per class) and, at
    slot -1, the temperature. sizes: the classes of each model."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("o", "ascending"), ("lang", "ascending"), ("text", "ascending")])
        node, texts, y = table["node"][0].as_py(), table["text"].to_pylist(), table["class"].to_numpy()
        classes = sizes[node]
        vectors = []
        for t in texts:
            slots, count = np.unique(features([t])[0], return_counts=True)
            vectors.append((slots, count / max(count.sum(), 1) * idf[slots]))
        held = np.arange(len(y)) % 5 == 4
        z, g2, w = (np.zeros((DIM, classes)) for _ in range(3))
        for _ in range(EPOCHS):
            for i in np.flatnonzero(~held):
                slots, x = vectors[i]
                own = np.where(np.abs(z[slots]) > L1, -(z[slots] - np.sign(z[slots]) * L1) / ((BETA + np.sqrt(g2[slots])) / ALPHA + L2), 0.0)
                p = softmax(x @ own)
                p[y[i]] -= 1
                g = x[:, None] * p
                s = (np.sqrt(g2[slots] + g * g) - np.sqrt(g2[slots])) / ALPHA
                z[slots] += g - s * own
                g2[slots] += g * g
        w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2), 0.0)
        check = np.flatnonzero(held) if held.any() else np.arange(len(y))
        logits = np.array([vectors[i][1] @ w[vectors[i][0]] for i in check])
        grid = np.exp(np.linspace(math.log(0.02), math.log(20), 120))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in grid]
        at = np.flatnonzero(np.any(w != 0, axis=1))
        rows = [*w[at].tolist(), [float(grid[int(np.argmin(loss))])] * classes]
        return pa.table({"node": [node] * len(rows), "slot": pa.array(np.append(at, -1), pa.int64()), "w": pa.array(rows, pa.list_(pa.float64()))})

    return fit


def branches(labels: list[str], fan: int, node: str = "") -> dict[str, list[list[str]]]:
    """The models by name, each with its classes: the languages of each. A class of several has a model named after it."""
    size = 1
    while size * fan < len(labels):
        size *= fan
    classes = [labels[i : i + size] for i in range(0, len(labels), size)]
    out = {node: classes}
    for k, part in enumerate(classes):
        if len(part) > 1:
            out |= branches(part, fan, f"{node}/{k}")
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, max_labels: int | None = None, fan: int = FAN) -> dict:
    """The model: labels, table (DIM x labels: idf times weight), temperature and below (the models of classes that are several
    languages). The driver gets DIM counts and DIM rows of weights for each model; one task trains a model on `sample` rows per
    class and NODE_ROWS in all at most, the first by a hash of their ids. max_labels: learn only that many languages, those of
    most documents (ties in alphabetical order), where the caller wants that."""
    known = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    total = next((r.n for r in counts if r.slot < 0), 0)
    idf = np.full(DIM, math.log(1 + total))
    for r in counts:
        if r.slot >= 0:
            idf[r.slot] = math.log((1 + total) / (1 + r.n))
    names = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    labels = sorted(r.lang for r in (names.limit(max_labels) if max_labels else names).collect())  # languages, not rows
    if not labels:
        return {"labels": [], "table": np.zeros((DIM, 1), np.float32), "temperature": 1.0, "below": {}}
    nodes = branches(labels, fan)
    sizes = {node: len(classes) for node, classes in nodes.items()}
    table = [(x, node, k, min(sample, max(5, NODE_ROWS // len(classes)))) for node, classes in nodes.items() for k, part in enumerate(classes) for x in part]
    spots = docs.sparkSession.createDataFrame(table, "lang string, node string, class int, most int")
    order = F.xxhash64("i", F.lit(7))
    held = F.broadcast if len(table) <= BROADCAST else lambda df: df  # a row for each language and model, counted here
    ids = known.select("i", "lang", order.alias("o")).distinct().join(held(spots), "lang").select("node", "class", "most", "o", "i").distinct()
    first = ids.withColumn("k", F.row_number().over(Window.partitionBy("node", "class").orderBy("o", "i"))).filter(F.col("k") <= F.col("most"))
    bars = cut(first.groupBy("node", "class", "most").agg(F.max("o").alias("bar")))
    reached = known.withColumn("o", order).join(held(spots.drop("most").join(bars, ["node", "class"])), "lang").filter(F.col("o") <= F.col("bar"))
    rows_first = Window.partitionBy("node", "class").orderBy("o", F.md5("text"))  # an id may have many rows: only the first ones of a task leave it
    chosen = reached.withColumn("k", F.row_number().over(rows_first)).filter(F.col("k") <= F.col("most"))
    trained = chosen.select("text", "lang", "o", "node", "class").groupBy("node").applyInArrow(ftrl(idf, sizes), "node string, slot long, w array<double>").collect()
    weights = {node: (np.zeros((DIM, n)), [1.0]) for node, n in sizes.items()}
    for r in trained:
        if r.slot < 0:
            weights[r.node][1][0] = r.w[0]
        else:
            weights[r.node][0][r.slot] = r.w

    def model(node: str) -> dict:
        classes, (w, temperature) = nodes[node], weights[node]
        below = {k: model(f"{node}/{k}") for k, part in enumerate(classes) if len(part) > 1}
        return {"labels": [part[0] for part in classes], "table": (w * idf[:, None]).astype(np.float32), "temperature": temperature[0], "below": below}

    return model("")


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs without its text, with lang_pred and score, the calibrated probability of lang_pred."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "lang_pred", "score")]

    def guess(texts: list[str], own: dict) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability, by a model and those below it."""
        slots, bounds = features(texts)
        size = np.maximum(np.diff(bounds), 1)[:, None]
        table = own["table"]
        logits = np.stack([np.add.reduceat(np.append(table[:, c][slots], 0), bounds[:-1], dtype=np.float64) for c in range(len(own["labels"]))], axis=1) / size
        p = softmax(logits / own["temperature"])
        best = p.argmax(axis=1)
        names, scores = [own["labels"][k] for k in best], p.max(axis=1)
        for k, below in own["below"].items():
            at = np.flatnonzero(best == k)
            if len(at):
                told, more = guess([texts[i] for i in at], below)
                scores[at] *= more
                for i, name in zip(at, told, strict=True):
                    names[i] = name
        return names, scores

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if model["labels"] and t is not None and any(map(str.isalpha, t))]
        for a in range(0, len(at), 64):
            for i, name, p in zip(at[a : a + 64], *guess([texts[i] for i in at[a : a + 64]], model), strict=True):
                names[i], scores[i] = name, float(p)
        return names, scores

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                b = batch.slice(a, 1024)
                names, scores = score(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[f"c{i}" for i in range(len(rest))], "lang_pred", "score"])

    carried = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("text"))
    schema = StructType([*carried.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    out = carried.mapInArrow(body, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], "lang_pred", "score")
