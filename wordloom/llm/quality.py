"""Text quality with a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it from the first byte to the last.  Each byte has a learned
embedding, learned filters run over the chunk, and the maximum of each filter is the chunk's features.  The mean and the
maximum over all chunks of the text go through a small layer into one probability.

The network is trained on the driver with Adam, on a bounded sample: at most ``per_class`` labelled texts of each class
(those with the smallest id hashes), read from the first byte to the last as in scoring.  The share of label 1 among all
labelled rows sets the score back to the true proportions.  Scores read every byte of every text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import map_batches, text_slices

CHUNK, STRIDE = 256, 224
WIDTH, HOP, EMBED, FILTERS, HIDDEN = 8, 2, 4, 16, 16
POSITIONS = (CHUNK - WIDTH) // HOP + 1
PER_CLASS = 2000


def chunk_starts(n: int) -> np.ndarray:
    """Starts of overlapping chunks that cover n bytes; the last one ends with the text."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - CHUNK + STRIDE, STRIDE)
    starts[-1] = n - CHUNK
    return starts


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, fan: (rng.normal(size=shape) / np.sqrt(fan)).astype(np.float32)
    return {
        "embed": draw(256, EMBED, fan=1), "conv": draw(WIDTH * EMBED, FILTERS, fan=WIDTH * EMBED), "bias": np.zeros(FILTERS, np.float32),
        "dense": draw(2 * FILTERS, HIDDEN, fan=2 * FILTERS), "dense_bias": np.zeros(HIDDEN, np.float32),
        "out": draw(HIDDEN, 1, fan=HIDDEN), "out_bias": np.zeros(1, np.float32),
    }


def _windows(model, chunks: np.ndarray) -> np.ndarray:
    """Rows of embedded bytes under each filter position."""
    x = model["embed"][chunks].reshape(len(chunks), CHUNK * EMBED)
    step = x.strides[1]
    view = np.lib.stride_tricks.as_strided(x, (len(chunks), POSITIONS, WIDTH * EMBED), (x.strides[0], HOP * EMBED * step, step))
    return view.reshape(-1, WIDTH * EMBED)


def pooled(model, chunks: np.ndarray) -> np.ndarray:
    """Features of each chunk."""
    act = (_windows(model, chunks) @ model["conv"]).reshape(len(chunks), POSITIONS, FILTERS)
    return np.maximum(act.max(1) + model["bias"], 0)


def combine(model, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Logit of each text from its chunks' features; ``first`` are the texts' first chunks."""
    count = np.diff(np.append(first, len(features)))[:, None]
    doc = np.concatenate([np.add.reduceat(features, first) / count, np.maximum.reduceat(features, first)], axis=1)
    hidden = np.maximum(doc @ model["dense"] + model["dense_bias"], 0)
    return (hidden @ model["out"] + model["out_bias"])[:, 0]


def _gradients(model, chunks, first, target) -> tuple[float, dict[str, np.ndarray]]:
    n = len(chunks)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    windows = _windows(model, chunks)
    act = (windows @ model["conv"]).reshape(n, POSITIONS, FILTERS)
    top = act.argmax(1)
    feature = np.maximum(np.take_along_axis(act, top[:, None], 1)[:, 0] + model["bias"], 0)
    count = np.bincount(owner)[:, None]
    mean, high = np.add.reduceat(feature, first) / count, np.maximum.reduceat(feature, first)
    doc = np.concatenate([mean, high], axis=1)
    hidden = np.maximum(doc @ model["dense"] + model["dense_bias"], 0)
    logit = (hidden @ model["out"] + model["out_bias"])[:, 0]
    p = 1 / (1 + np.exp(-logit))
    loss = -np.mean(np.log(np.where(target == 1, p, 1 - p) + 1e-9))
    d = ((p - target) / len(target)).astype(np.float32)[:, None]
    g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
    dh = (d @ model["out"].T) * (hidden > 0)
    g["dense"], g["dense_bias"] = doc.T @ dh, dh.sum(0)
    dd = dh @ model["dense"].T
    df = (dd[:, :FILTERS] / count)[owner] + dd[:, FILTERS:][owner] * (feature == high[owner])
    df *= feature > 0
    g["bias"] = df.sum(0)
    rows = (np.arange(n)[:, None] * POSITIONS + top).ravel()  # the window each filter took its maximum from
    column, weight = np.tile(np.arange(FILTERS), n), df.ravel()
    live = np.flatnonzero(weight)
    rows, column, weight = rows[live], column[live], weight[live]
    g["conv"] = np.zeros_like(model["conv"])
    taken = windows[rows] * weight[:, None]
    np.add.at(g["conv"].T, column, taken)
    back = (model["conv"].T[column] * weight[:, None]).reshape(-1, EMBED)
    at = (rows % POSITIONS)[:, None] * HOP + np.arange(WIDTH)
    byte = chunks[(rows // POSITIONS)[:, None], at].ravel()
    g["embed"] = np.stack([np.bincount(byte, back[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
    return float(loss), g


def train(texts: list[np.ndarray], labels: np.ndarray, steps: int = 1200, batch: int = 32, rate: float = 5e-3, seed: int = 7):
    """Fit the network; ``texts`` are arrays of chunks (one row each)."""
    model, rng = initial(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    while step < steps:
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            starts = np.cumsum([0] + [len(texts[i]) for i in own[:-1]])
            _, g = _gradients(model, np.concatenate([texts[i] for i in own]), starts, labels[own])
            step += 1
            now = rate * 0.5 * (1 + math.cos(math.pi * min(step, steps) / steps))
            for name, value in g.items():
                first[name] = 0.9 * first[name] + 0.1 * value
                second[name] = 0.999 * second[name] + 0.001 * value * value
                m, v = first[name] / (1 - 0.9**step), second[name] / (1 - 0.999**step)
                model[name] = (model[name] - now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def _padded(data: np.ndarray) -> np.ndarray:
    return data if len(data) >= CHUNK else np.concatenate([data, np.zeros(CHUNK - len(data), np.uint8)])


def score_bytes(model, texts: list[np.ndarray], block: int = 1024) -> np.ndarray:
    """Probability of each text (arrays of bytes)."""
    out = []
    for a in range(0, len(texts), 256):
        part = [_padded(t) for t in texts[a : a + 256]]
        starts = [chunk_starts(len(t)) for t in part]
        offset = np.cumsum([0] + [len(t) for t in part[:-1]])
        at = np.concatenate([s + o for s, o in zip(starts, offset, strict=True)])
        data, features = np.concatenate(part), []
        for k in range(0, len(at), block):
            features.append(pooled(model, data[at[k : k + block, None] + np.arange(CHUNK)]))
        out.append(combine(model, np.concatenate(features), np.cumsum([0] + [len(s) for s in starts[:-1]])))
    logit = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-(logit + model["prior"]).astype(np.float64)))


def held_out(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict[str, np.ndarray]:
    """Train on labelled rows outside the held-out fifth; with one class or none, every score is that class's share.

    Labels without id or other than 0 and 1 take no part, nor do documents with both labels.  Repeated labels and documents
    count once; of several texts of one id the smallest is read.  Null texts are read as empty.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other"))
    known = known.where("quality = other").drop("other")
    share = known.agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    n, good = share["n"], share["good"] or 0
    model = initial() | {"prior": np.float64(0)}
    if not 0 < good < n:
        model["out"] = np.zeros_like(model["out"])
        model["prior"] = np.float64(math.log((good + 1) / (n - good + 1)))
        return model
    pick = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    sample = pick[0].unionByName(pick[1])

    def chunks(batch):
        ids, quality, data = [], [], []
        for row, to, raw, off in text_slices(batch.column(1)):
            for k in range(to - row):
                text = _padded(raw[off[k] : off[k + 1]])
                starts = chunk_starts(len(text))
                ids.append(batch.column(0)[row + k].as_py())
                quality.append(batch.column(2)[row + k].as_py())
                data.append(text[starts[:, None] + np.arange(CHUNK)].tobytes())
        yield {"doc_id": ids, "quality": quality, "chunks": data}

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")  # 2 * per_class rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # repeated ids
    got = map_batches(rows, chunks, "doc_id long, quality int, chunks binary").toPandas()
    got = got.sort_values(["doc_id", "chunks"]).reset_index(drop=True)
    if got["quality"].nunique() < 2:
        model["out"] = np.zeros_like(model["out"])
        model["prior"] = np.float64(math.log((good + 1) / (n - good + 1)))
        return model
    texts = [np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for c in got["chunks"]]
    target = got["quality"].to_numpy()
    model = train(texts, target)
    odds = lambda p: math.log(p / (1 - p))
    return model | {"prior": np.float64(odds(good / n) - odds(target.mean()))}


def quality_scores(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null and empty texts are scored as no bytes.

    A null id is not held out.  Repeated rows are all scored.
    """

    def fn(batch):
        out = []
        for row, to, raw, off in text_slices(batch.column(1)):
            out.append(score_bytes(model, [raw[off[k] : off[k + 1]] for k in range(to - row)]))
        score = np.concatenate(out) if out else np.zeros(0)
        yield {"doc_id": batch.column(0), "score": score}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    scored = map_batches(rows, fn, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose text scores at least ``threshold``, with all their columns."""
    place = docs.columns.index(text)

    def fn(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for row, to, raw, off in text_slices(batch.column(place)):
                keep[row:to] = score_bytes(model, [raw[off[k] : off[k + 1]] for k in range(to - row)]) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(fn, docs.schema)
