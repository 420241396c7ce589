"""Quality classifier: a byte-level convolutional network in numpy.

A filter sees eight bytes and steps by four. Its outputs are max-pooled over
chunks of CHUNK bytes that overlap by half and cover the whole document; the
chunks' maxima and means are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import filtered, id_and_text, slices, table

THRESHOLD = 0.3
FOLDS = 5
#: Labelled rows of each class that the driver learns from, at most; letters of each, and stretches of a longer text that have as many.
SAMPLE, SAMPLE_LETTERS, PIECES = 1500, 1 << 16, 8
EPOCHS = 8
CHUNK, STEP, DEPTH, FILTERS = 512, 4, 8, 32
HALF = CHUNK // 2
#: Text bytes that go through the network at a time.
SLICE_BYTES = 1 << 19


@dataclass
class Layout:
    """Texts as byte steps, each text padded with zero bytes to whole halves of chunks."""

    steps: np.ndarray  # (steps, STEP) bytes
    halves: np.ndarray  # halves of each text

    @classmethod
    def of(cls, texts: list[bytes]) -> Layout:
        halves = np.array([-(-(len(x) + STEP) // HALF) for x in texts], np.int64)
        data = b"".join(x.ljust(n * HALF, b"\0") for x, n in zip(texts, halves.tolist()))
        return cls(np.frombuffer(data, np.uint8).reshape(-1, STEP), halves)


class Network:
    """Embedding, filters and the final layer; ``params`` by name."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.params = {
            "embed": normal(0.5, 256, DEPTH),
            "filters": normal(1 / np.sqrt(2 * STEP * DEPTH), 2 * STEP * DEPTH, FILTERS),
            "bias": np.zeros(FILTERS, np.float32),
            "out": normal(0.1, 2 * FILTERS),
            "shift": np.zeros(1, np.float32),
        }

    def forward(self, layout: Layout) -> tuple[np.ndarray, dict]:
        """Log-odds of each text, and what ``gradients`` needs."""
        p = self.params
        seen = p["embed"][layout.steps].reshape(len(layout.steps), STEP * DEPTH)
        left, right = np.split(p["filters"], 2)
        windows = seen @ left
        windows[:-1] += (seen @ right)[1:]
        ends = np.cumsum(layout.halves)
        windows += p["bias"]
        windows[ends * (HALF // STEP) - 1] = 0  # its second half would lie in the next text
        windows = np.maximum(windows, 0).reshape(-1, HALF // STEP, FILTERS)
        pooled = windows.max(axis=1)
        chunks = pooled.copy()
        follows = np.ones(len(pooled), bool)
        follows[ends - 1] = False
        chunks[:-1][follows[:-1]] = np.maximum(pooled[:-1], pooled[1:])[follows[:-1]]
        starts = ends - layout.halves
        most = np.maximum.reduceat(chunks, starts)
        mean = np.add.reduceat(chunks, starts) / layout.halves[:, None].astype(np.float32)
        features = np.concatenate([most, mean], 1)
        logits = features @ p["out"] + p["shift"]
        return logits, {"seen": seen, "windows": windows, "pooled": pooled, "chunks": chunks, "follows": follows, "starts": starts, "features": features, "most": most}

    def gradients(self, layout: Layout, kept: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a loss whose slope in each text's log-odds is given."""
        p, texts = self.params, np.repeat(np.arange(len(layout.halves)), layout.halves)
        grads = {"out": kept["features"].T @ slope, "shift": slope.sum(keepdims=True)}
        by_feature = slope[:, None] * p["out"]
        top, mean = by_feature[:, :FILTERS], by_feature[:, FILTERS:] / layout.halves[:, None]
        is_top = kept["chunks"] == kept["most"][texts]
        ties = np.add.reduceat(is_top.astype(np.float32), kept["starts"])
        d_chunk = (mean[texts] + is_top * (top / ties)[texts]).astype(np.float32)
        second = np.zeros_like(d_chunk, bool)
        second[:-1] = kept["follows"][:-1, None] & (kept["pooled"][1:] > kept["pooled"][:-1])
        d_half = np.where(second, 0, d_chunk)
        d_half[1:] += np.where(second, d_chunk, 0)[:-1]
        at = kept["windows"].argmax(axis=1)
        d_half *= kept["pooled"] > 0
        step = at + np.arange(len(at))[:, None] * (HALF // STEP)
        after = np.minimum(step + 1, len(kept["seen"]) - 1)
        grads["bias"] = d_half.sum(0)
        both = [np.einsum("hfd,hf->df", kept["seen"][s], d_half) for s in (step, after)]
        grads["filters"] = np.concatenate(both)
        embed = np.zeros_like(p["embed"])
        for s, w in zip((step, after), np.split(p["filters"], 2)):
            d_seen = d_half[:, :, None] * w.T[None]
            np.add.at(embed, layout.steps[s].reshape(-1), d_seen.reshape(-1, DEPTH))
        grads["embed"] = embed
        return grads

    def of_long(self, text: bytes) -> float:
        """Log-odds of one text of any length, SLICE_BYTES at a time; ``forward`` gives the same but for rounding."""
        p, halves, some = self.params, -(-(len(text) + STEP) // HALF), SLICE_BYTES // HALF
        left, right = np.split(p["filters"], 2)
        most, total, before = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), None
        for at in range(0, halves, some):
            upto = min(halves, at + some)
            ahead = STEP * (upto < halves)  # the last filter of a part reaches into the next one
            data = text[at * HALF : upto * HALF + ahead].ljust((upto - at) * HALF + ahead, b"\0")
            seen = p["embed"][np.frombuffer(data, np.uint8).reshape(-1, STEP)].reshape(-1, STEP * DEPTH)
            windows = np.zeros(((upto - at) * (HALF // STEP), FILTERS), np.float32)
            windows[: len(seen) - 1] = (seen[:-1] @ left) + (seen[1:] @ right) + p["bias"]
            pooled = np.maximum(windows, 0).reshape(-1, HALF // STEP, FILTERS).max(axis=1)
            most = np.maximum(most, pooled.max(0))
            if before is not None:
                total += np.maximum(before, pooled[0])
            total += np.maximum(pooled[:-1], pooled[1:]).sum(0)
            before = pooled[-1]
        return float(np.concatenate([most, (total + before) / halves]) @ p["out"] + p["shift"][0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability that each whole text is of good quality; an empty text is all padding."""
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            if len(texts[at]) > SLICE_BYTES:
                out[at] = self.of_long(texts[at])
                at += 1
                continue
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) <= SLICE_BYTES):
                held += len(texts[upto]) + HALF
                upto += 1
            out[at:upto] = self.forward(Layout.of(texts[at:upto]))[0]
            at = upto
        return 1 / (1 + np.exp(-out.clip(-30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0, rate: float = 0.01, batch: int = 32) -> Network:
    """Adam over shuffled batches; each class has half of the weight."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: the smoothed share of label 1
        share = (labels.sum() + 1) / (len(labels) + 2)
        net.params["out"][:] = 0
        net.params["shift"][:] = np.log(share / (1 - share))
        return net
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    means = {k: np.zeros_like(v) for k, v in net.params.items()}
    squares = {k: np.zeros_like(v) for k, v in net.params.items()}
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick, t = order[at : at + batch], t + 1
            layout = Layout.of([texts[i] for i in pick])
            logits, kept = net.forward(layout)
            odds = 1 / (1 + np.exp(-logits.clip(-30, 30)))
            slope = (weight[pick] * (odds - labels[pick]) / len(pick)).astype(np.float32)
            step = rate * (1 - epoch / epochs)
            for k, g in net.gradients(layout, kept, slope).items():
                means[k] = 0.9 * means[k] + 0.1 * g
                squares[k] = 0.999 * squares[k] + 0.001 * g * g
                net.params[k] -= (step * (means[k] / (1 - 0.9**t)) / (np.sqrt(squares[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def excerpt(text: Column, letters: int) -> Column:
    """The text, or of one with more letters than that, PIECES stretches of it, evenly apart, that have as many together."""
    size, piece = F.length(text), letters // PIECES
    starts = F.sequence(F.lit(0), F.lit(PIECES - 1))
    parts = F.transform(starts, lambda i: F.substring(text, (1 + F.floor(i * (size - piece) / (PIECES - 1))).cast("int"), F.lit(piece)))
    return F.when(size <= letters, text).otherwise(F.array_join(parts, " "))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0, letters: int = SAMPLE_LETTERS) -> Network:
    """Fit on at most ``sample`` labelled documents of each class, none of fold 0.

    The sample is the documents that come first by a hash of their ids, so it is the
    same at every run. Only ids and labels are ordered; the chosen ids (at most
    twice ``sample``) are broadcast to fetch their texts. Of a text of more than ``letters``
    as many are learnt from, in stretches from all over it, so what reaches the driver
    is bounded in bytes as well. An id with several labels counts with the
    least; null labels don't count.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    marks = marks.where(marks["quality"].isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = lambda q: marks.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = id_and_text(docs).join(F.broadcast(some(0).unionByName(some(1))), "doc_id")
    rows = chosen.withColumn("text", excerpt(F.col("text"), letters)).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return fit([(x or "").encode() for x in rows.text], rows.quality.to_numpy(np.float32), seed=seed)


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = net.scores([(x or "").encode() for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labels and score every document.

    Null and empty texts get the score of padding alone; rows that repeat are
    scored each; null ids are in fold 0; other columns are never read. Without
    labels of both classes the score is the smoothed share of label 1.
    """
    return score(docs, learn(docs, labels, sample))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    Each row is judged by its text as in ``classify``: null and empty texts by the score
    of padding alone, repeated rows alike. No rows give no rows.
    """
    net = learn(docs, labels, sample)
    return filtered(docs, lambda part: (net.scores([(x or "").encode() for x in part.column("text").to_pylist()]) >= threshold).tolist())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
