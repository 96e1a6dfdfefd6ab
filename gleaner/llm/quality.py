"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed byte trigrams, runs of four character classes (they
show capitals, symbols and lists) and a few word terms (length, equal to the
word before or to an earlier one nearby). Their document frequencies are counted over all
documents. A singular value decomposition of the tf-idf rows of a bounded
labelled sample gives the latent space. The sample's vectors are broadcast
(`SAMPLE` rows of `RANK` floats at most, 1 MB), every document is compared with
all of them, exactly and in blocks, and the `NEIGHBOURS` nearest vote with their
label, weighted by similarity.

Rules: a null text is an empty text. A text without terms, and every text when
there are no labels, has no neighbours: the vote is then the share of label 1 in
the sample (0.5 without labels). Labels other than 0 and 1 and labels without a
document don't count; of repeated labels of a document each counts. Repeated
documents have one row each. Other columns of the input aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.blocks import blocks, rows_of, span_hashes, tidy, word_bounds, Block

TRIGRAMS, SHAPES, WORDS = 3072, 7**4, 24
TERMS = TRIGRAMS + SHAPES + WORDS
SAMPLE, RANK, NEIGHBOURS = 3000, 64, 15
SHARPNESS = 8.0

# classes: other, lower, upper, digit, space, line end, multi-byte
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 1, 2, 3, 4, 5, 6


def term_counts(block: Block) -> np.ndarray:
    """Documents x terms, float32."""
    n, data, offsets = len(block.offsets) - 1, block.data, block.offsets
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 3:
        at = np.arange(len(data))
        row = rows_of(at, offsets)
        d = data.astype(np.uint32)
        grams = ((d[:-2] * 65536 + d[1:-1] * 256 + d[2:]) * np.uint32(2654435761)) >> np.uint32(8)
        inside = row[:-2] == row[2:]
        keys = row[:-2] * TERMS + grams % TRIGRAMS
        c = _CLASS[data].astype(np.int64)
        shapes = ((c[:-3] * 7 + c[1:-2]) * 7 + c[2:-1]) * 7 + c[3:]
        whole = row[:-3] == row[3:]
        shape_keys = row[:-3] * TERMS + TRIGRAMS + shapes
        found = np.bincount(np.concatenate([keys[inside], shape_keys[whole]]), minlength=n * TERMS)
        out += found.reshape(n, TERMS)
    starts, ends = word_bounds(block)
    if len(starts):
        row = rows_of(starts, offsets)
        hashes = span_hashes(data, starts, ends)
        base = row * TERMS + TRIGRAMS + SHAPES
        keys = [base + np.minimum(ends - starts, 15)]
        for k, back in enumerate((1, 2, 3, 4)):
            same = (hashes[back:] == hashes[:-back]) & (row[back:] == row[:-back])
            keys.append(np.repeat(base[back:][same] + 16 + k, 8))  # rare in prose: counts more
        np.add.at(out.reshape(-1), np.concatenate(keys), 1)
    return out


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of tf-idf, in place of the counts."""
    np.log1p(counts, out=counts)
    counts *= idf
    for lo in range(0, len(counts), 256):
        rows = counts[lo : lo + 256]
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        np.divide(rows, norm, out=rows, where=norm > 0)
    return counts


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term: one row of sums per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for b in blocks(batch.column(0)):
                total += np.count_nonzero(term_counts(b), axis=0)
                n += b.hi - b.lo
        at = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total[at[:-1]], n))], names=["term", "n"])

    counted = df.select(F.col(text).cast("string").alias("_text")).mapInArrow(tidy(run), "term long, n long")
    idf, n = np.zeros(TERMS, np.int64), 0
    for term, count in counted.groupBy("term").agg(F.sum("n")).collect():  # one row per term
        if term < 0:
            n = count
        else:
            idf[term] = count
    return n, idf


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """Up to `most` / 2 rows of each label, by the least hashes of their ids."""
    rows = labels.select(F.col(key).alias("_id"), F.col("quality").cast("int").alias("_label")).filter("_label in (0, 1) and _id is not null").distinct()
    rows = rows.join(docs.select(F.col(key).alias("_id")).distinct(), "_id")
    order = [F.xxhash64(F.col("_id").cast("string")), F.col("_id")]
    return rows.filter("_label = 0").orderBy(*order).limit(most // 2).union(rows.filter("_label = 1").orderBy(*order).limit(most // 2))


class Model:
    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray):
        self.idf, self.labels = idf, labels.astype(np.float32)
        self.share = float(self.labels.mean()) if len(labels) else 0.5
        x = weights(counts, idf)
        self.axes = np.zeros((x.shape[1], 0), np.float32)
        if len(x):
            rank = min(RANK, len(x))
            probe = np.random.default_rng(7).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
            for _ in range(4):  # randomised subspace iteration
                q, _ = np.linalg.qr(x @ probe)
                probe = x.T @ q
            _, _, vt = np.linalg.svd(probe.T, full_matrices=False)
            self.axes = np.ascontiguousarray(vt[:rank].T.astype(np.float32))
        self.vectors = self.project(x)

    def project(self, rows: np.ndarray) -> np.ndarray:
        out = rows @ self.axes
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 1e-6)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.share)
        if not len(self.labels):
            return out
        v = self.project(weights(counts, self.idf))
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(v), 512):
            sims = v[lo : lo + 512] @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(sims, near, 1).astype(np.float64)
            w = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
            vote = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
            some = np.linalg.norm(v[lo : lo + 512], axis=1) > 0
            out[lo : lo + 512][some] = vote[some]
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """`labels`: doc_id and quality of the rows that may be learned from. The
    frequencies cover all of `docs`; the driver gets them and the fitted model. One
    task holds the sample's counts (`SAMPLE` rows) and decomposes them."""
    n, found = document_frequencies(docs, text)
    idf = np.log((1.0 + n) / (1.0 + found)).astype(np.float32) + 0.1
    sample = labelled_sample(docs, labels, key=key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                own = batch.slice(b.lo, b.hi - b.lo)
                rows = [x.astype(np.float16).tobytes() for x in np.minimum(term_counts(b), 60000)]
                yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.int64()), own.column(1), pa.array(rows, pa.binary())], names=["id", "label", "counts"])

    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), "_id")
    # an id may stand in any number of rows: one text of each counts, the one with the least hash
    rows = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.md5("_text"), "_text"))["_text"].alias("_text"))
    kinds = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("counts", pa.binary())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = (pa.Table.from_batches(held) if held else kinds.empty_table()).sort_by([("id", "ascending"), ("label", "ascending"), ("counts", "ascending")])
        del held  # these rows are held once in each of two forms, and only one from here on
        counts, kept = np.empty((len(rows), TERMS), np.float32), rows["label"].to_numpy()
        for i, row in enumerate(rows["counts"]):
            counts[i] = np.frombuffer(row.as_buffer(), np.float16)
        del rows
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(idf, counts, kept))], pa.binary())], names=["model"])

    rows = rows.select(F.col("_id").cast("long"), "_label", "_text").mapInArrow(tidy(run), "id long, label int, counts binary")
    # an empty sample may be no task at all
    model = rows.repartition(1).mapInArrow(tidy(learn), "model binary").first()
    return pickle.loads(model[0]) if model else Model(idf, np.empty((0, TERMS), np.float32), np.empty(0, np.int32))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep`, with score double and predicted int, or as `names` has it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(keep.index(text) if text in keep else len(keep))):
                s = shared.value.scores(term_counts(b))
                own = batch.slice(b.lo, b.hi - b.lo).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, *names])

    # a text that is kept is sent once
    taken = docs.select(*keep, *([] if text in keep else [F.col(text).cast("string").alias("_text")]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[: len(keep)])
    return taken.mapInArrow(tidy(run), f"{kinds}, `{names[0]}` double, `{names[1]}` int")
