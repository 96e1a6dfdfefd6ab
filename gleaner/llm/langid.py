"""Language identification: sparse multinomial logistic regression on tf-idf
character n-grams.

N-grams of 1 to `ORDER` lower-case characters are hashed into `BUCKETS` terms; a
term's weight in a text is its relative frequency times its inverse document
frequency, which is counted over all documents with a language. The weights are
learned by follow-the-regularised-leader (proximal, per-coordinate rates) with L1
and L2 penalties from a bounded sample, up to `PER_LANG` documents of each
language and `MOST` in all; a temperature that calibrates the probabilities is fitted on a fifth of
the sample that training leaves out.

Rules: texts that are null or have no letter are `und` with score 0; so is every
text if nothing could be learned. Equal probabilities go to the language that is
first in order. Rows without a language are never learned from. Repeated rows are
repeated results. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.blocks import blocks, tidy, Block
from gleaner.llm.bpe import LETTER, _classes, _once
from gleaner.sources.tables import broadcast_if_small

ORDER, BUCKETS, SCALE = 3, 1 << 15, 10.0
PER_LANG, MOST, PASSES = 1200, 24000, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"


def _characters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the documents, and their offsets."""
    raw, at = block.data.tobytes(), block.offsets.tolist()
    texts = [raw[a:b].decode("utf-8").lower() for a, b in zip(at, at[1:], strict=False)]
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])


def terms(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the term at each character, and for each document the
    first and the end of its n-grams."""
    points, offsets = _characters(block)
    hashed = np.zeros(len(points), np.uint32)
    for order in range(1, ORDER + 1):
        n = max(0, len(points) - order + 1)
        hashed = (hashed[:n] * np.uint32(0x01000193)) ^ (points[order - 1 : order - 1 + n] * np.uint32(0x9E3779B1))
        salt = np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
        found = ((hashed + salt) * np.uint32(0xC2B2AE35)) >> np.uint32(17)
        ends = np.maximum(offsets[1:] - order + 1, offsets[:-1])
        yield found, np.minimum(offsets[:-1], n), np.minimum(ends, n)


def has_letter(block: Block) -> np.ndarray:
    points, offsets = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), block.offsets
    if len(points) != len(block.data):
        starts = np.flatnonzero((block.data & 0xC0) != 0x80)
        offsets = np.searchsorted(starts, offsets)
    run = np.concatenate([[0], np.cumsum(_once("classes", _classes)[points] == LETTER)])
    return run[offsets[1:]] > run[offsets[:-1]]


def frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for b in blocks(batch.column(0), 1 << 19):
                seen = np.zeros((b.hi - b.lo, BUCKETS), bool)
                for found, lo, hi in terms(b):
                    sizes = hi - lo
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
                    seen[row, found[inside]] = True
                total += np.count_nonzero(seen, axis=0)
                n += b.hi - b.lo
        at = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total[at[:-1]], n))], names=["term", "n"])

    out, n = np.zeros(BUCKETS, np.int64), 0
    for term, count in docs.select(F.col(text).cast("string")).mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        if term < 0:
            n = count
        else:
            out[term] = count
    return n, out


def sample(docs: DataFrame, key: str, text: str, lang: str, most: int = PER_LANG) -> DataFrame:
    """id, lang, text: up to `most` documents of each language, fewer where that
    would be more than `MOST` in all, by the least hashes of their ids. Languages with
    more are thinned by their hashes first. One text of an id counts, the one with the
    least hash, in however many rows the id stands."""
    ids = docs.select(F.col(key).alias("_id"), F.col(lang).alias("_lang")).filter("_id is not null")
    # ids are counted roughly; twice as many as needed pass the thinning
    counts = ids.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("_n"))
    most = max(1, min(most, MOST // max(1, counts.count())))
    rank = F.xxhash64(F.col("_id").cast("string"))
    spread = (rank.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    ids = ids.join(broadcast_if_small(counts), "_lang").filter(spread * F.col("_n") <= 2.0 * most + 50)
    chosen = ids.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy(spread, "_id"))).filter(F.col("_r") <= most)
    chosen = chosen.select("_id", "_lang")
    rows = docs.select(F.col(key).alias("_id"), F.col(lang).alias("_lang"), F.col(text).cast("string").alias("_text"))
    rows = rows.join(broadcast_if_small(chosen), ["_id", "_lang"])
    return rows.groupBy("_id", "_lang").agg(F.min(F.struct(F.md5("_text"), "_text"))["_text"].alias("_text"))


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray):
        """`rows`: terms and relative frequencies of the sample's texts."""
        self.langs, self.temperature = langs, 1.0
        x = [(t, f * idf[t] * SCALE) for t, f in rows]
        order = np.random.default_rng(11).permutation(len(x)).tolist()
        train, rest = order[len(order) // 5 :], order[: len(order) // 5]
        w = self._train([x[i] for i in train], y[train]) if langs else np.zeros((BUCKETS, 0))
        self.weights = np.ascontiguousarray((w * idf[:, None] * SCALE).T)  # languages x terms
        if rest and langs:
            logits = np.stack([v @ w[t] for t, v in (x[i] for i in rest)])
            self.temperature = min(np.geomspace(0.02, 10, 60), key=lambda t: _loss(logits / t, y[rest]))

    def _train(self, x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
        k = len(self.langs)
        z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))

        def weights(z, n):
            return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

        for _ in range(PASSES):
            for (t, v), label in zip(x, y.tolist(), strict=True):
                zt, nt = z[t], n[t]
                w = weights(zt, nt)
                p = _softmax(v @ w)
                p[label] -= 1.0
                g = v[:, None] * p
                more = nt + g * g
                z[t] = zt + g - (np.sqrt(more) - np.sqrt(nt)) / ALPHA * w
                n[t] = more
        return weights(z, n)

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        n, k = block.hi - block.lo, len(self.langs)
        sums, sizes = np.zeros((n, k)), np.zeros(n)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        for found, lo, hi in terms(block):
            sizes += hi - lo
            for j in range(k):
                run = np.concatenate([[0.0], np.cumsum(self.weights[j][found])])
                sums[:, j] += run[hi] - run[lo]
        p = _softmax(sums / np.maximum(sizes, 1)[:, None] / self.temperature)
        best = np.argmax(np.round(p, 12), axis=1)
        letters = has_letter(block)
        langs = [self.langs[i] if some else UNKNOWN for i, some in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs, np.where(letters, p[np.arange(n), best], 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return -float(np.log(np.maximum(_softmax(logits)[np.arange(len(y)), y], 1e-12)).mean())


def text_row(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and relative frequencies of each document of a block."""
    per_order = list(terms(block))
    out = []
    for i in range(block.hi - block.lo):
        found, counts = np.unique(np.concatenate([f[lo[i] : hi[i]] for f, lo, hi in per_order]), return_counts=True)
        out.append((found.astype(np.int32), counts / max(1, counts.sum())))
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows of `docs` that have a text and a language. The driver
    gets the frequencies (`BUCKETS` numbers) and the sample's terms."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n, found = frequencies(known, text)
    idf = np.log((1.0 + n) / (1.0 + found)) + 0.1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                rows = text_row(b)
                own = batch.slice(b.lo, b.hi - b.lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).cast(pa.int64()), own.column(1), pa.array([t.tolist() for t, _ in rows], pa.list_(pa.int32())), pa.array([f.tolist() for _, f in rows], pa.list_(pa.float64()))],
                    names=["id", "lang", "terms", "shares"],
                )

    rows = sample(known, key, text, lang).select(F.col("_id").cast("long"), F.col("_lang").cast("string"), "_text")
    got = rows.mapInArrow(tidy(run), "id long, lang string, terms array<int>, shares array<double>").toArrow()
    got = got.sort_by([("id", "ascending"), ("lang", "ascending")])
    names = got["lang"].to_pylist()
    langs = sorted(set(names))
    x = [(t.values.to_numpy(), f.values.to_numpy()) for t, f in zip(got["terms"], got["shares"], strict=True)]
    return Model(langs, idf, x, np.array([langs.index(v) for v in names], np.int64))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, with lang_pred string and score double."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(len(keep))):
                langs, score = shared.value.predict(b)
                own = batch.slice(b.lo, b.hi - b.lo).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    taken = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double")
