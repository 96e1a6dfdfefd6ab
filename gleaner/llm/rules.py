"""Quality rules by distribution divergence.

A text is compared with language references by the Jensen-Shannon distance (base
2, 0 to 1) of two histograms: characters by class, and words by common word. The
references are sums over all documents of a language that pass the base rules;
a language's common words are its `COMMON` most frequent ones. Words are told
apart by hash buckets, so that a reference has a fixed size. A text fails if no
reference is near in both histograms. Guards: a histogram with fewer than
`MIN_CHARS` characters or `MIN_WORDS` words says nothing and isn't judged;
languages whose references have fewer than `MIN_REFERENCE` words have none, and neither
their documents nor, with no references at all, any are judged.

Rules: null texts have no words. Null languages add to no reference, but their
documents are judged by all. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.blocks import blocks, lower_ascii, mix, rows_of, SPACE, span_hashes, tidy, window_hashes, word_bounds, Block

BUCKETS, COMMON = 8192, 48
MIN_CHARS, MIN_WORDS, MIN_REFERENCE = 200, 50, 2000
MAX_CHARS, MAX_WORDS = 0.30, 0.48

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

# classes of bytes: white space, vowels, other lower-case letters, capitals, digits,
# stops, symbols, other punctuation, beginnings of multi-byte characters; 9: not counted
CLASSES = 9
_CLASS = np.full(256, 7, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 2
_CLASS[[ord(c) for c in "aeiouy"]] = 1
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_CLASS[128:192] = 9
_CLASS[192:] = 8


_STIR = (mix(np.arange(1, 257)) >> np.uint64(56)).astype(np.uint8)


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[offsets[1:]] - run[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def line_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of long spans. Powers modulo 2 ** 64 alone don't tell some self-similar strings of
    1,024 bytes and more apart, so that runs of three bytes are hashed as well."""
    three = data.copy()
    three[:-2] = (_STIR[data[:-2]] + data[1:-1]) ^ _STIR[data[2:] ^ data[:-2]]
    return mix(span_hashes(data, first, last) ^ mix(span_hashes(three, first, np.maximum(first, last - 2))))


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each
    document, and the row and hash of each word."""
    data, offsets = block.data, block.offsets
    n = len(offsets) - 1
    starts, ends = word_bounds(block)
    row = rows_of(starts, offsets)
    out = {"n_words": np.bincount(row, minlength=n)}
    spaces = SPACE[data]
    out["word_chars"] = _per_document(~spaces & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_document(SYMBOLS[data], offsets)

    # lines: from each document's start or line end to the next line end or document's end
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([offsets[:-1], breaks + 1])
    last = np.concatenate([offsets[1:], breaks])
    first, last = np.sort(first, kind="stable"), np.sort(last, kind="stable")
    run = np.concatenate([[0], np.cumsum(~spaces)])
    full = (last > first) & (run[np.maximum(last, first)] > run[first])
    first, last = first[full], last[full]
    line_row = rows_of(first, offsets)
    keys = mix(line_hashes(data, first, last) + line_row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    distinct = np.unique(keys, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[distinct], minlength=n)

    words = span_hashes(data, starts, ends)
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        runs = window_hashes(words, 3)
        inside = np.flatnonzero(row[2:] == row[:-2])
        twice = inside[_repeats(mix(runs[inside] + row[inside].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return out | {"row": row, "starts": starts, "ends": ends}


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def class_counts(block: Block) -> np.ndarray:
    """Documents x classes."""
    n = len(block.offsets) - 1
    row = np.repeat(np.arange(n), np.diff(block.offsets))
    return np.bincount(row * 10 + _CLASS[block.data], minlength=n * 10).reshape(n, 10)[:, :CLASSES]


def word_buckets(block: Block, counts: dict[str, np.ndarray]) -> np.ndarray:
    """Bucket of each word, lower-cased, without stops at its end."""
    data, starts, ends = lower_ascii(block.data), counts["starts"], counts["ends"].copy()
    if len(starts):
        stop = (data[ends - 1] == 46) | (data[ends - 1] == 44)
        ends[stop & (ends - starts > 1)] -= 1
    return (span_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of counts `p` from the distribution `q`."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


class References:
    """Of each language: a distribution of character classes, its common words'
    buckets, and a distribution of these and the rest."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.languages = []
        for lang in sorted(sums):
            chars, words = sums[lang][:CLASSES].astype(float), sums[lang][CLASSES:]
            if words.sum() < MIN_REFERENCE:
                continue
            common = np.argsort(-words, kind="stable")[:COMMON]
            place = np.full(BUCKETS, COMMON)
            place[common] = np.arange(COMMON)
            shares = np.bincount(place, words, COMMON + 1)
            self.languages.append((lang, chars / chars.sum(), place, shares / shares.sum()))

    def kept(self, block: Block, counts: dict[str, np.ndarray], langs: list[str | None]) -> np.ndarray:
        """Verdicts of a block's documents; `langs`: their languages."""
        n = block.hi - block.lo
        failed = base_failed(counts)
        if not self.languages:
            return ~failed
        chars, buckets, row = class_counts(block), word_buckets(block, counts), counts["row"]
        judged_chars, judged_words = chars.sum(axis=1) >= MIN_CHARS, counts["n_words"] >= MIN_WORDS
        known = {name for name, *_ in self.languages}
        fits = np.array([lang is not None and lang not in known for lang in langs], bool)
        for _, classes, place, shares in self.languages:
            own = np.bincount(row * (COMMON + 1) + place[buckets], minlength=n * (COMMON + 1)).reshape(n, COMMON + 1)
            fits |= (~judged_chars | (distance(chars, classes) <= MAX_CHARS)) & (~judged_words | (distance(own, shares) <= MAX_WORDS))
        return ~failed & fits


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """From all documents with a language that pass the base rules. The driver
    gets `BUCKETS` sums of each language."""
    width = CLASSES + BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for b in blocks(batch.column(1)):
                counts = base_counts(b)
                good = ~base_failed(counts)
                chars, buckets = class_counts(b), word_buckets(b, counts)
                own = langs[b.lo : b.hi]
                for name in set(own[good].tolist()):
                    mine = good & (own == name)
                    total = sums.setdefault(name, np.zeros(width, np.int64))
                    total[:CLASSES] += chars[mine].sum(axis=0)
                    total[CLASSES:] += np.bincount(buckets[mine[counts["row"]]], minlength=BUCKETS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "place", "n"])

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(tidy(run), "lang string, place long, n long")
    sums: dict[str, np.ndarray] = {}
    for name, place, total in rows.groupBy("lang", "place").agg(F.sum("n")).collect():
        sums.setdefault(name, np.zeros(width, np.int64))[place] = total
    return References(sums)


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, refs: References, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, with the five numbers, base_failed and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(len(keep))):
                counts = base_counts(b)
                own = batch.slice(b.lo, b.hi - b.lo).columns[: len(keep)]
                langs = batch.column(len(keep) + 1).slice(b.lo, b.hi - b.lo).to_pylist()
                numbers = [pa.array(counts[x].astype(np.int64)) for x in NUMBERS]
                yield pa.RecordBatch.from_arrays(
                    [*own, *numbers, pa.array(base_failed(counts)), pa.array(shared.value.kept(b, counts, langs))], names=[*keep, *NUMBERS, "base_failed", "kept"]
                )

    taken = docs.select(*keep, F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-2])
    return taken.mapInArrow(tidy(run), f"{kinds}, {', '.join(f'{x} long' for x in NUMBERS)}, base_failed boolean, kept boolean")
