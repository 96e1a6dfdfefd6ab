"""Phrases that stand together more often than their parts would by chance.

Texts (null: empty) get A-Z in lower case, are split into pieces at `.,;:!?` and line
ends, and pieces into words at blanks and tabs. All counts are per language (null:
`und`). A phrase found `least` times has parts found as often, so four passes do:

1. words are counted;
2. a sieve: pairs of frequent words, as 64-bit hashes. Tasks send sorted runs of hashes with
   their counts, cut by the leading bits of the hash; each cut is merged by itself;
3. the same sieve for triples of two pairs that pass it;
4. pairs and triples that pass their sieve are counted.

Words, pairs and triples that are frequent reach the next passes as filters of bits with a fixed
largest size (`FILTER_BITS`). Equal hashes and false hits only let more phrases be counted: the
counts of passes 1 and 4 are of the words themselves, and exact.

A task's `PhraseTrie` has a level for language and first word, and below it hash
containers of the words that follow. A container of over `BURST` phrases bursts: it
becomes a level of its own, with a container for each second word. Beyond `ROOM`
phrases the largest subtrees leave the task whole, as sorted runs. Runs go to Spark's
shuffle, which merges them by the whole phrase, so that a first word that starts a
third of all phrases is dealt out.

Rules: rows repeat and count each time; a null or empty text has no words; an empty
table has no phrases; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.blocks import blocks, lower_ascii, mix, rows_of, span_hashes, text_array, tidy, tidy_group, word_bounds
from gleaner.sources.tables import broadcast_if_small, written

LEAST, TOP, COVERED = 10, 2000, 50
BURST, ROOM, WORDS = 4096, 300_000, 400_000
SIEVE, SIEVE_CUT, SLICES = 3_000_000, 4_000_000, 32
FILTER_BITS = 1 << 26
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True
_MIX = np.uint64(0x9FB21C651E98DF25)


def binary_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings of a large binary array without nulls."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(words) + 1 + words.offset)[words.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return span_hashes(data[: offsets[-1]], offsets[:-1], offsets[1:])


def phrase_hashes(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    out = lang
    for word in words:
        out = mix(out * _MIX + word)
    return out


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of a filter of `bits` (a power of two) that stand for each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(4):
        yield (hashes + np.uint64(k) * step) & np.uint64(bits - 1)


def passes(places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in probes(hashes, len(places) * 64):
        found &= (places[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return found


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """Filter of a column `h` of hashes. Tasks send 64 places at a time; what reaches the
    driver is bounded by the filter's own size."""
    bits = 1 << 16
    while bits < min(16 * hashes.count(), FILTER_BITS):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(probes(batch.column(0).to_numpy().view(np.uint64), bits))))
            slot, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(slot):
                held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(held.view(np.int64))], ["slot", "held"])

    rows = hashes.select("h").mapInArrow(places, "slot bigint, held bigint").groupBy("slot").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["slot"].to_numpy()] = rows["held"].to_numpy().view(np.uint64)
    return out


def word_filter(frequent: DataFrame) -> np.ndarray:
    """Filter of the words of a table (lang, w1)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word = (binary_hashes(batch.column(i).cast(pa.large_binary())) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(lang, [word]).view(np.int64))], ["h"])

    return bit_filter(frequent.select("lang", "w1").mapInArrow(hashes, "h bigint"))


class PhraseTrie:
    """Counts of phrases as rows (language and first word, words that follow).

    `suffix` holds the second word's number in its upper and one more than the third word's
    in its lower 32 bits (0: a pair). `spill` and `drain` yield sorted runs: (first, suffix,
    count) arrays of whole subtrees."""

    def __init__(self, burst: int = BURST, room: int = ROOM):
        self.burst, self.room = burst, room
        self.root: dict[int, Counter | dict[int, Counter]] = {}
        self.size = 0

    def add(self, first: np.ndarray, suffix: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        first, suffix = first[order], suffix[order].tolist()
        ends = np.flatnonzero(np.diff(first, append=-1))
        lo = 0
        for key, hi in zip(first[ends].tolist(), (ends + 1).tolist(), strict=True):
            below = self.root.get(key)
            if below is None:
                below = self.root[key] = Counter()
            if type(below) is Counter:
                before = len(below)
                below.update(suffix[lo:hi])
                self.size += len(below) - before
                if len(below) > self.burst:
                    self.root[key] = self._split(below)
            else:
                for rest in suffix[lo:hi]:
                    box = below.setdefault(rest >> 32, Counter())
                    self.size += rest not in box
                    box[rest] += 1
            lo = hi

    @staticmethod
    def _split(box: Counter) -> dict[int, Counter]:
        out: dict[int, Counter] = {}
        for rest, n in box.items():
            out.setdefault(rest >> 32, Counter())[rest] = n
        return out

    @staticmethod
    def _boxes(below: Counter | dict[int, Counter]) -> list[Counter]:
        return [below] if type(below) is Counter else list(below.values())

    def _run(self, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        boxes = self._boxes(self.root.pop(key))
        n = sum(map(len, boxes))
        self.size -= n
        suffix = np.fromiter((s for box in boxes for s in box), np.int64, n)
        count = np.fromiter((c for box in boxes for c in box.values()), np.int64, n)
        order = np.argsort(suffix)
        return np.full(n, key), suffix[order], count[order]

    def spill(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of the largest subtrees, if the trie is full, until it is half empty."""
        if self.size > self.room:
            for key in sorted(self.root, key=lambda k: -sum(map(len, self._boxes(self.root[k])))):
                if self.size <= self.room // 2:
                    return
                yield self._run(key)

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for key in sorted(self.root):
            yield self._run(key)


class Numbers:
    """Numbers of byte strings in the order of their first sight."""

    def __init__(self) -> None:
        self.of: dict[bytes, int] = {}

    def take(self, words: list[bytes]) -> np.ndarray:
        of = self.of
        return np.fromiter((of.setdefault(w, len(of)) for w in words), np.int64, len(words))

    def strings(self) -> pa.Array:
        return pa.array(list(self.of), pa.binary()).cast(pa.string())


class WordCounts:
    """Counts of single words: the first level alone."""

    def __init__(self, room: int = ROOM):
        self.room, self.counts = room, Counter()

    @property
    def size(self) -> int:
        return len(self.counts)

    def add(self, first: np.ndarray) -> None:
        self.counts.update(first.tolist())

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        counts, self.counts = self.counts, Counter()
        first, count = (np.fromiter(v, np.int64, len(counts)) for v in (counts.keys(), counts.values()))
        order = np.argsort(first)
        yield first[order], np.zeros(len(first), np.int64), count[order]

    spill = drain


class Words:
    """The words of a block: their document, piece, place in `spelled` (distinct ones)."""

    def __init__(self, block) -> None:
        data = lower_ascii(block.data)
        starts, ends = word_bounds(block, _OUTSIDE)
        self.doc = rows_of(starts, block.offsets)
        self.piece = np.cumsum(_BREAK[data])[starts] + self.doc
        sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        letters = data[~_OUTSIDE[data]]
        every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(letters)]).dictionary_encode()
        self.spelled, self.at = every.dictionary, every.indices.to_numpy()

    def pairs(self, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words with their languages, of the pairs, and whether a pair stands in one piece."""
        plain = binary_hashes(self.spelled)[self.at]
        return phrase_hashes(salt, [plain]), phrase_hashes(salt[:-1], [plain[:-1], plain[1:]]), self.piece[:-1] == self.piece[1:]

    def triples(self, pairs: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the triples of two pairs that `fit`; `pairs`: hashes of all pairs."""
        at = np.flatnonzero(fit[1:] & fit[:-1])
        return at, phrase_hashes(pairs[at], [binary_hashes(self.spelled)[self.at[at + 2]]])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """Words of the blocks of batches (text, lang) and each word's language."""
    for batch in batches:
        lang = text_array(batch.column(1)).fill_null(UNKNOWN).cast(pa.large_binary())
        for block in blocks(batch.column(0), 1 << 20):
            words = Words(block)
            if len(words.doc):
                yield words, lang.slice(block.lo, block.hi - block.lo)


def run_counter(known: np.ndarray | None, room: int = ROOM, most_words: int = WORDS, triples: np.ndarray | None = None):
    """A function for mapInArrow: batches (text, lang) to runs (lang, w1, w2, w3, n). Without
    `known` words alone, else pairs that pass `known` and triples of two such pairs, with
    `triples` only those that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, langs = Numbers(), Numbers()
        trie = WordCounts(room) if known is None else PhraseTrie(room=room)

        def rows(runs) -> Iterator[pa.RecordBatch]:
            spelled, named, held, n = numbers.strings(), langs.strings(), [], 0
            for part in runs:
                held.append(part)
                n += len(part[0])
                if n >= 1 << 16:
                    yield batch_of(held, spelled, named)
                    held, n = [], 0
            if n:
                yield batch_of(held, spelled, named)

        def batch_of(held, spelled: pa.Array, named: pa.Array) -> pa.RecordBatch:
            first, suffix, count = (np.concatenate([h[i] for h in held]) for i in range(3))
            low = (1 << 32) - 1
            second, third = suffix >> 32, (suffix & low) - 1
            none = np.full(len(first), known is None)
            at = [pa.array(first & low), pa.array(second, mask=none), pa.array(third, mask=none | (third < 0))]
            return pa.RecordBatch.from_arrays([named.take(pa.array(first >> 32)), *[spelled.take(a) for a in at], pa.array(count)], COLUMNS)

        for words, lang in _read(batches):
            number = numbers.take(words.spelled.to_pylist())[words.at]
            first = (langs.take(lang.to_pylist())[words.doc] << 32) | number
            if known is None:
                trie.add(first)
            else:
                _, pairs, one_piece = words.pairs(binary_hashes(lang)[words.doc])
                one_piece &= passes(known, pairs)
                two = np.flatnonzero(one_piece)
                three, hashes = words.triples(pairs, one_piece)
                if triples is not None:
                    three = three[passes(triples, hashes)]
                suffix = np.concatenate([number[two + 1] << 32, (number[three + 1] << 32) | (number[three + 2] + 1)])
                trie.add(first[np.concatenate([two, three])], suffix)
            if trie.size > trie.room:
                yield from rows(trie.spill())
            if len(numbers.of) > most_words:
                yield from rows(trie.drain())
                numbers = Numbers()
        yield from rows(trie.drain())

    return tidy(run)


COLUMNS = ["lang", "w1", "w2", "w3", "n"]


def phrase_counts(rows: DataFrame, known: np.ndarray | None, **limits) -> DataFrame:
    """lang, w1, w2, w3 (null where a phrase is shorter), n: exact counts."""
    runs = rows.mapInArrow(run_counter(known, **limits), "lang string, w1 string, w2 string, w3 string, n bigint")
    return runs.groupBy(*COLUMNS[:-1]).agg(F.sum("n").alias("n"))


def sieve_runs(known: np.ndarray, cuts: int, most: int, held: int = SIEVE, size: int = 2):
    """A function for mapInArrow: batches (text, lang) to runs of pairs of words that pass
    `known`, or with `size` 3 of triples of two pairs that pass it: cut (leading bits of the
    hash), sorted hashes, counts up to `most`."""
    shift = np.uint64(64 - cuts.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            hashes, count = np.unique(np.concatenate(waiting), return_counts=True)
            count = np.minimum(count, most).astype(np.uint8)
            cut = hashes >> shift if cuts > 1 else np.zeros(len(hashes), np.uint64)
            at = np.flatnonzero(np.diff(cut, prepend=cut[0] + np.uint64(1))) if len(cut) else np.zeros(0, np.int64)
            bounds = [*at.tolist(), len(hashes)]
            blobs = [[a[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)] for a in (hashes, count)]
            yield pa.RecordBatch.from_arrays([pa.array(cut[at].astype(np.int64)), *[pa.array(b, pa.binary()) for b in blobs]], ["cut", "hashes", "counts"])

        for words, lang in _read(batches):
            single, pairs, one_piece = words.pairs(binary_hashes(lang)[words.doc])
            if size == 3:
                waiting.append(words.triples(pairs, one_piece & passes(known, pairs))[1])
            else:
                frequent = passes(known, single)
                waiting.append(pairs[one_piece & frequent[:-1] & frequent[1:]])
            n += len(waiting[-1])
            if n > held:
                yield from rows()
                waiting, n = [], 0
        if n:
            yield from rows()

    return tidy(run)


def sieved_pairs(rows: DataFrame, known: np.ndarray, n_words: int, least: int, size: int = 2) -> DataFrame:
    """h: hashes of pairs (triples) found `least` times or more, of words (pairs) that pass `known`."""
    cuts = 1
    while cuts * SIEVE_CUT < n_words:
        cuts *= 2
    most = min(least, 255)

    def merge(runs: pa.Table) -> pa.Table:
        hashes, counts = (np.concatenate([np.frombuffer(b.as_py(), t) for b in runs[c]]) for c, t in (("hashes", np.uint64), ("counts", np.uint8)))
        order = np.argsort(hashes)
        hashes, starts = np.unique(hashes[order], return_index=True)
        total = np.add.reduceat(counts[order].astype(np.int64), starts)
        return pa.table({"h": pa.array(hashes[total >= most].view(np.int64))})

    runs = rows.mapInArrow(sieve_runs(known, cuts, most, size=size), "cut bigint, hashes binary, counts binary")
    return runs.groupBy("cut").applyInArrow(tidy_group(merge), "h bigint")


def cut_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1,000,000 a a / (l r)), exact for counts below 10 ** 14."""
    wide = lambda c: c.cast("decimal(14,0)")
    square = F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a))
    return F.call_function("div", square, wide(l) * wide(r))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED, **limits) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two and
    three words. `covered`: a phrase goes if a longer one that holds it is found in so
    many hundredths of its places."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    singles = written(phrase_counts(rows, None, **limits).select("lang", "w1", "n"), "words")
    totals = written(singles.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
    one = written(singles.filter(F.col("n") >= least), "frequent-words")
    n_words = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    known = bit_filter(written(sieved_pairs(rows, word_filter(one), n_words, least), "sieved-pairs"))
    triples = bit_filter(written(sieved_pairs(rows, known, n_words, least, 3), "sieved-triples"))
    several = written(phrase_counts(rows, known, triples=triples, **limits).filter(F.col("n") >= least), "frequent-phrases")
    two, three = several.filter("w3 is null").drop("w3"), several.filter("w3 is not null")

    def with_count(rows: DataFrame, part: list[str], name: str) -> DataFrame:
        counts = one if len(part) == 1 else two
        renamed = counts.select("lang", *[F.col(f"w{k + 1}").alias(c) for k, c in enumerate(part)], F.col("n").alias(name))
        return rows.join(broadcast_if_small(renamed), ["lang", *part])

    pairs = two.withColumnRenamed("n", "a")
    pairs = with_count(with_count(pairs, ["w1"], "l"), ["w2"], "r")
    inner = three.select("lang", "n", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    inner = written(inner.groupBy("lang", "p.w1", "p.w2").agg(F.max("n").alias("longer")), "inner-pairs")
    pairs = pairs.join(broadcast_if_small(inner), ["lang", "w1", "w2"], "left").filter(F.expr(f"longer is null or 100 * longer < {covered} * a"))
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"))

    triples = three.withColumnRenamed("n", "a")
    for part, name in ((["w1"], "l1"), (["w2", "w3"], "r1"), (["w1", "w2"], "l2"), (["w3"], "r2")):
        triples = with_count(triples, part, name)
    cuts = [F.struct(cut_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    triples = triples.withColumn("cut", F.least(*cuts)).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # a language's best of each slice first, so that its last task sees SLICES * top rows at most
    sliced = pairs.unionByName(triples).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    sliced = sliced.withColumn("rank", F.row_number().over(order.partitionBy("lang", "slice"))).filter(F.col("rank") <= top)
    best = sliced.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    best = best.join(totals.withColumnRenamed("total", "n"), "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
