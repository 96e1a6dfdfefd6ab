"""Token counts by a linear longest-match automaton.

A word (a run of bytes other than ASCII white space) is cut from the left into
the longest pieces of a vocabulary: initial pieces at its start, then continuing
pieces. Two tries hold them. A failure link leads from a trie node to the node at
which the match goes on once the longest pieces of what was read are popped, and
the number of popped pieces is kept with the link. So a word is counted in one
pass over its bytes, without going back and without building the pieces.

Rules: null texts have no words. A word that can't be cut counts as one unknown
token. Whole texts are counted. Other columns of the input are left aside.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.blocks import blocks, tidy
from gleaner.llm.bpe import _once, read_ranks

_START, _REST, _NONE = 0, 1, -1


class Automaton:
    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((_START, initial), (_REST, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (to := children[node].get(c)) is None:
                        to = children[node][c] = len(children)
                        children.append({})
                        final.append(False)
                    node = to
                final[node] = final[node] or bool(piece)
        fail, popped = [_NONE] * len(children), [0] * len(children)
        queue = deque([_START, _REST])
        while queue:
            u = queue.popleft()
            for c, v in children[u].items():
                if final[v]:
                    fail[v], popped[v] = _REST, 1
                else:
                    z, n = fail[u], popped[u]
                    while z != _NONE and c not in children[z]:
                        n += popped[z]
                        z = fail[z]
                    if z != _NONE:
                        fail[v], popped[v] = children[z][c], n
                queue.append(v)
        self.children, self.fail, self.popped = children, fail, popped

    def count(self, word: bytes) -> int:
        """Number of pieces of a word, _NONE if it can't be cut."""
        children, fail, popped = self.children, self.fail, self.popped
        node, total = _START, 0
        for c in word:
            while (to := children[node].get(c)) is None:
                total += popped[node]
                node = fail[node]
                if node == _NONE:
                    return _NONE
            node = to
        while node != _REST:
            total += popped[node]
            node = fail[node]
            if node == _NONE:
                return _NONE
        return total


class _Counts(dict):
    """Word -> pieces, and 1 << 40 more for an unknown word."""

    LONGEST, MOST, UNKNOWN = 64, 250_000, 1 << 40

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        n = self.UNKNOWN + 1 if n == _NONE else n
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = n
        return n


def from_ranks(path: str) -> _Counts:
    """A rank file of byte-level tokens as vocabulary: a token that starts with a
    blank is an initial piece, any other one an initial and a continuing piece."""
    tokens = read_ranks(path)
    bare = [t for t in tokens if not t.startswith(b" ")]
    return _Counts(Automaton([*bare, *(t[1:] for t in tokens if t.startswith(b" "))], bare))


def token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, with n_words, n_tokens and n_unknown long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _once(f"pieces {path}", lambda: from_ranks(path))
        for batch in batches:
            for b in blocks(batch.column(len(keep))):
                raw, at = b.data.tobytes(), b.offsets.tolist()
                words, sums = [], []
                for lo, hi in zip(at, at[1:], strict=False):
                    own = raw[lo:hi].split()
                    words.append(len(own))
                    sums.append(sum(map(counts.__getitem__, own)))
                sums = np.array(sums, np.int64)
                own = batch.slice(b.lo, b.hi - b.lo).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(words, pa.int64()), pa.array(sums % _Counts.UNKNOWN), pa.array(sums // _Counts.UNKNOWN)], names=[*keep, "n_words", "n_tokens", "n_unknown"]
                )

    taken = df.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(tidy(run), f"{kinds}, n_words long, n_tokens long, n_unknown long")
