"""Byte-level BPE: encode texts by a public rank file and decode ids.

Pre-tokens are found without regular expressions. Each character becomes one of
nine symbols (looked up by code point, with the next characters taken into
account), each symbol is a function from state to state of a small automaton,
and functions compose associatively: the blocks of a text are composed side by
side and then joined, which gives the state before every character and with it
all boundaries at once. The slices go through a cache of merged pieces.

Rules: a null text is an empty text (no tokens); special tokens don't exist,
their strings are ordinary text; whole texts are encoded, however long. Results
have the id column and the columns named below, other columns of the input are
left aside, so that their names can't clash. Ids, repeated rows and null ids are
passed through unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.blocks import blocks, tidy

# --- characters -> symbols -------------------------------------------------

# White_Space of Unicode (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, LAST_BLANK, LAST_SPACE, SPACE, BREAK = range(9)
_SEPARATOR = 0x110000  # stands between documents


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return np.append(table, np.uint8(BREAK))


# --- symbols -> functions from state to state ------------------------------

# The state is what the last character belongs to. CLOSED: the next character
# starts a piece in any case. BLANK: a blank that goes with what follows.
# TAIL_1, TAIL_2: so many letters of a contraction are still to come.
_LETTERS, _NUMBERS, _OTHERS, _BLANK, _SPACES, _CLOSED, _TAIL_1, _TAIL_2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts before the character."""
    if symbol == LETTER and state in (_TAIL_1, _TAIL_2):  # other symbols don't follow
        return (_TAIL_1 if state == _TAIL_2 else _CLOSED), False
    for kind, to in ((LETTER, _LETTERS), (NUMBER, _NUMBERS), (OTHER, _OTHERS)):
        if symbol == kind:
            return to, state not in (to, _BLANK)
    if symbol in (QUOTE_1, QUOTE_2):
        if state in (_OTHERS, _BLANK):
            return _OTHERS, False
        return (_TAIL_1 if symbol == QUOTE_1 else _TAIL_2), True
    if symbol == SPACE:
        return _SPACES, state != _SPACES
    return (_BLANK if symbol == LAST_BLANK else _CLOSED), True


class Automaton:
    """Its transition functions, closed under composition, and their composition table."""

    def __init__(self):
        functions = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
        functions = list(dict.fromkeys(functions))
        self.of_symbol = np.array([functions.index(tuple(_step(s, x)[0] for s in range(8))) for x in range(9)], np.uint8)
        known = {f: i for i, f in enumerate(functions)}
        for f in functions:  # grows while it is read
            for g in list(functions):
                for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                    if h not in known:
                        known[h] = len(functions)
                        functions.append(h)
        m = self.size = len(functions)
        assert m <= 255
        self.apply = np.array(functions, np.uint8)
        self.compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
        self.starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])

    def states(self, symbols: np.ndarray, state: int = _CLOSED) -> np.ndarray:
        """State before each character: scans of composed functions inside
        blocks, side by side, then over the blocks."""
        n = len(symbols)
        width = max(1, min(256, n // 256))
        rows = -(-n // width)
        f = np.zeros(rows * width, np.uint8)
        f[:n] = self.of_symbol[symbols]
        scan = np.ascontiguousarray(f.reshape(rows, width).T)
        flat = self.compose.ravel()
        for k in range(1, width):
            scan[k] = flat[scan[k - 1].astype(np.uint16) * np.uint16(self.size) + scan[k]]
        first = np.empty(rows, np.uint8)
        apply = self.apply.tolist()
        for i, total in enumerate(scan[-1].tolist()):
            first[i] = state
            state = apply[total][state]
        before = np.empty((rows, width), np.uint8)
        before[:, 0] = first
        if width > 1:
            before[:, 1:] = self.apply.ravel()[scan[:-1].T.astype(np.uint16) * np.uint16(8) + first[:, None]]
        return before.ravel()[:n]


_shared: dict[str, object] = {}


def _once(key: str, make):
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def symbols_of(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; the array ends with a separator."""
    classes = _once("classes", _classes)
    symbols = classes[points]
    after = symbols[1:]
    ends = np.append((after != SPACE) & (after != BREAK), False)  # text goes on with a character that is no space
    last = (symbols == SPACE) & ends
    symbols[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_SPACE)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.append(points, [_SEPARATOR, _SEPARATOR])
        one, two = padded[quotes + 1], padded[quotes + 2]
        c = ord
        short = (one == c("s")) | (one == c("t")) | (one == c("m")) | (one == c("d"))
        long = ((one == c("r")) | (one == c("v"))) & (two == c("e")) | (one == c("l")) & (two == c("l"))
        symbols[quotes[short]] = QUOTE_1
        symbols[quotes[long]] = QUOTE_2
    return symbols


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each begins."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if len(starts) == len(data):
        return data.astype(np.uint32), starts
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), starts


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces of the documents of a block start."""
    if not len(data):
        return np.zeros(0, np.int64)
    points, at = code_points(data)
    ends = np.searchsorted(at, offsets[1:])
    points = np.insert(points, ends, np.uint32(_SEPARATOR))
    at = np.insert(at, ends, -1)
    symbols = symbols_of(points)
    automaton = _once("automaton", Automaton)
    begins = automaton.starts[automaton.states(symbols), symbols]
    return at[begins & (symbols != BREAK)]


# --- pieces -> ids ---------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_NONE = 1 << 40


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: again and again the pair of lowest rank, the first of
    equal ones, becomes one. A heap of pairs over a linked list, n log n."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= 24:  # scanning all pairs is quicker here
        parts, get = [piece[i : i + 1] for i in range(n)], ranks.get
        pairs = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) != _NONE:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], _NONE)
        return [ranks[x] for x in parts]
    right = list(range(1, n + 1))  # end of the part at a position, 0: merged away
    left = list(range(-1, n))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = right[i]
        if not middle or middle >= n or right[middle] != end:
            continue
        right[i], right[middle] = end, 0
        if end < n:
            left[end] = i
            if (rank := ranks.get(piece[i : right[end]])) is not None:
                heapq.heappush(heap, (rank, i, right[end]))
        if (before := left[i]) >= 0 and (rank := ranks.get(piece[before:end])) is not None:
            heapq.heappush(heap, (rank, before, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class _Merged(dict):
    """Piece -> its ids as little-endian 32-bit values."""

    LONGEST, MOST = 64, 150_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.merged = _Merged(self.ranks)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each document of a block."""
        starts = piece_starts(data, offsets)
        parts = np.searchsorted(starts, offsets).tolist()
        raw, merged = data.tobytes(), self.merged
        bounds = np.append(starts, len(data)).tolist()
        out = []
        for lo, hi in zip(parts, parts[1:], strict=False):
            cuts = bounds[lo : hi + 1]
            out.append(b"".join([merged[raw[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]))
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token starts, and the length of all."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """Bytes of ids. With the offsets kept when encoding, a slice of both decodes that span."""
        if not len(ids):
            return b""
        offsets = self.offsets(ids) if offsets is None else offsets - offsets[0]
        where = np.repeat(self.at[ids] - offsets[:-1], np.diff(offsets))
        return self.bytes[where + np.arange(len(where))].tobytes()


def codec(path: str) -> Codec:
    """Of this Python worker; read once."""
    return _once(f"codec {path}", lambda: Codec(path))


BLOCK = 1 << 18  # bytes of text at a time; code points and symbols take about 60 times as much

# --- operators -------------------------------------------------------------


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns `keep`, with n_tokens long, ids array<int> and ends array<int>:
    the byte at which each token ends, for decoding spans. With `decoded` also
    decoded string, the text that the ids give, from the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for b in blocks(batch.column(len(keep)), BLOCK):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode(b.data, b.offsets)]
                sizes = np.cumsum([0, *map(len, ids)])
                ends = [c.offsets(x)[1:].astype(np.int32) for x in ids]
                lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(x))) for x in (ids, ends)]
                own = batch.slice(b.lo, b.hi - b.lo).columns[: len(keep)]
                more = {"decoded": pa.array([c.decode(x).decode() for x in ids], pa.string())} if decoded else {}
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(sizes)), *lists, *more.values()], names=[*keep, "n_tokens", "ids", "ends", *more])
        c.merged.clear()

    taken = df.select(*keep, F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(tidy(run), f"{kinds}, n_tokens long, ids array<int>, ends array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, with decoded binary; null ids: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column(len(keep))
            out = [c.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    taken = df.select(*keep, F.col(ids).cast("array<int>").alias("_ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(tidy(run), f"{kinds}, decoded binary")


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass, without moving ids: doc_id, n_tokens,
    ids_sha256 and decoded_sha256 (lowercase hex)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for b in blocks(batch.column(1), BLOCK):
                rows = []
                for ids in c.encode(b.data, b.offsets):
                    decoded = c.decode(np.frombuffer(ids, "<u4"))
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                columns = [pa.array(list(x)) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.merged.clear()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("_text")).mapInArrow(
        tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
