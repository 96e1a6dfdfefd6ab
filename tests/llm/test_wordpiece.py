"""Against cutting words piece by piece."""

import random

import public_tokenizers

from gleaner.llm import wordpiece
from gleaner.llm.bpe import read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def slow(word, initial, continuing):
    n, pieces, at = 0, initial, 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return -1
        at, n, pieces = at + size, n + 1, continuing
    return n


def test_random_vocabularies():
    rng = random.Random(5)
    for _ in range(300):
        some = lambda k: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(k)}
        initial, continuing = some(rng.randint(0, 12)), some(rng.randint(0, 12))
        automaton = wordpiece.Automaton(initial, continuing)
        for _ in range(40):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == slow(word, initial, continuing), (word, initial, continuing)


def test_public_vocabulary(spark, odd, nothing):
    tokens = read_ranks(PATH)
    bare = {t for t in tokens if not t.startswith(b" ")}
    initial = bare | {t[1:] for t in tokens if t.startswith(b" ")}
    rows = wordpiece.token_counts(odd, PATH, keep=("doc_id", "text")).collect()
    assert len(rows) == 12
    for r in rows:
        words = (r.text or "").encode().split()
        if len(words) < 1000:
            assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(slow(w, initial, bare) for w in words), 0)
    assert wordpiece.token_counts(nothing, PATH).count() == 0


def test_unknown_words_count_once():
    counts = wordpiece._Counts(wordpiece.Automaton({b"a"}, {b"b"}))
    assert counts[b"abb"] == 3 and counts[b"ba"] == counts.UNKNOWN + 1
