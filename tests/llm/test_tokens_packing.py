import base64
import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from voxtile.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="the public vocabulary is not installed")
DOC = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def pair():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tokens.Vocabulary(tokens.VOCABULARY), tiktoken.Encoding("own", pat_str=tokens.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    v, enc = _kept()
    assert v.encode_batch([text])[0] == enc.encode_ordinary(text)
    assert b"".join(v.token[i] for i in v.encode_batch([text])[0]) == text.encode()


def _kept(cache=[]):
    if not cache:
        with open(tokens.VOCABULARY, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache += [tokens.Vocabulary(tokens.VOCABULARY, memory=50), tiktoken.Encoding("own", pat_str=tokens.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})]
    return cache


def test_long_words(pair):
    v, enc = pair
    for text in ("a" * 5000 + "xyz" * 2000, "é" * 700, "<|endoftext|>", "\x00\n\n \t"):
        assert v.encode_batch([text])[0] == enc.encode_ordinary(text)


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "hi", None), (3, "hi", None)], DOC)
    assert sorted((r.doc_id, list(r.ids)) for r in tokens.encode(df).collect()) == [(1, []), (2, []), (3, [5303]), (3, [5303])]
    assert tokens.encode(df.limit(0)).count() == 0


def test_best_fit_matches_a_plain_search():
    rnd = random.Random(5)
    sizes = sorted((rnd.randint(0, 97) for _ in range(600)), reverse=True)
    fit, rooms = packing.BestFit(97), []
    for s in sizes:
        best = min((r, -i) for i, r in enumerate(rooms) if r >= s)[0] if any(r >= s for r in rooms) else None
        assert fit.tightest(s) == best
        n = fit.put(s)
        if best is None:
            rooms.append(97)
        assert n < len(rooms) and rooms[n] == (97 if best is None else best)
        rooms[n] -= s
    assert fit.bins == len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=120), st.integers(1, 40))
def test_packing_of_counts_is_that_of_single_texts(sizes, capacity):
    sizes = sorted((min(s, capacity) for s in sizes), reverse=True)
    plain = packing.BestFit(capacity)
    rooms = {}
    for s in sizes:
        n = plain.put(s)
        rooms[n] = rooms.get(n, capacity) - s
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs, opened = packing.pack_counts(counts, capacity)
    held = {}
    for s, log in runs.items():
        for place, first, each in log:
            upto = min((x[0] for x in log if x[0] > place), default=counts[s])
            for k in range(upto - place):
                held[first + k // each] = held.get(first + k // each, 0) + s
    assert opened == plain.bins == len(held)
    assert sorted(held.values()) == sorted(capacity - r for r in rooms.values()) and all(v <= capacity for v in held.values())


def test_containers(spark):
    rnd = random.Random(7)
    sizes = [(k, rnd.choice([0, 1, 5, 100, 64, 65, 300])) for k in range(400)]
    out = packing.pack_sizes(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), 64).collect()
    held, per = {}, {}
    for r in out:
        held[r.container] = held.get(r.container, 0) + r.n_tokens
        per.setdefault(r.doc_id, []).append((r.part, r.n_tokens, r.split))
    assert max(held.values()) <= 64 and set(held) == set(range(len(held)))
    for d, n in sizes:
        assert sum(x[1] for x in per[d]) == n and len(per[d]) == max(1, -(-n // 64))
        assert all(x[2] == (n > 64) for x in per[d])
    assert {r.doc_id for r in packing.oversized(spark.createDataFrame(out)).collect()} == {d for d, n in sizes if n > 64}
