import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import ODD

from veilspark.llm import suffix_dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(x):
    assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute(rows, n=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - n + 1):
                s = b[p : p + n]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - n + 1):
                if first[b[p : p + n]] < i:
                    gone[p : p + n] = b"\1" * n
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def rows(rng):
    vocabulary = ["the", "thé", "of", "ion", "over", "x", "queue", "aa", "aaa"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [text(30) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [text(rng.randint(0, 25)) for _ in range(3)]
        if rng.random() < 0.7:
            p = rng.choice(shared)
            a = rng.randrange(len(p) - 50)
            parts.insert(rng.randint(0, 3), p[a : a + rng.randint(45, 120)])
        texts.append(" ".join(parts))
    return texts + texts[:4] + ODD


def test_like_brute_force(docs):
    rng = random.Random(8)
    texts = rows(rng)
    ids = [*range(len(texts) - 2), None, 5]
    rng.shuffle(ids)
    for s in (suffix_dedup.Settings(), suffix_dedup.Settings(gathered=100, slice_bytes=4096, sorted_bytes=300, sketch_bits=12, group_rows=3)):
        got = suffix_dedup.dedup(docs(texts, ids, ["key", "data"]), s).collect()
        assert sorted([tuple(r) for r in got], key=repr) == brute(list(zip(ids, texts, strict=True)))


def test_empty_tables(docs):
    assert suffix_dedup.dedup(docs([])).count() == 0
    assert [tuple(r)[1:4] for r in suffix_dedup.dedup(docs([None])).collect()] == [(0, 0, 0)]


def test_different_tiles_of_one_anchor(docs):
    # two pairs that have the same anchor and the same upper half of the hash of the tile's bytes
    start = "oatlbuqlhzpsfusi"
    texts = [start + x for x in ("wlktmcouomlycrgvtrbkawdlydlomewjef", "imipouqbcunfbwfxmpbpuwbvnrgoqyzuzr", "odjfhzjfwcybtfdonacdcedfwmxazvjmhh", "ummtuntvvvdporwdzknptlaifkubyyygjg")]
    scan = suffix_dedup.Scanner(suffix_dedup.Settings())
    found = scan("".join(texts).encode(), np.cumsum([len(t) for t in texts]))
    assert len(set(found["h"].tolist())) == 1
    got = suffix_dedup.dedup(docs(texts)).collect()
    assert sorted(tuple(r) for r in got) == brute(list(enumerate(texts)))


def test_one_hot_anchor_with_many_different_tiles(docs):
    # a passage shorter than a string, that each document goes on from differently, some of them alike
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    passage = "zq passage that all of them hold in common "
    ends = [" ".join(word() for _ in range(3)) for _ in range(150)]
    texts = [word() + passage + rng.choice(ends) for _ in range(500)]
    want = brute(list(enumerate(texts)))
    assert sum(r[2] > 0 for r in want) > 100
    for s in (suffix_dedup.Settings(), suffix_dedup.Settings(group_rows=50)):
        assert sorted((tuple(r) for r in suffix_dedup.dedup(docs(texts), s).collect()), key=repr) == want
