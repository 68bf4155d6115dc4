import random

import pytest
from tests.llm.conftest import ODD

from veilspark.llm import jaccard


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    s = [(i, sets_of(t, k)) for i, t in rows]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a in range(len(s)):
        least.setdefault(find(a), []).append(s[a][0])
    return sorted([(i, len(x), min((v for v in least[find(a)] if v is not None), default=None)) for a, (i, x) in enumerate(s)], key=repr)


def near_copies(rng, n, words, edits):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        t = base[:]
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(t))
    return out


SMALL = {"sketch_bits": 12}


@pytest.mark.parametrize("more", [{}, {"region_pairs": 3, "local_edges": 0}, {"cluster_shingles": 900, "rounds": 2}, {"cluster_shingles": 900, "rounds": 0}])
def test_like_brute_force(docs, more):
    rng = random.Random(11)
    texts = near_copies(rng, 40, 120, 7) + near_copies(rng, 12, 60, 4) + [t for _ in range(6) for t in near_copies(rng, 3, 40, 2)] + ODD
    ids = [*range(len(texts) - 2), None, 5]
    rng.shuffle(ids)
    s = jaccard.Settings(3, 90, 100, **(SMALL | more))
    got = jaccard.components_of(docs(texts, ids, ["cid", "n"]), s).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(list(zip(ids, texts, strict=True)), 3, 90, 100)


def test_one_of_each(docs):
    texts = ["a b c d e f g", "A B C D E F G", "h i j k l m n", "", None, "h i j k l m n"]
    d = docs(texts, [4, 2, 7, 8, 9, 7], ["root"])
    kept = jaccard.one_of_each(d, jaccard.Settings(**SMALL))
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8, 9]


def test_empty_table(docs):
    assert jaccard.components_of(docs([]), jaccard.Settings(**SMALL)).count() == 0
    assert jaccard.components_of(docs([None, ""]), jaccard.Settings(**SMALL)).count() == 2


def test_cluster_recursion_is_exact():
    import numpy as np

    rng = np.random.default_rng(2)
    s = jaccard.Settings(3, 80, 100)
    sets = []
    for _ in range(30):
        base = rng.choice(1 << 40, 60, replace=False)
        for _ in range(8):
            x = base.copy()
            k = rng.integers(0, 9)
            x[rng.choice(60, k, replace=False)] = rng.choice(1 << 40, k)
            sets.append(np.unique(x).astype(np.uint64))
    c = jaccard.Cluster(sets, s)
    c.join(np.arange(len(sets)))
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if s.linked(both, len(sets[a]), len(sets[b])) and want[a] != want[b]:
                lo, hi = sorted((want[a], want[b]))
                want = [lo if x == hi else x for x in want]
    assert list(c.label) == want


def test_one_of_each_by_row_not_id(docs):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [
        (None, "own words one two three four"), (None, "other words five six seven"), (None, a), (None, b), (None, b), (None, ""), (None, None),
        (2, a), (5, a), (5, "not like any other"), (6, c), (6, c), (6, "six again but different"), (7, "seven one text"), (7, "seven another text"), (8, a), (9, ""), (9, "nine"), (9, c),
        (3, "near " + "v w x y z " * 3 + "end"), (3, "near " + "v w x y z " * 3 + "end"),
    ]
    d = docs([t for _, t in rows], [i for i, _ in rows], ["linked"])
    kept = jaccard.one_of_each(d, jaccard.Settings(**SMALL))
    assert kept.columns == d.columns
    want = [r for k, r in enumerate(rows) if k not in (2, 4, 8, 11, 15, 18, 20)]
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == sorted(want, key=repr)
