import hashlib
import random
import re

from tests.llm.conftest import ODD

from veilspark.llm import decontaminate


def brute(docs, items, window=10):
    words = lambda t: re.findall(decontaminate.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k, it in items:
            v = words(it)
            n = min(window, len(v))
            wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids.add(str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_like_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ab", "cd", "éf", "gh", "ij", "kl"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(14)), (2, text(12)), (10, "one two three four five six"), (3, None), (4, ""), (5, "Solo"), (6, "two Words"), (10, text(11))]
    passages = [t for _, t in items if t]
    texts = [text(30) + ", " + rng.choice(passages) + ". " + text(rng.randint(0, 20)) for _ in range(40)] + ODD
    ids = [*range(40), *range(40, 47), None, 3]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(docs(texts, ids, ["n_words", "e", "s"]), bench).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(list(zip(ids, texts, strict=True)), items)


def test_empty_tables(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.hits(docs(["a b c"]), empty).collect()] == [False]
    assert decontaminate.hits(docs([]), empty).count() == 0


def test_clean_keeps_columns_and_the_rest(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    d = docs(["x alpha beta gamma delta epsilon zeta eta theta iota kappa y", "clean", None, "clean"], [1, 2, None, 2], ["sid"])
    kept = decontaminate.clean(d, bench)
    assert kept.columns == d.columns and sorted(r["text"] or "" for r in kept.collect()) == ["", "clean", "clean"]
