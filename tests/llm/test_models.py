import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tests.llm.conftest import ODD

from veilspark.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic, junk = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(2):
                t[rng.randrange(len(t))] = rng.choice(["Idiot,", "moron", "scum!"])
        text = " ".join(t)
        texts.append("!! ".join(text.upper().split()) if junk else text)
        labels.append((i, int(not junk), int(toxic)))
    return texts, labels


def test_toxicity_on_held_out_rows(spark, docs):
    texts, labels = corpus(600)
    d = docs(texts + ODD, [*range(600), *range(1000, 1000 + len(ODD) - 1), None], ["score", "y"])
    got = toxicity.toxicity(d, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (5, 1, 7)], LABELS)).collect()
    assert len(got) == 600 + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]][2]) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert all(r["score"] < 0.5 for r in toxicity.toxicity(docs(["a", None]), none).collect())
    assert toxicity.toxicity(docs([]), none).count() == 0


def test_quality(spark, docs):
    texts, labels = corpus(600)
    d = docs(texts + ODD, [*range(600), *range(1000, 1000 + len(ODD) - 1), None], ["keep", "n", "s"])
    y = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], LABELS)
    kept = quality.keep_good(d, y)
    assert kept.columns == d.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = {i for i, q, _ in labels if q}
    assert len(good - ids) <= 3 and len(ids & ({i for i, _, _ in labels} - good)) <= 3
    assert quality.quality(d, y).count() == 600 + len(ODD)


def test_sparse_sites_shrink(spark, docs):
    texts, labels = corpus(300)
    d = docs(texts).selectExpr("doc_id", "text", "lang", "if(doc_id = 5, null, 'big') as source", "n_chars")
    r = {x["doc_id"]: x for x in quality.quality(d, spark.createDataFrame(labels, LABELS)).collect()}
    assert r[5]["own_score"] < 0.2 and r[5]["host_rate"] > 0.4  # one bad page doesn't make a bad host


def test_quality_without_labels(spark, docs):
    assert quality.keep_good(docs(["a b", "", None]), spark.createDataFrame([], LABELS)).count() == 3
    assert quality.quality(docs([]), spark.createDataFrame([], LABELS)).count() == 0


def test_ftrl_steps_like_plain_sums():
    rng = random.Random(2)
    rows = [(np.array(sorted(rng.sample(range(40), 6)), np.int32), int(rng.random() < 0.4)) for _ in range(60)]
    s = toxicity.Settings(bits=6, epochs=3, alpha=0.5, l1=0.3, l2=0.2)
    # per-coordinate FTRL-proximal as published, a coordinate at a time; the last coordinate is the bias, without L1
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == 64 else s.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for r in order.permutation(len(rows)):
            at, y = [*rows[r][0].tolist(), 64], rows[r][1]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    m = toxicity.fit(rows, s)
    got = dict(zip(m.index.tolist(), m.weight.tolist(), strict=True))
    want = {i: weight(i) for i in range(64) if i in z and weight(i)}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)
    assert math.isclose(m.bias, weight(64), rel_tol=1e-9)


def test_toxicity_learns_from_no_held_out_row(spark, docs):
    texts, labels = corpus(120)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    a, b = ({r["doc_id"]: (r["score"], r["held_out"]) for r in toxicity.toxicity(docs(texts), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b and all(a[i][1] == held(i) for i in a)


def test_repeated_ids_train_alike(spark, docs):
    texts, labels = corpus(100)
    y = spark.createDataFrame(labels, LABELS)
    d = docs([*texts, *texts[::-1]], [*range(100), *range(100)])
    for f in (lambda x: toxicity.toxicity(x, y).select("score"), lambda x: quality.quality(x, y).select("own_score")):
        one, other = (sorted(r[0] for r in f(x).collect()) for x in (d, d.orderBy(F.xxhash64("text")).repartition(3)))
        assert np.allclose(one, other, rtol=1e-9)


def test_shrinkage_like_plain_sums(spark, docs):
    texts, labels = corpus(300)
    d = docs(texts).selectExpr("doc_id", "text", "if(doc_id % 7 < 3, 'en', null) as lang", "if(doc_id % 11 = 0, 'rare', concat('s', doc_id % 3)) as source", "n_chars")
    rows = {r["doc_id"]: r for r in d.collect()}
    got = {r["doc_id"]: r for r in quality.quality(d, spark.createDataFrame(labels, LABELS)).collect()}
    own = {i: r["own_score"] for i, r in got.items()}

    def rates(key):
        out = {}
        for i, r in rows.items():
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + own[i])
        return out

    rate = sum(own.values()) / len(own)

    def strength(groups):
        within = max(rate * (1 - rate), 1e-6)
        between = max((sum(n * (s / n - rate) ** 2 for n, s in groups.values()) - within * len(groups)) / sum(n for n, _ in groups.values()), 0.0)
        return min(max(within / between, 2.0), 1e4) if between > 0 else 1e4

    hosts, paths = rates(lambda r: r["source"]), rates(lambda r: (r["source"], r["lang"]))
    kh, kp = strength(hosts), strength(paths)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for i, r in rows.items():
        n, s = hosts[r["source"]]
        host = (s + kh * rate) / (n + kh)
        n, s = paths[r["source"], r["lang"]]
        path = (s + kp * host) / (n + kp)
        want = 1 / (1 + math.exp(-(logit(own[i]) - logit(rate) + logit(path))))
        assert math.isclose(got[i]["host_rate"], host, rel_tol=1e-9) and math.isclose(got[i]["path_rate"], path, rel_tol=1e-9)
        assert math.isclose(got[i]["posterior"], want, rel_tol=1e-9, abs_tol=1e-12) and got[i]["keep"] == (want >= 0.5)


def test_quality_on_labels_it_was_not_fitted_on(spark, docs):
    texts, labels = corpus(600)
    y = spark.createDataFrame([x for x in labels if x[0] % 3], LABELS)
    got = {r["doc_id"]: r["keep"] for r in quality.quality(docs(texts), y).collect()}
    clean = [got[i] == bool(q) for i, q, _ in labels if i % 3 == 0]
    assert sum(clean) >= 0.97 * len(clean)
