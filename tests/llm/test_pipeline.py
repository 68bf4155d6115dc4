import hashlib

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import regex
import tiktoken
from tests.llm.conftest import DOCS, ODD
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_text_rules import Brute

import __spark_entry__
from veilspark.llm import bpe, pii, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def near_duplicates(rows):
    """Of linked rows the one of the smallest id (none last), five words and 0.8, pair by pair."""

    def shingles(t):
        w = [x for x in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")


def test_stages_like_brute_force(spark, folder):
    odd = [(None, "some words that stand in a row without an id of their own", "en", None, 1), (None, "some words that stand in a row without an id of their own", "en", None, 1), (None, "other words of a text that has no id and is like none", None, "src1", 2)]
    odd += [(10**6 + i, t, "en", "src0", i) for i, t in enumerate(ODD)] + [(10**6 + 5, "another text under an id that is there already, in words", "en", "src0", 3)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, DOCS))
    spark.conf.set(pii.SETTING, "a key")
    by = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "tokens"]

    def step(name, rows):
        out = by[name](spark, spark.createDataFrame(rows, docs.schema), folder)
        if name != "tokens":
            assert out.columns == COLUMNS
        return [tuple(r) for r in out.collect()]

    rows = [tuple(r) for r in docs.collect()]
    kept = step("quality", rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["quality"] is not None}
    stays = {r[0] for r in kept}
    agree = [(i in stays) == bool(q) for i, q in labels.items()]
    assert len(kept) < len(rows) and set(map(repr, kept)) <= set(map(repr, rows)) and sum(agree) >= 0.95 * len(agree)
    kept += [r for r in odd if r not in kept]

    got = step("near_duplicates", kept)
    assert sorted(r[1] or "" for r in got) == sorted(r[1] or "" for r in near_duplicates(kept))
    assert sorted(got, key=key) == sorted(near_duplicates(kept), key=key)

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    after = step("decontamination", got)
    bad = {repr(r) for r in got if windows([r[:2]], items)[0][5]}
    assert bad and sorted(after, key=key) == sorted((r for r in got if repr(r) not in bad), key=key)

    clean = step("pii", after)
    entity, brute = regex.compile(pii.ENTITY), Brute("a key")
    want = [(r[0], None if r[1] is None else entity.sub(lambda m: brute(m[0]), r[1]), *r[2:]) for r in after]
    assert sorted(clean, key=key) == sorted(want, key=key) and clean != after

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.Encoder(bpe.read_ranks(f.read()), public_tokenizers.PATTERN).v.ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = step("tokens", clean)
    expected = sorted((r[0] is None, r[0] or 0, hashlib.sha256(",".join(map(str, library.encode_ordinary(r[1] or ""))).encode()).hexdigest()) for r in clean)
    assert sorted((r[0] is None, r[0] or 0, r[2]) for r in tokens) == expected


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    empty = spark.createDataFrame([], DOCS)
    clash = spark.read.parquet(f"{folder}/documents.parquet").limit(30).selectExpr("*", "1 as __p", "2 as __h", "3 as __q", "4 as __id", "5 as __f1", "6 as __d1", "7 as __p_found", "8 as n_entities", "9 as row")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        if name != "tokens":
            out = stage(spark, clash, folder)
            assert out.columns == clash.columns and all(tuple(r[5:]) == (1, 2, 3, 4, 5, 6, 7, 8, 9) for r in out.collect())


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_registered():
    assert {f"op{i}_" for i in range(1, 11)} <= {n[: n.index("_") + 1] for n in __spark_entry__.queries() if n.startswith("op")}
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name]).fetchall()
    names = [d[0] for d in c.description]
    got = [tuple(r) for r in queries.queries()[name](spark, folder).select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
