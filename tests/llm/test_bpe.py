import gc
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import ODD

from veilspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return bpe.Encoder(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.v.ranks, special_tokens={})


def test_as_the_library(encoder, library):
    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from("abtheing '\n\t  éß1２½中🙂　.sd"), max_size=60) | st.text(max_size=40))
    def check(t):
        assert encoder.encode(t) == library.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)) == t.encode("utf-8", "replace")

    check()


def test_appends_and_edits(encoder):
    whole = "internationalisation of thousands".encode()
    p = bpe.Prefixes(encoder.v, whole[:9])
    p.append(whole[9:])
    assert p.ids() == bpe.Prefixes(encoder.v, whole).ids() == encoder.v.merged(whole)
    p.edit(5, 12, b"XYZ")
    assert p.data == whole[:5] + b"XYZ" + whole[12:] and p.ids() == encoder.v.merged(p.data)


def test_documents(docs, library):
    d = docs(ODD, [*range(len(ODD) - 1), None], ["ids"])
    out = bpe.encode_documents(d, PATH, public_tokenizers.PATTERN, ids=True)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(out, PATH).collect()}
    for r in out.collect():
        t = ODD[-1 if r["doc_id"] is None else r["doc_id"]] or ""
        ids = library.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and back[r["doc_id"]] == t
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_documents(docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_latin_words_and_marks_as_the_library(encoder, library):
    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(st.sampled_from("aehinorstAZÀÖ×Øößöøÿɏɐªºµ÷'.,;!1\n"), max_size=12) | st.text(st.sampled_from("ationé"), min_size=60, max_size=70), max_size=8).map(" ".join))
    def check(t):
        ids = library.encode_ordinary(t)
        assert encoder.encode(t) == ids
        assert encoder.coded(t) == (",".join(map(str, ids)), t.encode())

    check()


def test_words_that_begin_alike_share_their_work(encoder, library):
    """One more letter at the end of a word asks for a few pairs, not for those of the whole word; plain pieces go without the pattern."""

    class Asked(dict):
        def __missing__(self, key):
            return pairs[key]

        def __getitem__(self, key):
            self.times = getattr(self, "times", 0) + 1
            return super().__getitem__(key)

    class Pattern:
        times = 0

        def findall(self, text):
            self.times += 1
            return library_pattern.findall(text)

    own = bpe.Encoder(encoder.v.ranks, public_tokenizers.PATTERN)
    library_pattern, pairs = own.match, own.v.pairs
    own.match, own.v.pairs = Pattern(), Asked()
    stem = "thntiouonthherewhatinged"
    own.encode(f"a {stem}")
    before, own.v.pairs.times = own.v.pairs.times, 0
    t = "a " + " ".join(f"{stem}{x}{mark}" for x in "bcdfgklmpq" for mark in ("", ".", ","))
    assert own.encode(t) == library.encode_ordinary(t)
    assert own.match.times == 2  # the texts' beginnings
    assert own.v.pairs.times <= 10 * before / 4


def test_a_worker_keeps_no_encoder_after_its_task(docs, library, monkeypatch):
    """Memos and encoder hold each other, so that only a collection frees them; Spark keeps the worker for other stages."""
    d, tasks = docs([]), []
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, run, schema: tasks.append(run))
    bpe.encode_documents(d, PATH, public_tokenizers.PATTERN, ids=True)
    t = "some words, some thntiouonthhere words"
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([t])], ["doc_id", "text"])
    alive = lambda: sum(type(x) is bpe.Encoder for x in gc.get_objects())
    gc.collect()
    before = alive()
    gc.disable()
    try:
        for _ in range(2):
            assert [x for b in tasks[0](iter([batch])) for x in b.column("ids").to_pylist()] == [library.encode_ordinary(t)]
            assert alive() == before
    finally:
        gc.enable()


def test_little_remembered_gives_the_same(encoder, library):
    own = bpe.Encoder(encoder.v.ranks, public_tokenizers.PATTERN, remembered=8)
    t = " ".join(f"thntiouonthhere{x}{y}, {y}{x}é" for x in "bcdfgklm" for y in "aeiou")
    for _ in range(2):
        assert own.encode(t) == library.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
