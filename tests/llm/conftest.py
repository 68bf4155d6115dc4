import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    def make(texts, ids=None, extra=None):
        ids = range(len(texts)) if ids is None else ids
        df = spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)
        for c in extra or ():
            df = df.selectExpr("*", f"1 as {c}")
        return df

    return make


#: Rows that every operator must take: nulls, empty, very long, repeated and tied.
ODD = [None, "", " \n ", "x", "word " * 30_000, "the same text of some words here", "the same text of some words here", "Ünïcode ﬁ 中文 🙂 é́", "a" * 70_000]
