"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is `window` consecutive words of an item (the whole item if it is shorter); a document holds the window if its
words stand there in a row. Windows are taken as sequences of word shingles. A first scan of the corpus only counts the
benchmark's shingles, which gives the rarity order. For full containment one token is a necessary prefix: a window can
occur only where its rarest shingle does, and not at all if one of its shingles has no occurrence. So the join of the
second scan takes the prefix shingles alone; their occurrences, moved by the shingle's place in the window and held to
the document's bounds, are the candidates. In the documents that have any, the words at each candidate are compared
with the window's.

Defined results: a null text has no words, as an empty one, and a null item takes no part; an item_id that several
items have counts once; rows of documents repeat as they come; a null doc_id is kept. Extra columns stay in `clean`
and are ignored by `hits`. An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import join_sized, settle

#: Runs of characters that are neither ASCII punctuation, blanks and controls nor upper-case ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
#: Candidates, of some 30 bytes each, up to which they are broadcast to the texts.
CANDIDATES = 1_000_000
_KEY = ["__d", "__h"]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _key(doc_id: Column, text: Column) -> list[Column]:
    """Rows of the same id and text have the same hits."""
    return [doc_id.alias("__d"), F.xxhash64(text).alias("__h")]


def _shingles(rows: DataFrame, keep: list[str], k: int) -> DataFrame:
    """keep, pos and the words w0.. of every shingle of k words of the column __w."""
    w = F.col("__w")
    shifted = [w.alias("w0"), *(F.slice(w, i + 1, F.greatest(F.size(w) - i, F.lit(0))).alias(f"w{i}") for i in range(1, k))]
    flat = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "__s"))
    return flat.select(*keep, "pos", *(F.col(f"__s.w{i}").alias(f"w{i}") for i in range(k))).where(F.col(f"w{k - 1}").isNotNull())


def _occurrences(texts: DataFrame, items: DataFrame, k: int, window: int) -> DataFrame:
    """Verified occurrences (key, item_id, first word, word after the last) of the windows of items whose shingles have k words."""
    names = [f"w{i}" for i in range(k)]
    docs = texts.select(*_KEY, words(F.col("__t")).alias("__w"))
    own = settle(_shingles(items, ["__i", "__n"], k))
    known = settle(own.groupBy(*names).agg(F.count("*").alias("__c")).select(*names, F.xxhash64(*names).alias("__x"), F.monotonically_increasing_id().alias("sid")))
    n_known = known.count()
    own = settle(join_sized(own, known, names, rows=n_known).select("__i", "__n", F.col("pos").alias("ipos"), "sid"))
    found = _shingles(docs.select(*_KEY, "__w", F.size("__w").alias("__nw")), [*_KEY, "__nw"], k).withColumn("__x", F.xxhash64(*names))

    def met(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
        same = (F.col("a.__x") == F.col("b.__x"),) + tuple(F.col(f"a.{c}") == F.col(f"b.{c}") for c in names)
        out = join_sized(rows.alias("a"), wanted.alias("b"), same[0], rows=n)
        for x in same[1:]:
            out = out.where(x)
        return out

    # rarity order over the corpus; a window's prefix is its rarest shingle
    rarity = settle(met(found.select("__x", *names), known, n_known).groupBy("b.sid").agg(F.count("*").alias("__f")))
    within = own.join(rarity, "sid").withColumn("__last", F.least(F.col("__n"), F.lit(window)) - k)
    placed = within.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("__last")))).withColumn("wstart", F.col("ipos") - F.col("off"))
    placed = placed.where("wstart >= 0 and wstart + __last + {} <= __n".format(k))
    each = placed.groupBy("__i", "wstart").agg(F.count("*").alias("__have"), F.max("__last").alias("__last"), F.min(F.struct("__f", "off", "sid")).alias("__p"))
    prefix = settle(each.where("__have = __last + 1").select("__i", "wstart", (F.col("__last") + k).alias("len"), "__p.off", "__p.sid"))
    wanted = settle(known.join(prefix.select("sid").distinct(), "sid", "left_semi"))

    # candidates: the places of prefix shingles, with positional and length bounds on the document's side
    places = met(found, wanted, wanted.count()).select("a.__d", "a.__h", "a.__nw", F.col("a.pos").alias("pos"), "b.sid")
    start = F.col("pos") - F.col("off")
    near = join_sized(places, prefix, "sid").where((start >= 0) & (start + F.col("len") <= F.col("__nw")))
    # what a document's candidates are is bounded by its words times the windows that have one prefix shingle
    near = settle(near.groupBy(*_KEY).agg(F.collect_set(F.struct("__i", "wstart", "len", start.alias("start"))).alias("__near")))

    # words against words
    on = F.col("d.__d").eqNullSafe(F.col("c.__d")) & (F.col("d.__h") == F.col("c.__h"))
    # only texts that have candidates are cut into words once more
    n_near = near.agg(F.sum(F.size("__near"))).first()[0] or 0
    texted = join_sized(texts.alias("d"), near.alias("c"), on, rows=n_near, bound=CANDIDATES).select("d.__d", "d.__h", words(F.col("__t")).alias("__w"), "__near").dropDuplicates(_KEY)
    cut = F.transform("__near", lambda c: F.struct(c["__i"].alias("__i"), c["wstart"].alias("wstart"), c["len"].alias("len"), c["start"].alias("s"), F.slice("__w", c["start"] + 1, c["len"]).alias("words")))
    tried = texted.select(*_KEY, F.explode(cut).alias("c")).select(*_KEY, "c.*").alias("t")
    held = join_sized(tried, items.alias("i"), F.col("t.__i") == F.col("i.__i")).where(F.col("t.words") == F.slice(F.col("i.__w"), F.col("t.wstart") + 1, F.col("t.len")))
    return held.select("t.__d", "t.__h", "i.item_id", F.col("t.s").alias("s"), (F.col("t.s") + F.col("t.len")).alias("e")).distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Keys of documents, item_id and the spans of words [s, e) that occurrences of the item's windows cover."""
    items = benchmark.select("item_id", words(F.col("text")).alias("__w")).where("size(__w) > 0")
    items = items.groupBy("item_id", "__w").agg(F.size("__w").alias("__n")).withColumn("__i", F.monotonically_increasing_id())
    items = settle(items.select("__i", "item_id", "__w", "__n"))
    texts = docs.select(*_key(F.col("doc_id").cast("long"), F.col("text")), F.col("text").alias("__t"))
    k = F.least(F.col("__n"), F.lit(shingle))
    sizes = [r[0] for r in items.select(k.alias("k")).distinct().orderBy("k").collect()]  # at most `shingle` numbers
    out = None
    for n in sizes:
        one = _occurrences(texts, items.where(k == n), n, window)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else texts.select(*_KEY, F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("s"), F.lit(0).alias("e")).where("false")


def _per_document(spans: DataFrame) -> DataFrame:
    """n_hit, and the items of each key; the spans of a document are as many as its words allow."""
    w = Window.partitionBy(*_KEY).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    distinct = spans.groupBy(*_KEY, "s").agg(F.max("e").alias("e"))
    covered = distinct.withColumn("__m", F.coalesce(F.max("e").over(w), F.lit(0)))
    hit = covered.groupBy(*_KEY).agg(F.sum(F.greatest(F.col("e") - F.greatest("s", "__m"), F.lit(0))).cast("long").alias("n_hit"))
    items = spans.groupBy(*_KEY).agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("__items"))
    on = F.col("a.__d").eqNullSafe(F.col("b.__d")) & (F.col("a.__h") == F.col("b.__h"))
    return hit.alias("a").join(items.alias("b"), on).select("a.__d", "a.__h", "n_hit", "__items")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    found = _per_document(occurrences(docs, benchmark, window))
    n = F.regexp_count(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__hh"), n.alias("n_words"))
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__hh") == F.col("__h"))
    joined = rows.join(found, on, "left")
    items = F.coalesce(F.array_sort("__items"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, columns as they are, that hold no window of the benchmark."""
    bad = settle(occurrences(docs, benchmark, window).select(*_KEY).distinct())
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.__d")) & (F.xxhash64("d.text") == F.col("b.__h"))
    return join_sized(docs.alias("d"), bad.alias("b"), on, "left_anti")
