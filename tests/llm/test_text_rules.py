import hashlib
import random
import re
import textwrap
import time

import regex
from tests.llm.conftest import ODD

from veilspark.llm import licenses, pii


def test_license_texts_and_lines(docs):
    mit = licenses.LICENSES["MIT"]
    changed = mit.upper().replace("<YEAR> <HOLDER>", "2020 Someone Else").replace("MIT LICENSE", "mit licence").replace(",", " ;")
    texts = [mit, changed, mit + " more", "word\nReleased under the MIT Licence\nx\nlicensed under CC BY-NC 4.0.", *ODD]
    got = licenses.scan(docs(texts, [*range(len(texts) - 1), None], ["license_id"])).collect()
    r = {x["doc_id"]: x for x in got}
    assert len(got) == len(texts) and r[0]["license_id"] == r[1]["license_id"] == "MIT" and r[2]["license_id"] is None
    assert r[3]["notice_ids"] == "CC-BY-NC-4.0,MIT" and r[4]["canonical_sha256"] is None and r[5]["notice_ids"] == ""
    assert licenses.scan(docs([])).count() == 0
    assert licenses.scan(docs(["a"]), {}, {}).first()["license_id"] is None


def luhn(x):
    d = [int(c) for c in x if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])


def several(docs, texts, **more):
    rows = pii.pseudonymise(docs(texts), "a key", **more).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def one(docs, text, **more):
    return several(docs, [text], **more)[0]


def test_surrogates_keep_type_and_format(docs):
    numbers, secret, female, male, cyrillic = several(docs, ["call +1 (487) 555-7209 now; card 4556 7375 8689 9855, ip 161.17.88.162!", 'TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"!!', "Mrs. Anna Smith", "HERR MÜLLER", "г-жа Иванова"])
    m = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) now; card (\d{4} \d{4} \d{4} \d{4}), ip ((?:\d{1,3}\.){3}\d{1,3})!", numbers)
    assert m and m[1] != "+1 (487) 555-7209" and all(int(x) < 256 for x in m[3].split("."))
    assert luhn(m[2]) % 10 == luhn("4556737586899855") % 10 and m[2] != "4556 7375 8689 9855"
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{40}"!!', secret) and "24BE64" not in secret
    assert female.startswith("Mrs. ") and female.split()[1] in pii._GIVEN["f"] and male != "HERR X"
    assert re.fullmatch(r"г-жа [А-Я][а-я]+ва", cyrillic)


def test_coreference_and_distinctness(docs):
    texts = [f"mail a{i}@x.org and 10.0.{i % 250}.{i // 250} tel (200) 555-{i:04d}" for i in range(400)]
    rows = pii.pseudonymise(docs(texts + texts[:5]), "a key").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"] % 400 if r["doc_id"] < 400 else r["doc_id"] - 400, set()).add(r["text"])
    assert all(len(v) == 1 for v in by.values())
    for part in range(3):
        assert len({re.findall(r"\S+@\S+|\d+\.\d+\.\d+\.\d+|\(\d+\) \S+", r["text"])[part] for r in rows}) == 400


def test_collisions_are_drawn_anew(docs):
    texts = [f"user{i}@a.com" for i in range(60)]
    rows = pii.pseudonymise(docs(texts + texts), "a key", space=997).collect()
    assert len({r["text"] for r in rows}) == 60


def test_clean_and_odd_rows(docs):
    clean = ["version 12.5 at 3:20 on page 1234567", *ODD]
    d = docs(clean, [*range(len(clean) - 1), None], ["kind", "out", "__p_found", "__p_new", "n_entities"])
    out = pii.replace_pii(d)
    assert out.columns == d.columns and sorted(out.collect(), key=repr) == sorted(d.collect(), key=repr)
    assert pii.replace_pii(docs([])).count() == 0


def test_long_secrets_and_tokens_of_parts(docs):
    long = "a1B2c3D4" * 1000
    token = ".".join(["eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIn0", "dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"])
    cases = [('token = "', long, '" end'), ("secret: ", long, ". End"), ("api_key=", token, ", end"), ("token: ", token, ". Then")]
    for (head, secret, tail), got in zip(cases, several(docs, ["".join(c) for c in cases]), strict=True):
        assert re.fullmatch(re.escape(head) + rf"[0-9a-f]{{{len(secret)}}}" + re.escape(tail), got)


def test_wrapped_license_texts(docs):
    texts = [(i, "\n".join(textwrap.fill(p, w, break_on_hyphens=False) for p in t.replace("<year>", "2020").replace("<holder>", "A B").split("\n"))) for i, t in licenses.LICENSES.items() for w in range(40, 100, 3)]
    broken = {i for i, t in texts if re.search(r"(?mi)^copyright (?!\(c\))", t)}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"} <= broken
    by_name = [(i, t.replace("Copyright (c) 2020, A B", "Copyright A B\n  Copyright C D").replace("Copyright (c) 2020 A B", "Copyright A B\n  Copyright C D")) for i, t in texts]
    want = [i for i, _ in texts + by_name]
    got = licenses.scan(docs([t for _, t in texts + by_name])).collect()
    assert [r["license_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == want
    assert licenses.canonical_text(licenses.LICENSES["ISC"], "notices") != licenses.canonical_text(licenses.LICENSES["ISC"].replace("copyright notice", ""), "notices")


def test_notices_of_any_words(docs):
    notices = {"own": "Free for any use.", "reserved": "All rights reserved.", "MIT": licenses.NOTICES["MIT"]}
    texts = ["x\nFREE for any use\n\ny", "a\nall rights reserved\nReleased under the MIT Licence.", "Copyright 2020 A\n\n"]
    got = licenses.scan(docs(texts), None, notices).collect()
    assert {r["doc_id"]: r["notice_ids"] for r in got} == {0: "own", 1: "MIT,reserved", 2: ""}


def iban_state(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_ibans_keep_their_format_and_state(docs):
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE88 3704 0044 0532 0130 00"]
    for x, got in zip(ibans, (t[7:-1] for t in several(docs, [f"pay to {x}." for x in ibans])), strict=True):
        assert got != x and got[:2] == x[:2] and iban_state(got) == iban_state(x)
        assert [("d" if c.isdigit() else "a" if c.isalpha() else c) for c in got] == [("d" if c.isdigit() else "a" if c.isalpha() else c) for c in x]


def test_names_of_one_person(docs):
    got = one(docs, "Mrs. Anna Smith wrote. Mrs. Smith came; Anna Smith left, not Anna Smithson. Mr. Eva Smith")
    m = re.fullmatch(r"Mrs\. (\S+) (\S+) wrote\. Mrs\. (\S+) came; (\S+) (\S+) left, not Anna Smithson\. Mr\. (\S+) (\S+)", got)
    assert m and m[1] == m[4] != "Anna" and m[2] == m[3] == m[5] == m[7] != "Smith" and m[6] != m[1]


def test_given_names_stay_distinct(docs):
    people = [f"{a}{b}" for a in ("An", "Be", "Ce", "De", "Fe", "Ge", "He") for b in ("la", "ma", "na", "ra", "sa", "ta")]
    rows = pii.pseudonymise(docs([f"Ms. {x} Smith" for x in people]), "a key").collect()
    assert len({r["text"] for r in rows}) == len(people) and len({r["text"].split()[-1] for r in rows}) == 1


def test_numbers_that_are_no_cards_stay(docs):
    assert one(docs, "id 9807915762804490 end") == "id 9807915762804490 end"
    assert pii.pseudonymise(docs(["id 9807915762804490"]), "k").first()["n_entities"] == 0


def test_surrogates_avoid_what_is_real(spark, docs):
    first = one(docs, "a1@x.org")
    rows = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(["a1@x.org", first]), "a key").collect()}
    assert first not in rows.values() and len(set(rows.values())) == 2


def test_time_is_in_proportion(docs):
    rng = random.Random(3)
    base64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    texts = [base64, "a1" * 200_000, "x@" + "b." * 100_000 + "1", "a@" * 100_000, "token=" + "ab." * 100_000, "1 " * 100_000, "Mr. A" + "a" * 200_000]
    pii.pseudonymise(docs(["x"]), "k").collect()
    begin = time.perf_counter()
    assert pii.pseudonymise(docs(texts), "k").count() == len(texts)
    pii.pseudonymise(docs(texts), "k").select("text").collect()
    assert time.perf_counter() - begin < 60


def test_a_key_is_the_callers_or_the_sessions(spark, docs):
    a, b, c = (pii.pseudonymise(docs(["mail a@b.org"]), k).first()["text"] for k in ("x", "y", None))
    assert len({a, b, c}) == 3 and pii.pseudonymise(docs(["mail a@b.org"])).first()["text"] == c
    assert "secret" in pii.SETTING  # so that Spark redacts it


class Brute:
    """The surrogates of the permuted kinds, of mail addresses and secrets, one at a time."""

    def __init__(self, key):
        self.key = key

    def hash(self, key, *parts):
        return hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()

    def feistel(self, kind, left, right, ml, mr):
        for i in range(6):
            other, m = (right, ml) if i % 2 == 0 else (left, mr)
            move = int(self.hash(f"{self.key}/{i}", kind, other, ml, mr)[:15], 16) % m
            left, right = ((left + move) % ml, right) if i % 2 == 0 else (left, (right + move) % mr)
        return left, right

    def digits(self, kind, num):
        n = len(num) // 2
        x, y = self.feistel(kind, int(num[:n] or 0), int(num[n:] or 0), 10**n, 10 ** (len(num) - n))
        return (str(x).zfill(n) if n else "") + str(y).zfill(len(num) - n)

    def fill(self, template, digits):
        it = iter(digits)
        return "".join(next(it) if c.isascii() and c.isdigit() else c for c in template)

    def __call__(self, e):
        whole = lambda p: regex.fullmatch(p, e)
        if whole(pii.SECRET):
            m = regex.match(r'([^=:]*[=:][ ]*"?)(.*?)("?)$', e)
            h = self.hash(self.key, "secret:" + m[2], 0)
            new = (h + "".join(self.hash(self.key + "/stream", i, h) for i in range(1, len(m[2]) // 64 + 2)))[: len(m[2])]
            return m[1] + (new.upper() if m[2] == m[2].upper() else new) + m[3]
        if "@" in e:
            domain = e.lower().rsplit("@", 1)[1]
            new = "user." + self.hash(self.key, "mail:" + e.lower(), 0)[:14] + "@d" + self.hash(self.key + "/domain", domain)[:8] + ".example." + domain.rsplit(".", 1)[1]
            return new.upper() if e == e.upper() else new
        if whole(pii.IP):
            o = [int(x) for x in e.split(".")]
            x, y = self.feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
            return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
        if whole(pii.SSN):
            return self.fill(e, self.digits("ssn", regex.sub(r"[^0-9]", "", e)))
        if whole(pii.PHONE):
            m = regex.match(r"^(\+[0-9]{1,3}(?=[^0-9]))", e)
            head = m[1] if m else ""
            return head + self.fill(e[len(head) :], self.digits("phone", regex.sub(r"[^0-9]", "", e[len(head) :])))
        if whole(pii.CARD):
            d = regex.sub(r"[^0-9]", "", e)
            if luhn(d) % 10:
                return e
            new = self.digits("card", d[:-1])
            return self.fill(e, new + str(-luhn(new + "0") % 10))
        return None


def test_like_brute_force(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6, 'ssn 123-45-6789, card 4556 7375 8689 9855; (487) 555-7209 and API_KEY: "ABC.DEF0123456789XYZ". A.B@C.ORG'), (None, None)], d.schema)
    rows, brute = d.union(more), Brute("a key")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(rows, "a key").collect()}
    entity, n = regex.compile(pii.ENTITY), 0
    for i, t in ((r["doc_id"], r["text"]) for r in rows.collect()):
        want = None if t is None else entity.sub(lambda m: brute(m[0]), t)
        n += t != want
        assert got[i] == want
    assert n > 5


def test_comment_marks_and_typeset_quotes(docs):
    mit = licenses.LICENSES["MIT"].replace("Copyright (c) <year> <holder>", "Copyright 2021 A B")
    commented = "\n".join(("# " + x).rstrip() for x in mit.split("\n"))
    typeset = mit.replace('"Software"', "\u201cSoftware\u201d").replace(", ", ",\u00a0").replace("Copyright 2021", "// \u00a9 2021")
    got = licenses.scan(docs([commented, typeset, "/* " + mit])).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {0: "MIT", 1: "MIT", 2: "MIT"}
