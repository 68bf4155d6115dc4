"""PII: surrogate generation, in DataFrame functions only.

Detected entities (mail addresses, IPv4 addresses, phone and social security numbers, card numbers with a right check
digit, IBANs, secrets, names after a title) are replaced by surrogates of the same type and format. A surrogate is a
function of a secret key and the entity's canonical form, so the same entity has the same surrogate everywhere. Numbers
go through a keyed Feistel permutation of their digits, which is one-to-one by construction and keeps separators and
country code; a card's check digit is made right again. IBANs keep country, blanks, the kind of each character and
whether the check digits are right. Names keep title (and so gender), script, case and number of words; a surname has
one surrogate with every title and given name, and a full name that a text has after a title is replaced where it
stands without one, too. Mail addresses keep case and top-level domain; secrets, of any length and with the parts that
follow after a dot, keep length and case. Surrogates that aren't one-to-one by construction are checked over the whole
corpus, against each other and against all entities that are detected: those that meet another are drawn again, until
every surrogate has one entity. A permuted number may be another real number, as any number of its format may.

The key is a secret, as permuted numbers can be undone with it: it comes from the caller or from the session's setting
`spark.veilspark.surrogates.secret`; without either a session draws one of its own, so two sessions differ.

Defined results: a null text stays null, a text without entities stays as it is; rows repeat as they come; null ids
are kept. All columns of the input are kept; working columns take names that it doesn't have. All patterns take time in
proportion to the text, whatever it holds.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import join_sized, settle

SETTING = "spark.veilspark.surrogates.secret"
#: Times that colliding surrogates are drawn anew before the space of surrogates counts as too small.
ATTEMPTS = 1_000

_TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа"]
_TITLES_M = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин"]
_TITLES_N = ["Dr", "Prof"]
_GIVEN = {
    "f": ["Anna", "Clara", "Elena", "Ines", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sofia", "Vera"],
    "m": ["Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Simon", "Victor"],
    "n": ["Alex", "Charlie", "Dominique", "Jamie", "Kim", "Luca", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yael"],
}
_GIVEN_CYRILLIC = {
    "f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    "m": ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"],
    "n": ["Саша", "Женя", "Валя", "Шура"],
}
_SYLLABLES = ["ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "wi", "zo", "ka", "le"]
_SYLLABLES_CYRILLIC = ["ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "ви", "зо", "ка", "ле"]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOCAL = r"[A-Za-z0-9À-ɏ._%+-]"
# from the start of a run and never back into it, so that long runs without the sign cost one look each
MAIL = rf"(?<!{_LOCAL}){_LOCAL}++@(?=[A-Za-z0-9.-]*?\.[A-Za-z]{{2}})[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){{1,40}}+"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key))[ ]*[=:][ ]*\"?(?=[A-Za-z0-9_+/=-]{12})[A-Za-z0-9_+/=.-]*[A-Za-z0-9_+/=-]\"?"
NAME = r"(?<![\p{L}])(?:" + "|".join(_TITLES_F + _TITLES_M + _TITLES_N) + r")\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"
#: In the order in which a place is tried.
ENTITY = "|".join([SECRET, MAIL, IP, SSN, PHONE, IBAN, CARD, NAME])
#: No entity stands in a text without one of these.
_SIGN = r"[0-9@=:]|(?:" + "|".join(_TITLES_F + _TITLES_M + _TITLES_N) + r")\.? "


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _hash(key: str, *parts: Column) -> Column:
    """Hex SHA-256 of the key and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)


def _number(hexes: Column, at: int = 1) -> Column:
    """15 hex digits as a long."""
    return F.conv(F.substring(hexes, at, 15), 16, 10).cast("long")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, F.lit("[^0-9]"), F.lit(""))


def _pow10(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def _half(x: Column) -> Column:
    return F.when(F.length(x) == 0, F.lit(0).cast("long")).otherwise(x.cast("long"))


def entities_of(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(_SIGN)), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def describe(e: Column) -> Column:
    """Kind, canonical form, the part before the replaced one, and what to permute."""
    is_ = lambda p: F.rlike(e, F.lit(_whole(p)))
    kind = (
        F.when(is_(SECRET), "secret").when(F.contains(e, F.lit("@")), "mail").when(is_(IP), "ip").when(is_(SSN), "ssn").when(is_(PHONE), "phone").when(is_(IBAN), "iban").when(is_(CARD), F.when(_luhn(_digits(e), 0) % 10 == 0, "card").otherwise("number")).otherwise("name")
    )
    return F.struct(kind.alias("kind"), e.alias("e"))


def _prepare(s: Column) -> Column:
    """head (kept as it is), body (replaced), canon (what the surrogate depends on)."""
    kind, e = s["kind"], s["e"]
    secret_head = F.regexp_extract(e, r"^([^=:]*[=:][ ]*\"?)", 1)
    country = F.regexp_extract(e, r"^(\+[0-9]{1,3}(?=[^0-9]))", 1)
    title = F.regexp_extract(e, r"^([^ ]+ )", 1)
    head = F.when(kind == "secret", secret_head).when(kind == "phone", country).when(kind == "iban", F.substring(e, 1, 2)).when(kind == "name", title).otherwise(F.lit(""))
    return F.struct(kind.alias("kind"), head.alias("head"), e.alias("e"))


def _bodied(s: Column) -> Column:
    body = F.substr(s["e"], F.length(s["head"]) + 1)
    tail = F.when((s["kind"] == "secret") & F.endswith(body, F.lit('"')), F.lit('"')).otherwise(F.lit(""))
    return F.struct(s["kind"].alias("kind"), s["head"].alias("head"), F.substr(body, F.lit(1), F.length(body) - F.length(tail)).alias("body"), tail.alias("tail"))


def _canonical(s: Column) -> Column:
    kind, body = s["kind"], s["body"]
    digits = _digits(body)
    plain = F.lower(body)
    canon = F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.concat(s["head"], F.upper(F.replace(body, F.lit(" "), F.lit(""))))).when(kind == "name", F.substring_index(plain, " ", -1)).when(kind == "secret", body).otherwise(plain)
    # the permuted number: of a card all digits but the check digit
    num = F.when(kind == "card", F.substr(digits, F.lit(1), F.length(digits) - 1)).when(kind.isin("phone", "ssn"), digits).otherwise(F.lit(""))
    a = F.floor(F.length(num) / 2).cast("int")
    octet = F.split(body, F.lit(r"\."))
    is_ip = kind == "ip"
    oc = lambda i: F.get(octet, F.lit(i)).cast("long")
    return F.struct(
        kind.alias("kind"), s["head"].alias("head"), body.alias("body"), s["tail"].alias("tail"), canon.alias("canon"), num.alias("num"), a.alias("na"), digits.alias("digits"),
        F.when(is_ip, oc(0) * 256 + oc(1)).otherwise(_half(F.substr(num, F.lit(1), a))).alias("l"),
        F.when(is_ip, oc(2) * 256 + oc(3)).otherwise(_half(F.substr(num, a + 1))).alias("r"),
        F.when(is_ip, F.lit(65536).cast("long")).otherwise(_pow10(a)).alias("ml"),
        F.when(is_ip, F.lit(65536).cast("long")).otherwise(_pow10(F.length(num) - a)).alias("mr"),
    )


def _round(s: Column, key: str, i: int) -> Column:
    """One round of the permutation: one half moves by a keyed hash of the other."""
    left = i % 2 == 0
    other, m = (s["r"], s["ml"]) if left else (s["l"], s["mr"])
    move = _number(_hash(f"{key}/{i}", s["kind"], other, s["ml"], s["mr"]))
    moved = F.pmod((s["l"] if left else s["r"]) + F.pmod(move, m), m)
    rest = [s[n].alias(n) for n in ("kind", "head", "body", "tail", "canon", "num", "na", "digits", "ml", "mr")]
    return F.struct(*rest, (moved if left else s["l"]).alias("l"), (s["r"] if left else moved).alias("r"))


def _rounds(key: str, i: int):
    return lambda s: _round(s, key, i)


def _luhn(num: Column, start: int) -> Column:
    """The Luhn sum of a digit string; start 1: its last digit counts double, as before a check digit."""
    places = F.sequence(F.lit(0), F.length(num) - 1)

    def value(i: Column) -> Column:
        d = F.substr(num, F.length(num) - i, F.lit(1)).cast("int")
        twice = F.when((i + start) % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.when(F.length(num) > 0, F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))


def _fill(template: Column, digits: Column) -> Column:
    """The digits in the places of the template's digits."""
    parts = F.split(template, F.lit("[0-9]"), -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.substr(digits, i + 1, F.lit(1)))), "")


def _permuted(s: Column) -> Column:
    n = F.length(s["num"])
    joined = F.concat(F.lpad(s["l"].cast("string"), s["na"], F.lit("0")), F.lpad(s["r"].cast("string"), n - s["na"], F.lit("0")))
    rest = [s[k].alias(k) for k in ("kind", "head", "body", "tail", "canon", "num", "digits", "l", "r")]
    return F.struct(*rest, F.when(n > 0, joined).otherwise(F.lit("")).alias("new"))


def _family(parts: list[str], h: Column, n: int = 6) -> Column:
    places = [F.conv(F.substring(h, 30 + i, 1), 16, 10).cast("int") + 1 for i in range(n)]
    return F.initcap(F.concat(*[F.element_at(F.array(*map(F.lit, parts)), p) for p in places]))


def _surname(body: Column, title: Column, h: Column) -> Column:
    """h: hash of the surname alone, so that it has one surrogate with any title and given name."""
    female = F.regexp_replace(F.trim(title), F.lit(r"\."), F.lit("")).isin(*_TITLES_F)
    cyrillic = F.concat(_family(_SYLLABLES_CYRILLIC, h), F.when(female, "ва").otherwise("в"))
    return F.when(F.rlike(body, F.lit(r"\p{IsCyrillic}")), cyrillic).otherwise(_family(_SYLLABLES, h))


def _given(body: Column, title: Column, h: Column, attempt: Column) -> Column:
    """A given name of the title's gender; one that is drawn again has a second part, as there are few."""
    bare = F.regexp_replace(F.trim(title), F.lit(r"\."), F.lit(""))
    g = F.when(bare.isin(*_TITLES_F), "f").when(bare.isin(*_TITLES_M), "m").otherwise("n")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(_number(h), F.lit(len(names))) + 1).cast("int"))

    def one(table: dict[str, list[str]], parts: list[str]) -> Column:
        first = F.when(g == "f", pick(table["f"])).when(g == "m", pick(table["m"])).otherwise(pick(table["n"]))
        return F.when(attempt == 0, first).otherwise(F.concat(first, F.lit("-"), _family(parts, h)))

    return F.when(F.rlike(body, F.lit(r"\p{IsCyrillic}")), one(_GIVEN_CYRILLIC, _SYLLABLES_CYRILLIC)).otherwise(one(_GIVEN, _SYLLABLES))


def _mod97(text: Column) -> Column:
    """An IBAN's number modulo 97: its characters as they stand, letters as 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        letter = F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))
        return F.when(c == "", acc).when(F.rlike(c, F.lit("[0-9]")), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(letter).cast("int")

    return F.aggregate(F.split(text, F.lit("")), F.lit(0), step)


def _let(value: Column, body) -> Column:
    """Binds a value, so that its expression isn't repeated."""
    return F.get(F.transform(F.array(value), body), 0)


def _iban(country: Column, body: Column, draws: Column) -> Column:
    """body: check digits and what follows, perhaps with blanks. Each character keeps its kind, the check digits their state.

    draws: 3 hex digits for each character.
    """

    def new(c: Column, i: Column) -> Column:
        return _let(F.conv(F.substr(draws, i * 3 + 1, F.lit(3)), 16, 10).cast("int"), lambda x: F.when(c.isin("", " "), c).when(F.rlike(c, F.lit("[0-9]")), F.pmod(x, F.lit(10)).cast("string")).otherwise(F.char(F.pmod(x, F.lit(26)) + 65)))

    def checked(rest: Column) -> Column:
        plain = F.replace(body, F.lit(" "), F.lit(""))
        state = _mod97(F.concat(F.substr(plain, F.lit(3)), country, F.substring(plain, 1, 2)))
        base = _mod97(F.concat(F.replace(rest, F.lit(" "), F.lit("")), country, F.lit("00")))
        check = _let(F.pmod(state - base, F.lit(97)), lambda c: F.when(c < 2, c + 97).otherwise(c))
        return F.concat(F.lpad(check.cast("string"), 2, "0"), rest)

    return _let(F.array_join(F.transform(F.split(F.substr(body, F.lit(3)), F.lit("")), new), ""), checked)


def _mail(body: Column, h: Column, key: str) -> Column:
    domain = F.lower(F.substring_index(body, "@", -1))
    d = _hash(key + "/domain", domain)
    new = F.concat(F.lit("user."), F.substring(h, 1, 14), F.lit("@d"), F.substring(d, 1, 8), F.lit(".example."), F.substring_index(domain, ".", -1))
    return F.when(body == F.upper(body), F.upper(new)).otherwise(new)


def _stream(body: Column, h: Column, key: str) -> Column:
    """Hex characters of the body's length, in its case."""
    blocks = F.transform(F.sequence(F.lit(1), F.ceil(F.length(body) / 64).cast("int")), lambda i: _hash(key + "/stream", i, h))
    new = F.substr(F.concat(F.substring(h, 1, 64), F.array_join(blocks, "")), F.lit(1), F.length(body))
    return F.when(body == F.upper(body), F.upper(new)).otherwise(new)


def _kept(s: Column, *names: str) -> list[Column]:
    return [s[n].alias(n) for n in names]


def _named(attempts: Column | None):
    """Adds the ids of what may collide, of a full name's given part too, and how often each was drawn."""

    def step(s: Column) -> Column:
        full = (s["kind"] == "name") & F.contains(s["body"], F.lit(" "))
        own, given = F.concat_ws(":", s["kind"], s["canon"]), F.when(full, F.concat(F.lit("given:"), F.lower(s["body"])))
        tried = lambda name: F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, name), F.lit(0))
        return F.struct(*_kept(s, "kind", "head", "body", "tail", "canon", "num", "digits", "l", "r", "new"), own.alias("own"), given.alias("given"), tried(own).alias("a"), F.when(full, tried(given)).alias("ag"))

    return step


def _drawn(key: str, space: int | None):
    """Adds a hash for each id; space: test bound of their values."""

    def step(s: Column) -> Column:
        def draw(name: str, attempt: str) -> Column:
            h = _hash(key, s[name], s[attempt])
            return _hash(key, F.pmod(_number(h), F.lit(space))) if space else h

        return F.struct(*_kept(s, "kind", "head", "body", "tail", "canon", "num", "digits", "l", "r", "new", "own", "given", "a", "ag"), draw("own", "a").alias("h"), F.when(s["given"].isNotNull(), draw("given", "ag")).alias("hg"))

    return step


def _replaced(key: str):
    """Adds the surrogate: `out` of the body, and a surname without its gender's ending."""

    def step(s: Column) -> Column:
        kind, body, new, h = s["kind"], s["body"], s["new"], s["h"]
        last = F.pmod(-_luhn(new, 1), F.lit(10)).cast("string")
        ip = F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), F.pmod(s["l"], F.lit(256)).cast("string"), F.floor(s["r"] / 256).cast("string"), F.pmod(s["r"], F.lit(256)).cast("string"))
        surname = _surname(body, s["head"], h)
        name = F.concat_ws(" ", F.when(s["given"].isNotNull(), _given(body, s["head"], s["hg"], s["ag"])), surname)
        draws = F.concat(_hash(key + "/iban", F.lit(1), h), _hash(key + "/iban", F.lit(2), h))
        out = (
            F.when(kind.isin("phone", "ssn"), _fill(body, new))
            .when(kind == "card", _fill(body, F.concat(new, last)))
            .when(kind == "ip", ip)
            .when(kind == "mail", _mail(body, h, key))
            .when(kind == "name", _let(name, lambda n: F.when(body == F.upper(body), F.upper(n)).otherwise(n)))
            .when(kind == "iban", _let(draws, lambda d: _iban(s["head"], body, d)))
            .when(kind == "number", body)
            .otherwise(_stream(body, h, key))
        )
        bare = F.when(kind == "name", F.lower(_surname(body, F.lit(""), h)))
        return F.struct(*_kept(s, "kind", "head", "body", "tail", "canon", "own", "given", "a", "ag"), out.alias("out"), bare.alias("bare"))

    return step


def _finished(s: Column) -> Column:
    """struct<kind, head, body, new, out, ids>: ids has, for what may collide, its id, what stood there, what does now, and the attempt."""
    kind, out = s["kind"], s["out"]
    plain = lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("")))
    of = lambda name, was, now, a: F.struct(name.alias("id"), was.alias("was"), now.alias("now"), a.alias("attempt"))
    tag = F.concat(kind, F.lit(":"), F.when(kind == "iban", F.lower(s["head"])).otherwise(F.lit("")))
    own = of(s["own"], F.concat(tag, F.when(kind == "name", s["canon"]).otherwise(plain(s["body"]))), F.concat(tag, F.coalesce(s["bare"], plain(out))), s["a"])
    given = of(s["given"], F.concat(F.lit("given:"), plain(s["body"])), F.concat(F.lit("given:"), plain(out)), s["ag"])
    ids = F.when(s["given"].isNotNull(), F.array(own, given)).when(kind.isin("mail", "secret", "iban", "name"), F.array(own))
    return F.struct(kind.alias("kind"), s["body"].alias("body"), out.alias("new"), F.concat(s["head"], out, s["tail"]).alias("out"), ids.alias("ids"))


def surrogates(found: Column, key: str, attempts: Column | None = None, space: int | None = None) -> Column:
    """For an array of entities the array of what `_finished` gives; attempts: map from an id to an attempt."""
    x = F.transform(found, describe)
    for step in (_prepare, _bodied, _canonical, *(_rounds(key, i) for i in range(6)), _permuted, _named(attempts), _drawn(key, space), _replaced(key), _finished):
        x = F.transform(x, step)  # each step binds what the next one uses more than once
    return x


def collisions(docs: DataFrame, key: str, space: int | None = None) -> DataFrame:
    """id and attempt of what had to be drawn again, over the whole corpus; permuted kinds can't collide."""
    each = docs.select(F.explode(entities_of(F.col("text"))).alias("e")).where(~F.rlike("e", F.lit(_whole(f"{IP}|{SSN}|{PHONE}|{CARD}"))))
    known = settle(each.groupBy("e").agg(F.count("*").alias("n")).select("e", F.lit(None).cast("map<string,int>").alias("attempts")))
    for _ in range(ATTEMPTS):
        pairs = known.select("e", F.explode(surrogates(F.array("e"), key, F.col("attempts"), space)[0]["ids"]).alias("x")).select("e", "x.*")
        owners = pairs.groupBy("now").agg(F.min(F.struct("attempt", "id")).alias("own"), F.count_distinct("id").alias("n")).where("n > 1")
        of_others = pairs.join(owners, "now").where(F.col("id") != F.col("own.id")).select("id")
        of_real = pairs.alias("a").join(pairs.select(F.col("was").alias("real")).distinct(), F.col("a.now") == F.col("real"), "left_semi").select("id")
        lost = settle(of_others.union(of_real).distinct())
        if lost.isEmpty():
            break
        tries = pairs.join(lost.withColumn("lost", F.lit(1)), "id", "left").select("e", "id", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt"))
        # an entity has two ids at most
        known = settle(tries.groupBy("e").agg(F.map_from_entries(F.collect_set(F.struct("id", "attempt"))).alias("attempts")))
    else:
        raise ValueError("surrogates still collide: there are too few of them")
    return settle(pairs.where("attempt > 0").select("id", "attempt").distinct())


def secret_of(spark: SparkSession, key: str | None = None) -> str:
    """The key given, or the session's; a session without one draws it once."""
    if key is None:
        key = spark.conf.get(SETTING, None)
    if key is None:
        key = secrets.token_hex(32)
        spark.conf.set(SETTING, key)
    return key


def _bare_names(parts: Column, new: Column) -> Column:
    """The stretches between entities, with full names replaced that stand after a title elsewhere in the text."""
    names = F.filter(new, lambda s: (s["kind"] == "name") & F.contains(s["body"], F.lit(" ")))

    def one(p: Column) -> Column:
        return F.aggregate(names, p, lambda acc, s: F.when(F.contains(acc, s["body"]), F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}])\Q"), s["body"], F.lit(r"\E(?![\p{L}])")), s["new"])).otherwise(acc))

    return F.when(F.size(names) > 0, F.transform(parts, one)).otherwise(parts)


def pseudonymise(docs: DataFrame, key: str | None = None, space: int | None = None, count: str = "n_entities") -> DataFrame:
    """The rows of docs with `text` replaced, and `count`, the number of entities replaced in it."""
    if count in docs.columns:
        raise ValueError(f"the input has a column {count}; name the count differently")
    key = secret_of(docs.sparkSession, key)
    p = "__p"
    while any(c.startswith(p) for c in docs.columns):
        p = "_" + p
    fixes = collisions(docs, key, space)
    found = docs.withColumn(f"{p}_found", entities_of(F.col("text")))
    attempts = None
    n_fixes = fixes.count()
    if n_fixes:
        # the attempts of each document that holds a redrawn entity
        rows = docs.select(F.xxhash64("text").alias(f"{p}_h"), F.sha1("text").alias(f"{p}_s"), entities_of(F.col("text")).alias("f")).where("size(f) > 0")
        named = F.transform(F.flatten(F.transform(surrogates(F.col("f"), key, None, space), lambda s: F.coalesce(s["ids"], F.array().cast("array<struct<id:string,was:string,now:string,attempt:int>>")))), lambda x: x["id"])
        ids = rows.select(f"{p}_h", f"{p}_s", F.explode(named).alias("id")).distinct()
        per = join_sized(ids, fixes, "id", rows=n_fixes).groupBy(f"{p}_h", f"{p}_s").agg(F.map_from_entries(F.collect_set(F.struct("id", "attempt"))).alias(f"{p}_at"))
        found = found.withColumns({f"{p}_h": F.xxhash64("text"), f"{p}_s": F.sha1("text")})
        found = join_sized(found, settle(per), [f"{p}_h", f"{p}_s"], "left")
        attempts = F.col(f"{p}_at")
    found = found.withColumn(f"{p}_new", surrogates(F.col(f"{p}_found"), key, attempts, space))
    parts = _bare_names(F.split("text", F.lit(ENTITY), -1), F.col(f"{p}_new"))
    replaced = F.array_join(F.zip_with(parts, F.transform(f"{p}_new", lambda s: s["out"]), lambda x, s: F.concat(x, F.coalesce(s, F.lit("")))), "")
    n = F.size(F.filter(f"{p}_new", lambda s: s["kind"] != "number"))
    text = F.when(n > 0, replaced).otherwise(F.col("text"))
    return found.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns], F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias(count))


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The rows of docs, columns as they are, with surrogates in `text`."""
    count = "n_entities"
    while count in docs.columns:
        count = "_" + count
    return pseudonymise(docs, key, count=count).drop(count)
