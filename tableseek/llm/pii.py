"""Surrogates for personal data. DataFrame functions only.

Entities are found by patterns and names by titles and lists of given names. Each gets a replacement derived from a
secret key, its kind and its value, so the same value has the same surrogate everywhere (coreference), also as part of
a full name. Surrogates keep the format (digits stay digits, letters keep their case and script, separators stay),
the check digit of card numbers, and the gender of given names. A check over the whole table finds surrogates that
two values share or that equal a real value; all but one of these values are derived anew until none is left. Values
without a free surrogate of their format (short ones, or without letters and digits) get a longer one.
"""

from __future__ import annotations

import secrets
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableseek.llm.scratch import stored

KINDS = {
    # a host has 127 labels at most; without a bound the matcher would recurse for each of them
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}",
    "secret": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|(?<![0-9A-Za-z])(?=[0-9a-f]{0,31}[0-9])(?=[0-9a-f]{0,31}[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[0-9A-F]{0,31}[0-9])(?=[0-9A-F]{0,31}[A-F])[0-9A-F]{32,64}(?![0-9A-Za-z]))",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9A-Za-z-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
}
# Given names by gender; a capitalised word behind one of them, or behind a title, is a family name.
MALE = "James John Robert Michael William David Thomas Peter Paul Hans Klaus Wolfgang Pierre Jean Jacques Luis Carlos Juan Pedro Иван Пётр Сергей Дмитрий Γιώργος Νίκος".split()
FEMALE = "Mary Patricia Linda Elizabeth Barbara Susan Sarah Anna Maria Ursula Monika Sabine Marie Claire Sophie Isabelle Carmen Lucia Elena Ольга Наталья Светлана Ирина Μαρία Ελένη".split()
MALE_TITLES, FEMALE_TITLES, TITLES = "Mr|Herr|Monsieur|Señor|Sir", "Mrs|Ms|Miss|Frau|Madame|Señora", "Dr|Prof|Professor"
WORD = r"\p{Lu}[\p{L}'’-]*\p{Ll}"
_GIVEN = "|".join(MALE + FEMALE)
KINDS["name"] = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:{MALE_TITLES}|{FEMALE_TITLES}|{TITLES})\.? {WORD}(?: {WORD})?|(?:{_GIVEN}) {WORD})(?![\p{{L}}\p{{N}}])"
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
SIGNS = ("@", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")
LEFT, RIGHT = "\ufdd0", "\ufdd1"  # noncharacters: no text may hold them; they are removed from texts that do


KEY = "spark.tableseek.pii.key"


def session_key(spark: SparkSession) -> str:
    """The key that a deployment sets in its configuration; without one, a key drawn for this run, which nobody knows."""
    return spark.conf.get(KEY, None) or secrets.token_hex(32)


def kind_of(value: Column) -> Column:
    """First kind whose pattern the whole value has. Look-arounds hold, since nothing stands around it."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def marked(text: Column) -> Column:
    """The text with every entity between LEFT and RIGHT."""
    clean = F.translate(F.coalesce(text, F.lit("")), LEFT + RIGHT, "")
    return F.regexp_replace(clean, f"({ANY})", f"{LEFT}$1{RIGHT}")


def pieces_of(text: Column) -> Column:
    """The text cut before each entity; null where it holds none of the signs that every entity has."""
    signs = text.rlike("[0-9]")
    for sign in SIGNS:
        signs = signs | text.contains(sign)
    return F.when(signs | text.rlike(KINDS["name"]), F.split(marked(text), LEFT))


def _values(pieces: Column) -> Column:
    return F.transform(F.slice(pieces, 2, F.size(pieces)), lambda piece: F.substring_index(piece, RIGHT, 1))


def _draw(secret: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(secret, i), F.lit(n)).cast("int")


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC, _GREEK = "абвгдежзиклмнопрстуфхчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


_WIDE = 64


def _letters(script: str, category: str) -> str:
    """The first letters of a script and category outside ASCII by the names of the characters, repeated up to _WIDE."""
    found = (c for c in map(chr, range(128, 0x10450)) if unicodedata.category(c) == category and unicodedata.name(c, "").startswith(script))
    letters = "".join(c for c, _ in zip(found, range(_WIDE)))
    return (letters * _WIDE)[:_WIDE]


# Other letters: a row of _WIDE per script and case.
_ROWS = [_letters(x, c) for x in ("LATIN", "ARMENIAN", "GEORGIAN", "CHEROKEE", "COPTIC", "GLAGOLITIC", "DESERET") for c in ("Ll", "Lu")]
_ROWS += [_letters(x, "Lo") for x in ("HEBREW", "ARABIC", "DEVANAGARI", "THAI", "HIRAGANA", "KATAKANA", "HANGUL SYLLABLE", "CJK UNIFIED")]
_GRID = "".join(_ROWS)
# Scripts with more letters than a row holds: any letter counts as the first one.
_LARGE = {r"[\p{IsLatin}&&\p{Ll}]": _ROWS[0][0], r"[\p{IsLatin}&&\p{Lu}]": _ROWS[1][0], r"\p{IsHan}": _ROWS[-1][0], r"\p{IsHangul}": _ROWS[-2][0]}


def _other(c: Column) -> Column:
    """What another letter is drawn from: its row, or ASCII letters of its case."""
    known = c
    for pattern, letter in _LARGE.items():
        known = F.when(c.rlike(pattern), letter).otherwise(known)
    at = F.instr(F.lit(_GRID), known)
    row = F.substr(F.lit(_GRID), F.floor((at - 1) / _WIDE).cast("int") * _WIDE + 1, F.lit(_WIDE))
    return F.when(~c.rlike(r"\p{L}"), c).when(at > 0, row).when(c.rlike(r"\p{Lu}"), _UPPER).otherwise(_LOWER)


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def restyled(value: Column, secret: Column, hexadecimal: bool = False) -> Column:
    """Each digit and letter becomes another of its class (case, script); other characters stay."""

    def one(c, i):
        letters = (
            F.when(c.rlike("[0-9]"), "0123456789")
            .when(c.rlike("[a-z]"), "abcdef" if hexadecimal else _LOWER)
            .when(c.rlike("[A-Z]"), "ABCDEF" if hexadecimal else _UPPER)
            .when(c.rlike(r"\p{ASCII}"), c)
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), _CYRILLIC)
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), _CYRILLIC.upper())
            .when(c.rlike(r"[\p{IsGreek}&&\p{Ll}]"), _GREEK)
            .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), _GREEK.upper())
            .otherwise(_other(c))
        )
        return F.transform(F.array(letters), lambda x: F.substr(x, F.pmod(F.xxhash64(secret, i), F.length(x)).cast("int") + 1, F.lit(1)))[0]

    return F.array_join(F.transform(_characters(value), one), "")


def _luhn(value: Column) -> Column:
    """Sum of the digits, every second one from the right doubled, modulo 10."""
    digits = F.reverse(F.filter(F.split(value, ""), lambda c: c.rlike("[0-9]")))
    double = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(digits, lambda c, i: double(c.cast("int"), i)), F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, secret: Column) -> Column:
    """Keeps the validity of the check digit."""
    new = restyled(value, secret)
    head = F.substr(new, F.lit(1), F.length(new) - 1)
    right = F.concat(head, (10 - _luhn(F.concat(head, F.lit("0")))) % 10)
    return F.when(_luhn(value) == 0, right).otherwise(F.when(_luhn(new) == 0, F.concat(head, (F.substr(new, F.length(new), F.lit(1)).cast("int") + 1) % 10)).otherwise(new))


def _ip(secret: Column) -> Column:
    return F.concat_ws(".", *[(_draw(secret, F.lit(i), 222 if i == 0 else 254) + 1).cast("string") for i in range(4)])


def _email(value: Column, secret: Column) -> Column:
    """Host names for examples stay, other hosts keep their last part."""
    host = F.substring_index(value, "@", -1)
    site = F.regexp_extract(host, r"^(.*?)(example\.(?:com|org|net)|\.[A-Za-z]+)$", 1)
    last = F.regexp_extract(host, r"^(.*?)(example\.(?:com|org|net)|\.[A-Za-z]+)$", 2)
    return F.concat(restyled(F.substring_index(value, "@", 1), secret), F.lit("@"), restyled(site, F.concat(secret, F.lit("@"))), last)


def _given(word: Column, secret: Column) -> Column:
    """A made-up given name of the same gender and script: a stem and an ending."""
    female = word.isin(*FEMALE)
    cyrillic, greek = word.rlike(r"\p{IsCyrillic}"), word.rlike(r"\p{IsGreek}")
    stem = restyled(F.initcap(F.regexp_replace(word, ".$", "")), secret)
    ending = F.when(cyrillic, F.when(female, "ина").otherwise("ор")).when(greek, F.when(female, "ία").otherwise("ος")).otherwise(F.when(female, "ina").otherwise("or"))
    return F.concat(stem, ending)


def _name(value: Column, key: str, attempt: Column) -> Column:
    """Word by word: titles stay, given names keep their gender, every other word is a family name."""
    words = F.split(value, " ")

    def one(word):
        own = _secret(key, F.lit("name"), word, attempt)
        return F.when(word.rlike(f"^(?:{MALE_TITLES}|{FEMALE_TITLES}|{TITLES})\\.?$"), word).when(word.isin(*MALE, *FEMALE), _given(word, own)).otherwise(restyled(word, own))

    return F.array_join(F.transform(words, one), " ")


def _secret(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(key), kind, value, attempt.cast("string")), 256)


TRIES = 3  # surrogates in a value's own format; later ones have twelve keyed letters or digits more


def surrogate(value: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The keyed replacement of a value; attempt counts earlier ones that collided."""
    own, late = _secret(key, kind, value, attempt), attempt >= TRIES
    address = F.when(late, F.concat(F.substring_index(value, "@", 1), F.lit("x" * 12 + "@"), F.substring_index(value, "@", -1))).otherwise(value)
    groups = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substr(own, 4 * i + 1, F.lit(4)))
    letter = F.when(value.rlike(r"\p{IsCyrillic}"), "ж").when(value.rlike(r"\p{IsGreek}"), "α").when(value.rlike(r"\p{IsArmenian}"), "ա").when(value.rlike(r"\p{IsGeorgian}"), "ა").otherwise("x")
    tail = restyled(F.when(kind == "name", F.repeat(letter, F.lit(12))).otherwise("-" + "0" * 12), F.concat(own, F.lit("-")))
    made = (
        F.when(kind == "email", _email(address, own))
        .when(kind == "ip", F.when(late, F.concat(F.lit("fd00:"), F.array_join(groups, ":"))).otherwise(_ip(own)))
        .when(kind == "card", _card(value, own))
        .when(kind == "name", _name(value, key, attempt))
        .when(kind == "secret", F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), restyled(value, own, True)).otherwise(F.concat(F.regexp_extract(value, "^(AKIA|gh._|sk-|xox.-|)", 1), restyled(F.regexp_replace(value, "^(AKIA|gh._|sk-|xox.-)", ""), own))))
        .when((kind == "phone") & value.startswith("+"), F.concat(F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0), restyled(F.regexp_replace(value, r"^\+[0-9]{1,3}(?=[ .(-])", ""), own)))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), restyled(F.substr(value, F.lit(3)), own)))
        .otherwise(restyled(value, own))
    )
    return F.concat(made, F.when(late & ~kind.isin("email", "ip"), tail).otherwise(""))


def resolve_collisions(values: DataFrame, key: str) -> DataFrame:
    """value, attempt: of values whose first surrogates collide. values: distinct (kind, value).

    Of the values that share a surrogate, the smallest keeps it unless it is a real value itself. It ends, since from
    the attempt TRIES on surrogates have so long a keyed part that they do not meet.
    """
    moved, attempt = None, values.withColumn("attempt", F.lit(0))
    while True:
        tried = stored(attempt.withColumn("made", surrogate(F.col("value"), F.col("kind"), key, F.col("attempt"))), "surrogates")
        shared = tried.groupBy("kind", "made").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n")).where("n > 1")
        losers = tried.join(shared.select("kind", "made", F.col("value").alias("winner")), ["kind", "made"]).where("value != winner").select("kind", "value")
        real = tried.join(tried.select("kind", F.col("value").alias("made")), ["kind", "made"], "left_semi").select("kind", "value")
        again = stored(losers.unionByName(real).distinct(), "collisions")
        if again.isEmpty():
            return moved
        attempt = stored(tried.drop("made").join(again.withColumn("again", F.lit(1)), ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "attempts")
        moved = attempt.where("attempt > 0").select("value", "attempt")


def replace_personal_data(docs: DataFrame, key: str, text: str = "text", added: str = "n_entities") -> DataFrame:
    """All columns of docs with every entity of `text` replaced, and `added` (long, entities found) added.

    Null texts stay null, empty ones empty. Repeated rows get the same result. An existing column `added` is replaced; others
    are kept, whatever their names. Texts count whole, however long: no pattern recurses with the text's length.
    """
    names = [c for c in docs.columns if c != added]
    columns = [f"c{i}" for i in range(len(names))]
    docs, text = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*columns), columns[names.index(text)]
    source = docs.select(*columns, pieces_of(F.col(text)).alias("__pieces"))
    holding = source.where(F.size("__pieces") > 1)
    found = holding.select(F.explode(_values(F.col("__pieces"))).alias("value")).distinct()
    values = stored(found.select(kind_of(F.col("value")).alias("kind"), "value").where("kind is not null"), "entities")
    moved = resolve_collisions(values, key)
    attempts = F.lit(None).cast("map<string,int>")
    if moved is not None:
        # the few texts that hold such a value learn its attempt; a text is known by its digest
        digest = F.sha2(F.col(text), 256)
        holders = holding.select(digest.alias("__digest"), F.explode(F.array_distinct(_values(F.col("__pieces")))).alias("value")).distinct()
        maps = holders.join(moved, "value").groupBy("__digest").agg(F.map_from_entries(F.collect_list(F.struct("value", "attempt"))).alias("__attempts"))
        source = source.withColumn("__digest", digest).join(maps, "__digest", "left").drop("__digest")
        attempts = F.col("__attempts")

    def rewrite(piece):
        value, rest = F.substring_index(piece, RIGHT, 1), F.substr(piece, F.instr(piece, RIGHT) + 1)
        kind = kind_of(value)
        tries = F.coalesce(attempts[value], F.lit(0))
        return F.concat(F.when(kind.isNull(), value).otherwise(surrogate(value, kind, key, tries)), rest)

    pieces, some = F.col("__pieces"), F.coalesce(F.size("__pieces") > 1, F.lit(False))
    rewritten = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), rewrite), ""))
    new = F.when(some, rewritten).otherwise(F.col(text))
    number = F.when(some, F.size(pieces) - 1).otherwise(0).cast("long")
    return source.select(*[new.alias(n) if c == text else F.col(c).alias(n) for c, n in zip(columns, names)], number.alias(added))
