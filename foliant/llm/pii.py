"""Personal data: detection and keyed surrogates; DataFrame functions alone.

One pattern finds e-mail and IP addresses, phone, card, account and social security numbers, birth dates behind a word
for them, secrets, and persons behind a title or with a known given name. Every entity has a type and a canonical form
(a number's digits with its country code, lower case of an address, each name by itself), and its surrogate follows from
the caller's key, type, canonical form and attempt alone (sha2): the same entity gets the same surrogate in every
document and spelling (coreference). There is no default key: whoever knows it can search for an entity's surrogate.
The surrogate keeps type, script, case, length and separators; a phone's country code, a card's first digit and Luhn
state, an account's country and an address's network class (private, loopback or public) stay, and an account gets
valid check digits; known given names keep their gender (a title stands beside its name and tells its own).

Numbers, IP addresses and birth dates go through keyed Feistel permutations of their digits, bits or days, which never
map two to one; e-mail addresses, accounts, secrets and names are drawn from spaces of 2^20 (names) to 2^160. Collision
checks over the corpus's entities preserve distinctness: of entities of a type that share a surrogate, all but the
first draw again with the next attempt, and so does one that is its own surrogate, until none collides. Every spelling
is drawn from the canonical form, so the check of one spelling holds for all. The entities with a later attempt, few
or none, go as a map to all tasks if they are LATER_MAP at most, and are else joined to the texts that hold them.

Defined results: null text stays null and empty text empty; texts without entities are unchanged, byte for byte;
repeated rows get equal results; a null doc_id is kept; an empty table gives no rows; in replace() all other columns
stay as they are, whatever their names. Texts are worked whole; repeats in the pattern are
bounded or, in secrets of any length, possessive over one class of signs. Of compressed IPv6 addresses those of the
reserved block 0000::/8 stay (::, ::1, 1::2, which are slices in code), but not IPv4 in IPv6. Persons with neither a
title nor a known given name stay, as a pattern can't tell them from other capitalised words.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

ROUNDS = 40
#: Entities with a later attempt (some 50 bytes each) that are sent as one map.
LATER_MAP = 5_000

# Titles by gender, given names by gender, and syllables for surrogate names by script.
MALE_TITLES = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Lady"]
NEUTRAL_TITLES = ["Dr", "Prof", "Professor", "Doctor"]
MALE_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Alexander Benjamin Samuel Peter Henry Oliver Hans Klaus Jürgen Wolfgang Stefan Andreas Matthias Lukas Felix Jonas Pierre Jean Jacques Michel Philippe Nicolas Antoine Olivier Carlos José Juan Miguel Luis Javier Antonio Pablo Diego Fernando Иван Сергей Алексей Дмитрий Николай".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Michelle Laura Rebecca Emma Olivia Anna Alice Julia Maria Ursula Petra Sabine Monika Claudia Katharina Johanna Marie Sophie Claire Camille Charlotte Isabelle Nathalie Carmen Lucía Isabel Elena Ana Pilar Teresa Анна Мария Елена Ольга Наталья".split()
SYLLABLES = {
    "latin": ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ша"],
    "greek": ["βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "φο", "χυ", "ψα"],
}
MALE_END, FEMALE_END, OTHER_END = {"latin": "n", "cyrillic": "н", "greek": "ν"}, {"latin": "la", "cyrillic": "ла", "greek": "λα"}, {"latin": "r", "cyrillic": "р", "greek": "ρ"}

# Calling codes of one and two digits; all others have three. Words for a birth date.
CODES_1, CODES_2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
BORN = ["born", "date of birth", "birth date", "birthdate", "birthday", "dob", "geboren", "geburtsdatum", "geb.", "né", "née", "naissance", "nacido", "nacida", "nacimiento"]

_TITLES = MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES
#: Titles behind which a second capitalised word is mostly a noun.
_GERMAN = ["Herr", "Frau"]
_either = lambda xs: "(?:" + "|".join(sorted(xs, key=lambda x: (-len(x), x))) + ")"
_NAME = r"\p{Lu}[\p{L}'’]{1,40}(?:-\p{Lu}\p{L}{1,40})?"
_given, _second = _either(MALE_NAMES + FEMALE_NAMES), rf"(?:{_either(['Dr', 'Prof'])}\.? )?"
_titled = rf"{_either(_TITLES)}\.? {_second}"
_WORD_START = r"(?<![\p{L}\p{N}])(?=\p{Lu})"
_HEX = "[0-9A-Fa-f]{1,4}"
_QUAD = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# IPv6 with '::': a first group of three or four digits, one decimal digit or an allocated first group, at most seven groups.
_SHORT_V6 = rf"(?<![\w:.])(?=[0-9A-Fa-f]{{3,4}}:)(?=[A-Fa-f:]*\d|[Ff][C-Fc-f])(?!(?:[0-9A-Fa-f]{{0,4}}:){{8}}[0-9A-Fa-f:])(?:{_HEX}:){{1,7}}(?::(?:{_HEX}:){{0,5}}(?:{_QUAD}(?!\.?\d)|{_HEX})|:)(?![\w:])"
_V4_IN_V6 = rf"(?<![\w:.])(?:::(?:[Ff]{{4}}:(?:0{{1,4}}:)?)?|64:[Ff]{{2}}9[Bb]::|(?:{_HEX}:){{6}}){_QUAD}(?!\.?\d)"
#: Phone numbers without a country code that begin with 0 and aren't grouped as in North America.
_NATIONAL = r"^0[1-9](?:(?:[ .-]\d{2}){4}|\d{1,4}[ /]\d{5,9})$"
PATTERNS = {
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\"?\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_+/.\-]{8,}+|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])" + f"|{_SHORT_V6}|{_V4_IN_V6}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\w.-])0[1-9](?:[ .-]\d{2}){4}(?![\w-])|(?<![\w.-])0[1-9]\d{1,4}[ /]\d{5,9}(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\w.-])(?:\d{4}[ -]){3}\d{1,7}(?![\d-])|(?<![\w.-])\d{4}[ -]\d{6}[ -]\d{5}(?![\d-])|(?<![\w.-])\d{13,19}(?!\w)",
    "birth": rf"(?i:(?<!\p{{L}}){_either([b.replace('.', '[.]') for b in BORN])}(?: ?[:=]| (?:on|am|le|el))?) (?:(?:19|20)\d{{2}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)\d{{2}})(?!\d)",
    "person": rf"{_WORD_START}{_either(_GERMAN)} {_second}(?:{_given} )?{_NAME}|{_WORD_START}{_either([t for t in _TITLES if t not in _GERMAN])}\.? {_second}{_NAME}(?: {_NAME}){{0,2}}|{_WORD_START}{_given} {_NAME}(?: {_NAME})?(?![\p{{L}}])",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_GROUPS = {"secret": r"^(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\"?\s*[=:]\s*\"?"}


def hinted(text: Column) -> Column:
    """False only for texts without an entity; cheap searches for a byte class and for titles and names."""
    return text.rlike("[0-9@=:]") | text.rlike(rf"{_WORD_START}{_either(_TITLES + MALE_NAMES + FEMALE_NAMES)}[. ]")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kind(found: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in PATTERNS.items():
        out = out.when(found.rlike(rf"^(?:{pattern})$"), kind)
    return out.otherwise("card")


def _title(found: Column) -> Column:
    return F.regexp_extract(found, rf"^({_titled})", 1)


def _body(found: Column, kind: Column) -> Column:
    """The part of a match that is replaced: no title, no label."""
    return (
        F.when(kind == "secret", F.regexp_replace(found, _GROUPS["secret"], ""))
        .when(kind == "person", F.regexp_replace(found, rf"^{_titled}", ""))
        .when(kind == "birth", F.regexp_extract(found, r"[\d./-]+$", 0))
        .otherwise(found)
    )


def _v6(body: Column) -> Column:
    """An IPv6 address as eight groups of four digits in lower case."""
    quad = lambda i: F.regexp_extract(body, r"(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).cast("int")
    two = lambda i: F.hex(quad(i) * 256 + quad(i + 1))
    plain = F.lower(F.when(body.contains("."), F.concat(F.regexp_replace(body, r"[\d.]+$", ""), two(1), F.lit(":"), two(3))).otherwise(body))

    def whole(b):
        groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
        head, tail = groups(F.substring_index(b, "::", 1)), F.when(b.contains("::"), groups(F.substring_index(b, "::", -1))).otherwise(F.array().cast("array<string>"))
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(head) - F.size(tail))
        return F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.lpad(g, 4, "0")), ":")

    return _let(plain, whole)


def _iso(date: Column) -> Column:
    """A birth date as year-month-day."""
    return F.when(date.rlike("^[0-9]{4}"), date).otherwise(F.concat_ws("-", F.substring(date, 7, 4), F.substring(date, 4, 2), F.substring(date, 1, 2)))


def _canon(body: Column, kind: Column) -> Column:
    digits = F.regexp_replace(body, r"\D", "")
    return (
        F.when((kind == "phone") & body.startswith("+1"), F.substring(digits, F.lit(2), F.length(digits)))
        .when((kind == "phone") & body.startswith("+"), F.concat(F.lit("+"), digits))
        .when((kind == "phone") & body.rlike(_NATIONAL), F.concat(F.lit("n"), digits))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(body, " ", ""))
        .when(kind == "birth", _iso(body))
        .when((kind == "ip") & body.contains(":"), _v6(body))
        .otherwise(F.lower(body))
    )


def _gender(given: Column) -> Column:
    """By the name alone, so that a name keeps one surrogate behind any title."""
    return F.when(given.isin(MALE_NAMES), "m").when(given.isin(FEMALE_NAMES), "f").otherwise("n")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def units(found: Column, kind: Column, body: Column) -> Column:
    """The entities of one match: itself, or of a person each name ('given-<gender>' or 'surname')."""

    def of_person(names):
        title = _title(found)
        family = lambda i: (i == F.size(names) - 1) & ((F.size(names) > 1) | (title != ""))
        given = F.concat(F.lit("given-"), _gender(F.get(names, F.lit(0))))
        return F.transform(names, lambda n, i: F.struct(F.when(family(i), "surname").otherwise(given).alias("kind"), F.lower(n).alias("canon"), n.alias("body")))

    whole = F.array(F.struct(kind.alias("kind"), _canon(body, kind).alias("canon"), body.alias("body")))
    return F.when(kind == "person", _let(F.split(body, " "), of_person)).otherwise(whole)


def parted(found: Column) -> Column:
    """struct(found, kind, body, units) of a match."""
    whole = lambda kind: _let(_body(found, kind), lambda body: F.struct(found.alias("found"), kind.alias("kind"), body.alias("body"), units(found, kind, body).alias("units")))
    return _let(_kind(found), whole)


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """192 hexadecimal digits that key, type, canonical form and attempt decide."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(3)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 96) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _fresh(c: Column, b: Column) -> Column:
    """A sign of the class of c (digit, capital, other letter) that the byte b picks."""
    pick = lambda chars: F.substring(F.lit(chars), b % len(chars) + 1, F.lit(1))
    return F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(pick("abcdefghijklmnopqrstuvwxyz"))


def _fill_secret(body: Column, stream: Column) -> Column:
    """_fill for bodies of any length: by place, so time is linear."""
    return F.array_join(F.transform(F.split(body, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), _fresh(c, _byte(stream, i))).otherwise(c)), "")


def _fill(body: Column, stream: Column, keep: Column) -> Column:
    """Letters and digits drawn anew, all else as it is; the first `keep` letters and digits stay."""
    is_real = lambda c: c.rlike(r"[\p{L}\p{N}]")

    def step(acc, c):
        fresh = _fresh(c, _byte(stream, acc["i"]))
        return F.struct(F.concat(acc["out"], F.when(is_real(c) & (acc["i"] >= keep), fresh).otherwise(c)).alias("out"), (acc["i"] + is_real(c).cast("int")).alias("i"))

    return F.aggregate(F.split(body, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: acc["out"])


def _hex(body: Column, stream: Column) -> Column:
    """Hexadecimal digits drawn anew in the body's case."""
    drawn = F.substring(F.repeat(stream, F.ceil(F.length(body) / 192).cast("int")), F.lit(1), F.length(body))
    return F.when(body.rlike("[A-F]"), F.upper(drawn)).otherwise(drawn)


def _luhn(digits: Column) -> Column:
    """Sum of a digit string by Luhn's rule."""
    return F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda acc, c: F.struct((acc["sum"] + F.when(acc["i"] % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))).alias("sum"), (acc["i"] + 1).alias("i")),
        lambda acc: acc["sum"],
    )


def _round(key: str, kind: Column, attempt: Column, *parts: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: Column, attempt: Column, extra: Column) -> Column:
    """struct(l, r): a permutation of the pairs below (left_size, right_size), by four rounds in turn."""

    def step(s, i):
        even = i % 2 == 0
        f = _round(key, kind, attempt, extra, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(F.when(even, (s["l"] + f % left_size) % left_size).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + f % right_size) % right_size).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*map(F.lit, range(4))), start, step)


def _permute(digits: Column, key: str, kind: Column, attempt: Column) -> Column:
    """A digit string of the same length, by a permutation of all of that length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    size = lambda n: F.pow(F.lit(10), n).cast("long")
    number = lambda x: F.coalesce(x.cast("long"), F.lit(0))
    mixed = _feistel(number(F.substring(digits, F.lit(1), half)), number(F.substring(digits, half + 1, rest)), size(half), size(rest), key, kind, attempt, F.length(digits))
    return _let(mixed, lambda m: F.concat(F.when(half > 0, F.lpad(m["l"].cast("string"), half, F.lit("0"))).otherwise(F.lit("")), F.lpad(m["r"].cast("string"), rest, F.lit("0"))))


def _refill(body: Column, digits: Column, skip: Column) -> Column:
    """body with its digits, after the first `skip`, replaced by those of `digits` in turn."""

    def step(acc, c):
        real = c.rlike("[0-9]")
        return F.struct(F.concat(acc["out"], F.when(real & (acc["i"] >= skip), F.substring(digits, acc["i"] - skip + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + real.cast("int")).alias("i"))

    return F.aggregate(F.split(body, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: acc["out"])


def _number(body: Column, canon: Column, key: str, kind: Column, attempt: Column) -> Column:
    """All digits of the canonical form but a country code or a phone's leading 0 permuted, in the body's format."""
    code = F.when(F.substring(canon, 2, 1).isin(CODES_1), 1).when(F.substring(canon, 2, 2).isin(CODES_2), 2).otherwise(3)
    keep = F.when(canon.startswith("+"), code).when(canon.startswith("n"), 1).otherwise(0)
    digits = F.regexp_replace(canon, r"\D", "")
    before = F.length(F.regexp_replace(body, r"\D", "")) - F.length(digits)
    return _let(_permute(F.substring(digits, keep + 1, F.length(digits)), key, kind, attempt), lambda d: _refill(body, d, before + keep))


def _birth(body: Column, canon: Column, key: str, kind: Column, attempt: Column) -> Column:
    """A permutation of the days of 1900 to 2099 (below 271 x 270, walked until a day comes), in the body's format."""
    days, wide = 73_049, 270
    day = F.greatest(F.lit(0), F.coalesce(F.datediff(F.try_to_timestamp(canon, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date")), F.lit(0))).cast("long")

    def step(x, i):
        mixed = _feistel(F.floor(x / wide), x % wide, F.lit(271), F.lit(wide), key, kind, attempt, F.lit("day"))
        return F.when((i > 0) & (x < days), x).otherwise(_let(mixed, lambda m: (m["l"] * wide + m["r"]).cast("long")))

    drawn = F.aggregate(F.array(*map(F.lit, range(8))), day, step)
    date = F.date_add(F.lit("1900-01-01").cast("date"), (drawn % days).cast("int"))
    iso = body.rlike("^[0-9]{4}")
    return F.when(iso, F.date_format(date, "yyyy-MM-dd")).when(body.contains("/"), F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "dd.MM.yyyy"))


def _iban(body: Column, stream: Column) -> Column:
    """Letters and digits behind the country drawn anew, and the check digits that they ask for (ISO 7064, modulo 97)."""

    def closed(filled):
        order = F.concat(F.regexp_replace(F.substring(filled, F.lit(5), F.length(filled)), " ", ""), F.substring(filled, 1, 2), F.lit("00"))
        rest = F.aggregate(F.split(order, ""), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
        return F.concat(F.substring(filled, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(filled, F.lit(5), F.length(filled)))

    return _let(_fill(body, stream, F.lit(2)), closed)


def _card(body: Column, canon: Column, key: str, kind: Column, attempt: Column) -> Column:
    """The middle digits permuted; the last keeps its distance from the one that Luhn's rule asks for."""
    inner = F.substring(canon, F.lit(2), F.length(canon) - 2)
    right = lambda head: (10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10
    off = F.substring(canon, -1, 1).cast("int") - right(F.substring(canon, F.lit(1), F.length(canon) - 1)) + 10

    def closed(mid):
        head = F.concat(F.substring(canon, 1, 1), mid)
        return _refill(body, F.concat(head, ((right(head) + off) % 10).cast("string")), F.lit(0))

    return _let(_permute(inner, key, kind, attempt), closed)


def _ip(body: Column, stream: Column, key: str, kind: Column, attempt: Column) -> Column:
    """Version 4: a permutation of the address's class; version 6: a unique local address.

    Classes are the private blocks 172.16/12 and 192.168/16, 169.254/16, each first octet of 0, 10, 127 and 224 on, and
    all public addresses, whose permutation of 32 bits is walked until it comes to a public one.
    """
    o = F.split(body, r"\.")
    part = lambda i: F.get(o, F.lit(i)).cast("long")
    high, low = part(0) * 256 + part(1), part(2) * 256 + part(3)
    octet = lambda x: F.floor(x / 256).isin(0, 10, 127) | (x >= 224 * 256)
    twelve = lambda x: x.between(172 * 256 + 16, 172 * 256 + 31)
    sixteen = lambda x: x.isin(192 * 256 + 168, 169 * 256 + 254)
    # the block's first address, and the sizes of what is permuted: all below the block
    base = F.when(octet(high), F.floor(high / 256) * 256).when(twelve(high), F.lit(172 * 256 + 16).cast("long")).otherwise(high)
    size = F.when(octet(high), 256).when(twelve(high), 16).otherwise(1)
    inner = _feistel(high - base, low, size, F.lit(1 << 16), key, kind, attempt, base)

    def step(x, i):
        again = _feistel(x["l"], x["r"], F.lit(1 << 16), F.lit(1 << 16), key, kind, attempt, F.lit("public"))
        return F.when((i > 0) & ~(octet(x["l"]) | twelve(x["l"]) | sixteen(x["l"])), x).otherwise(again)

    outer = F.aggregate(F.array(*map(F.lit, range(8))), F.struct(high.cast("long").alias("l"), low.cast("long").alias("r")), step)
    mixed = F.when(octet(high) | twelve(high) | sixteen(high), _let(inner, lambda m: F.struct((m["l"] + base).cast("long").alias("l"), m["r"].alias("r")))).otherwise(outer)
    four = _let(mixed, lambda m: F.concat_ws(".", F.floor(m["l"] / 256).cast("string"), (m["l"] % 256).cast("string"), F.floor(m["r"] / 256).cast("string"), (m["r"] % 256).cast("string")))
    six = F.concat(F.lit("fd"), F.substring(stream, 1, 2), *[F.concat(F.lit(":"), F.substring(stream, 4 * i + 3, 4)) for i in range(7)])
    return F.when(body.contains(":"), six).otherwise(four)


def _email(body: Column, stream: Column, key: str) -> Column:
    """Local part of the same shape, with six digits more if it has under ten signs; the domain by itself, below example.org."""
    local, domain = F.substring_index(body, "@", 1), F.lower(F.substring_index(body, "@", -1))
    mapped = F.concat(F.lit("m"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), 1, 10), F.lit(".example.org"))
    padded = F.concat(_fill(local, stream, F.lit(0)), F.when(F.length(local) < 10, F.substring(stream, 180, 6)).otherwise(F.lit("")))
    return F.concat(padded, F.lit("@"), F.when(body == F.upper(body), F.upper(mapped)).otherwise(mapped))


def _name(name: Column, kind: Column, stream: Column) -> Column:
    """Five syllables of the name's script, with the gender's ending, in the name's case."""
    script = _script(name)
    out = F.when(F.lit(False), "")
    for s, syllables in SYLLABLES.items():
        body = F.concat(*[F.element_at(F.array(*map(F.lit, syllables)), _byte(stream, F.lit(i)) % 16 + 1) for i in range(5)])
        end = F.when(kind == "given-m", MALE_END[s]).when(kind == "given-f", FEMALE_END[s]).otherwise(OTHER_END[s])
        out = out.when(script == s, F.concat(body, end))
    return F.when((F.length(name) > 1) & (name == F.upper(name)), F.upper(out)).otherwise(F.initcap(out))


def surrogate(kind: Column, body: Column, canon: Column, attempt: Column, key: str) -> Column:
    """What stands for one entity, in the format of the spelling `body`."""
    def drawn(stream):
        return (
            F.when(kind.isin("surname", "given-m", "given-f", "given-n"), _name(body, kind, stream))
            .when(kind == "card", _card(body, canon, key, kind, attempt))
            .when(kind == "ip", _ip(body, stream, key, kind, attempt))
            .when(kind == "email", _email(body, stream, key))
            .when(kind.isin("phone", "ssn"), _number(body, canon, key, kind, attempt))
            .when(kind == "birth", _birth(body, canon, key, kind, attempt))
            .when(kind == "iban", _iban(body, stream))
            .when((kind == "secret") & body.rlike("^(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)$"), _hex(body, stream))
            .when(kind == "secret", _fill_secret(body, stream))
            .otherwise(_fill(body, stream, F.lit(0)))
        )

    return _let(_stream(kind, canon, attempt, key), drawn)


def entities(docs: DataFrame) -> DataFrame:
    """(kind, canon, body) of all distinct entities, with one of its spellings."""
    found = docs.filter(hinted(F.col("text"))).select(F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("found")).distinct()
    each = found.select(F.explode(parted(F.col("found"))["units"]).alias("u"))
    return each.groupBy("u.kind", "u.canon").agg(F.min("u.body").alias("body"))


def attempts(docs: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate collides; mostly there are none."""
    known = materialize(entities(docs).withColumn("attempt", F.lit(0)), "entities")
    for _ in range(ROUNDS):
        drawn = known.withColumn("drawn", surrogate(F.col("kind"), F.col("body"), F.col("canon"), F.col("attempt"), key))
        group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
        drawn = drawn.withColumn("group", group).withColumn("drawn", _canon(F.col("drawn"), F.col("kind")))
        order = Window.partitionBy("group", "drawn").orderBy("attempt", "canon", "kind")
        judged = drawn.withColumn("place", F.row_number().over(order))
        again = (F.col("place") > 1) | (F.col("drawn") == F.col("canon"))
        judged = materialize(judged.select("kind", "canon", "body", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), "attempts")
        known = judged.drop("again")
        if judged.filter("again").isEmpty():
            return known.filter("attempt > 0").select("kind", "canon", "attempt")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def _replaced(text: Column, later: Column | None, key: str) -> Column:
    """struct(text, n): all matches replaced. later: map from 'kind\\x1fcanon' to attempt, or None."""

    def spelled(p):
        def one(u):
            tried = F.coalesce(F.element_at(later, F.concat_ws("\x1f", u["kind"], u["canon"])), F.lit(0)) if later is not None else F.lit(0)
            return surrogate(u["kind"], u["body"], u["canon"], tried, key)

        head = F.substring(p["found"], F.lit(1), F.length(p["found"]) - F.length(p["body"]))
        return F.concat(head, F.array_join(F.transform(p["units"], one), " "))

    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    between = F.split(text, ENTITY, -1)
    joined = F.zip_with(between, F.transform(F.transform(found, parted), spelled), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.struct(F.array_join(joined, "").alias("text"), F.size(found).cast("long").alias("n"))


def session_key(spark: SparkSession) -> str:
    """The secret of spark.foliant.pii.key; where it is unset one that is drawn for this process, so runs differ."""
    return spark.conf.get("spark.foliant.pii.key", None) or _drawn_key()


@lru_cache(maxsize=1)
def _drawn_key() -> str:
    return secrets.token_hex(32)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with every entity in text replaced; all columns stay, and a last column _n_entities counts replacements.

    A column of docs that is named _n_entities gives way to it.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    columns = [c for c in docs.columns if c != "_n_entities"]
    later = attempts(docs, key)
    rows, text = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")), F.col("row.text")
    has = hinted(text)
    few = later.limit(LATER_MAP + 1).collect()
    if len(few) <= LATER_MAP:
        known = F.map_from_arrays(F.lit([f"{r.kind}\x1f{r.canon}" for r in few]), F.lit([r.attempt for r in few])) if few else None
    else:
        # the few documents with such entities get a map of their attempts, found by a hash of the text
        mark = F.sha2(text, 256)
        own = rows.filter(has).select(text.alias("text")).distinct().select(F.sha2("text", 256).alias("mark"), F.explode(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), lambda m: parted(m)["units"]))).alias("u"))
        maps = own.select("mark", "u.kind", "u.canon").distinct().join(later, ["kind", "canon"]).groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "canon"), "attempt"))).alias("later"))
        rows = rows.withColumn("mark", F.when(has, mark)).join(maps, "mark", "left")
        known = F.coalesce("later", F.create_map().cast("map<string,int>"))
    done = rows.withColumn("done", F.when(has, _replaced(text, known, key)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))))
    return done.select(*[F.col("done.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns], F.col("done.n").alias("_n_entities"))
