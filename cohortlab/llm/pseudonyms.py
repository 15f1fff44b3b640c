"""Personal data replaced by pseudonyms of the same format.

Validated numbers and dates, e-mail names and keys are permuted by a keyed Feistel network within the values of their
format: a card number becomes another one with a right check digit, a date another date. The same value becomes the
same pseudonym in every document, however it is separated, and whoever has the key could turn it back.

All of it is column expressions. A text is split at the matches of one pattern; only the matches are worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.tables import LOWER, UPPER, field, packed, unpacked

ROUNDS = 10
DIGITS, HEX = "0123456789", "0123456789abcdef"
# Dates of 400 years, a whole cycle of the calendar: 146,097 days, which is 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)

# What the formats look like.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
# A token ends before a full stop, so that it has one pseudonym at the end of a sentence too.
_TOKEN = r"[A-Za-z0-9._~+/=-]{15,}[A-Za-z0-9_~+/=-]"
_SET = r"[ \t]{0,2}[=:][ \t]{0,2}[\"']{0,1}"
SECRET = (
    rf"(?<=password[=:])[^\s\"']{{4,}}|(?<=token = \"){_TOKEN}|(?<=token=){_TOKEN}"
    # Any letter case, blanks and quotes around the sign, and the usual names of keys.
    rf"|(?i:(?<=(?:password|passwd|pwd|passphrase){_SET}))[^\s\"']{{4,}}"
    rf"|(?i:(?<=(?:token|secret|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key){_SET})){_TOKEN}"
    rf"|(?i:(?<=bearer[ \t]{{1,2}})){_TOKEN}"
)
ACCESS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,4}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,4}"
    r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
)
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
# A country's number, then groups of digits; one bank account, its country and check digits; an address of eight groups.
ABROAD = r"(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-][0-9]{2,5}){2,4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP6 = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
ANY = "|".join((SECRET, ACCESS, EMAIL, IP, IP6, IBAN, CARD, ABROAD, PHONE, SSN, DATE))
# No format goes without one of these: the other formats need digits.
HINT = r"[0-9@=]|AKIA|(?i:pass(?:word|wd|phrase)|pwd|token|secret|key|bearer)"
_DATE_FORMATS = (
    (r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{4}/", "yyyy/MM/dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), (r"^[0-9]{2}/", "MM/dd/yyyy"),
)


def _whole(number: int) -> Column:
    return F.lit(number).cast("long")


def _noise(key: str, kind: str, turn: Column, half: Column) -> Column:
    """48 keyed bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def permute(x: Column, left: Column, right: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the whole numbers below ``left * right``: the two digits of ``x`` to these bases take turns
    in being moved by a hash of the other one."""
    start = F.struct(F.floor(x / right).cast("long").alias("a"), (x % right).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + _noise(key, kind, i, s["b"])) % left).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + _noise(key, kind, i, s["a"])) % right).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * right + s["b"])


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def permute_text(text: Column, alphabets: tuple[str, ...], kind: str, key: str) -> Column:
    """A keyed permutation of texts that leaves every character in its alphabet, and others as they are: the halves of
    the text take turns in being moved by a hash of the other one."""
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b"))

    def moved(part: Column, i: Column, other: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 512)

        def char(c: Column, at: Column) -> Column:
            step = F.conv(F.substring(stream, 2 * (at % 64) + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for letters in alphabets:
                place = F.instr(F.lit(letters), c)
                there = F.substring(F.lit(letters), (place - 1 + step) % len(letters) + 1, F.lit(1))
                out = F.when(place > 0, there).otherwise(out)
            return out

        return F.array_join(F.transform(_chars(part), char), "")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, moved(s["a"], i, s["b"])).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(moved(s["b"], i, s["a"])).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced one by one."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        new = F.when(digit, F.substring(digits, s["at"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["text"], new).alias("text"), (s["at"] + F.when(digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(_chars(template), start, step, lambda s: s["text"])


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10; 0 for a valid number."""

    def worth(c: Column, i: Column) -> Column:
        x = c.cast("int") * (i % 2 + 1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), worth), F.lit(0), lambda a, x: a + x) % 10


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def card(text: Column, key: str) -> Column:
    digits = _digits(text)
    n = F.length(digits) - 1
    right = F.floor(n / 2).cast("int")
    moved = permute(F.substring(digits, F.lit(1), n).cast("long"), _power(n - right), _power(right), "card", key)
    payload = F.lpad(moved.cast("string"), n, F.lit("0"))
    check = (10 - _luhn(F.concat(payload, F.lit("0")))) % 10
    new = _refilled(text, F.concat(payload, check.cast("string")))
    return F.when(_luhn(digits) == 0, new).otherwise(text)


def phone(text: Column, key: str) -> Column:
    digits = _digits(text)
    front = F.substring(digits, F.lit(1), F.length(digits) - 10)
    own = F.substring(digits, F.length(digits) - 9, F.lit(10))
    y = permute(own.cast("long"), _whole(100_000), _whole(100_000), "phone", key)
    return _refilled(text, F.concat(front, F.lpad(y.cast("string"), F.lit(10), F.lit("0"))))


def abroad(text: Column, key: str) -> Column:
    """The country's number stays; the digits after it are one number."""
    code = _digits(F.regexp_extract(text, "^.[0-9]+", 0))
    own = F.substring(_digits(text), F.length(code) + 1, F.length(text))
    n = F.length(own)
    right = F.floor(n / 2).cast("int")
    # 18 digits at most go into a whole number; the format has no more than 20, and the last of more stay.
    n18, right = F.least(n, F.lit(18)), F.least(right, F.lit(9))
    y = permute(F.substring(own, F.lit(1), n18).cast("long"), _power(n18 - right), _power(right), "abroad", key)
    return _refilled(text, F.concat(code, F.lpad(y.cast("string"), n18, F.lit("0")), F.substring(own, n18 + 1, n)))


def _mod97(text: Column) -> Column:
    """Remainder of the number that a text of digits and capital letters spells, A being 10."""

    def step(rest: Column, c: Column) -> Column:
        letter = F.instr(F.lit(UPPER), c)
        return F.when(letter > 0, rest * 100 + letter + 9).otherwise(rest * 10 + c.try_cast("int")) % 97

    return F.aggregate(_chars(text), F.lit(0), step)


def account(text: Column, key: str) -> Column:
    """Country and length stay, the check digits are those of the new account."""
    plain = F.regexp_replace(text, " ", "")
    country, own = F.substring(plain, F.lit(1), F.lit(2)), F.substring(plain, F.lit(5), F.length(plain))
    moved = permute_text(own, (DIGITS, UPPER), "account", key)
    check = (98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string")
    new = F.concat(country, F.lpad(check, F.lit(2), F.lit("0")), moved)
    spaced = F.when(F.contains(text, F.lit(" ")), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)
    valid = _mod97(F.concat(own, country, F.substring(plain, F.lit(3), F.lit(2)))) == 1
    return F.when(valid, spaced).otherwise(text)


def address6(text: Column, key: str) -> Column:
    """Written in small letters, so that its letter case makes no other value."""
    return permute_text(F.lower(text), (HEX,), "ip6", key)


def address(text: Column, key: str) -> Column:
    octet = [F.split_part(text, F.lit("."), F.lit(i)).cast("long") for i in range(1, 5)]
    x = ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]
    y = permute(x, _whole(1 << 16), _whole(1 << 16), "ip", key)
    return F.concat_ws(".", *((F.floor(y / (256**i)) % 256).cast("string") for i in (3, 2, 1, 0)))


def ssn(text: Column, key: str) -> Column:
    area, group, serial = (F.split_part(text, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    x = (place * 99 + group - 1) * 9_999 + serial - 1
    y = permute(x, _whole(898), _whole(99 * 9_999), "ssn", key)
    place = F.floor(y / (99 * 9_999))
    area = place + F.when(place >= 665, 2).otherwise(1)
    new = [(area, 3), (F.floor(y / 9_999) % 99 + 1, 2), (y % 9_999 + 1, 4)]
    made = F.concat_ws("-", *(F.lpad(v.cast("string"), F.lit(n), F.lit("0")) for v, n in new))
    return F.when(valid, made).otherwise(text)


def date(text: Column, key: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    out = text
    for pattern, shape in _DATE_FORMATS:
        day = F.try_to_date(text, shape)
        x = F.datediff(day, first).cast("long")
        y = permute(x, _whole(DAYS[0]), _whole(DAYS[1]), "date", key)
        valid = day.isNotNull() & (x >= 0) & (x < DAYS[0] * DAYS[1])
        made = F.date_format(F.date_add(first, y.cast("int")), shape)
        out = F.when(text.rlike(pattern), F.when(valid, made).otherwise(text)).otherwise(out)
    return out


def email(text: Column, key: str) -> Column:
    name = F.substring_index(text, "@", 1)
    site = F.substring(text, F.length(name) + 1, F.length(text))
    return F.concat(permute_text(name, (DIGITS, LOWER, UPPER), "email", key), site)


def secret(text: Column, key: str) -> Column:
    plain = permute_text(text, (DIGITS, LOWER, UPPER), "secret", key)
    return F.when(text.rlike("^[0-9a-f]+$"), permute_text(text, (HEX,), "secret", key)).otherwise(plain)


def access(text: Column, key: str) -> Column:
    own = F.substring(text, F.lit(5), F.length(text))
    return F.concat(F.lit("AKIA"), permute_text(own, (DIGITS, UPPER), "access", key))


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of a matched value; itself if it is not valid in its format."""
    digits = F.length(_digits(match))
    return (
        F.when(match.rlike(rf"^(?:{ACCESS})$"), access(match, key))
        .when(match.rlike(rf"^(?:{EMAIL})$"), email(match, key))
        .when(match.rlike(rf"^(?:{IP})$"), address(match, key))
        .when(match.rlike(rf"^(?:{IP6})$"), address6(match, key))
        .when(match.rlike(rf"^(?:{IBAN})$"), account(match, key))
        .when(match.rlike(rf"^(?:{ABROAD})$"), abroad(match, key))
        .when(match.rlike(rf"^(?:{SSN})$"), ssn(match, key))
        .when(match.rlike(rf"^(?:{DATE})$"), date(match, key))
        .when(match.rlike(rf"^(?:{PHONE})$"), phone(match, key))
        .when(match.rlike(rf"^(?:{CARD})$") & (digits >= 13), card(match, key))
        .otherwise(secret(match, key))
    )


def pseudonymise(docs: DataFrame, key: str = "pseudonyms", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with the values in ``text`` replaced, and ``n_values``, the number of values replaced.

    Numbers that look like cards or bank accounts but have wrong check digits, impossible dates and impossible social
    security numbers stay. A short value may by chance stand for itself. Null text: null, 0 values. Null ids and repeated rows
    are passed on. Very long texts are read whole. An empty table gives no rows. Extra columns are kept; one that
    is called ``n_values`` is replaced. Values with equal beginnings: the first format of the list that fits at the
    earliest place, as in the pattern.
    """
    rows = packed(docs, field(text).cast("string").alias("text"))
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    rows = rows.withColumn("hinted", F.col("text").rlike(HINT))
    rows = rows.withColumn("found", F.when(F.col("hinted"), found))
    made = F.transform("found", lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    rows = rows.withColumn("made", F.when(F.size("found") > 0, made))
    between = F.split("text", ANY, -1)
    joined = F.array_join(
        F.zip_with(between, F.col("made"), lambda s, m: F.concat(s, F.coalesce(m["new"], F.lit("")))), ""
    )
    replaced = F.when(F.col("made").isNotNull(), joined).otherwise(F.col("text"))
    changed = F.size(F.filter("made", lambda m: m["old"] != m["new"]))
    n = F.when(F.col("made").isNotNull(), changed).otherwise(0).cast("long")
    return unpacked(rows, docs.columns, replaced.alias(text), n.alias("n_values"))
