"""Personal data replaced by format-preserving pseudonyms.

Native: DataFrame functions only. Card numbers, telephone and social security numbers, IPv4
addresses, dates and the local parts of e-mail addresses are found by pattern and checked:
cards by Luhn's sum, dates by the calendar, addresses by range. A value that passes is
permuted within its format by a keyed Feistel network, so equal values get equal
pseudonyms in every document, different values different ones, and a pseudonym passes the
same check. Layout, such as blanks and brackets, stays.

* Cards keep length and first digit; the check digit follows from the others.
* Telephone numbers keep what is before their last ten digits.
* Dates stay in their stretch of 28 years, in which every calendar day is hit once.
* Addresses and social security numbers go over their whole valid range.
* Local parts of e-mail addresses permute letters and digits in their places.

A Feistel round adds a keyed SHA-256 of one half to the other half, modulo the size of that
half's range; ranges that are products of two numbers need no second try. Null stays null,
and texts without digits and ``@`` pass unread. Rows are read one by one, so repeated rows
and ids change alike, and an empty table stays empty. Repeats in the patterns are bounded
or possessive, so a text of any length is read in steps that do not pile up. Nothing is
shuffled. The key is part of the
query plan; keep plans and event logs as secret as the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.llm.common import free_name

ROUNDS = 10
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE = (
    r"(?<![0-9-])[12][0-9]{3}-[01][0-9]-[0-3][0-9](?![0-9-])"
    r"|(?<![0-9.])[0-3][0-9]\.[01][0-9]\.[12][0-9]{3}(?![0-9])"
    r"|(?<![0-9/])[0-3][0-9]/[0-3][0-9]/[12][0-9]{3}(?![0-9/])"
)
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONE = (
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
)
PATTERN = "|".join((EMAIL, DATE, ADDRESS, SOCIAL, CARD, PHONE))
KINDS = ("email", "date", "address", "social", "card", "phone")

# 28 years from 1901 on have 10227 days = 21 * 487, and so have the next ones until 2096.
ORIGIN = "1901-01-01"
DAYS = (21, 487)
DATE_FORMS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")
# Social security numbers: areas without 000, 666 and 900 on, groups and serials without 0.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _hash(key: str, tag: str | Column, turn: Column, half: Column) -> Column:
    """60 bits that depend on the key, the kind of value, the round and the other half."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    text = F.concat_ws("|", F.lit(key), tag, turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tag: str | Column, first: Column, second: Column, sizes: tuple) -> Column:
    """A keyed permutation of pairs of numbers below ``sizes``, as a struct of first and second."""
    size_a, size_b = (F.lit(s).cast("long") if isinstance(s, int) else s for s in sizes)

    def turn(pair: Column, i: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.when(
            i % 2 == 0, F.struct(F.pmod(a + _hash(key, tag, i, b), size_a).alias("a"), b.alias("b"))
        ).otherwise(F.struct(a.alias("a"), F.pmod(b + _hash(key, tag, i, a), size_b).alias("b")))

    start = F.struct(first.cast("long").alias("a"), second.cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ten_to(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(key: str, tag: str, digits: Column) -> Column:
    """Another string of as many digits; up to 18."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    # The zero in front gives an empty left half its value.
    first = F.substr(F.concat(F.lit("0"), digits), F.lit(1), left + 1).cast("long")
    second = F.substr(digits, left + 1, right).cast("long")
    sizes = (_ten_to(left), _ten_to(right))
    pair = feistel(key, F.concat(F.lit(tag), n.cast("string")), first, second, sizes)
    both = F.transform(
        F.array(pair),
        lambda p: F.concat(
            F.when(left > 0, F.lpad(p["a"].cast("string"), left, "0")).otherwise(F.lit("")),
            F.lpad(p["b"].cast("string"), right, "0"),
        ),
    )
    return both[0]


def _laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in their places."""

    def at(k: Column) -> Column:
        char = F.substr(value, k, F.lit(1))
        nth = F.length(_digits(F.substr(value, F.lit(1), k)))
        return F.when(char.rlike("[0-9]"), F.substr(digits, nth, F.lit(1))).otherwise(char)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), at), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum with the last digit counted once."""

    def part(k: Column) -> Column:
        d = F.substr(F.reverse(digits), k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    parts = F.transform(F.sequence(F.lit(1), F.length(digits)), part)
    return F.aggregate(parts, F.lit(0), lambda total, x: total + x)


def _card(key: str, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    inner = permuted_digits(key, "card", F.substr(digits, F.lit(2), n - 2))
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), inner)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn_sum(digits) % 10 == 0, _laid_out(value, F.concat(body, check)))


def _phone(key: str, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    kept = F.greatest(n - 10, F.lit(0))
    new = F.concat(F.substr(digits, F.lit(1), kept), permuted_digits(key, "phone", F.substr(digits, kept + 1, n)))
    return F.when(n.between(7, 15), _laid_out(value, new))


def _address(key: str, value: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    pair = feistel(key, "address", octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], (65536, 65536))
    new = F.transform(
        F.array(pair),
        lambda p: F.concat_ws(".", *[(F.floor(p[h] / d) % 256).cast("string") for h in "ab" for d in (256, 1)]),
    )[0]
    return F.when(F.forall(octets, lambda x: x < 256), new)


def _social(key: str, value: Column) -> Column:
    parts = F.transform(F.split(value, "-"), lambda x: x.cast("long"))
    area, group, serial = parts[0], parts[1], parts[2]
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel(key, "social", index, (group - 1) * SERIALS + serial - 1, (AREAS, GROUPS * SERIALS))

    def written(p: Column) -> Column:
        new_area = F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1)
        new_group, new_serial = F.floor(p["b"] / SERIALS) + 1, p["b"] % SERIALS + 1
        return F.concat_ws(
            "-", *[F.lpad(x.cast("string"), w, "0") for x, w in ((new_area, 3), (new_group, 2), (new_serial, 4))]
        )

    return F.when(valid, F.transform(F.array(pair), written)[0])


def _date_as(key: str, value: Column, form: str) -> Column:
    day = F.try_to_timestamp(value, F.lit(form)).cast("date")
    number = F.datediff(day, F.lit(ORIGIN).cast("date"))
    place = F.pmod(number, F.lit(DAYS[0] * DAYS[1]))
    pair = feistel(key, "date", F.floor(place / DAYS[1]), place % DAYS[1], DAYS)

    def written(p: Column) -> Column:
        moved = (number - place + p["a"] * DAYS[1] + p["b"]).cast("int")
        return F.date_format(F.date_add(F.lit(ORIGIN).cast("date"), moved), form)

    shape = "^" + "".join("[0-9]" if c.isalpha() else f"[{c}]" for c in form) + "$"
    return F.when(value.rlike(shape) & day.isNotNull(), F.transform(F.array(pair), written)[0])


def _date(key: str, value: Column) -> Column:
    """Of the two ways to read a date with slashes the one with the month first, if it is valid."""
    return F.coalesce(*[_date_as(key, value, form) for form in DATE_FORMS])


def _shifted(part: Column, stream: Column) -> Column:
    """Letters and digits of ``part`` moved on within their kind by bytes of ``stream``, in hex."""

    def at(k: Column) -> Column:
        char = F.substr(part, k, F.lit(1))
        place = F.pmod(k - 1, F.lit(32)) * 2 + 1
        by = F.conv(F.substr(stream, place, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(char)

        def moved(low: int, size: int) -> Column:
            return F.char(F.lit(low) + F.pmod(code - low + by, F.lit(size)))

        return (
            F.when(char.rlike("[a-z]"), moved(97, 26))
            .when(char.rlike("[A-Z]"), moved(65, 26))
            .when(char.rlike("[0-9]"), moved(48, 10))
            .otherwise(char)
        )

    places = F.filter(F.sequence(F.lit(0), F.length(part)), lambda k: k > 0)
    return F.array_join(F.transform(places, at), "")


def _email(key: str, value: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def stream(i: Column, other: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other), 256)

    def turn(pair: Column, i: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.when(i % 2 == 0, F.struct(_shifted(a, stream(i, b)).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), _shifted(b, stream(i, a)).alias("b"))
        )

    start = F.struct(F.substr(local, F.lit(1), half).alias("a"), F.substr(local, half + 1, F.length(local)).alias("b"))
    pair = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), start, turn)
    new = F.transform(F.array(pair), lambda p: F.concat(p["a"], p["b"]))[0]
    return F.concat(new, F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(key: str, value: Column) -> Column:
    """Kind and pseudonym of a match of PATTERN; null where the value fails its check."""
    makers = {"email": _email, "date": _date, "address": _address, "social": _social, "card": _card, "phone": _phone}
    shapes = dict(zip(KINDS, (EMAIL, DATE, ADDRESS, SOCIAL, CARD, PHONE), strict=True))
    found = F.lit(None).cast("struct<kind:string,new:string>")
    for kind in reversed(KINDS):
        new = makers[kind](key, value)
        made = F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("new")))
        found = F.when(value.rlike(f"^(?:{shapes[kind]})$"), made).otherwise(found)
    return found


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and a count of each kind: n_email, n_date, ...

    Columns of these names in ``docs`` get an underscore in front of the new ones.
    """
    some = F.col(text).rlike("[0-9@]")
    values, between, made = (free_name(docs, n) for n in ("_values", "_between", "_made"))
    split = docs.withColumn(
        values, F.when(some, F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    ).withColumn(between, F.when(some & (F.size(values) > 0), F.split(text, PATTERN, -1)))
    done = split.withColumn(made, F.transform(values, lambda v: pseudonym(key, v)))
    pieces = F.zip_with(
        F.zip_with(values, made, lambda v, m: F.coalesce(m["new"], v)),
        F.slice(between, 2, F.greatest(F.size(values), F.lit(1))),
        lambda new, after: F.concat(new, after),
    )
    new_text = F.when(F.size(values) > 0, F.concat(F.col(between)[0], F.array_join(pieces, ""))).otherwise(F.col(text))

    def count(kind: str) -> Column:
        own = F.size(F.filter(made, lambda m: m["kind"] == kind))
        return F.coalesce(own, F.lit(0)).cast("long").alias(free_name(docs, f"n_{kind}"))

    counts = [count(kind) for kind in KINDS]
    return done.select(*[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *counts)
