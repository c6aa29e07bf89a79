"""Format-preserving Feistel pseudonyms for personal values, in DataFrame functions alone.

Every candidate that passes its validation is replaced by another valid value of the same format: a
keyed permutation within the format, so equal values stay equal across documents and others stay
different. Text around the values does not change, nor does its length.

* payment card: 13 to 19 digits, grouped by blanks or dashes or not, with a right Luhn digit; all
  digits but the last are permuted and the last made right again. Of a longer row of digit groups every
  run of groups that is a card is replaced, the longest from the left, so an expiry date, a check code
  or another number beside a card does not hide it;
* phone: North American, with area code and exchange from 200; both ranges are kept;
* IPv4 address: four numbers up to 255, written without leading zeros, each of which keeps its width;
* date: yyyy-mm-dd (a time may follow), dd.mm.yyyy or mm/dd/yyyy (dd/mm/yyyy where only that is a date)
  of 1800 to 2199, permuted over the 146,097 days of that Gregorian cycle;
* social security number: ddd-dd-dddd with a possible area, group and serial;
* e-mail address: letters and digits of the local part, each within its class; the domain stays;
* secret: hexadecimal strings of 32 or more digits in one case, quoted after a name and an equals sign
  or colon; those of more than 128 are permuted in pieces of 64, each under its place and the piece before it.

Rows of digit groups and secrets may be of any length.

Numbers that fail their validation stay as they are. Not covered: IBAN, IPv6, names, addresses.

The key is an argument, and reaches the tasks by a scalar subquery, so that no plan or log shows it.

Edge cases: null text stays null; empty text stays empty; texts of any length are taken whole; repeated
documents change alike; other columns are not looked at, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting that holds the key of registered queries and the pipeline.
KEY_SETTING = "quantloom.pii.key"
ROUNDS = 8
#: Digits of the longest card, groups of digits put together at a time, and digits of a long secret's pieces.
MOST_CARD_DIGITS, CHUNK, SECRET_PIECE = 19, 64, 64

#: Fixed patterns, by kind: what must stand before, the value, what must not or must stand after it. No part
#: without an upper bound makes Java's matcher recurse: such parts are single classes, or possessive.
PATTERNS = {
    "email": (r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}", ""),
    "secret": (r"(?<=[=:]\s?[\"'])", r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)", r"(?=[\"'])"),
    "iso_date": (r"(?<![\w.-])", r"\d{4}-\d{2}-\d{2}", r"(?:(?![\w-])|(?=T\d{2}:\d{2}))"),
    "dot_date": (r"(?<![\w.-])", r"\d{2}\.\d{2}\.\d{4}", r"(?![\w-])"),
    "slash_date": (r"(?<![\w/-])", r"\d{2}/\d{2}/\d{4}", r"(?![\w/-])"),
    "ssn": (r"(?<![\w-])", r"\d{3}-\d{2}-\d{4}", r"(?![\w-])"),
    "ipv4": (r"(?<![\w.])", r"(?:\d{1,3}\.){3}\d{1,3}", r"(?!\w|\.\d)"),
    "phone": (r"(?<![\w-])", r"(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}", r"(?![\w-])"),
    "card": (r"(?<![\w-])", r"(?=\d(?:[ -]?\d){12})\d++(?!\w)(?:[ -]\d++(?!\w))*+", ""),
}
ANY = "|".join(before + value + after for before, value, after in PATTERNS.values())
#: What every value of any pattern holds; texts without it are not searched.
NEEDED = r"@|\d\D{0,4}\d\D{0,4}\d|[0-9a-fA-F]{32}"

#: Days of 1800 to 2199, as the product of two radices, and the first of them.
DAYS, DAY_RADICES, FIRST_DAY = 146_097, (189, 773), "1800-01-01"


_own_keys: dict[str, str] = {}


def configured_key(spark: SparkSession) -> str:
    """The key in the session's ``quantloom.pii.key``; where that is unset, a random one for the
    application, so that pseudonyms agree within it and can't be undone after it."""
    return spark.conf.get(KEY_SETTING, None) or _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _prf(key: Column, kind: str, round_: Column | int, value: Column) -> Column:
    """64 hexadecimal digits from the key, the format, the round and the other half."""
    return F.sha2(F.concat(key, F.lit(f"|{kind}|"), F.lit(round_).cast("string") if isinstance(round_, int) else round_.cast("string"), F.lit("|"), value), 256)


def _number(hex_digits: Column, modulus: Column) -> Column:
    return F.conv(F.substring(hex_digits, 1, 14), 16, 10).cast("long") % modulus


def permute_pair(key: Column, kind: str, left: Column, right: Column, radix_left: Column | int, radix_right: Column | int) -> Column:
    """A keyed permutation of pairs of numbers below the two radices: struct<l, r>."""
    radix_left, radix_right = (F.lit(r).cast("long") if isinstance(r, int) else r for r in (radix_left, radix_right))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        half, other, radix = F.when(even, acc["l"]).otherwise(acc["r"]), F.when(even, acc["r"]).otherwise(acc["l"]), F.when(even, radix_left).otherwise(radix_right)
        moved = (half + _number(_prf(key, kind, i, other.cast("string")), radix)) % radix
        return _bound(moved, lambda m: F.struct(F.when(even, m).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(m).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once, however often ``make`` reads it inside other functions."""
    return F.transform(F.array(value), make)[0]


def _streams(key: Column, kind: str, round_: Column, other: Column, length: Column) -> Column:
    """Four hexadecimal digits for each of so many places, from the other half: blocks of 16 places with a
    number each, so that no place's digits are those of another."""
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((length - 1) / 16).cast("int")))
    numbered = lambda b: F.when(b == 0, other).otherwise(F.concat(other, F.lit("|"), b.cast("string")))
    return F.array_join(F.transform(blocks, lambda b: _prf(key, kind, round_, numbered(b))), "")


def _shifted(half: Column, stream: Column, hexadecimal: bool) -> Column:
    """Every digit and letter of a string moved within its class by the stream; others stay."""

    def move(c: Column, i: Column, digits: Column) -> Column:
        by = F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        if hexadecimal:
            digit = F.conv(c, 16, 10).cast("int")
            return F.lower(F.conv(((digit + by) % 16).cast("string"), 10, 16))
        return (
            F.when(c.between("0", "9"), F.char((code - 48 + by) % 10 + 48))
            .when(c.between("a", "z"), F.char((code - 97 + by) % 26 + 97))
            .when(c.between("A", "Z"), F.char((code - 65 + by) % 26 + 65))
            .otherwise(c)
        )

    return F.when(half == "", half).otherwise(_bound(stream, lambda digits: F.array_join(F.transform(F.split(half, ""), lambda c, i: move(c, i, digits)), "")))


def permute_string(key: Column, kind: str, value: Column, hexadecimal: bool = False, tweak: Column | None = None) -> Column:
    """A keyed permutation of strings that keeps the class of every character and the places of others; one
    for each ``tweak``."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        salt = F.concat(F.length(value).cast("string"), F.lit(":"), *([] if tweak is None else [tweak]))
        half, other = F.when(even, acc["l"]).otherwise(acc["r"]), F.when(even, acc["r"]).otherwise(acc["l"])
        moved = _bound(half, lambda h: _shifted(h, _streams(key, kind, i, F.concat(salt, other), F.length(h)), hexadecimal))
        return _bound(moved, lambda m: F.struct(F.when(even, m).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(m).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum of a digit string, every other digit doubled from the given place (0: the last)."""
    indexed = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == doubled_from_right, d.cast("int") * 2 - F.when(d >= "5", F.lit(9)).otherwise(F.lit(0))).otherwise(d.cast("int")))
    return F.aggregate(indexed, F.lit(0), lambda a, x: a + x)


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, MOST_CARD_DIGITS) & (_luhn_sum(digits, 1) % 10 == 0) & ~digits.rlike(r"^(\d)\1*$")


def _card_digits(key: Column, digits: Column) -> Column:
    body = permute_string(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    return _bound(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))


def _card(key: Column, value: Column) -> Column:
    """The value with every run of digit groups that is a card replaced; null if there is none."""
    return _bound(F.split(value, "(?<=[ -])"), lambda groups: _cards_of(key, groups))


def _cards_of(key: Column, groups: Column) -> Column:
    """The groups (each with the separator after it) as one text, with the cards among them replaced: at each
    group that no card has taken the longest run that is one. The text is put together in chunks, so that a
    row of very many groups does not copy it for each of them."""
    text = lambda i, n: F.array_join(F.slice(groups, i + 1, n), "")
    plain = lambda t: F.regexp_replace(t, "[ -]", "")

    def step(acc: Column, i: Column) -> Column:
        lengths = F.filter(F.sequence(F.least(F.size(groups) - i, F.lit(MOST_CARD_DIGITS)), F.lit(1), F.lit(-1)), lambda n: _is_card(plain(text(i, n))))

        def moved(n: Column) -> Column:
            new = _bound(text(i, F.greatest(n, F.lit(1))), lambda piece: F.when(n > 0, _fill(piece, _card_digits(key, plain(piece)))).otherwise(piece))
            return F.struct(F.concat(acc["text"], new).alias("text"), (i + F.greatest(n, F.lit(1))).alias("next"), (acc["cards"] + (n > 0).cast("int")).alias("cards"))

        return F.when(i < acc["next"], acc).otherwise(_bound(F.coalesce(F.get(lengths, F.lit(0)), F.lit(0)), moved))

    def chunk(acc: Column, c: Column) -> Column:
        places = F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, F.size(groups)) - 1)
        start = F.struct(F.lit("").alias("text"), acc["next"].alias("next"), acc["cards"].alias("cards"))
        return _bound(F.aggregate(places, start, step), lambda part: F.struct(F.concat(acc["text"], part["text"]).alias("text"), part["next"].alias("next"), part["cards"].alias("cards")))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("next"), F.lit(0).alias("cards"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(groups) - 1) / CHUNK).cast("int"))
    return F.aggregate(chunks, start, chunk, lambda acc: F.when(acc["cards"] > 0, acc["text"]))


def _secret(key: Column, value: Column) -> Column:
    """A hexadecimal string permuted; a long one in pieces, so that its cost is linear."""
    short = F.length(value) <= 2 * SECRET_PIECE
    size = F.when(short, 2 * SECRET_PIECE).otherwise(SECRET_PIECE)
    piece = lambda j: F.substring(value, j * size + 1, size)
    tweak = lambda j: F.when(short, F.lit("")).otherwise(F.concat(j.cast("string"), F.lit("."), F.when(j > 0, piece(j - 1)).otherwise(F.lit("")), F.lit(":")))
    pieces = F.sequence(F.lit(0), F.floor((F.length(value) - 1) / size).cast("int"))
    return F.array_join(F.transform(pieces, lambda j: _bound(piece(j), lambda p: permute_string(key, "secret", p, True, tweak(j)))), "")


def _fill(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order."""
    count_before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"\D", ""))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, count_before(i) + 1, F.lit(1))).otherwise(c)), "")


def _phone(key: Column, value: Column) -> Column:
    digits = F.right(_digits(value), F.lit(10))
    area, rest = F.substring(digits, 1, 3).cast("long") - 200, (F.substring(digits, 4, 3).cast("long") - 200) * 10_000 + F.substring(digits, 7, 4).cast("long")
    national = lambda m: F.concat(F.lpad((m["l"] + 200).cast("string"), 3, "0"), F.lpad((m["r"] + 2_000_000).cast("string"), 7, "0"))
    new = _bound(permute_pair(key, "phone", area, rest, 800, 8_000_000), national)
    return _bound(F.concat(F.when(F.length(_digits(value)) == 11, F.lit("1")).otherwise(F.lit("")), new), lambda d: _fill(value, d))


def _ipv4(key: Column, value: Column) -> Column:
    valid = F.forall(F.split(value, r"\."), lambda x: (x.cast("int") <= 255) & ((x == "0") | ~x.startswith("0")))
    least = lambda i: F.element_at(F.array(F.lit(0), F.lit(10), F.lit(100)), F.length(F.split(value, r"\.")[i])).cast("long")
    count = lambda i: F.element_at(F.array(F.lit(10), F.lit(90), F.lit(156)), F.length(F.split(value, r"\.")[i])).cast("long")
    index = lambda i: F.split(value, r"\.")[i].cast("long") - least(i)
    made = permute_pair(key, "ipv4", index(0) * count(1) + index(1), index(2) * count(3) + index(3), count(0) * count(1), count(2) * count(3))
    part = lambda x, i: F.concat_ws(".", (F.floor(x / count(i + 1)) + least(i)).cast("string"), (x % count(i + 1) + least(i + 1)).cast("string"))
    return F.when(valid, _bound(made, lambda m: F.concat(part(m["l"], 0), F.lit("."), part(m["r"], 2))))


def _date(key: Column, value: Column, *formats: str) -> Column:
    """The first format under which the value is a day of the range; all formats share one permutation."""
    out = F.lit(None).cast("string")
    for f in reversed(formats):
        day = F.to_date(F.try_to_timestamp(value, F.lit(f)))
        at = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
        made = permute_pair(key, "date", F.floor(at / DAY_RADICES[1]), at % DAY_RADICES[1], *DAY_RADICES)
        new = _bound(made, lambda m: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (m["l"] * DAY_RADICES[1] + m["r"]).cast("int")), f))
        out = F.when(day.isNotNull() & at.between(0, DAYS - 1) & (F.date_format(day, f) == value), new).otherwise(out)
    return out


def _ssn(key: Column, value: Column) -> Column:
    """Areas 1 to 665 and 667 to 899, groups 1 to 99, serials 1 to 9999."""
    area, group, serial = F.substring(value, 1, 3).cast("long"), F.substring(value, 5, 2).cast("long"), F.substring(value, 8, 4).cast("long")
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    made = permute_pair(key, "ssn", place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    new_area = lambda m: F.when(m["l"] >= 665, m["l"] + 2).otherwise(m["l"] + 1)
    parts = lambda m: (F.lpad(new_area(m).cast("string"), 3, "0"), F.lpad((F.floor(m["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((m["r"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, _bound(made, lambda m: F.concat_ws("-", *parts(m))))


def _email(key: Column, value: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(permute_string(key, "email", local), F.lit("@"), F.substring_index(value, "@", -1))


def pseudonym(key: Column | str, value: Column) -> Column:
    """The pseudonym of one candidate; null where it fails its validation."""
    key = F.lit(key) if isinstance(key, str) else key
    full = lambda kind: value.rlike(f"^(?:{PATTERNS[kind][1]})$")
    secret = _secret(key, F.lower(value))
    return (
        F.when(value.contains("@"), _email(key, value))
        .when(full("iso_date"), _date(key, value, "yyyy-MM-dd"))
        .when(full("dot_date"), _date(key, value, "dd.MM.yyyy"))
        .when(full("slash_date"), _date(key, value, "MM/dd/yyyy", "dd/MM/yyyy"))
        .when(full("ssn"), _ssn(key, value))
        .when(full("ipv4"), _ipv4(key, value))
        .when(full("phone"), _phone(key, value))
        .when(full("card"), _card(key, value))
        .when(full("secret"), F.when(value.rlike("[A-F]"), F.upper(secret)).otherwise(secret))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """doc (a struct of all columns as they were), text (with pseudonyms), n_found and n_replaced."""
    spark = docs.sparkSession
    source = F.col("doc").getField(text).cast("string")
    has = F.coalesce(source.rlike(NEEDED), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    secret_key = spark.createDataFrame([(key,)], "key string").scalar()
    found = rows.select("doc", source.alias("source"), secret_key.alias("key"), F.when(has, F.regexp_extract_all(source, F.lit(f"({ANY})"), F.lit(1))).alias("found"))
    made = found.select("doc", "source", "found", F.when(F.size("found") > 0, F.transform("found", lambda v: F.struct(v.alias("old"), pseudonym(F.col("key"), v).alias("new")))).alias("made"))
    pieces = F.split("source", ANY, -1)
    joined = F.array_join(F.zip_with(pieces, "made", lambda p, m: F.concat(p, F.coalesce(m["new"], m["old"], F.lit("")))), "")
    return made.select(
        "doc",
        F.when(F.size("found") > 0, joined).otherwise(F.col("source")).alias("text"),
        F.coalesce(F.when(F.size("found") >= 0, F.size("found")), F.lit(0)).alias("n_found"),
        F.coalesce(F.size(F.filter("made", lambda m: m["new"].isNotNull())), F.lit(0)).alias("n_replaced"),
    )


def redact(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The columns of ``docs``, with pseudonyms in the text."""
    return pseudonymise(docs, key, text).select(*[F.col("text").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])
