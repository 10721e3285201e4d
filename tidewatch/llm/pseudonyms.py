r"""Format-preserving pseudonyms for personal numbers, dates and addresses. DataFrame functions only.

Every candidate is validated, and its number is permuted by a keyed Feistel network whose domain is exactly the valid numbers of its format, so a pseudonym is valid too, keeps the layout, and equal values get equal pseudonyms in every document, however they are laid out. The number is split into a left half below a and a right half below b; ROUNDS times one half is shifted, modulo its size, by a keyed hash of the other. That is a permutation of all a times b numbers.

    card   13 to 19 digits with a valid Luhn digit, in one piece, in groups of four or as 4-6-5: all digits but the last are permuted, and the last is worked out again
    iban   two letters, two check digits and 11 to 30 letters or digits, in one piece or groups of four, with a valid checksum: the digits after the check digits are permuted, and the check digits worked out again
    phone  North American, area and exchange from 200 to 999: all ten digits
    intl   a plus sign and 9 to 15 digits, which spaces, dots, hyphens or brackets may part: all digits but the first two
    ssn    ddd-dd-dddd with an area of 001 to 899 but 666, group and serial not zero
    ip     four octets of 0 to 255
    ipv6   eight groups of hex digits, or fewer around one ::, written out again as eight groups: its four parts of 32 bits, each keyed by those before it too
    date   yyyy-mm-dd, d/m/yyyy (m/d/yyyy if only that is a day), d.m.yyyy, d Month yyyy or Month d, yyyy with an English month, a day of 1900 to 2099: the day's number among these 73,049
    email  no number: the local part becomes u and 16 hex digits of its keyed hash, and the domain example.com

A find never begins or ends inside a word, letters of any script. Candidates that aren't valid stay as they are. The texts are searched once, and the kind of a find is told by the patterns of the finds alone. The key is read by a subquery, so that it stands in no plan.

Defined results: a null text stays null, an empty one empty, with no finds. Rows that share an id are each returned. Other columns are kept, whatever their names, but for one named pii, which is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# English months.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + ")"
# The formats, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2} " + MONTH + " [0-9]{4}|" + MONTH + r" [0-9]{1,2}, [0-9]{4})(?![\p{L}0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:(?<![0-9])\+?1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9.-])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "intl": r"(?<![\p{L}0-9+])\+[1-9](?:[ .()-]{0,2}[0-9]){8,14}(?![0-9])",
    "card": r"(?<![\p{L}0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![\p{L}0-9:.])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){0,6}[0-9A-Fa-f]{1,4}(?![\p{L}0-9:])",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def divided(x: Column, by: Column) -> Column:
    """Whole-number division of longs, without a way through doubles."""
    return F.call_function("div", x, by)


def feistel(x: Column, a: Column | int, b: Column | int, key: Column | str, kind: str) -> Column:
    """The permuted number, for 0 <= x < a b."""
    key = key if isinstance(key, Column) else F.lit(key)
    a, b = (v if isinstance(v, Column) else F.lit(v).cast("long") for v in (a, b))

    def shift(k: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), k.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def once(s: Column, k: Column) -> Column:
        left, right = s.getField("l"), s.getField("r")
        return F.when(k % 2 == 1, F.struct(((left + shift(k, right) % a) % a).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), ((right + shift(k, left) % b) % b).alias("r")))

    start = F.struct(divided(x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, once, lambda s: s.getField("l") * b + s.getField("r"))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def laid_out(m: Column, digits: Column) -> Column:
    """The layout of m with other digits, as many as it has."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    put = F.transform(chars, lambda c, k: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(digits_of(F.substr(m, F.lit(1), k + 1))), F.lit(1))).otherwise(c))
    return F.array_join(put, "")


def padded(x: Column, n: int | Column) -> Column:
    x = x.cast("string")
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(F.repeat(F.lit("0"), n - F.length(x)), x)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, whose last digit is 0 for a valid number."""
    n = F.length(digits)

    def one(k: Column) -> Column:
        d = F.substr(digits, n - k + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda s, d: s + d)


def card(m: Column, key: Column) -> Column:
    digits = digits_of(m)
    n = F.length(digits) - 1
    right = F.floor(n / 2).cast("int")
    a, b = (F.pow(F.lit(10.0), k).cast("long") for k in (n - right, right))
    payload = padded(feistel(F.substr(digits, F.lit(1), n).cast("long"), a, b, key, "card"), n)
    check = F.pmod(-luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10))
    return F.when(luhn_sum(digits) % 10 == 0, laid_out(m, F.concat(payload, check.cast("string"))))


def phone(m: Column, key: Column) -> Column:
    digits = digits_of(m)
    lead, ten = F.substr(digits, F.lit(1), F.length(digits) - 10), F.right(digits, F.lit(10))
    area, exchange, line = (F.substr(ten, F.lit(p), F.lit(k)).cast("long") for p, k in ((1, 3), (4, 3), (7, 4)))
    x = feistel(((area - 200) * 800 + (exchange - 200)) * 10000 + line, 80_000, 80_000, key, "phone")
    high = divided(x, F.lit(10_000))
    new = F.concat(lead, padded(divided(high, F.lit(800)) + 200, 3), padded(high % 800 + 200, 3), padded(x % 10_000, 4))
    return F.when((area >= 200) & (exchange >= 200), laid_out(m, new))


def ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substr(m, F.lit(p), F.lit(k)).cast("long") for p, k in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 0 .. 897
    x = feistel((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    high = divided(x, F.lit(9999))
    at = divided(high, F.lit(99))
    new = F.concat_ws("-", padded(F.when(at >= 665, at + 2).otherwise(at + 1), 3), padded(high % 99 + 1, 2), padded(x % 9999 + 1, 4))
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), new)


def ip(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, "[.]"), lambda o: o.cast("long"))
    x = feistel(F.aggregate(octets, F.expr("0L"), lambda s, o: s * 256 + o), 65_536, 65_536, key, "ip")
    new = F.array_join(F.transform(F.array(*[F.lit(1 << k) for k in (24, 16, 8, 0)]), lambda k: divided(x, k) % 256), ".")
    return F.when(F.forall(octets, lambda o: o <= 255), new)


def number_of(digits: Column, key: Column, kind: str) -> Column:
    """As many other digits (two or more), by a permutation of all numbers with so many: up to 15 at once, the rest keyed by those before them too."""
    n = F.length(digits)
    head = F.when(n > 15, divided(n, F.lit(2))).otherwise(n).cast("int")

    def permuted(part: Column, by: Column) -> Column:
        right = divided(F.length(part), F.lit(2)).cast("int")
        a, b = (F.pow(F.lit(10.0), k).cast("long") for k in (F.length(part) - right, right))
        return padded(feistel(part.cast("long"), a, b, by, kind), F.length(part))

    first = permuted(F.substr(digits, F.lit(1), head), key)
    rest = F.substr(digits, head + 1, n - head)
    return F.when(n > 15, F.concat(first, permuted(rest, F.concat_ws("|", key, F.substr(digits, F.lit(1), head))))).otherwise(first)


def intl(m: Column, key: Column) -> Column:
    digits = digits_of(m)
    return laid_out(m, F.concat(F.substr(digits, F.lit(1), F.lit(2)), number_of(F.substr(digits, F.lit(3), F.length(digits) - 2), key, "intl")))


def checksum(letters: Column) -> Column:
    """The number that the characters make, letters as 10 to 35, modulo 97."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    chars = F.filter(F.split(letters, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda s, c: F.when(value(c) > 9, s * 100 + value(c)).otherwise(s * 10 + value(c)) % 97)


def iban(m: Column, key: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain) - 4)
    digits = digits_of(rest)
    new = F.when(F.length(digits) > 1, laid_out(rest, number_of(digits, key, "iban"))).otherwise(rest)
    check = padded((F.lit(98) - checksum(F.concat(new, country, F.lit("00")))).cast("long"), 2)
    valid = (checksum(F.concat(rest, F.substr(plain, F.lit(1), F.lit(4)))) == 1) & (F.length(plain) >= 15) & (F.length(plain) <= 34)
    return F.when(valid, laid_out(m, F.concat(check, digits_of(new))))


def ipv6(m: Column, key: Column) -> Column:
    sides = F.split(m, "::")
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    missing = 8 - F.size(left) - F.size(right)
    valid = F.when(F.size(sides) == 2, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
    full = F.transform(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right), lambda g: F.conv(g, 16, 10).cast("long"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(6), F.lit(2)), lambda k: F.get(full, k) * 65_536 + F.get(full, k + 1))
    by = lambda k: F.concat_ws("|", key, F.array_join(F.slice(parts, F.lit(1), k).cast("array<string>"), "|"))
    new = F.transform(parts, lambda p, k: feistel(p, 65_536, 65_536, by(k), "ipv6"))
    text = F.array_join(F.transform(new, lambda p: F.concat_ws(":", F.lower(F.hex(divided(p, F.lit(65_536)))), F.lower(F.hex(p % 65_536)))), ":")
    return F.when(valid, text)


def date(m: Column, key: Column) -> Column:
    """The day's number from 1900-01-01, permuted among 17 * 4297 days."""
    p = F.filter(F.split(m, "[-/., ]"), lambda x: x != "")
    a, b, c = (F.get(p, F.lit(k)) for k in range(3))
    named = m.rlike("[A-Za-z]")
    month_of = lambda x: F.array_position(F.array(*[F.lit(n[:3]) for n in MONTHS]), F.substr(x, F.lit(1), F.lit(3))).cast("string")
    iso = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    day_first, month_first = F.when(named, iso(c, month_of(b), a)).otherwise(iso(c, b, a)), F.when(named, iso(c, month_of(a), b)).when(m.contains("/"), iso(c, a, b))
    by_day = day_first.isNotNull()
    day = F.when(m.rlike("^[0-9]{4}-"), iso(a, b, c)).otherwise(F.coalesce(day_first, month_first))
    n = F.date_diff(day, F.lit("1900-01-01").cast("date")).cast("long")
    new = F.date_add(F.lit("1900-01-01").cast("date"), feistel(n, 17, 4297, key, "date").cast("int"))
    d, mo, y = F.dayofmonth(new).cast("string"), F.month(new), F.year(new).cast("string")
    # A day or month is padded as the old one was.
    like = lambda x, old: F.when(old.startswith("0") | (F.length(old) == 2), F.lpad(x, 2, "0")).otherwise(x)
    name = lambda old: F.when(F.length(old) > 3, F.get(F.array(*map(F.lit, MONTHS)), mo - 1)).otherwise(F.get(F.array(*[F.lit(x[:3]) for x in MONTHS]), mo - 1))
    num = mo.cast("string")
    sep = F.when(m.contains("/"), "/").otherwise(".")
    numbers = F.when(by_day, F.concat(like(d, a), sep, like(num, b), sep, y)).otherwise(F.concat(like(num, a), sep, like(d, b), sep, y))
    words = F.when(by_day, F.concat_ws(" ", d, name(b), y)).otherwise(F.concat(name(a), F.lit(" "), d, F.lit(", "), y))
    text = F.when(m.rlike("^[0-9]{4}-"), F.date_format(new, "yyyy-MM-dd")).when(named, words).otherwise(numbers)
    return F.when((n >= 0) & (n < 73_049), text)


def email(m: Column, key: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.com"))


MAKERS = {"email": email, "date": date, "ssn": ssn, "phone": phone, "intl": intl, "card": card, "iban": iban, "ip": ip, "ipv6": ipv6}


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The columns of docs with the pseudonymised text, and put last the array pii of (kind, old, new) in the order of the text."""
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"
    rows = own.withColumn("key", docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    whole_of = lambda p: f"^(?:{p})$"

    def told(m: Column) -> Column:
        kind = F.coalesce(*[F.when(m.rlike(whole_of(PATTERNS[k])), F.lit(k)) for k in KINDS])
        return F.struct(kind.alias("kind"), m.alias("old"))

    def made(s: Column) -> Column:
        new = F.coalesce(*[F.when(s.getField("kind") == k, MAKERS[k](s.getField("old"), F.col("key"))) for k in KINDS])
        return F.struct(s.getField("kind").alias("kind"), s.getField("old").alias("old"), new.alias("new"))

    some = F.col(text).rlike("[0-9@]")  # any find has one of these
    # A text does not hold a mark of its own hash: every second piece is a find.
    mark = F.concat(F.lit("\0"), F.hex(F.xxhash64(text)))
    rows = rows.withColumn("pieces", F.when(some, F.split(F.regexp_replace(F.col(text), F.lit(ANY), F.concat(mark, F.lit("$0"), mark)), mark)))
    found = F.transform(F.filter("pieces", lambda x, k: k % 2 == 1), told)
    rows = rows.withColumn("found", F.transform(F.coalesce(found, F.array().cast("array<struct<kind:string,old:string>>")), made))
    new = lambda k: F.get("found", F.floor(k / 2).cast("int"))
    mended = F.array_join(F.transform("pieces", lambda x, k: F.when(k % 2 == 1, F.coalesce(new(k)["new"], x)).otherwise(x)), "")
    shown = [F.when(F.size("found") > 0, mended).otherwise(F.col(c)).alias(n) if c == text else F.col(c).alias(n) for c, n in zip(own.columns, docs.columns, strict=True) if n != "pii"]
    return rows.select(*shown, F.filter("found", lambda s: s.getField("new").isNotNull()).alias("pii"))


def counted(done: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> of each kind and text from pseudonymise()'s rows."""
    kinds = F.transform("pii", lambda s: s.getField("kind"))
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select(F.col(id_col).alias("doc_id"), *counts, F.col(text_col).alias("text"))
