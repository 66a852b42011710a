"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern, validated, and replaced by a keyed permutation of their own format, so
that equal values stay equal in every document and different values stay different.

==========  =======================================  =============================================
kind        accepted when                            permuted
==========  =======================================  =============================================
email       local part of 64 characters at most      letters and digits of the local part
secret      32 to 64 hexadecimal digits, one case,    hexadecimal digits; letters and digits behind
            a letter and a digit among them, or      the prefix
            a key with a known prefix
iban        check digits right (mod 97)              account part, check digits made right again
card        13 to 19 digits, Luhn sum right          all but first and last digit, Luhn made right
ssn         area, group and serial in use            all, within the numbers in use
phone       3-3-4 digits after an optional country   area, exchange and line; whether they begin
            code, a country code and groups, groups   with 0/1 or 2-9 stays; in groups all but the
            behind a 0, or ten digits that follow     country code or the 0
            a word like tel or call
ip          four numbers up to 255, or a version 6    all four; hexadecimal digits
            address of eight groups, or of three
            to seven with ``::``
date        a calendar day from 1900 to 2099, in      the day, within these 200 years
            numbers or with an English month
==========  =======================================  =============================================

Each permutation is an alternating Feistel network: one half is shifted by a SHA-256 digest of key,
kind, round and other half. Numbers with bounded parts (ip, ssn, phone, date) are pairs of residues;
the rest are strings, shifted character by character inside the character's class.

One regular-expression pass finds the values of a text; only texts with a value are split and joined
again. Work is row by row: no shuffle and no state.

Edge cases: a null text stays null with zero counts; an empty text stays empty; a value that fails
validation stays as it is. An input column named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headway.llm.common import col, others

ROUNDS = 8
KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ip", "date")
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped(n: int, countries: str) -> str:
    """An IBAN of n characters in groups of four: words that follow it stay outside."""
    rest = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}"


# English months, prefixes of keys, words before a phone number.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PREFIXES = {"AKIA": "[0-9A-Z]{16}", "ASIA": "[0-9A-Z]{16}", "AIza": "[0-9A-Za-z_-]{35}", "gh[pousr]_": "[0-9A-Za-z]{36}", "sk_live_": "[0-9A-Za-z]{24,64}"}
CALLED = r"(?<=\b(?:[Pp]hone|[Tt]el|[Ff]ax|[Cc]all|[Mm]obile|[Cc]ell)(?: (?:number|no|is|at|me at|us at)){0,1}[.:]{0,2} {0,2})"
TEN_DIGITS = r"[2-9]\d{2}[2-9]\d{6}"
_MONTH = "(?:" + "|".join(m if len(m) == 3 else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
_V6 = r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?!:)"

#: The value must match the whole pattern; the first kind that fits counts. Groups without an upper bound repeat possessively: the matcher
#: walks them in a loop, where it would otherwise take a stack frame for each repetition.
SHAPES = {
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|" + "|".join(map("".join, PREFIXES.items())) + ")",
    "iban": r"(?:" + "|".join(_grouped(n, c) for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))",
    "card": r"(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}|\d{6}\1\d{5}))",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-. /])\d{3}[-. ]\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\+\d{8,15}|(?:\(0\d{2,4}\) ?|0\d{2,4}[ -])\d{3,4}[ -]\d{3,4})",
    "ip": r"(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|" + _V6 + ")",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|" + rf"\d{{1,2}} {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}}, \d{{4}})",
}
_BEFORE = {
    "email": r"(?<![\p{L}\p{N}._%+-])", "phone": r"(?<![\p{L}\p{N}+])", "ip": r"(?<![\p{L}\p{N}]|\d\.)",
    "date": r"(?<![\p{L}\p{N}]|\d[./-])", "ssn": r"(?<![\p{L}\p{N}]|\d-)",
}
_AFTER = {"ip": r"(?![\p{L}\p{N}]|\.\d)", "date": r"(?![\p{L}\p{N}]|[./-]\d)", "ssn": r"(?![\p{L}\p{N}]|-\d)"}


def pattern() -> str:
    """All kinds as one alternation, groups numbered from left to right."""
    parts = []
    for k in KINDS:
        shape = SHAPES[k].replace(r"([ -])", r"(?<gap>[ -])").replace(r"\1", r"\k<gap>")
        parts.append(_BEFORE.get(k, EDGE_L) + shape + _AFTER.get(k, EDGE_R))
    # Ten digits alone are a phone number only behind a word that says so; nothing else finds ten digits.
    parts.append(rf"(?={TEN_DIGITS}{EDGE_R}){CALLED}{TEN_DIGITS}")
    return "|".join(parts)


# ---------------------------------------------------------------- permutations


def _digest(key: str, kind: Column, i: Column, half: Column, part: str = "") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), F.lit(part), half), 256)


def _number(hex_text: Column, at, digits: int) -> Column:
    return F.conv(F.substring(hex_text, at, F.lit(digits)) if isinstance(at, Column) else F.substring(hex_text, at, digits), 16, 10).cast("long")


def _rounds(left: Column, right: Column, step) -> Column:
    """Odd rounds change the left half by the right one, even rounds the right half by the left one."""

    def turn(acc, i):
        odd = F.struct(step(acc["l"], acc["r"], i, 0).alias("l"), acc["r"].alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(F.struct(acc["l"].alias("l"), step(acc["r"], acc["l"], i, 1).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), turn)


def permute_pair(x: Column, y: Column, a, b, key: str, kind: str) -> Column:
    """struct(l, r): the pair (x mod a, y mod b) permuted."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in (a, b))

    def step(mine, other, i, side):
        return (mine + _number(_digest(key, F.lit(kind), i, other.cast("string")), 1, 15)) % (b if side else a)

    return _rounds(x.cast("long"), y.cast("long"), step)


def _shift(c: Column, by: Column, classes: tuple[str, ...]) -> Column:
    out = c
    for letters in classes:
        at = F.instr(F.lit(letters), c)
        moved = F.substring(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))
        out = F.when((at > 0) & (c != ""), moved).otherwise(out)
    return out


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = (DIGITS, LOWER, UPPER)


def permute_text(value: Column, key: str, kind: str, classes: tuple[str, ...] = ALNUM) -> Column:
    """The text with each character of a class moved inside that class; other characters stay."""

    def step(mine, other, i, side):
        def moved(j):
            h = F.concat(_digest(key, F.lit(kind), i, other), _digest(key, F.lit(kind), i, other, "+"))
            return _shift(F.substring(mine, j, F.lit(1)), _number(h, ((j - 1) * 2) % 127 + 1, 2), classes)

        chars = F.transform(F.sequence(F.lit(1), F.length(mine)), moved)
        return F.when(F.length(mine) == 0, mine).otherwise(F.array_join(chars, ""))

    half = F.floor(F.length(value) / 2).cast("int")
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, F.length(value) - half)
    done = _rounds(left, right, step)
    return F.concat(done["l"], done["r"])


# ---------------------------------------------------------------- kinds


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10; the last digit is the check digit."""

    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return (acc + twice) % 10

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def mod97(text: Column) -> Column:
    """Remainder of letters (A is 10) and digits read as one number."""

    def add(acc, i):
        c = F.substring(text, i, F.lit(1))
        v = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _whole(kind: str) -> str:
    return "^(?:" + SHAPES[kind] + (f"|{TEN_DIGITS}" if kind == "phone" else "") + ")$"


def _email(v, key):
    at = F.instr(v, "@")
    local = F.substring(v, F.lit(1), (at - 1).cast("int"))
    new = F.concat(permute_text(local, key, "email"), F.substring(v, at.cast("int"), F.length(v)))
    return at <= 65, new


def _hexadecimal(v, key, kind):
    lower = permute_text(v, key, kind, (DIGITS + "abcdef",))
    upper = permute_text(v, key, kind, (DIGITS + "ABCDEF",))
    return F.when(v.rlike("[a-f]"), lower).otherwise(upper)


def _secret(v, key):
    prefix = F.regexp_extract(v, "^(?:" + "|".join(PREFIXES) + ")", 0)
    known = F.concat(prefix, permute_text(F.substring(v, F.length(prefix) + 1, F.length(v)), key, "secret"))
    ok = (prefix != "") | (v.rlike("[0-9]") & v.rlike("[A-Fa-f]"))
    return ok, F.when(prefix != "", known).otherwise(_hexadecimal(v, key, "secret"))


def _iban(v, key):
    bare = F.replace(v, F.lit(" "), F.lit(""))
    ok = mod97(F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))) == 1
    rest = permute_text(F.substring(v, 5, 100), key, "iban", (DIGITS, UPPER))
    country = F.substring(v, 1, 2)
    check = 98 - mod97(F.concat(F.replace(rest, F.lit(" "), F.lit("")), country, F.lit("00")))
    return ok, F.concat(country, _pad(check, 2), rest)


def _card(v, key):
    ok = (luhn_sum(_digits(v)) == 0) & v.rlike("[1-9]")
    n = F.length(v)
    first, middle = F.substring(v, 1, 1), F.substring(v, F.lit(2), n - 2)
    body = F.concat(first, permute_text(middle, key, "card", (DIGITS,)))
    check = (10 - luhn_sum(F.concat(_digits(body), F.lit("0")))) % 10
    return ok, F.concat(body, check.cast("string"))


def _ssn(v, key):
    area, group, serial = (F.substring(v, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    p = permute_pair(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    a = F.when(p["l"] > 664, p["l"] + 2).otherwise(p["l"] + 1)
    return ok, F.concat(_pad(a, 3), F.lit("-"), _pad(F.floor(p["r"] / 9999) + 1, 2), F.lit("-"), _pad(p["r"] % 9999 + 1, 4))


#: Country code, gap, area, gap, exchange, gap, line; without gaps where the ten digits stand alone.
_TEN = r"^((?:\+\d{1,3}[ .-]?)?\(?)(\d{3})(\) ?|[-. /]|(?<=^\d{3})(?=\d{7}$))(\d{3})([-. ]|(?<=^\d{6}))(\d{4})$"


def _phone(v, key):
    part = [F.regexp_extract(v, _TEN, i) for i in range(7)]
    area, exchange, line = (F.coalesce(part[i].try_cast("int"), F.lit(0)) for i in (2, 4, 6))
    low_a, low_e = (F.when(x < 200, F.lit(0)).otherwise(F.lit(200)) for x in (area, exchange))
    size_a, size_e = (F.when(x < 200, F.lit(200)).otherwise(F.lit(800)) for x in (area, exchange))
    p = permute_pair(area - low_a, (exchange - low_e) * 10000 + line, size_a, size_e * 10000, key, "phone")
    ten = F.concat(
        part[1], _pad(p["l"] + low_a, 3), part[3], _pad(F.floor(p["r"] / 10000) + low_e, 3), part[5], _pad(p["r"] % 10000, 4)
    )
    code = F.regexp_extract(v, r"^(?:\+(?:\d{1,3}(?=[ .-])|\d{2})|\(?0)", 0)
    rest = permute_text(F.substring(v, F.length(code) + 1, F.length(v)), key, "phone", (DIGITS,))
    return F.lit(True), F.when(v.rlike(_TEN), ten).otherwise(F.concat(code, rest))


def _ip(v, key):
    o = [F.coalesce(F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).try_cast("int"), F.lit(999)) for i in range(1, 5)]
    ok = (F.greatest(*o) < 256) & ~v.rlike(r"(^|\.)0\d")
    p = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    parts = [F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256]
    six, groups = v.contains(":"), F.size(F.array_remove(F.split(v, ":"), ""))
    ok = F.when(six, (groups == 8) & ~v.contains("::") | groups.between(3, 7) & v.contains("::")).otherwise(ok)
    return ok, F.when(six, _hexadecimal(v, key, "ip")).otherwise(F.concat_ws(".", *[x.cast("string") for x in parts]))


def _date(v, key):
    iso = v.rlike(r"^\d{4}")
    gap = F.when(iso, F.substring(v, 5, 1)).otherwise(F.substring(v, 3, 1))
    year, day = (F.when(iso, F.substring(v, *a)).otherwise(F.substring(v, *b)) for a, b in (((1, 4), (7, 4)), ((9, 2), (1, 2))))
    month = F.when(iso, F.substring(v, 6, 2)).otherwise(F.substring(v, 4, 2))
    # 00/00/0000 with a slash is read as month/day/year when only that is a calendar day.
    us = ~iso & (gap == "/") & (month.cast("int") > 12)
    shown = F.concat_ws("-", year, F.when(us, day).otherwise(month), F.when(us, month).otherwise(day))
    name = F.regexp_extract(v, "[A-Z][a-z]+", 0)
    spelled, first, short = name != "", v.rlike(r"^\d"), (F.length(name) == 3) & (name != "May")
    number = F.floor((F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.substring(name, 1, 3)) + 2) / 3)
    written = F.concat_ws("-", F.substring(v, -4, 4), _pad(number, 2), F.lpad(F.regexp_extract(v, r"\d{1,2}(?= |,)", 0), 2, "0"))
    at = F.try_to_date(F.when(spelled, written).otherwise(shown), "yyyy-MM-dd")
    n = F.datediff(at, F.lit("1900-01-01").cast("date"))
    ok = at.isNotNull() & (n >= 0) & (n < 17 * 4297)  # the days of 1900 to 2099
    p = permute_pair(F.floor(n / 4297), n % 4297, 17, 4297, key, "date")
    new = F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * 4297 + p["r"]).cast("int"))
    y, m, d = F.date_format(new, "yyyy"), F.date_format(new, "MM"), F.date_format(new, "dd")
    whole = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(new))
    month, day = F.when(short, F.substring(whole, 1, 3)).otherwise(whole), F.dayofmonth(new).cast("string")
    words = F.when(first, F.concat_ws(" ", day, month, y)).otherwise(F.concat(month, F.lit(" "), day, F.lit(", "), y))
    return ok, F.when(spelled, words).when(iso, F.concat(y, gap, m, gap, d)).when(us, F.concat(m, gap, d, gap, y)).otherwise(F.concat(d, gap, m, gap, y))


_RULES = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, value): the replacement of one found value; kind is null where none is valid."""
    kind, new = F.lit(None).cast("string"), value
    for k in reversed(KINDS):
        ok, changed = _RULES[k](value, key)
        fits = value.rlike(_whole(k))
        kind = F.when(fits & ok, F.lit(k)).otherwise(kind)
        new = F.when(fits & ok, changed).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("value"))


def pseudonymise(df: DataFrame, text: str, key: str) -> DataFrame:
    """Replace the text and add ``n_<kind>`` for each kind."""
    counts = [f"n_{k}" for k in KINDS]
    kept = others(df, [*counts, "_found", "_new"])
    found = df.select(*[col(x) for x in kept], F.regexp_extract_all(col(text), F.lit(pattern()), F.lit(0)).alias("_found"))
    new = F.when(F.size("_found") > 0, F.transform("_found", lambda v: pseudonym(v, key)))
    changed = found.withColumn("_new", new)
    gaps = F.split(col(text), pattern(), -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at("_new", i + 1)["value"], F.lit("")))), "")
    kinds = F.transform("_new", lambda x: F.coalesce(x["kind"], F.lit("")))
    number = [F.coalesce(F.size(kinds) - F.size(F.array_remove(kinds, k)), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return changed.select(
        *[F.when(F.col("_new").isNull(), col(x)).otherwise(joined).alias(x) if x == text else col(x) for x in kept], *number
    )
