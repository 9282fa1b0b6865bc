"""Format-preserving pseudonyms: found values are permuted within their format by keyed Feistel rounds.

Everything is a Spark expression.  A value maps to the same pseudonym wherever it stands, different values of a format to
different pseudonyms, and a pseudonym passes the check that its value passed (card check digit, address range, calendar).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Fixed value: lengths of the IBANs of the countries in the registry.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "HR LV LI CH",
    22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IL AE IQ TL OM SO", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "PT ST LY",
    26: "IS TR", 27: "FR GR IT MR MC SM BI DJ", 28: "AL AZ CY DO GT HU LB PL BY SV HN", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "NI LC", 33: "RU",
}


def _iban_pattern() -> str:
    """An IBAN of its country's length is taken first, so it never runs into the next word; then any length, unbroken first."""
    bounded = []
    for length, countries in _IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        bounded.append(f"(?:{'|'.join(countries.split())})\\d\\d(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    other = r"[A-Z]{2}\d\d(?:[A-Z0-9]{11,31}|(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    # The countries are tried only where two capitals and two digits stand.
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d\d)(?:{'|'.join([*bounded, other])})(?![A-Za-z0-9])"


KEY = "pseudonym-key-1"

_SECRET_NAME = r"(?i:password|passwd|secret|token|api[_-]?key)[\"']?"
# Fixed value: what keys of well-known services and signed web tokens begin with.
_KEY_HEADS = r"gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza"

# What is looked for, in this order of preference at one place.  Digits are never cut out of longer digit runs.
PATTERNS = {
    # Starts where a run of signs starts, or behind the last found value, so that a long run without @ is read once.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "private_key": r"-----BEGIN (?:[A-Z]{2,9} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END (?:[A-Z]{2,9} ){0,3}PRIVATE KEY-----",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "web_token": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "service_key": rf"(?<![A-Za-z0-9])(?:(?:{_KEY_HEADS})[A-Za-z0-9_-]{{16,}}|sk-[A-Za-z0-9]{{20,}})",
    # A bare word behind a space ("password: required") is prose; a digit, a change of case, a quote or no space makes it a value.
    "secret": rf"{_SECRET_NAME}(?:\s{{0,3}}[:=]\s{{0,3}}[\"']|\s{{0,3}}[:=]\s{{0,3}}(?=[A-Za-z_+/.-]*(?:\d|[a-z][A-Z]))|[:=])[A-Za-z0-9_+/.-]{{6,}}",
    "date": r"(?<![\d.-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "slash_date": r"(?<![\d/])(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/(?:19|20)\d\d(?![\d/])",
    "month_first_date": r"(?<![\d/])(?:0[1-9]|1[0-2])/(?:1[3-9]|2\d|3[01])/(?:19|20)\d\d(?![\d/])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    # Global, unique-local and link-local addresses, whole or with one gap.
    "ipv6": (r"(?<![A-Za-z0-9:.])(?i:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f])"
             r"(?i:(?::[0-9a-f]{1,4}){7}|(?::[0-9a-f]{1,4}){0,5}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?)(?![A-Za-z0-9:])"),
    "foreign_phone": r"(?<![\d+])\+[2-9]\d(?:[ .-]?\d){6,12}(?!\d)",
    "phone": (r"(?<!\d)(?:\+1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\d)"
              r"|(?<![A-Za-z])(?i:telephone|phone|mobile|cell|call|tel|fax)[ :.#]{1,3}(?:\+?1)?[2-9]\d\d[2-9]\d{6}(?!\d)"),
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "iban": _iban_pattern(),
}
ANY = "|".join(PATTERNS.values())
# A cheap test that every pattern implies, so that most texts are passed over in one scan.
_HINT = rf"[@\d]|AKIA|ASIA|(?i:passw|secret|token|api[_-]?key)|PRIVATE KEY|eyJ|sk-|{_KEY_HEADS}|(?i:f[cd][0-9a-f]{{2}}|fe[89ab][0-9a-f]):"


def _noise(key: str, label: str, number: Column, *parts: Column) -> Column:
    """Keyed pseudo-random number of 52 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(f"{key}|{label}"), number.cast("string"), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(key: str, label: str, left: Column, right: Column, left_size: int, right_size: int,
            body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the permuted pair ``(left, right)`` below ``(left_size, right_size)``; both sizes at most 2^40."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(acc: Column, turn: Column) -> Column:
        new_left = F.pmod(acc.l + _noise(key, label, turn, acc.r), F.lit(left_size))
        return let(new_left, lambda x: F.struct(x.alias("l"), F.pmod(acc.r + _noise(key, label, turn + 100, x), F.lit(right_size)).alias("r")))

    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda done: body(done.l, done.r))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def refilled(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced one by one; every other sign stays."""
    def filled(new: Column) -> Column:
        seen = lambda i: F.length(digits_of(F.substring(template, F.lit(1), i + 1)))
        return F.concat_ws("", F.transform(
            F.split(template, ""), lambda s, i: F.when(s.rlike("^[0-9]$"), F.substring(new, seen(i), F.lit(1))).otherwise(s)))

    return let(digits, filled)


def _number(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).cast("bigint")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def luhn_sum(digits: Column) -> Column:
    """Sum of a number in front of its check digit, every second digit from the right doubled."""
    signs = F.reverse(F.split(digits, ""))
    doubled = F.transform(signs, lambda s, i: F.when(i % 2 == 0, s.cast("int") * 2).otherwise(s.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


def luhn_digit(body: Column) -> Column:
    return F.pmod(F.lit(10) - luhn_sum(body) % 10, F.lit(10)).cast("string")


def _rest(digits: Column) -> Column:
    return F.substring(digits, F.lit(1), F.length(digits) - 1)


def valid_card(text: Column) -> Column:
    digits = digits_of(text)
    return luhn_digit(_rest(digits)) == F.right(digits, F.lit(1))


def _card(key: str, text: Column) -> Column:
    """All digits but the last are permuted, the last is made to fit."""
    def permuted(body: Column) -> Column:
        out = F.lit(None).cast("string")
        for length in range(12, 19):
            half, rest = length // 2, length - length // 2
            new = feistel(key, f"card{length}", _number(body, 1, half), _number(body, half + 1, rest), 10**half, 10**rest,
                          lambda left, right, half=half, rest=rest: F.concat(_padded(left, half), _padded(right, rest)))
            out = F.when(F.length(body) == length, new).otherwise(out)
        return out

    new = let(let(_rest(digits_of(text)), permuted), lambda out: F.concat(out, luhn_digit(out)))
    return refilled(text, new)


def _ip(key: str, text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("bigint"))
    return feistel(key, "ip", parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536, lambda left, right: F.concat_ws(
        ".", *[x.cast("string") for x in (F.floor(left / 256), left % 256, F.floor(right / 256), right % 256)]))


def _phone(key: str, text: Column) -> Column:
    """Area and exchange codes keep their first digit between 2 and 9; a country code stays."""
    digits = digits_of(text)
    own = F.right(digits, F.lit(10))
    area, exchange, line = _number(own, 1, 3) - 200, _number(own, 4, 3) - 200, _number(own, 7, 4)
    new = feistel(key, "phone", area * 100 + F.floor(line / 100), exchange * 100 + line % 100, 80_000, 80_000, lambda left, right: F.concat(
        (F.floor(left / 100) + 200).cast("string"), (F.floor(right / 100) + 200).cast("string"), _padded(left % 100, 2), _padded(right % 100, 2)))
    return refilled(text, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), new))


def _ssn(key: str, text: Column) -> Column:
    digits = digits_of(text)
    area = _number(digits, 1, 3)
    area = area - F.when(area > 666, 1).otherwise(0)
    def written(left: Column, right: Column) -> Column:
        new_area = F.floor(left / 99) + 1
        new_area = new_area + F.when(new_area >= 666, 1).otherwise(0)
        return F.concat_ws("-", _padded(new_area, 3), _padded(left % 99 + 1, 2), _padded(right + 1, 4))

    return feistel(key, "ssn", (area - 1) * 99 + _number(digits, 4, 2) - 1, _number(digits, 6, 4) - 1, 898 * 99, 9999, written)


_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days are the years 1900 to 2099


def _day(key: str, day: Column) -> Column:
    number = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
    return feistel(key, "date", F.floor(number / _DAYS[1]), number % _DAYS[1], *_DAYS, lambda left, right: F.date_add(
        F.lit(_FIRST_DAY).cast("date"), (left * _DAYS[1] + right).cast("int")))


def _iban(key: str, text: Column) -> Column:
    """Country stays, the account part is permuted by kind of sign, the two check digits are made to fit."""
    plain = F.regexp_replace(text, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    whole = let(by_sign_kind(key, "iban", account), lambda new: F.concat(
        country, _padded(98 - _mod97(F.concat(new, country, F.lit("00"))), 2), new))

    def spaced(new: Column) -> Column:
        place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), " ", ""))
        return F.concat_ws("", F.transform(F.split(text, ""), lambda s, i: F.when(s == " ", s).otherwise(F.substring(new, place(i), F.lit(1)))))

    return let(whole, spaced)


def _mod97(text: Column) -> Column:
    def step(acc: Column, s: Column) -> Column:
        value = F.conv(s, 36, 10).cast("bigint")
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), step)


def valid_iban(text: Column) -> Column:
    plain = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, 1, 4))
    return (F.length(plain) >= 15) & (_mod97(moved) == 1)


_KINDS = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_sign_kind(key: str, label: str, text: Column, kinds: tuple[str, ...] = _KINDS) -> Column:
    """Feistel rounds over the two halves of a string: every letter or digit is shifted within its own kind, by noise drawn
    from the other half, so the format (kinds and punctuation) stays and the map can be inverted."""
    half = F.floor((F.length(text) + 1) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def shifted(part: Column, other: Column, turn: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            noise = _noise(key, label, turn, i, F.length(text), other)
            out = s
            for signs in kinds:
                place = F.instr(F.lit(signs), s)
                out = F.when(place > 0, F.substring(F.lit(signs), (F.pmod(place - 1 + noise, F.lit(len(signs))) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.when(part == "", part).otherwise(F.concat_ws("", F.transform(F.split(part, ""), one)))

    def step(acc: Column, turn: Column) -> Column:
        return let(shifted(acc.l, acc.r, turn), lambda left: F.struct(left.alias("l"), shifted(acc.r, left, turn + 100).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda done: F.concat(done.l, done.r))


def _email(key: str, text: Column) -> Column:
    """The last label of the domain stays."""
    top = F.concat(F.lit("."), F.substring_index(text, ".", -1))
    return F.concat(by_sign_kind(key, "email", F.substring(text, F.lit(1), F.length(text) - F.length(top))), top)


def _after(prefix: str, label: str) -> Callable[[str, Column], Column]:
    """Permute what follows the prefix."""
    def run(key: str, text: Column) -> Column:
        head = F.regexp_extract(text, prefix, 0)
        return F.concat(head, by_sign_kind(key, label, F.substring(text, F.length(head) + 1, F.length(text))))

    return run


def _ipv6(key: str, text: Column) -> Column:
    """The first group stays, so the address keeps its range; the length of every group stays as well."""
    small = F.lower(text)
    return F.concat(F.substring(small, 1, 4), by_sign_kind(key, "ipv6", F.substring(small, F.lit(5), F.length(small)), ("0123456789abcdef",)))


def _foreign_phone(key: str, text: Column) -> Column:
    """Two digits of the country code stay; a number is the same however it is spaced."""
    digits = digits_of(text)
    own = by_sign_kind(key, "foreign phone", F.substring(digits, F.lit(3), F.length(digits)))
    return refilled(text, F.concat(F.substring(digits, 1, 2), own))


def _web_token(key: str, text: Column) -> Column:
    """Both encoded braces stay."""
    parts = F.split(text, r"\.")
    inner = F.concat_ws(".", *[F.substring(parts[i], F.lit(4), F.length(parts[i])) for i in (0, 1)], parts[2])
    return let(F.split(by_sign_kind(key, "web token", inner), r"\."), lambda p: F.concat(
        F.lit("eyJ"), p[0], F.lit(".eyJ"), p[1], F.lit("."), p[2]))


def _private_key(key: str, text: Column) -> Column:
    """The lines that open and close the block stay."""
    head, tail = F.regexp_extract(text, r"\A-----BEGIN [A-Z ]*-----", 0), F.regexp_extract(text, r"-----END [A-Z ]*-----\z", 0)
    inner = F.substring(text, F.length(head) + 1, F.length(text) - F.length(head) - F.length(tail))
    return F.concat(head, by_sign_kind(key, "private key", inner), tail)


def _month_first_date(key: str, text: Column) -> Column:
    """The day is permuted as in the other ways of writing it; the result may have a day below 13."""
    return F.date_format(_day(key, F.try_to_date(text, "MM/dd/yyyy")), "MM/dd/yyyy")


def _slash_date(key: str, text: Column) -> Column:
    return F.date_format(_day(key, F.try_to_date(text, "dd/MM/yyyy")), "dd/MM/yyyy")


def _iso_date(key: str, text: Column) -> Column:
    return F.date_format(_day(key, F.try_to_date(text, "yyyy-MM-dd")), "yyyy-MM-dd")


def kind_of(match: Column) -> Column:
    """Name of the format of a found value, null when it fails its check (it is then left as it is)."""
    checks = {
        "card": valid_card(match), "iban": valid_iban(match), "date": F.try_to_date(match, "yyyy-MM-dd").isNotNull(),
        "slash_date": F.try_to_date(match, "dd/MM/yyyy").isNotNull(),
        "month_first_date": F.try_to_date(match, "MM/dd/yyyy").isNotNull(),
    }
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        # Looking around is settled by the search; the value alone has to fit.
        fits = match.rlike(rf"\A(?:{pattern})\z")
        out = F.when(fits, F.when(checks[name], F.lit(name)) if name in checks else F.lit(name)).otherwise(out)
    return out


_MAKERS: dict[str, Callable[[str, Column], Column]] = {
    "email": _email, "aws_key": _after(r"\A(?:AKIA|ASIA)", "aws"),
    "private_key": _private_key, "web_token": _web_token,
    "service_key": _after(rf"\A(?:{_KEY_HEADS}|sk-)", "service key"),
    "secret": _after(rf"\A{_SECRET_NAME}\s*[:=]\s*[\"']?", "secret"),
    "date": _iso_date, "slash_date": _slash_date, "month_first_date": _month_first_date, "ssn": _ssn, "ip": _ip, "ipv6": _ipv6,
    "foreign_phone": _foreign_phone, "phone": _phone, "card": _card, "iban": _iban,
}


def pseudonym(found: Column, key: str) -> Column:
    """Pseudonym of a ``struct<value, kind>``."""
    out = found.value
    for name, make in _MAKERS.items():
        out = F.when(found.kind == name, make(key, found.value)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str = KEY, found_col: str = "pii_found") -> DataFrame:
    """``docs`` with personal values in ``text_col`` replaced, and their number by kind (a map) in ``found_col``.

    Finds e-mail addresses, access keys, private key blocks, web tokens, secrets behind a name, dates of 1900 to 2099, social
    security numbers, IPv4 and IPv6 addresses, phone numbers (North American ones in groups or behind a word for them, others with
    their country code), payment cards and IBANs; the last two and dates must pass their check.  Text around the
    values is kept sign by sign; a text without values stays as it is; null stays null and has an empty map.  All other
    columns are kept; a column named like ``found_col`` is replaced.  The plan is one narrow projection: rows never move.
    """
    text = F.col(text_col).cast("string")
    # A name that no column of the table has, in any case of letters.
    name = "_found" + "_" * max(map(len, [*docs.columns, ""]))
    parts = docs.withColumn(name, F.when(text.rlike(_HINT), F.transform(
        F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0)), lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))))
    found = F.col(name)
    between = F.split(text, ANY)
    replaced = F.concat_ws("", F.flatten(F.zip_with(
        between, F.transform(found, lambda f: pseudonym(f, key)), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    kinds = F.filter(F.transform(found, lambda f: f.kind), lambda k: k.isNotNull())
    counts = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return parts.withColumn(text_col, F.when(F.size(name) > 0, replaced).otherwise(text)).withColumn(
        found_col, F.coalesce(counts, empty)).drop(name)
