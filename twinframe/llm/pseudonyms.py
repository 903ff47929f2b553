"""Format-preserving pseudonyms for personal data, in built-in functions only.

Numbers and dates that pass their own validation (check digits, ranges, calendar) are permuted by a keyed Feistel network
within the values of their format: a card number becomes another with a right check digit, a date another date written
alike. Values outside the format are walked over (the network is applied again until a valid value comes). The network is
a bijection, so equal values stay equal in all documents and different ones stay different, and the key can invert it.
What has no numeric format (e-mail addresses, keys and passwords) gets a keyed hash in its shape.

  card      13 to 19 digits with a Luhn check digit; first digit and grouping stay. In a longer run of numbers every stretch
            of whole groups is tried, those grouped like cards first, and the rest is searched for phones, dates and ssn
  phone     North American numbers by area and exchange rules, with +1 also those outside the rules, among themselves;
            others after + with 8 to 15 digits keep the first three
  ssn       3-2-4 digits by the published ranges
  iban      as long as its country's are and check digits right; its last eight digits are permuted, the check digits renewed
  ipv4      four numbers up to 255
  date      1900 to 2099, as year-month-day, or day and month and year by slashes (month first unless the first number is
            above 12) or dots (day first)

Null texts stay null, empty ones empty; texts without such values stay as they are. The key stands in query plans, which
spark.redaction.string.regex can hide. Expressions are columns, not SQL text: the parser would keep some 55 MB in the driver
for a text of their length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Most applications of the network for one value; each format accepts at least a third of the values it is walked over.
WALKS = 64
_SECRET = "(?i:password|passwd|secret|token|api_?key)"

# Lengths of the countries' account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRIES = "|".join(" ".join(IBAN_LENGTHS.values()).split())
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

# The written forms that are looked at. Validation decides whether they are replaced.
PATTERNS = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,32}",
    rf"\b{_SECRET}[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?[^\s\"']{{8,}}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    r"(?<![\w/.-])\d{4}-\d{2}-\d{2}(?:(?=T\d{2}:\d{2})|(?![\w/-]))",
    r"(?<![\w/.-])\d{1,2}/\d{1,2}/\d{4}(?![\w/-])",
    r"(?<![\w/.-])\d{1,2}\.\d{1,2}\.\d{4}(?![\w/-])",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    rf"\b(?:{_IBAN})\b",
    rf"\b(?!{_COUNTRIES})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b",
    r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    r"(?<![\w+])\+1\d{10}(?![\w-])",
    r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,5}\)?){2,5}(?![\w-])",
    r"(?<![\w.-])\d[\d -]{11,}\d(?![\w-]|\.\d{1,3}\.|/\d{1,2}/)",
]
#: What the rest of a run of numbers can hold.
IN_RUN = [p for p in PATTERNS if any(x in p for x in (r"\d{4}-\d{2}-", r"\d{3}-\d{2}-", r"[ .-]\d{4}"))]
#: Groups as cards have them.
_CARD_GROUPS = "^([0-9]{13,19}|[0-9]{4}( [0-9]{4}){3}( [0-9]{1,3})?|[0-9]{4} [0-9]{6} [0-9]{4,5})$"


def fn(name: str, *args: Column | str | int) -> Column:
    """A built-in function; what is not a column is a literal."""
    return F.call_function(name, *(x if isinstance(x, Column) else F.lit(x) for x in args))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def prf(key: str, kind: Column, step: Column, half: Column, modulus: Column) -> Column:
    """A number below ``modulus`` that depends on the key, the kind of value, the round and the other half."""
    digest = F.sha2(F.concat(F.lit(f"{key}|"), kind, F.lit("|"), step, F.lit("|"), half), 256)
    return F.conv(fn("substr", digest, 1, 15), 16, 10).cast("bigint") % modulus


def permuted(key: str, kind: Column, value: Column, high: Column, low: Column) -> Column:
    """Permutes the numbers below ``high * low``: the halves in turn are shifted by a function of the other."""

    def shifted(s: Column, i: Column) -> Column:
        bound = F.when(i % 2 == 0, high).otherwise(low)  # the halves change places, and do so an even number of times
        return fn("named_struct", "a", s["b"], "b", (s["a"] + prf(key, kind, i, s["b"], bound)) % bound)

    number = value.cast("bigint")
    start = fn("named_struct", "a", fn("div", number, low), "b", number % low)
    return F.aggregate(fn("sequence", 0, ROUNDS - 1), start, shifted, lambda s: s["a"] * low + s["b"])


def feistel(key: str, kind: Column, value: Column, high: int, low: int) -> Column:
    return permuted(key, kind, value, F.lit(high).cast("bigint"), F.lit(low).cast("bigint"))


def digits_permuted(key: str, kind: Column, digits: Column, n: Column) -> Column:
    """Permutes the strings of ``n`` digits; ``kind`` and ``n`` are columns, so one expression serves all lengths."""

    def power(digits: Column) -> Column:
        return fn("rpad", "1", digits + 1, "0").cast("bigint")

    def new(kind: Column) -> Column:
        half = fn("div", n, 2).cast("int")
        bound = let(power(n - half), lambda high: let(power(half), lambda low: permuted(key, kind, digits, high, low)))
        return fn("lpad", bound.cast("string"), n, "0")

    return let(kind, new)


def walked(key: str, kind: Column, value: Column, high: int, low: int, valid: Callable[[Column], Column]) -> Column:
    """Permutes the values for which ``valid`` (of a column) holds."""

    def once(t: Column, _: Column) -> Column:
        found = let(feistel(key, kind, t["v"], high, low), lambda p: fn("named_struct", "v", p, "done", valid(p)))
        return F.when(t["done"], t).otherwise(found)

    start = fn("named_struct", "v", value.cast("bigint"), "done", F.lit(False))
    return F.aggregate(fn("sequence", 1, WALKS), start, once, lambda t: t["v"])


def halves(digits: int) -> tuple[int, int]:
    return 10 ** (digits - digits // 2), 10 ** (digits // 2)


def refill(old: Column, new: Column, places: str) -> Column:
    """``old`` with the characters of ``new`` at its ``places``, all others as they were."""

    def filled(f: Column, c: Column) -> Column:
        taken = fn("named_struct", "o", F.concat(f["o"], fn("substr", new, f["k"], 1)), "k", f["k"] + 1)
        return F.when(c.rlike(f"^{places}$"), taken).otherwise(fn("named_struct", "o", F.concat(f["o"], c), "k", f["k"]))

    return F.aggregate(fn("split", old, ""), fn("named_struct", "o", "", "k", 1), filled, lambda f: f["o"])


def refilled(old: Column, new: Column, places: str) -> Column:
    return let(new, lambda w: refill(old, w, places))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last one is the check digit."""

    def share(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)

    return F.aggregate(F.transform(F.reverse(fn("split", digits, "")), share), F.lit(0), lambda x, y: x + y)


def mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capital letters, letters as 10 to 35."""

    def on(r: Column, c: Column) -> Column:
        return F.when(c.rlike("^[A-Z]$"), (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + c.cast("int")) % 97)

    return F.aggregate(fn("split", text, ""), F.lit(0), on)


def card(key: str, m: Column) -> Column:
    def by_digits(d: Column) -> Column:
        inner = digits_permuted(key, F.concat(F.lit("card"), F.length(d)), fn("substr", d, 2, F.length(d) - 2), F.length(d) - 2)

        def checked(q: Column) -> Column:
            check = let(luhn_sum(F.concat(q, F.lit("0"))), lambda z: ((10 - z % 10) % 10).cast("string"))
            return F.concat(q, check)

        new = let(F.concat(fn("left", d, 1), inner), checked)
        valid = F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
        return F.when(valid, refilled(m, new, "[0-9]")).otherwise(m)

    return let(fn("regexp_replace", m, "[^0-9]", ""), by_digits)


def rest_of_run(key: str, text: Column) -> Column:
    """The numbers beside or without a card, with pseudonyms for other values in them."""
    pattern = "|".join(IN_RUN)

    def one(m: Column) -> Column:
        return F.when(m.rlike("^[0-9]{4}-[0-9]{2}-"), date(key, m)).when(m.rlike("^[0-9]{3}-[0-9]{2}-"), ssn(key, m)).otherwise(phone(key, m))

    new = F.transform(fn("regexp_extract_all", text, pattern, 0), one)
    return F.array_join(F.zip_with(fn("split", text, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def cards(key: str, m: Column) -> Column:
    """A run of numbers with pseudonyms for the cards in it: a whole run that is one, then stretches of groups as cards have
    them, then any; of equal ones the first and longest."""

    def by_groups(run: Column, g: Column) -> Column:
        def tries(a: Column) -> Column:
            def one(b: Column) -> Column:
                groups = fn("slice", g, a, b - a + 1)
                rank = F.when((a == 1) & (b == F.size(g)), 0).when(F.array_join(groups, " ").rlike(_CARD_GROUPS), 1).otherwise(2)
                return fn("named_struct", "rank", rank, "a", a, "back", -b, "d", F.array_join(groups, ""))

            ends = fn("sequence", a, F.least(a + 18, F.size(g)))
            return F.transform(F.filter(ends, lambda b: (g[a - 1] != "") & (g[b - 1] != "")), one)

        def valid(x: Column) -> Column:
            return F.length(x["d"]).between(13, 19) & (luhn_sum(x["d"]) % 10 == 0)

        def choose(t: Column, x: Column) -> Column:
            apart = ~F.exists(t, lambda o: (x["a"] <= -o["back"]) & (-x["back"] >= o["a"]))
            return F.when(apart, F.array_append(t, fn("named_struct", "a", x["a"], "back", x["back"]))).otherwise(t)

        def before(group: Column) -> Column:
            return F.aggregate(fn("slice", g, 1, group - 1), F.lit(0), lambda x, y: x + F.length(y) + 1)

        def build(f: Column, c: Column) -> Column:
            between = let(fn("substr", run, f["at"] + 1, c["low"] - f["at"]), lambda r: rest_of_run(key, r))
            found = let(fn("substr", run, c["low"] + 1, c["high"] - c["low"]), lambda m: card(key, m))
            return fn("named_struct", "o", F.concat(f["o"], between, found), "at", c["high"])

        tried = fn("array_sort", F.filter(F.flatten(F.transform(fn("sequence", 1, F.size(g)), tries)), valid))
        chosen = fn("array_sort", F.aggregate(tried, F.array().cast("array<struct<a: int, back: int>>"), choose))
        # the end of the run is one more place without a card, so what lies between is written once
        end = F.array(fn("named_struct", "low", F.length(run), "high", F.length(run)))
        places = F.transform(chosen, lambda c: fn("named_struct", "low", before(c["a"]), "high", before(1 - c["back"]) - 1))
        return F.aggregate(F.concat(places, end), fn("named_struct", "o", "", "at", 0), build, lambda f: f["o"])

    return let(m, lambda run: let(fn("split", run, "[ -]"), lambda g: by_groups(run, g)))


def phone(key: str, m: Column) -> Column:
    def valid(p: Column) -> Column:
        text = fn("lpad", p.cast("string"), 10, "0")
        return (fn("substr", text, 1, 1) >= "2") & (fn("substr", text, 4, 1) >= "2")

    def by_digits(d: Column) -> Column:
        last = fn("right", d, 10)

        right = (fn("substr", last, 1, 1) >= "2") & (fn("substr", last, 4, 1) >= "2")

        def ten(rules: Column) -> Column:
            """Numbers by the rules among themselves, and so those outside them."""
            kind = F.when(rules, F.lit("phone")).otherwise("phone-other")
            new = fn("lpad", walked(key, kind, last, *halves(10), lambda p: valid(p) == rules).cast("string"), 10, "0")
            return refilled(m, F.concat(fn("left", d, F.length(d) - 10), new), "[0-9]")

        far = digits_permuted(key, F.concat(F.lit("phone"), F.length(d)), fn("right", d, F.length(d) - 3), F.length(d) - 3)
        other = F.when(F.length(d).between(8, 15), refilled(m, F.concat(fn("left", d, 3), far), "[0-9]")).otherwise(m)
        north = let(right, lambda rules: F.when(rules | m.rlike("^[+]1"), ten(rules)).otherwise(m))
        return F.when(m.rlike("^[+][2-9]"), other).otherwise(north)

    return let(fn("regexp_replace", m, "[^0-9]", ""), by_digits)


def ssn(key: str, m: Column) -> Column:
    def valid(t: Column) -> Column:
        first = ~fn("left", t, 3).isin("000", "666") & (fn("left", t, 1) != "9")
        return first & (fn("substr", t, 4, 2) != "00") & (fn("right", t, 4) != "0000")

    def nine(p: Column) -> Column:
        return fn("lpad", p.cast("string"), 9, "0")

    def by_digits(d: Column) -> Column:
        new = nine(walked(key, F.lit("ssn"), d, *halves(9), lambda p: valid(nine(p))))
        return F.when(valid(d), refilled(m, new, "[0-9]")).otherwise(m)

    return let(fn("replace", m, "-", ""), by_digits)


def iban(key: str, m: Column) -> Column:
    def tail(r: Column, n: Column) -> Column:
        kind = F.when(n == 8, F.lit("iban")).otherwise(F.concat(F.lit("iban"), n))
        last = F.when(n > 0, digits_permuted(key, kind, fn("right", r, n), n)).otherwise("")
        return F.concat(fn("left", r, F.length(r) - n), last)

    def by_text(d: Column) -> Column:
        account = fn("substr", d, 5)
        digits = let(fn("regexp_replace", account, "[^0-9]", ""), lambda r: let(F.least(F.lit(8), F.length(r)), lambda n: tail(r, n)))

        def checked(q: Column) -> Column:
            sum_ = mod97(F.concat(q, fn("left", d, 2), F.lit("00")))
            check = let(sum_, lambda z: fn("lpad", (98 - z).cast("string"), 2, "0"))
            return F.concat(fn("left", d, 2), check, q)

        new = let(refilled(account, digits, "[0-9]"), checked)
        right = mod97(F.concat(account, fn("left", d, 4))) == 1
        return F.when(right, refilled(m, new, "[A-Z0-9]")).otherwise(m)

    return let(fn("replace", m, " ", ""), by_text)


def ipv4(key: str, m: Column) -> Column:
    def by_parts(d: Column) -> Column:
        number = F.aggregate(d, F.lit(0).cast("bigint"), lambda x, y: x * 256 + y.cast("bigint"))
        parts = [1 << 24, 1 << 16, 1 << 8]
        new = feistel(key, F.lit("ipv4"), number, 1 << 16, 1 << 16)
        dotted = let(new, lambda w: fn("concat_ws", ".", *((fn("div", w, p) % 256).cast("string") for p in parts), (w % 256).cast("string")))
        return F.when(F.forall(d, lambda y: y.cast("int") <= 255), dotted).otherwise(m)

    return let(fn("split", m, "[.]"), by_parts)


def date(key: str, m: Column) -> Column:
    """Dates become days since 1900, so a date written in two ways gets the same pseudonym."""
    days = 73049  # from 1900-01-01 to 2099-12-31
    first = F.lit("1900-01-01").cast("date")
    part = fn("split", m, "[-/.]")
    swap = F.contains(m, F.lit(".")) | (part[0].cast("int") > 12)
    is_iso = m.rlike("^[0-9]{4}-")

    def two(x: Column) -> Column:
        return fn("lpad", x, 2, "0")

    iso = (
        F.when(is_iso, m)
        .when(swap, fn("concat_ws", "-", part[2], two(part[1]), two(part[0])))
        .otherwise(fn("concat_ws", "-", part[2], two(part[0]), two(part[1])))
    )

    def written(w: Column) -> Column:
        wide = m.rlike("^[0-9]{2}[/.][0-9]{2}[/.]")
        day, month = (F.when(wide, two(x.cast("string"))).otherwise(x.cast("string")) for x in (F.day(w), F.month(w)))
        mark, year = F.when(F.contains(m, F.lit("/")), F.lit("/")).otherwise("."), F.year(w).cast("string")
        numbers = F.when(swap, fn("concat_ws", mark, day, month, year)).otherwise(fn("concat_ws", mark, month, day, year))
        return F.when(is_iso, w.cast("string")).otherwise(numbers)

    def by_day(d: Column) -> Column:
        place = walked(key, F.lit("date"), F.datediff(d, first), 300, 300, lambda p: p < days)
        inside = d.isNotNull() & F.year(d).between(1900, 2099)
        return F.when(inside, let(fn("date_add", first, place.cast("int")), written)).otherwise(m)

    return let(iso.try_cast("date"), by_day)


def letters(key: str, kind: str, value: Column, n: int) -> Column:
    return fn("translate", fn("left", F.sha2(F.concat(F.lit(f"{key}|{kind}|"), value), 256), n), "0123456789", "ghijklmnop")


def email(key: str, m: Column) -> Column:
    host = fn("split", F.lower(m), "@")[1]
    domain = F.concat(letters(key, "domain", host, 8), F.lit("."), fn("regexp_extract", m, "[^.]+$", 0))
    return F.concat(letters(key, "email", F.lower(m), 12), F.lit("@"), domain)


def secret(key: str, m: Column) -> Column:
    def hidden(v: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}|secret|"), v), 256)
        return F.concat(fn("left", m, F.length(m) - F.length(v)), fn("rpad", digest, F.length(v), digest))

    return let(fn("regexp_replace", m, "^[A-Za-z_]+[^A-Za-z0-9]{0,3}[=:][^A-Za-z0-9]{0,4}", ""), hidden)


def replacement(key: str, m: Column) -> Column:
    """The pseudonym of a found value ``m``, by the form it has."""
    code = F.upper(fn("left", F.sha2(F.concat(F.lit(f"{key}|akia|"), m), 256), 16))
    is_date = m.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}[/.][0-9]{4})$")
    is_phone = m.rlike("^(1[ -])?[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}$")
    return (
        F.when(m.rlike(f"^{_SECRET}[^A-Za-z0-9@]"), secret(key, m))
        .when(F.contains(m, F.lit("@")), email(key, m))
        .when(m.rlike("^AKIA"), F.concat(F.lit("AKIA"), code))
        .when(m.rlike("^[A-Z]"), iban(key, m))
        .when(m.rlike("^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$"), ipv4(key, m))
        .when(is_date, date(key, m))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ssn(key, m))
        .when(m.rlike("^[0-9][0-9 -]*$") & (F.length(m) >= 13) & ~is_phone, cards(key, m))
        .otherwise(phone(key, m))
    )


@lru_cache(maxsize=8)
def replacements(context: SparkContext, key: str) -> Column:
    """Pseudonyms of all values in ``__found``. Thousands of calls build this expression, so a context keeps it."""
    return F.transform("__found", lambda m: replacement(key, m))


def found_values(text: Column) -> Column:
    """All values of a text that have one of the forms, valid or not, in order."""
    return F.regexp_extract_all(text, F.lit("|".join(PATTERNS)), F.lit(0))


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str = "pseudonym-key-1", count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``count_col``, if given, gets the number of replaced values.

    The text is split at the found values; most texts hold no digit or sign of one and are not searched at all.
    """
    if not key.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a key may hold letters, digits, - and _ only")
    names = docs.columns
    text = F.col(text_col)
    likely = text.rlike(rf"[0-9@]|{_SECRET}")
    none = F.expr("cast(array() as array<string>)")
    found = docs.withColumn("__found", F.when(likely, found_values(text)).otherwise(none))
    changed = found.withColumn("__new", replacements(docs.sparkSession.sparkContext, key))
    rest = F.split(text, "|".join(PATTERNS), -1)
    joined = F.array_join(F.zip_with(rest, "__new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = {text_col: F.when(F.size("__found") > 0, joined).otherwise(text)}
    if count_col:
        pairs = F.zip_with("__found", "__new", lambda a, b: (a != b).cast("long"))
        out[count_col] = F.coalesce(F.aggregate(pairs, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long"))
    order = [c for c in names if c != count_col] + ([count_col] if count_col else [])
    return changed.withColumns(out).select(*(F.col(f"`{c}`") for c in order))
