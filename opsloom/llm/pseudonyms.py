"""Personal data as format-preserving pseudonyms.

Card numbers (13 to 19 digits, plain or in groups of four, with a valid Luhn digit), social security numbers in
their valid ranges, phone numbers, IPv4 addresses and calendar dates are found in whole texts and put in place by
other ones of the same kind and format: the value is taken as a number below the count of valid values, permuted
by a keyed Feistel network of alternating moduli and written in the same form, cards with a new Luhn digit.
A permutation has no collisions, so equal values stay equal and different ones different, in all documents. Numbers
that fail validation stay. The part of a mail address before the ``@`` becomes a keyed hash (linked as well, but no
permutation: its format has no fixed size).

Only DataFrame functions are used: a text is split at the matches of one pattern, and gaps and replaced
matches are put together again. Every document is handled by itself, without any shuffle.

Defined results: a null text stays null, an empty one empty; texts of any length are read whole; repeated rows are
replaced alike; rows without an id too. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "pseudonym-key"      # replace by a secret of your own
ROUNDS = 8
WALK = 8                   # steps of cycle walking; each leaves the valid range with a chance below 0.002

# The patterns of each kind.
_EDGE = r"(?<![0-9A-Za-z_.-])"
_END = r"(?![0-9A-Za-z_]|[.-][0-9])"
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)[0-9]{2}"
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date_iso": f"{_EDGE}{_YEAR}-{_MONTH}-{_DAY}{_END}",
    "date_dot": f"{_EDGE}{_DAY}\\.{_MONTH}\\.{_YEAR}{_END}",
    "date_slash": f"{_EDGE}{_MONTH}/{_DAY}/{_YEAR}{_END}",
    "phone": r"(?:\+[0-9]{1,3} )?\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|"
             + _EDGE + r"[0-9]{3}-[0-9]{3}-[0-9]{4}" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "ip": _EDGE + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _END,
    "card": _EDGE + r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def number(text: Column) -> Column:
    return text.cast("long")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def padded(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def permuted(value: Column, left: Column, right: Column, count: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the numbers below ``count``; ``left * right`` is at least ``count``.

    The number is a pair (below ``left``, below ``right``); rounds add a hash of one half to the other. A result
    that is not below ``count`` is permuted again until it is.
    """
    def hashed(half: Column, step: Column, modulus: Column) -> Column:
        name = F.concat_ws("|", F.lit(key), F.lit(kind), count.cast("string"), step.cast("string"),
                           half.cast("string"))
        return F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long") % modulus

    def once(x: Column) -> Column:
        halves = F.struct(F.floor(x / right).cast("long").alias("a"), (x % right).alias("b"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), halves,
            lambda s, r: F.when(r % 2 == 1, F.struct(
                ((s["a"] + hashed(s["b"], r, left)) % left).alias("a"), s["b"].alias("b")))
            .otherwise(F.struct(s["a"].alias("a"), ((s["b"] + hashed(s["a"], r, right)) % right).alias("b"))),
            lambda s: s["a"] * right + s["b"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), count,
                       lambda s, r: F.when(r == 1, once(value)).when(s >= count, once(s)).otherwise(s))


def permuted_below(value: Column, count: int, kind: str, key: str) -> Column:
    left = math.isqrt(count - 1) + 1
    right = -(-count // left)
    return permuted(value, F.lit(left).cast("long"), F.lit(right).cast("long"), F.lit(count).cast("long"), kind, key)


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second one from the right doubled; the last digit counts once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def in_format(digits: Column, form: Column) -> Column:
    """Digits written into the places of the digits of ``form``."""
    places = F.transform(F.split(form, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substr(digits, F.length(digits_of(F.substr(form, F.lit(1), i + 1))), F.lit(1)))
        .otherwise(c))
    return F.array_join(places, "")


def card(m: Column, key: str) -> Column:
    d = digits_of(m)
    size = F.length(d) - 1
    body = number(F.substr(d, F.lit(1), size))
    left, right = (F.rpad(F.lit("1"), (F.floor((size + k) / 2) + 1).cast("int"), "0").cast("long") for k in (1, 0))
    new = F.lpad(permuted(body, left, right, left * right, "card", key).cast("string"), size.cast("int"), "0")
    check = (10 - luhn_sum(F.concat(new, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(d) % 10 == 0, in_format(F.concat(new, check.cast("string")), m))


def ssn(m: Column, key: str) -> Column:
    d = digits_of(m)
    area, group, serial = (number(F.substring(d, a, n)) for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
    new = permuted_below(rank, 898 * 99 * 9999, "ssn", key)
    place = F.floor(new / (99 * 9999)).cast("long")
    text = F.concat_ws("-", padded(F.when(place >= 665, place + 2).otherwise(place + 1), 3),
                       padded(F.floor(new / 9999).cast("long") % 99 + 1, 2), padded(new % 9999 + 1, 4))
    return F.when(valid, text)


def phone(m: Column, key: str) -> Column:
    d = digits_of(m)
    line = number(F.substr(d, F.length(d) - 9, F.lit(10)))
    new = padded(permuted_below(line, 10 ** 10, "phone", key), 10)
    return in_format(F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new), m)


def ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    valid = F.forall(parts, lambda p: p <= 255)
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    new = permuted_below(value, 2 ** 32, "ip", key)
    text = F.concat_ws(".", *[(F.shiftright(new, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return F.when(valid, text)


def date(m: Column, java: str, key: str) -> Column:
    day = F.try_to_timestamp(m, F.lit(java)).cast("date")
    valid = day.isNotNull() & (F.date_format(day, java) == m)
    first, count = F.lit("1900-01-01").cast("date"), 73049   # days of 1900 to 2099
    new = permuted_below(F.datediff(day, first).cast("long"), count, "date", key)
    return F.when(valid, F.date_format(F.date_add(first, new.cast("int")), java))


def mail(m: Column, key: str) -> Column:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    hashed = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(name), F.lower(host)), 256), 1, 12)
    return F.concat(F.lit("user"), hashed, F.lit("@"), host)


def replaced(m: Column, key: str) -> Column:
    """``kind`` and ``new`` of a match; ``new`` is null where validation fails."""
    makers = {"mail": mail, "date_iso": lambda x, k: date(x, "yyyy-MM-dd", k),
              "date_dot": lambda x, k: date(x, "dd.MM.yyyy", k),
              "date_slash": lambda x, k: date(x, "MM/dd/yyyy", k), "phone": phone, "ssn": ssn, "ip": ip, "card": card}
    kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(list(PATTERNS)):
        here = m.rlike(f"^(?:{PATTERNS[name]})$")
        kind, new = F.when(here, F.lit(name)).otherwise(kind), F.when(here, makers[name](m, key)).otherwise(new)
    return F.struct(kind.alias("kind"), m.alias("old"), new.alias("new"))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id, text`` with pseudonyms in place, ``n_found`` and ``n_replaced`` and counts per kind."""
    matches = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    seen = docs.select("doc_id", "text", F.when(F.col("text").rlike("[0-9@]"), matches).alias("matches"))
    found = seen.select("doc_id", "text", F.transform("matches", lambda m: replaced(m, key)).alias("found"))
    joined = F.array_join(F.zip_with(
        F.split("text", ANY, -1), F.transform("found", lambda f: F.coalesce(f["new"], f["old"])),
        lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = F.filter("found", lambda f: f["new"].isNotNull())

    def count(spans, name: str) -> Column:
        return F.coalesce(F.when(spans.isNotNull(), F.size(spans)), F.lit(0)).cast("long").alias(name)

    kinds = [count(F.filter("found", lambda f: f["kind"].startswith(k) & f["new"].isNotNull()), f"n_{k}")
             for k in ("card", "ssn", "phone", "ip", "date", "mail")]
    return found.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"),
                        count(F.col("found"), "n_found"), count(changed, "n_replaced"), *kinds)
