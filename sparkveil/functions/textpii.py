"""Verified personal data in text, as column expressions: no shuffle, no Python.

A pattern's places come from marking its matches with two control characters and splitting
there. Kinds claim their spans in the order e-mail, ssn, coordinates, card, phone; a later
kind's match that overlaps a claimed span is dropped. Offsets are code points, half open.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results have to agree on.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The address pattern with no place tried twice: a match begins where its run of characters or the
#: match before it ends, and the run is read once. Same matches, in linear time.
LINEAR = {EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
PHONE = r"(?<!\d)(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
SEPARATOR = r"(?:(?:\s*[,;/|:\-]\s*|\s+)(?:(?:LAT(?:ITUDE)?|LON(?:GITUDE)?|GPS)\b\s*[:.\-]?\s*)?)"
KINDS = ["email", "ssn", "gps coordinates", "credit card number", "phone number"]
HIT = "array<struct<kind:string,text:string,start:int,end:int>>"
#: Names inside track keys, in the order in which they decide, and the stand-in each takes.
PATCH_OF = [("license plate", "license plate"), ("house number", "house number"), ("street sign", "house number"), ("credit card number", "credit card number"), ("phone number", "phone number"), ("email", "email"), ("ssn", "ssn")]
PLATE_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<text,start>> of a pattern's non-overlapping matches, left to right. The marked
    text is cut once and the offset is carried along the parts in one fold."""
    pattern = LINEAR.get(pattern, pattern)
    clean = F.translate(text, "\x01\x02", "  ")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", "\x01$1\x02"), "[\x01\x02]", -1)
    none = F.array().cast("array<struct<text:string,start:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("out"))
    step = lambda s, x: F.struct((s["at"] + F.char_length(x)).alias("at"), (~s["odd"]).alias("odd"), F.when(s["odd"], F.concat(s["out"], F.array(F.struct(x.alias("text"), s["at"].alias("start"))))).otherwise(s["out"]).alias("out"))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(parts, start, step, lambda s: s["out"])).otherwise(none)


def hits(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["text"].alias("text"), s["start"].alias("start"), (s["start"] + F.char_length(s["text"])).alias("end"))).cast(HIT)


def luhn_ok(text: Column) -> Column:
    """13 to 19 digits, whatever stands between them, that pass the checksum."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ssn_ok(text: Column) -> Column:
    area = F.substring(text, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(text, 5, 2) != "00") & (F.substring(text, 8, 4) != "0000")


def _pair(mark: str) -> str:
    number = rf"([+\-−]?\d{{1,3}}{mark}\d{{4,}})"
    suffix = r"([NSEW](?![A-Za-z]))?"
    return rf"([NSEW])?\s*{number}\s*°?\s*{suffix}{SEPARATOR}([NSEW])?\s*{number}\s*°?\s*{suffix}"


def _valid(text: Column, pattern: str) -> Column:
    """Both numbers in range in either order, and not both zero."""

    def value(number: int, before: int, after: int) -> Column:
        g = lambda i: F.regexp_extract(text, f"(?iU)^{pattern}", i)
        x = F.regexp_replace(F.regexp_replace(g(number), "−", "-"), ",", ".").try_cast("double")
        hemisphere = F.upper(F.when(g(after) != "", g(after)).otherwise(g(before)))
        return F.when(hemisphere.isin("S", "W"), -F.abs(x)).otherwise(x)

    a, b = value(2, 1, 3), value(5, 4, 6)
    fits = ((F.abs(a) <= 90) & (F.abs(b) <= 180)) | ((F.abs(a) <= 180) & (F.abs(b) <= 90))
    return F.coalesce(fits & ~((a == 0) & (b == 0)), F.lit(False))


def gps(text: Column) -> Column:
    """Coordinate pairs: every start is tried, overlapping candidates merge, white space is trimmed."""
    clean = F.translate(text, "\x01\x02", "  ")
    every = []
    for mark in (r"\.", ","):
        pattern = _pair(mark)
        guarded = rf"(?iU)(?<![\d.,])(?={{}}(?![\d.,]))"
        parts = F.split(F.regexp_replace(clean, guarded.format(pattern), "\x01"), "\x01", -1)
        texts = F.regexp_extract_all(clean, F.lit(guarded.format(f"({pattern})")), F.lit(1))
        # the i-th text starts behind the first i + 1 parts: both run along in one fold
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,t:string>>").alias("out"))
        after = lambda s, z: s["at"] + F.char_length(z["p"])
        step_ = lambda s, z: F.struct(after(s, z).alias("at"), F.when(z["t"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(after(s, z).alias("a"), (after(s, z) + F.char_length(z["t"])).alias("b"), z["t"].alias("t"))))).alias("out"))
        found = F.aggregate(F.arrays_zip(parts.alias("p"), texts.alias("t")), begin, step_, lambda s: s["out"])
        glued = lambda s: F.rlike(F.substr(s["t"], F.lit(1), F.lit(1)), F.lit("(?i)[NSEW]")) & (s["a"] > 0) & F.rlike(F.substr(clean, s["a"], F.lit(1)), F.lit(r"\p{L}"))
        ok = partial(_valid, pattern=pattern)
        found = F.filter(found, lambda s: ~glued(s) & ok(s["t"]))  # noqa: B023
        every.append(F.transform(found, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        overlaps = (F.size(acc) > 0) & (s["a"] < F.try_element_at(acc, F.lit(-1))["b"])
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when(overlaps, merged).otherwise(F.concat(acc, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))

    merged = F.aggregate(F.array_sort(F.concat(*every)), empty, step)

    def trimmed(s: Column) -> Column:
        body = F.substr(clean, s["a"] + 1, s["b"] - s["a"])
        left = F.char_length(body) - F.char_length(F.regexp_replace(body, r"(?U)^\s+", ""))
        kept = F.regexp_replace(F.regexp_replace(body, r"(?U)^\s+", ""), r"(?U)\s+$", "")
        return F.struct(kept.alias("text"), (s["a"] + left).alias("start"))

    out = F.transform(merged, trimmed)
    return F.when(F.rlike(text, F.lit(r"\d[.,]\d{4}")), out).otherwise(F.array().cast("array<struct<text:string,start:int>>"))


def candidates(text: Column) -> dict[str, Column]:
    """Verified hits of each kind by itself, before any claims."""
    card = F.filter(matches(text, CARD), lambda s: luhn_ok(s["text"]))
    ssn = F.filter(matches(text, SSN), lambda s: ssn_ok(s["text"]))
    found = {"email": matches(text, EMAIL), "ssn": ssn, "gps coordinates": gps(text), "credit card number": card, "phone number": matches(text, PHONE)}
    return {k: hits(k, v) for k, v in found.items()}


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def find_pii(text: Column, kinds: list[str] = KINDS) -> Column:
    """All verified hits of a text, sorted by start; null and empty texts have none.

    Candidates of all kinds stand in one array in the order of their claims and are folded once,
    so no pattern is evaluated twice.
    """
    by = candidates(F.coalesce(text, F.lit("")))
    # a cheap test on the row first, which every match of any kind passes: an @, nine digits a
    # separator apart at most, the end of a phone number, or four decimals
    likely = F.rlike(text, F.lit(r"@|(?:\d[ -]?){8}\d|\d{3}[ .-]\d{4}|\d[.,]\d{4}"))
    every = F.concat(*[by[k] for k in KINDS if k in kinds])
    claimed = F.aggregate(every, F.array().cast(HIT), lambda taken, h: F.when(F.exists(taken, lambda t: overlap(h, t)), taken).otherwise(F.concat(taken, F.array(h))))
    ordered = F.array_sort(claimed, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return F.when(F.coalesce(likely, F.lit(False)), ordered).otherwise(F.array().cast(HIT))


def digits_of(key: Column, n: int) -> Column:
    """n decimal digits that depend on the key alone."""
    return F.substr(F.lpad(F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10), 20, "0"), F.lit(21 - n), F.lit(n))


def luhn_digit(digits: Column) -> Column:
    """The digit that completes a number to a valid checksum."""
    n = F.char_length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * (1 + (n - i + 1) % 2))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return ((10 - total % 10) % 10).cast("string")


def stand_in(kind: Column, key: Column) -> Column:
    """A stand-in of the same format that depends on the key alone, and belongs to no one."""
    body = F.concat(F.lit("4242"), digits_of(key, 11))
    card = F.concat(body, luhn_digit(body))
    spaced = F.concat_ws(" ", *[F.substring(card, i, 4) for i in (1, 5, 9, 13)])
    phone = F.concat(F.lit("555-01"), (F.lit(10) + digits_of(key, 6).cast("int") % 90).cast("string"))
    # every letter and digit takes part of the key's hash, so a stand-in is the same wherever it is made
    letter = lambda i: F.substr(F.lit(PLATE_LETTERS), F.substr(digits_of(key, 9), F.lit(2 * i + 1), F.lit(2)).cast("int") % len(PLATE_LETTERS) + 1, F.lit(1))
    plate = F.concat(letter(0), letter(1), letter(2), F.lit(" "), digits_of(key, 3))
    house = (F.lit(12) + digits_of(key, 9).cast("int") % 9888).cast("string")
    by_kind = [("credit card number", spaced), ("phone number", phone), ("email", F.lit("person@example.com")), ("ssn", F.lit("000-00-0000")), ("license plate", plate), ("house number", house)]
    out = F.lit(None).cast("string")
    for name, value in reversed(by_kind):
        out = F.when(kind == name, value).otherwise(out)
    return F.coalesce(out, F.concat(F.lit("["), kind, F.lit("]")))


def replacement(track_key: Column) -> Column:
    """What covers a track in replace mode: struct<action, text>. The action is avatar, patch (with
    a stand-in as its text) or fill; the first name in order that stands inside the key decides."""
    low = F.lower(track_key)
    action, text = F.lit("fill"), F.lit(None).cast("string")
    for name, kind in reversed(PATCH_OF):
        action = F.when(F.contains(low, F.lit(name)), "patch").otherwise(action)
        text = F.when(F.contains(low, F.lit(name)), stand_in(F.lit(kind), track_key)).otherwise(text)
    person = F.contains(low, F.lit("face")) | F.contains(low, F.lit("person"))
    return F.struct(F.when(person, "avatar").otherwise(action).alias("action"), F.when(~person, text).alias("text"))


def mask(text: Column, found: Column) -> Column:
    """The text with each hit replaced by its stand-in; hits are sorted and don't overlap."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, h: F.struct(F.concat(s["out"], F.substr(text, s["at"] + 1, h["start"] - s["at"]), stand_in(h["kind"], F.concat_ws(":", h["kind"], h["text"]))).alias("out"), h["end"].alias("at"))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.char_length(text)))))
