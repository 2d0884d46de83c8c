"""Spans of pattern matches as Catalyst expressions.

Places are code points from 0, ends exclusive. Matches are marked by ``regexp_replace`` and cut out by ``split``;
the running length of the pieces gives the places, so look-around and back-references keep their context.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks between pieces and between the groups of a match. In texts they are first replaced, one for one, by private
#: signs that no pattern tells from them, so places do not move.
MARK, FIELD = "\ue000", "\ue001"
STAND_INS = "\ue002\ue003"

SPAN = "struct<kind:string,start:int,end:int,text:string,confidence:double,detector:string>"
SPANS = f"array<{SPAN}>"
MATCHES = "array<struct<start:int,end:int,match:string,groups:array<string>>>"

#: Every decimal digit of Unicode, and the ASCII digit of its value.
DIGITS = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.digit(d)) for d in DIGITS)


def find(text: Column, pattern: str, groups: tuple[str, ...] = ()) -> Column:
    """All leftmost matches: array of struct(start, end, match, groups); groups that took no part are empty.

    Texts without a match, null ones among them, cost one look: nothing is taken apart in them.
    """
    safe = unmarked(text)
    fields = "".join(f"{FIELD}${{{g}}}" for g in groups)
    marked = F.regexp_replace(safe, F.lit(f"(?U){pattern}"), F.lit(f"{MARK}$0{fields}{MARK}"))
    taken = lambda ps: let(F.transform(ps, lambda p: F.split(p, FIELD, -1)), lambda parts: _places(parts, max(len(groups), 1)))
    apart = lambda ps: F.when(F.size(ps) == 3, _single(ps, groups)).otherwise(taken(ps))
    return let(marked, lambda m: F.when(F.contains(m, F.lit(MARK)), let(F.split(m, MARK, -1), apart)).otherwise(F.array().cast(MATCHES)))


def unmarked(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(FIELD)), F.translate(text, MARK + FIELD, STAND_INS)).otherwise(text)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once.

    ``element_at`` rather than ``get``: that asks for the type of what it gets for every row, and nested ones each twice.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _single(pieces: Column, groups: tuple[str, ...]) -> Column:
    """The match out of three pieces, the most common case: nothing has to be summed for its place."""
    start = F.length(F.get(pieces, F.lit(0)))
    one = lambda m, gs: F.array(F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), gs.alias("groups")))
    match = F.get(pieces, F.lit(1))
    return let(F.split(match, FIELD, -1), lambda p: one(F.get(p, F.lit(0)), F.slice(p, 2, len(groups)))) if groups else one(match, F.array().cast("array<string>"))


def _places(parts: Column, groups: int) -> Column:
    """Matches out of pieces, of which every second is one."""
    lengths = F.transform(parts, lambda p: F.length(F.get(p, F.lit(0))))

    def matches(ls: Column, starts: Column) -> Column:
        one = lambda i: let(F.get(starts, i), lambda a: F.struct(a.alias("start"), (a + F.get(ls, i)).alias("end"), F.get(F.get(parts, i), F.lit(0)).alias("match"), F.slice(F.get(parts, i), 2, groups).alias("groups")))
        every = F.when(F.size(ls) > 1, F.sequence(F.lit(1), F.size(ls) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(every, one)

    return let(lengths, lambda ls: let(before(ls, F.lit(0), lambda a, x: a + x), lambda starts: matches(ls, starts)))


def before(values: Column, zero: Column, merge) -> Column:
    """For each place of an array, the values before it folded by ``merge`` (associative, ``zero`` changes nothing).

    The fold is taken over chunks and then within them, so that it costs little more than linear time; a fold that
    builds a list would copy all it has built at every step. Arrays of a few values, the most common, have one chunk.
    """
    step = 100
    fold = lambda xs: F.aggregate(xs, zero, merge)
    chunk = lambda i: F.floor(i / step).cast("int")
    chunks = lambda vs: F.transform(F.sequence(F.lit(0), chunk(F.size(vs))), lambda c: fold(F.slice(vs, c * step + 1, F.lit(step))))
    prefix = lambda sums: F.transform(sums, lambda _, i: fold(F.slice(sums, F.lit(1), i)))
    each = lambda vs, pre: F.transform(vs, lambda _, i: merge(F.get(pre, chunk(i)), fold(F.slice(vs, chunk(i) * step + 1, i % step))))
    few = lambda vs: F.transform(vs, lambda _, i: fold(F.slice(vs, F.lit(1), i)))
    return let(values, lambda vs: F.when(F.size(vs) <= 10, few(vs)).otherwise(let(let(chunks(vs), prefix), lambda pre: each(vs, pre))))


def blocks(text: Column) -> Column:
    """A text in blocks, so that ``cut`` need not count its code points from the start each time."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


#: Code points of a block.
BLOCK = 1000


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points of a text from ``start`` (from 0), out of its blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + length - 1) / BLOCK).cast("int")
    part = F.when(first == last, F.get(pieces, first)).otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
    only = (F.size(pieces) == 1) & (start >= 0)
    found = F.when(only, F.substring(F.get(pieces, F.lit(0)), start + 1, length)).otherwise(F.substring(part, start % BLOCK + 1, length))
    return F.when(length > 0, F.coalesce(found, F.lit(""))).otherwise(F.lit(""))


#: Windows around digits reach so far before the first and behind the last of them; stretches without a digit that are
#: longer than GAP lie between two windows. No pattern of a detector reaches further, nor has such a gap within.
BEFORE, AFTER, GAP = 25, 20, 30
#: Texts of so many code points at most are not cut into windows.
SHORT = 60
NEAR = "array<struct<start:int,text:string,digits:int>>"


def near_digits(text: Column, least: int = 6) -> Column:
    """The surroundings of digits, of at least ``least`` in a row or close to each other: array of struct(start, text, digits).

    One pass over the text, which every detector of numbers can share. A match in a window is one in the text, and the
    other way round: windows hold all that patterns look at, and what lies between them holds no digit. A short text is
    one window as it stands.
    """
    safe = unmarked(text)
    parts = F.split(F.regexp_replace(safe, F.lit(f"(?U)\\D{{{GAP},}}"), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def windows(ps: Column, starts: Column) -> Column:
        lead = lambda i: F.when(i > 0, F.right(F.get(ps, i - 1), F.lit(BEFORE))).otherwise(F.lit(""))
        tail = lambda i: F.coalesce(F.left(F.get(ps, i + 1), F.lit(AFTER)), F.lit(""))
        many = F.filter(F.sequence(F.lit(0), F.size(ps) - 1, F.lit(2)), lambda i: F.get(ps, i).rlike(f"(?U)(?:\\d\\D*){{{least}}}"))
        return F.transform(many, lambda i: let(lead(i), lambda x: F.struct((F.get(starts, i) - F.length(x)).alias("start"), F.concat(x, F.get(ps, i), tail(i)).alias("text"), F.length(F.regexp_replace(F.get(ps, i), r"(?U)\D", "")).alias("digits"))))

    lengths = lambda ps: F.transform(ps, lambda p: F.length(p))
    found = let(parts, lambda ps: let(before(lengths(ps), F.lit(0), lambda a, x: a + x), lambda starts: windows(ps, starts)))
    whole = F.array(F.struct(F.lit(0).alias("start"), safe.alias("text"), F.length(F.regexp_replace(text, r"(?U)\D+", "")).alias("digits")))
    found = F.when(F.length(text) <= SHORT, whole.cast(NEAR)).otherwise(found.cast(NEAR))
    return F.when(text.rlike(r"(?U)\d(?:\D{0,29}\d){" + str(least - 1) + "}"), found).otherwise(F.array().cast(NEAR))


def find_near(near: Column, pattern: str, groups: tuple[str, ...] = (), context: int = 0, least: int = 0, needs: str | None = None) -> Column:
    """Matches in windows, as ``find`` gives them; if asked with so many characters before them (``lead``), and on
    either side (``context``). Windows with fewer digits than a match has at ``least``, or without what it ``needs``,
    are passed over."""

    def of(w: Column) -> Column:
        def one(m: Column, pieces: Column | None) -> Column:
            low = F.greatest(m["start"] - context, F.lit(0))
            around = [cut(pieces, low, m["start"] - low).alias("lead"), cut(pieces, low, m["end"] + context - low).alias("context")] if context else []
            return F.struct((m["start"] + w["start"]).alias("start"), (m["end"] + w["start"]).alias("end"), m["match"].alias("match"), m["groups"].alias("groups"), *around)

        found = find(w["text"], pattern, groups)
        return let(blocks(w["text"]), lambda pieces: F.transform(found, lambda m: one(m, pieces))) if context else F.transform(found, lambda m: one(m, None))

    fit = F.filter(near, lambda w: (w["digits"] >= least) & w["text"].rlike(needs) if needs else w["digits"] >= least)
    return F.flatten(F.transform(fit, of))


def group(match: Column, k: int) -> Column:
    return F.get(match["groups"], F.lit(k))


def span(kind: str, detector: str, found: Column, start: Column, end: Column, confidence: Column | float) -> Column:
    confidence = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence.cast("double")
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), found.alias("text"), confidence.alias("confidence"), F.lit(detector).alias("detector"))


def ascii_digits(value: Column) -> Column:
    """Only the digits of a value, in ASCII; the long table of other digits is consulted only where there are any."""
    digits = F.regexp_replace(value, r"(?U)\D", "")
    return F.when(F.length(digits) == F.octet_length(digits), digits).otherwise(F.translate(digits, "".join(DIGITS), ASCII_DIGITS))


def digit(value: Column, place: int) -> Column:
    """The digit at a place from 0 of a string of ASCII digits."""
    return F.substring(value, place + 1, 1).cast("int")


def weighted(value: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(value, i) * w
    return total


def real_date(year: Column, month: Column, day: Column) -> Column:
    """Whether it is a calendar date of year 1 or later."""
    iso = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.coalesce(iso.try_cast("date").isNotNull() & (year.cast("int") >= 1), F.lit(False))
