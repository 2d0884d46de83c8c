"""Overlap resolution and rewriting of texts, as expressions over ``(text, array of spans)``."""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossveil.functions.detectors import RRN_WEIGHTS
from mossveil.functions.spans import BLOCK, SPANS, before, blocks, cut, let

#: Labels of the kinds.
LABELS = {
    "rrn": "주민등록번호",
    "phone": "전화번호",
    "email": "이메일",
    "name": "이름",
    "address": "주소",
    "card": "카드번호",
    "account": "계좌번호",
    "biz_reg": "사업자등록번호",
    "passport": "여권번호",
    "birth_date": "생년월일",
    "driver_license": "운전면허",
}
#: Parts of pseudonyms, of this engine's own choice.
FAMILY, GIVEN = "김 이 박 최 정 강 조 윤".split(), "가온 나래 다솜 라온 마루 보람 새롬 아람 하늘 한별".split()
CITIES, DISTRICTS, TOWNS = "가람특별시 누리광역시 다온광역시".split(), "새봄구 한빛구 푸른구".split(), "달빛동 별빛동 솔빛동".split()


def resolve(text: Column, spans: Column) -> Column:
    """Disjoint spans in order of start, so that no part of any span is left bare.

    Spans are taken by start, then longer, then surer ones, then as given. One that overlaps the last is joined with
    it; kind and confidence are those of the surer. A span within the last leaves its detector. Touching spans stay
    apart.
    """
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("shorter"), (-s["confidence"]).alias("unsure"), i.alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["confidence"].alias("confidence"), s["detector"].alias("detector"), s["text"].alias("text")))
    kept = "struct<kind:string,start:int,end:int,confidence:double,detector:string,text:string>"
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"), s["detector"].alias("detector"), s["text"].alias("text")).cast(kept)

    def join(last: Column, s: Column) -> Column:
        surer = s["confidence"] > last["confidence"]
        return F.struct(
            F.when(surer, s["kind"]).otherwise(last["kind"]).alias("kind"),
            last["start"].alias("start"),
            F.greatest(s["end"], last["end"]).alias("end"),
            F.greatest(s["confidence"], last["confidence"]).alias("confidence"),
            F.when(surer & (s["end"] > last["end"]), s["detector"]).otherwise(last["detector"]).alias("detector"),
            F.when(s["end"] <= last["end"], last["text"]).alias("text"),  # a longer one is cut out anew
        ).cast(kept)

    def islands(ordered: Column) -> Column:
        """Runs of overlapping spans: one begins where no earlier span reaches."""
        reached = before(F.transform(ordered, lambda s: s["end"]), F.lit(-1), lambda a, x: F.greatest(a, x))
        every = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
        heads = let(reached, lambda ends: F.filter(every, lambda i: F.get(ordered, i)["start"] >= F.get(ends, i)))
        return let(heads, lambda hs: F.transform(hs, lambda h, k: F.slice(ordered, h + 1, F.coalesce(F.get(hs, k + 1), F.size(ordered)) - h)))

    one = lambda run: F.aggregate(F.slice(run, F.lit(2), F.greatest(F.size(run) - 1, F.lit(0))), plain(F.get(run, F.lit(0))), join)
    merged = F.transform(let(F.sort_array(keyed), islands), one)
    done = lambda pieces: F.transform(merged, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["text"], cut(pieces, s["start"], s["end"] - s["start"])).alias("text"), s["confidence"].alias("confidence"), s["detector"].alias("detector")))
    alone = (F.size(spans) == 1) & F.get(spans, F.lit(0))["text"].isNotNull()  # joined with nothing, it stays as it is
    return F.when((F.size(spans) > 0) & ~alone, let(blocks(text), done).cast(SPANS)).otherwise(spans.cast(SPANS))


def first_only(spans: Column) -> Column:
    """The display rule: by start, longer first; spans that begin before the last one's end are left out.

    The fold notes a sign for each span, 1 for those that stay; a list of spans would be copied at every step.
    """
    keyed = F.sort_array(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("longer"), i.alias("place"), s.alias("span"))))
    start = F.struct(F.lit(-1).alias("end"), F.lit("").alias("signs"))

    def step(state: Column, k: Column) -> Column:
        stays = k["start"] >= state["end"]
        return F.struct(F.when(stays, -k["longer"]).otherwise(state["end"]).alias("end"), F.concat(state["signs"], F.when(stays, "1").otherwise("0")).alias("signs"))

    shown = lambda ks: let(F.split(F.aggregate(ks, start, step, lambda s: s["signs"]), ""), lambda signs: F.transform(F.filter(F.transform(ks, lambda k, i: F.struct(k["span"].alias("span"), (F.get(signs, i) == "1").alias("stays"))), lambda x: x["stays"]), lambda x: x["span"]))
    return F.when(F.size(spans) > 0, let(keyed, shown).cast(SPANS)).otherwise(spans.cast(SPANS))


def segments(text: Column, spans: Column) -> Column:
    """The whole text in order: array of struct(is_span, text, kind, confidence), empty plain parts left out."""
    plain = lambda part: F.struct(F.lit(False).alias("is_span"), part.alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("confidence"))
    found = lambda s: F.struct(F.lit(True).alias("is_span"), s["text"].alias("text"), s["kind"].alias("kind"), s["confidence"].alias("confidence"))
    end = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))

    def parts(pieces: Column) -> Column:
        each = F.flatten(F.transform(spans, lambda s, i: F.array(plain(cut(pieces, previous_end(spans, i), s["start"] - previous_end(spans, i))), found(s))))
        return F.concat(each, F.array(plain(cut(pieces, end, F.length(text) - end))))

    return F.filter(let(blocks(text), parts), lambda p: p["is_span"] | (p["text"] != ""))


def previous_end(spans: Column, i: Column) -> Column:
    return F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])


def rewrite(text: Column, spans: Column, value, short: bool = True) -> Column:
    """The text with every span replaced by ``value(span)``; spans are disjoint and in order."""
    return rewrite_each(text, spans, lambda s, i: value(s), short)


def rewrite_each(text: Column, spans: Column, value, short: bool = True) -> Column:
    """``rewrite`` by a function of a span and its number; with ``short``, single spans have a way of their own, which
    holds the value once more and does not pay for long ones."""
    end = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))

    def whole(pieces: Column) -> Column:
        parts = F.transform(spans, lambda s, i: F.concat(cut(pieces, previous_end(spans, i), s["start"] - previous_end(spans, i)), value(s, i)))
        return F.concat(F.array_join(parts, ""), cut(pieces, end, F.length(text) - end))

    # One span in a text of one block, the most common case: three pieces, and nothing to loop over.
    only = F.get(spans, F.lit(0))
    single = F.concat(F.substring(text, F.lit(1), only["start"]), value(only, F.lit(0)), F.substring(text, only["end"] + 1, F.length(text)))
    many = F.when(F.size(spans) > 0, let(blocks(text), whole)).otherwise(text)
    return F.when((F.size(spans) == 1) & (F.length(text) <= BLOCK), single).otherwise(many) if short else many


def mask(text: Column, spans: Column, char: str = "*", keep_head: int = 0) -> Column:
    """Replace by as many signs; the first ``keep_head`` characters stay, but never more than half of the span."""
    size = lambda s: s["end"] - s["start"]
    head = lambda s: F.least(F.lit(keep_head), F.floor(size(s) / 2).cast("int"))
    return rewrite(text, spans, lambda s: F.concat(F.substring(s["text"], F.lit(1), head(s)), F.repeat(F.lit(char), size(s) - head(s))))


def label_of(kind: Column, labels: dict[str, str] | None = None) -> Column:
    known = LABELS | (labels or {})
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), kind), kind)


def label(text: Column, spans: Column, labels: dict[str, str] | None = None, numbered: bool = False) -> Column:
    """Replace by ``[label]``; numbered ones count the distinct texts of a kind by first appearance."""
    named = lambda s, number: F.concat(F.lit("["), label_of(s["kind"], labels), number, F.lit("]"))
    if not numbered:
        return rewrite(text, spans, lambda s: named(s, F.lit("")))
    return let(numbers_of(spans), lambda numbers: rewrite_each(text, spans, lambda s, i: named(s, F.get(numbers, i).cast("string"))))


def numbers_of(spans: Column) -> Column:
    """For each span, the number of its text among the distinct texts of its kind, by first appearance.

    By sorting: equal texts come together with their first place ahead, then the texts of a kind in order of it.
    """
    last = lambda values: before(values, F.lit(None).cast("int"), lambda a, x: F.coalesce(x, a))
    changed = lambda xs, i, *fields: (i == 0) | F.array(*[F.get(xs, i)[f].cast("string") for f in fields]).eqNullSafe(F.array(*[F.get(xs, i - 1)[f].cast("string") for f in fields])).__invert__()

    def with_first(same: Column) -> Column:
        firsts = F.transform(same, lambda x, j: F.when(changed(same, j, "kind", "text"), x["place"]))
        return let(firsts, lambda fs: let(last(fs), lambda ls: F.sort_array(F.transform(same, lambda x, j: F.struct(x["kind"].alias("kind"), F.coalesce(F.get(fs, j), F.get(ls, j)).alias("first"), x["place"].alias("place"))))))

    def with_number(ordered: Column) -> Column:
        new = F.transform(ordered, lambda x, j: F.when(changed(ordered, j, "kind", "first"), 1).otherwise(0))
        counts = let(new, lambda ns: let(before(ns, F.lit(0), lambda a, x: a + x), lambda bs: F.transform(ns, lambda n, j: n + F.get(bs, j))))

        def numbered(cs: Column) -> Column:
            starts = F.transform(ordered, lambda x, j: F.when(changed(ordered, j, "kind"), F.get(cs, j) - 1))
            number = lambda ss, ls: F.transform(ordered, lambda x, j: F.struct(x["place"].alias("place"), (F.get(cs, j) - F.coalesce(F.get(ss, j), F.get(ls, j))).alias("number")))
            return F.transform(F.sort_array(let(starts, lambda ss: let(last(ss), lambda ls: number(ss, ls)))), lambda x: x["number"])

        return let(counts, numbered)

    same = F.sort_array(F.transform(spans, lambda s, i: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), i.alias("place"))))
    return let(let(same, with_first), with_number)


def pseudonym(text: Column, spans: Column, row_key: Column, salt: str | None = None) -> Column:
    """Replace by made-up values: equal kind and text in one row give equal values, and kinds without any a label.

    Values follow from a hash of salt, row key, kind and text, so a repeated task makes the same ones; the salt is
    drawn anew for each call unless given. Made-up registration and card numbers never have a right check digit.
    """
    salt = salt if salt is not None else secrets.token_hex(16)

    def value(s: Column) -> Column:
        draw = lambda k, n: F.pmod(F.xxhash64(F.lit(salt), row_key, s["kind"], s["text"], F.lit(k)), F.lit(n)).cast("int")
        pick = lambda k, words: F.element_at(F.array(*[F.lit(w) for w in words]), draw(k, len(words)) + 1)
        digits = lambda k, n: F.lpad(draw(k, 10**n).cast("string"), n, "0")
        letters = F.array_join(F.transform(F.sequence(F.lit(1), draw(40, 5) + 5), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(F.xxhash64(F.lit(salt), row_key, s["kind"], s["text"], i), F.lit(26)).cast("int") + 1, F.lit(1))), "")
        body = F.concat(F.lpad((draw(1, 60) + 40).cast("string"), 2, "0"), F.lpad((draw(2, 12) + 1).cast("string"), 2, "0"), F.lpad((draw(3, 28) + 1).cast("string"), 2, "0"), (draw(4, 2) + 1).cast("string"), digits(5, 5))
        at = lambda x, i: F.substring(x, i + 1, 1).cast("int")

        # What digits are taken from is made once, not once for each of them.
        def registration(made: Column) -> Column:
            total = sum((at(made, i) * w for i, w in enumerate(RRN_WEIGHTS)), F.lit(0))
            wrong = ((F.lit(11) - total % 11) % 10 + 1 + draw(6, 9)) % 10
            return F.concat(F.substring(made, 1, 6), F.lit("-"), F.substring(made, 7, 6), wrong.cast("string"))

        def card(made: Column) -> Column:
            doubled = lambda twice: sum((at(made if i % 2 else twice, i) for i in range(15)), F.lit(0))
            luhn = let(F.translate(made, "0123456789", "0246813579"), doubled)
            whole = F.concat(made, ((F.lit(10) - luhn % 10 + 1 + draw(9, 9)) % 10).cast("string"))
            return let(whole, lambda w: F.concat_ws("-", *[F.substring(w, 4 * i + 1, 4) for i in range(4)]))

        return (
            F.when(s["kind"] == "name", F.concat(pick(10, FAMILY), pick(11, GIVEN)))
            .when(s["kind"] == "phone", F.concat(F.lit("010-"), digits(12, 4), F.lit("-"), digits(13, 4)))
            .when(s["kind"] == "email", F.concat(letters, F.lit("@example.com")))
            .when(s["kind"] == "address", F.concat_ws(" ", pick(14, CITIES), pick(15, DISTRICTS), pick(16, TOWNS), F.concat((draw(17, 99) + 1).cast("string"), F.lit("-"), (draw(18, 9) + 1).cast("string"))))
            .when(s["kind"] == "rrn", let(body, registration))
            .when(s["kind"] == "card", let(F.concat(F.lit("4"), digits(7, 7), digits(8, 7)), card))
            .otherwise(F.concat(F.lit("["), label_of(s["kind"]), F.lit("]")))
        )

    return rewrite(text, spans, value, short=False)
