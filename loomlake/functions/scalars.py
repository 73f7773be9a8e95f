"""Scalar functions as column expressions: ids, content hashes, token estimates, captions, byte arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of content hashing; a vertical tab is not in it.
SPACE = r"[ \t\n\f\r]+"


def hex_id(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def derived_id(domain: str, *parts: Column) -> Column:
    """16 bytes, as 32 hex digits, of a SHA-256 over the domain and the length-prefixed parts."""
    framed = [F.lit(domain), *(x for p in parts for x in (F.lpad(F.octet_length(p).cast("string"), 10, "0"), p))]
    return F.substring(F.sha2(F.concat(*framed), 256), 1, 32)


def content(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACE, " "), F.lit(" "))


def content_hash(text: Column) -> Column:
    return F.sha2(content(text), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def embed_token_estimate(text: Column) -> Column:
    return F.least(F.greatest(F.ceil(F.char_length(text) / 3), F.lit(1)), F.lit(512)).cast("long")


def normalized(text: Column) -> Column:
    """Without a byte-order mark at the start and without carriage returns."""
    return F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r"), F.lit(""))


def bytes_range(text: Column, start: Column, stop: Column) -> Column:
    """Bytes start to stop of a text, as text; what a cut character leaves becomes the replacement character."""
    return F.decode(F.substr(F.encode(text, "UTF-8"), start + 1, stop - start), "UTF-8")


def heading_depth(line: Column) -> Column:
    """Leading `#` among the first eight bytes that are not white space, 1 to 6 with something after them; else 0."""
    marks = F.regexp_extract(F.substring(F.regexp_replace(line, r"\s", ""), 1, 8), r"^(#{1,6})[^#]", 1)
    return F.length(marks)


def caption_ms(stamp: Column) -> Column:
    """[HH:]MM:SS[.,]fff in ms; the fraction is cut or filled to three digits; null if it is no time."""
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d+))?$"
    part = lambda k: F.regexp_extract(stamp, pattern, k)
    number = lambda c: F.when(c == "", 0).otherwise(c.try_cast("long"))
    fraction = F.rpad(F.substring(part(4), 1, 3), 3, "0")
    value = number(part(1)) * 3600000 + number(part(2)) * 60000 + number(part(3)) * 1000 + number(fraction)
    return F.when(stamp.rlike(pattern), value)


def excerpt(text: Column, chars: int = 400) -> Column:
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def media_of(head: Column) -> Column:
    """Kind of content by its first bytes as text: captions, markup, tables, marked text, plain text, or opaque."""
    return (
        F.when(F.startswith(head, F.lit("%PDF-")), "pdf")
        .when(F.startswith(head, F.lit("WEBVTT")), "captions")
        .when(F.lower(F.substring(F.ltrim(head), 1, 9)) == "<!doctype", "html")
        .when(head.rlike(r"^\s*[\[{]"), "json")
        .when(head.rlike(r"(?m)^#{1,6}[^#]"), "markdown")
        .when(head.rlike(r"(?m)^[^|\n]+(\|[^|\n]+){2,}$"), "table")
        .when(head.rlike(r"[\x00-\x08\x0E-\x1A]"), "opaque")
        .otherwise("text")
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value taken once: an expression from outside that stands inside a lambda is taken again for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def emitted(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, last: Callable[[Column], Column], block: int = 128) -> Column:
    """All that a fold over an array emits, in order. step(state, item): the next state and an array (of this type) of what is emitted; last(state): at the end.

    A fold copies what it carries at every step, so one that carried its own output would be quadratic. Here states alone are folded
    from block to block first; then each block is folded from its state and emits its own share.
    """
    nothing = F.array().cast(f"array<{kind}>")

    def share(part: Column, start: Column) -> Column:
        def both(acc: Column, x: Column) -> Column:
            state, out = step(acc["at"], x)
            return F.struct(state.alias("at"), F.concat(acc["out"], out).alias("out"))

        return F.aggregate(part, F.struct(start.alias("at"), nothing.alias("out")), both)["out"]

    def whole(parts: Column) -> Column:
        begun = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        states = F.aggregate(parts, begun, lambda acc, part: F.struct(F.aggregate(part, acc["at"], lambda s, x: step(s, x)[0]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        return bound(states, lambda st: F.concat(F.flatten(F.zip_with(parts, st["out"], share)), last(st["at"])))

    def parts(items: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
        return F.transform(firsts, lambda b: F.slice(items, b * block + 1, F.lit(block)))

    return bound(bound(items, parts), whole)


def running_sums(widths: Column, block: int = 128) -> Column:
    """For an array of longs, what lies before each element. In blocks, so that a long array costs little more than in proportion."""
    empty = F.array().cast("array<bigint>")

    def inside(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), lambda acc, w: F.struct((acc["at"] + w).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def summed(widths: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(widths) - 1) / block).cast("int"))
        blocks = F.transform(firsts, lambda b: inside(F.slice(widths, b * block + 1, F.lit(block))))
        # Sums of whole blocks are few, and a second level of blocks keeps them so.
        return bound(blocks, lambda blocks: F.flatten(F.zip_with(blocks, starts(F.transform(blocks, lambda b: b["at"])), lambda b, at: F.transform(b["out"], lambda s: s + at))))

    def starts(totals: Column) -> Column:
        def groups(totals: Column) -> Column:
            firsts = F.sequence(F.lit(0), F.floor((F.size(totals) - 1) / block).cast("int"))
            return F.transform(firsts, lambda b: inside(F.slice(totals, b * block + 1, F.lit(block))))

        def joined(groups: Column) -> Column:
            before = F.aggregate(groups, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
            return F.flatten(F.zip_with(groups, before, lambda g, at: F.transform(g["out"], lambda s: s + at)))

        return bound(bound(totals, groups), joined)

    return bound(widths, lambda w: F.when(F.size(w) > 0, summed(w)).when(w.isNotNull(), empty))
