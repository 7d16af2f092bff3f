"""String expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs that become one blank each, so offsets stay valid.
PUNCTUATION = ",.()\"':;?!@[]/“”‘’"
LINE_SIGNS = "\n\t"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(text: Column | str, start: Column | int, length: Column | int) -> Column:
    """Substring from a 0-based offset."""
    start = start if isinstance(start, Column) else F.lit(start)
    length = length if isinstance(length, Column) else F.lit(length)
    return F.substring(col(text), (start + 1).cast("int"), length.cast("int"))


def count_in(text: Column | str, needle: Column) -> Column:
    """Number of non-overlapping hits; an empty needle fits between all characters."""
    text = col(text)
    gone = F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.length(text) + 1).otherwise(
        ((F.length(text) - gone) / F.length(needle)).cast("long")
    )


def find_nth(text: Column | str, needle: str, n: Column | int) -> Column:
    """0-based offset of the n-th hit, -1 if there are fewer; n <= 1 means the first."""
    text, mark = col(text), F.lit(needle)
    n = F.greatest(n if isinstance(n, Column) else F.lit(n), F.lit(1)).cast("int")
    head = F.call_function("substring_index", text, mark, n)
    return F.when(count_in(text, mark) >= n, F.length(head)).otherwise(-1).cast("long")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside a lambda function."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def running_sums(sizes: Column, block: int = 128) -> Column:
    """0, s1, s1 + s2, ... of an integer array of at least one element.

    An array is copied when it grows, so sums are made inside blocks and over the blocks' totals.
    """

    def summed(parts: Column) -> Column:
        return F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def blocks(parts: Column) -> Column:
        last = F.ceil(F.size(parts) / block).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: summed(F.slice(parts, b * block + 1, F.lit(block))))

    def shifted(inner: Column, outer: Column) -> Column:
        moved = F.zip_with(
            inner, F.slice(outer, F.lit(1), F.size(inner)),
            lambda a, start: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda x: x + start),
        )
        return F.array_append(F.flatten(moved), F.element_at(outer, -1))

    def joined(inner: Column) -> Column:
        return once(summed(F.transform(inner, lambda a: F.element_at(a, -1))), lambda outer: shifted(inner, outer))

    return once(sizes, lambda parts: once(blocks(parts), joined))


def occurrences(lowered: Column | str, needle: Column) -> Column:
    """0-based offsets of every hit of a lower-case needle in a lower-case text, overlapping ones included.

    The pieces of the text cut at a needle give the offsets as running lengths. A needle that starts
    like it ends can overlap itself; only then the text is cut in front of each hit instead.
    """
    lowered = col(lowered)
    size = F.length(needle)
    quoted = F.concat(F.lit("\\Q"), needle, F.lit("\\E"))
    repeats = F.exists(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
        lambda k: (k < size) & (F.substring(needle, F.lit(1), k) == F.substring(needle, size - k + 1, k)),
    )

    def places(pattern: Column, gap: Column) -> Column:
        ends = running_sums(F.transform(F.split(lowered, pattern, -1), lambda piece: F.length(piece) + gap))
        # the last running length lies behind the text; the first is a hit only if the text starts with it
        return once(ends, lambda e: F.slice(e, F.lit(2), F.greatest(F.size(e) - 2, F.lit(0))))

    none = F.array().cast("array<int>")
    front = F.when(F.startswith(lowered, needle), F.array(F.lit(0))).otherwise(none)
    ahead = F.concat(front, places(F.concat(F.lit("(?="), quoted, F.lit(")")), F.lit(0)))
    plain = F.transform(places(quoted, size), lambda at: at - size)
    return F.when((size > 0) & F.contains(lowered, needle), F.when(repeats, ahead).otherwise(plain)).otherwise(none)


def with_offsets(rows: DataFrame, sizes: str, name: str, block: int = 128) -> DataFrame:
    """Add the running sums 0, s1, s1 + s2, ... of an integer array column of at least one element."""
    return rows.withColumn(name, running_sums(F.col(sizes), block))


def sign_places(text: Column | str, sign: str) -> Column:
    """Ascending 0-based offsets of a one-character sign; the text is cut once."""
    pieces = F.split(col(text), F.lit(f"\\Q{sign}\\E"), -1)
    ends = running_sums(F.transform(pieces, lambda p: F.length(p) + 1))
    return once(ends, lambda e: F.transform(F.slice(e, F.lit(2), F.size(e) - 2), lambda x: x - 1))


def rank_in(ordered: Column, value: Column) -> Column:
    """Number of elements of an ascending array that are smaller than a value, by halving."""
    state = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))

    def halved(s: Column) -> Column:
        low, high = s["low"], s["high"]
        middle = F.shiftright(low + high, 1)
        right = (low < high) & (F.get(ordered, middle) < value)
        return F.struct(
            F.when(right, middle + 1).otherwise(low).alias("low"),
            F.when(right | (low >= high), high).otherwise(middle).alias("high"),
        )

    return F.aggregate(steps, state, lambda s, _: halved(s), lambda s: s["low"])


def normalise_text(text: Column | str, collapse: bool = False) -> Column:
    """Lower case, punctuation and line signs to blanks; same length unless collapsed."""
    signs = PUNCTUATION + LINE_SIGNS
    out = F.translate(F.lower(col(text)), signs, " " * len(signs))
    return F.trim(F.regexp_replace(out, " +", " ")) if collapse else out


def ngram_window(
    text: Column | str, start: Column | str, end: Column | str, n: int, plain: bool = False
) -> Column:
    """The mention with up to n blank-separated tokens on both sides; ``plain`` text is normalised already."""
    text = col(text) if plain else normalise_text(text)
    start, end = col(start), col(end)
    left = F.substring_index(sub(text, 0, start), " ", -(n + 1))
    right = F.substring_index(F.substring(text, (end + 1).cast("int"), F.length(text)), " ", n + 1)
    return F.trim(F.concat(left, sub(text, start, end - start), right))


def section_bounds(body: Column | str) -> Column:
    """Ends of the opening three sentences and start of the closing three."""
    body = col(body)
    size = F.length(body).cast("long")
    third = find_nth(body, ".", 3) + 1
    opening = F.when(third == 0, size).otherwise(third)
    tail = find_nth(body, ".", count_in(body, F.lit(".")) + 1 - 3) + 1
    closing = F.greatest(F.when(tail == 0, size).otherwise(tail), opening)
    return F.struct(opening.alias("opening_end"), closing.alias("closing_start"), size.alias("size"))


def sentence_place(stops: Column, start: Column) -> Column:
    """Relative place of an offset in its sentence, from the ascending offsets of the full stops.

    NULL on a full stop and after the last one.
    """

    def between(r: Column) -> Column:
        low = F.coalesce(F.get(stops, r - 1) + 1, F.lit(0))
        high = F.get(stops, r)
        return F.when(high > start, (start - low) / (high - low))

    return once(rank_in(stops, start), between)


def upper_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{IsUppercase}")).cast("long")


def round9(c: Column | str, digits: int = 9) -> Column:
    return F.round(col(c).cast("double"), digits)
