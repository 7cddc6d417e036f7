"""Amounts, percentages and costs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import comparable, let

#: Dollars a million tokens, read in, put out, written to and read from the cache.
RATES = {"input": 5.0, "output": 25.0, "cache_write": 6.25, "cache_read": 0.5}
BATCH_DISCOUNT = 0.5


#: What a word or letter after a number multiplies it by.
UNITS = {"milhao": 1_000_000, "milhoes": 1_000_000, "mlhao": 1_000_000, "mlhoes": 1_000_000, "m": 1_000_000, "m€": 1_000_000, "mil": 1000, "k": 1000, "k€": 1000}


def _unit(t: Column) -> Column:
    """The largest multiplier among the words of a text; a letter counts where it follows a number."""
    words = F.split(F.regexp_replace(t, r"(?<=\d)(?=[a-z])", " "), r"[^a-z€0-9]+")
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    after = F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda word, before: F.when(word.isNull(), 1).when((F.length(word) > 1) & ~((word == "mil") & before.startswith("h")) | before.rlike("^[0-9]+$"), F.coalesce(F.try_element_at(known, word), F.lit(1))).otherwise(1))
    return F.array_max(after)


def amount(s: Column) -> Column:
    """Euros as decimal(18,2) from Portuguese notation, or null.

    The first number counts. Its last mark of two kinds is the decimal one; of one kind, a comma is decimal and a point
    before three digits, or a comma before three in a number without unit, parts thousands. Where the decimal mark stands
    more than once, as in 30.09.2026, there is no number to read.
    """
    number = lambda t: F.rtrim(F.regexp_replace(F.regexp_extract(t, r"\d[\d.,\s]*", 0), r"\s+", ""), F.lit(".,"))
    return let(comparable(s), lambda t: let(number(t), lambda digits: F.when(digits != "", let(_unit(t), lambda times: _euros_of(digits, times)))))


def _euros_of(digits: Column, times: Column) -> Column:
    def read(marks: Column, tail: Column) -> Column:
        last = F.substring(marks, -1, 1)
        mixed = marks.contains(",") & marks.contains(".")
        decimal = (marks != "") & (mixed | (last == ",") & ((tail != 3) | (times > 1)) | (last == ".") & (tail != 3))
        twice = F.length(marks) - F.length(F.replace(marks, last)) > 1
        bare = F.translate(digits, ".,", "")
        whole = F.concat(F.substring(bare, F.lit(1), F.length(bare) - tail), F.lit("."), F.right(bare, tail))
        return F.when(decimal & twice, F.lit(None)).when(decimal, whole).otherwise(bare)

    tail = F.length(digits) - F.length(F.regexp_replace(digits, "[0-9]+$", ""))
    bare = let(F.regexp_replace(digits, "[0-9]", ""), lambda marks: let(tail, lambda n: read(marks, n)))
    return F.round(bare.try_cast("decimal(20,6)") * times, 2).cast("decimal(18,2)")


def percentage(s: Column) -> Column:
    """The first number before a sign or words of per cent, from 0 to 100, or null."""
    signed = F.regexp_replace(F.regexp_replace(comparable(s), "por ?cento", "%"), " +%", "%")
    number = F.regexp_extract(signed, "([0-9]+([.,][0-9]+)?)%", 1)
    v = F.translate(number, ",", ".").try_cast("double")
    return F.when(v.between(0, 100), v)


def euros(v: Column) -> Column:
    """1234.5 -> 1.234,50 €."""
    return F.concat(F.translate(F.format_number(v, 2), ",.", ".,"), F.lit(" €"))


def call_cost(input_: Column, output: Column, cache_write: Column, cache_read: Column, batched: Column | None = None) -> Column:
    """Dollars of a model call at fixed rates, to six places."""
    millionths = input_ * RATES["input"] + output * RATES["output"] + cache_write * RATES["cache_write"] + cache_read * RATES["cache_read"]
    if batched is not None:
        millionths = millionths * F.when(batched, BATCH_DISCOUNT).otherwise(1.0)
    return F.round(millionths) / 1_000_000
