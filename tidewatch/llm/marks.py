"""A bitmap of the keys of a table, which spares most rows of another a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 24


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def _place(key: list[Column], word: str, bit: str) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(*key), F.lit(BITS))
    return F.shiftright(at, 6).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias(bit)


def marked(docs: DataFrame, key: list[Column], wanted: DataFrame, wanted_key: list[Column], flag: str = "_marked") -> DataFrame:
    """``docs`` with ``flag``, a new column: whether the key of a row may be among those of ``wanted``.

    The bitmap has 2**24 bits, so it is broadcast at any size; where it is full, more rows are marked than need be.
    """
    word, bit, bits = free([*docs.columns, flag], "_word", "_bit", "_bits")
    table = wanted.select(*_place(wanted_key, word, bit)).groupBy(word).agg(F.bit_or(bit).alias(bits))
    rows = docs.select("*", *_place(key, word, bit)).join(F.broadcast(table), word, "left")
    return rows.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(F.col(bit)) != 0, F.lit(False))).drop(word, bit, bits)


def without(docs: DataFrame, key: list[Column], gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``, of the key's columns alone; only marked rows are shuffled."""
    names = docs.columns
    flag, *own = free(names, "_marked", *[f"_key{i}" for i in range(len(key))])
    rows = marked(docs, key, gone, [gone[c] for c in gone.columns], flag)
    some = rows.where(F.col(flag)).select(*names, *[k.alias(n) for k, n in zip(key, own, strict=True)])
    on = [some[n].eqNullSafe(gone[c]) for n, c in zip(own, gone.columns, strict=True)]
    return rows.where(~F.col(flag)).select(*names).unionByName(some.join(gone, on, "left_anti").select(*names))
