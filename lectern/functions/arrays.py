"""Folds over arrays that keep what they pass, in time that grows little faster than the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a block.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, start: int, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Array of what step(state, item) gives as `out`, where its `state`, an int, goes on to the next item; kind is the type of an `out`.

    Appending to an array copies it. So items are cut into blocks, a first pass finds the state before each block, and a
    second one folds each block from there.
    """

    def before(blocks: Column) -> Column:
        one = lambda acc, block: F.struct(F.aggregate(block, acc["state"], lambda state, x: step(state, x)["state"]).alias("state"), F.concat(acc["at"], F.array(acc["state"])).alias("at"))
        return F.aggregate(blocks, F.struct(F.lit(start).alias("state"), F.array().cast("array<int>").alias("at")), one, lambda acc: acc["at"])

    def inner(block: Column, state: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            got = step(acc["state"], x)
            return F.struct(got["state"].alias("state"), F.concat(acc["out"], F.array(got["out"].cast(kind))).alias("out"))

        return F.aggregate(block, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda acc: acc["out"])

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
    folded = lambda blocks: let(before(blocks), lambda at: F.flatten(F.transform(blocks, lambda block, i: inner(block, F.get(at, i)))))
    return let(items, lambda all_: F.when(F.size(all_) == 0, F.array().cast(f"array<{kind}>")).otherwise(let(cut(all_), folded)))
