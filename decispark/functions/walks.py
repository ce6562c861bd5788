"""Row generators: a consumer walks each episode in order and emits rows as it goes (table functions)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf


def walked(rows: DataFrame, by: str, order: str, start: Callable[[], Any], step: Callable[[Any, Row], tuple[Any, Iterable[tuple]]], finish: Callable[[Any], Iterable[tuple]], schema: str) -> DataFrame:
    """What a consumer emits on its walk through each group of rows, in their order.

    start() gives a group's first state; step(state, row) the next state and the rows that it emits;
    finish(state) what is left at the end. Spark brings each group's rows sorted, one at a time, so a worker
    holds one row and one state whatever the group's size. Groups without rows do not exist; ties in the
    order come in any order.
    """

    class Walk:
        def __init__(self) -> None:
            self.now = start()

        def eval(self, row: Row) -> Iterable[tuple]:
            self.now, out = step(self.now, row)
            yield from out

        def terminate(self) -> Iterable[tuple]:
            yield from finish(self.now)

    return udtf(Walk, returnType=schema)(rows.asTable().partitionBy(by).orderBy(order))
