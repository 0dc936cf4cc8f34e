"""Small column helpers shared by the operators that stay in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row. A plain reference would
    be inlined into the lambdas of `body` and computed for each element."""
    return F.transform(F.array(value), body)[0]


def id_number(df: DataFrame, id_col: str) -> Column:
    """Ids that are whole numbers as they are, others as a hash of their text; null stays null."""
    c = F.col(id_col)
    return c.cast("long") if isinstance(df.schema[id_col].dataType, IntegralType) else F.when(c.isNotNull(), F.xxhash64(c.cast("string")))


def row_key(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two values k1, k2 that tell rows apart even where ids are null or repeat;
    rows that agree in id and text share them. k1 orders rows by their ids: null
    ids are 0, and ids that are no whole numbers stand in the order of a hash."""
    return F.coalesce(id_number(df, id_col), F.lit(0)).alias("k1"), F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias("k2")


#: Words that most operators count: runs of all but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def own_names(*added: str):
    """For operators that give back the columns of `docs`: these go through the
    operator as column_0, column_1 and so on, and get their names back at the
    end, so no name in a table can meet one that the operator uses inside.
    Columns with a name in `added`, those of its result, are replaced."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        form = signature(fn)

        @wraps(fn)
        def run(*args, **kwargs) -> DataFrame:
            given = form.bind(*args, **kwargs)
            given.apply_defaults()
            docs = given.arguments["docs"]
            at = {c: f"column_{i}" for i, c in enumerate(x for x in docs.columns if x not in added)}
            given.arguments["docs"] = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in at.items()))
            for p in ("id_col", "text_col"):
                if p in given.arguments:
                    given.arguments[p] = at[given.arguments[p]]
            return fn(*given.args, **given.kwargs).withColumnsRenamed({a: c for c, a in at.items()})

        return run

    return wrap
