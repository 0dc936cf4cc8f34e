"""The library's functions by name, for queries written in SQL.

    register(spark)
    spark.sql("SELECT lf_est_tokens(text) FROM docs")

lf_est_tokens, lf_clip and lf_cosine are SQL expressions that Catalyst puts in
the place of the call. lf_norm_title and lf_fts_tokens take Arrow batches and give
what the column functions of their names give; lf_chunk_text is a table function
with a row for each chunk.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loreforge.functions.text import ELLIPSIS, FOLD, _accents

_FLAT = r"trim(regexp_replace(t, '(?U)\\s+', ' '))"
#: By name: the arguments, the type of the result and the expression.
EXPRESSIONS = {
    "lf_est_tokens": ("t STRING", "BIGINT", "CAST(floor((length(t) + 3) / 4) AS BIGINT)"),
    "lf_clip": ("t STRING, n INT", "STRING", f"CASE WHEN length({_FLAT}) <= n THEN {_FLAT} ELSE concat(left({_FLAT}, n), '{ELLIPSIS}') END"),
    "lf_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)",
    ),
}


def _titles(t: pa.Array) -> pa.Array:
    old = str.maketrans("".join(FOLD.values()), "".join(k * len(v) for k, v in FOLD.items()))
    other = regex.compile(r"[^\p{L}\p{Nd}]+")
    return pa.array([None if x is None else other.sub(" ", x.lower().translate(old)).strip(" ") for x in t.to_pylist()], pa.string())


def _tokens(t: pa.Array) -> pa.Array:
    accents = str.maketrans(*_accents())
    marks, word = regex.compile(r"\p{Mn}+"), regex.compile(r"[\p{L}\p{N}]+")

    def one(x: str) -> list[str]:
        x = x.lower()
        return word.findall(x if x.isascii() else marks.sub("", x.translate(accents)))

    return pa.array([None if x is None else one(x) for x in t.to_pylist()], pa.list_(pa.string()))


class ChunkText:
    """ordinal from 0, text and token_count of the chunks of a text; a null text has none."""

    def eval(self, text: str):
        from loreforge.operators.chunking import chunk_text

        for i, x in enumerate(chunk_text(text)):
            yield i, x, (len(x) + 3) // 4


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session; doing it again replaces them."""
    for name, (given, gives, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {gives} RETURN {body}")
    spark.udf.register("lf_norm_title", F.arrow_udf(_titles, "string"))
    spark.udf.register("lf_fts_tokens", F.arrow_udf(_tokens, "array<string>"))
    spark.udtf.register("lf_chunk_text", F.udtf(ChunkText, returnType="ordinal int, text string, token_count long", useArrow=True))
