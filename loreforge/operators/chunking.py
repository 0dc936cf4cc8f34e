"""Texts to chunks, and other splits whose state depends on what came before."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1000
LEAST_SECTION = 500
_MARKER = re.compile(r"⟦([^\n]*)⟧")
_PARAGRAPHS = re.compile(r"\n\s*\n", re.ASCII)
_SENTENCE_END = re.compile(r"(?<=[.!?])(?=[ \n])")


def greedy(items: list[str], most: int, glue: str) -> list[str]:
    """Items joined while they fit; an item over the bound is cut hard."""
    out, now = [], ""
    for item in items:
        joined = f"{now}{glue}{item}" if now else item
        if len(joined) <= most:
            now = joined
            continue
        if now:
            out.append(now)
        now = ""
        if len(item) <= most:
            now = item
        else:
            out += [x for i in range(0, len(item), most) if (x := item[i : i + most].strip())]
    return [*out, now] if now else out


def _paragraph(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    return greedy([s for x in _SENTENCE_END.split(text) if (s := x.strip())], most, " ")


def chunk_text(text: str | None) -> list[str]:
    """Paragraphs of up to CHUNK characters, longer ones packed by sentence. A
    paragraph that is a lone ⟦label⟧ turns sections on for the whole text: their
    paragraphs are merged up to the bound and begin with [label]."""
    paras = [p for x in _PARAGRAPHS.split(text or "") if (p := x.strip())]
    if not any(_MARKER.fullmatch(p) for p in paras):
        return [c for p in paras for c in _paragraph(p, CHUNK)]
    out, label, held = [], "", []

    def flush() -> None:
        if held:
            prefix = f"[{label}] " if label else ""
            out.extend(prefix + x for x in greedy(list(held), max(CHUNK - len(prefix), LEAST_SECTION), "\n\n"))
            held.clear()

    for p in paras:
        if m := _MARKER.fullmatch(p):
            flush()
            label = m[1]
            continue
        prefix = f"[{label}] " if label else ""
        most = max(CHUNK - len(prefix), LEAST_SECTION)
        if len(p) > most:
            flush()
            out += [prefix + x for x in _paragraph(p, most)]
        else:
            held.append(p)
    flush()
    return out


def split_rows(df: DataFrame, fn: Callable[[str | None], list[str]], id_col: str, text_col: str) -> DataFrame:
    """id, ordinal from 0 and text of what fn makes of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, x) for i, t in zip(pdf["id"], pdf["text"], strict=True) for n, x in enumerate(fn(t))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "text"])

    kind = dict(df.select(id_col).dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, ordinal int, text string").withColumnRenamed("id", id_col)


def chunk(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, ordinal, text and token_count of the chunks of each text."""
    return split_rows(df, chunk_text, id_col, text_col).withColumn("token_count", F.floor((F.length("text") + 3) / 4).cast("long"))


def all_windows(text: str | None, most: int = 40_000) -> list[str]:
    """Whole lines (up to \\n) packed into windows."""
    out, now = [], ""
    for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
        if now and len(now) + len(line) > most:
            out.append(now)
            now = ""
        now += line
    return [*out, now] if now else out


def windows(df: DataFrame, id_col: str, text_col: str, most: int = 40_000, keep: int = 8) -> DataFrame:
    """id, ordinal from 0, text and dropped: of more than `keep` windows the last
    stay, and dropped says how many went."""
    rows = split_rows(df, lambda t: all_windows(t, most), id_col, text_col)
    per = rows.groupBy(id_col).agg(F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("dropped"))
    return rows.join(per, id_col).filter("ordinal >= dropped").withColumn("ordinal", (F.col("ordinal") - F.col("dropped")).cast("int"))


def pack(lengths: list[int], most: int) -> list[int]:
    """The batch number of each line in turn; a line counts one more than its
    length, and one over the bound stands alone."""
    out, batch, held = [], 0, 0
    for n in lengths:
        if held and held + n + 1 > most:
            batch, held = batch + 1, 0
        out.append(batch)
        held += n + 1
    return out
