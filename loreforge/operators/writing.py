"""The write path: from notes and extractions as they come to rows of the tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loreforge.functions.text import embed_text, file_tag, redact, trim_all
from loreforge.operators.chunking import chunk
from loreforge.operators.state import content_hash, fold_notes, upsert_notes

# The kinds of notes.
KINDS = ["note", "fact", "preference", "decision", "document", "procedure", "task_hint", "transcript", "caption"]


@dataclass(frozen=True)
class Written:
    """What writes make: all notes, the fresh ones with the text that is indexed,
    their chunks, the jobs to embed them, and the writes that were refused."""

    notes: DataFrame
    fresh: DataFrame
    chunks: DataFrame
    jobs: DataFrame
    refused: DataFrame


def write_notes(notes: DataFrame, writes: DataFrame, kinds: list[str] | None = None) -> Written:
    """Writes (space_id, kind, text, tags, project, why, at, seq) to a table of
    notes as in upsert_notes. A text that is blank, or of an unknown kind, is
    refused. A note that is there is refreshed and makes nothing more; of a fresh
    one the text, with its last reason where the text does not hold it, is
    redacted as a whole, so that no chunk holds half a secret, then chunked, and
    one job embeds it."""
    ok = (F.coalesce(trim_all(F.col("text")), F.lit("")) != "") & F.coalesce(F.col("kind").isin(*(kinds or KINDS)), F.lit(False))
    good = writes.filter(ok)
    after = upsert_notes(notes, good)
    # equal notes differ in surrounding white space only
    keyed = good.select("space_id", content_hash(F.col("space_id"), F.col("kind"), F.col("text")).alias("content_hash"), trim_all(F.col("text")).alias("text"))
    texts = keyed.groupBy("space_id", "content_hash").agg(F.min("text").alias("text"))
    fresh = fold_notes(good).select("space_id", "content_hash", "kind", "why").join(notes.select("space_id", "content_hash"), ["space_id", "content_hash"], "left_anti").join(texts, ["space_id", "content_hash"])
    fresh = fresh.select("space_id", "content_hash", "kind", redact(embed_text(F.col("text"), F.col("why"))).alias("indexed"))
    jobs = fresh.select(F.lit("embed_chunk").alias("type"), F.to_json(F.struct("content_hash")).alias("payload"))
    return Written(after, fresh, chunk(fresh, "content_hash", "indexed"), jobs, writes.filter(~F.coalesce(ok, F.lit(False))))


# The kinds that a file can be taken in as; transcripts and captions come of media alone.
INGEST_KINDS = ["document", "note", "fact", "preference", "decision", "task_hint"]


def ingest(asked: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files taken in as notes. asked: path, space_id, kind (null or '': document),
    tags, title and summary (optional), at and seq. texts: path, text and error,
    as sources.documents reads them. Returns the writes, for write_notes, with
    source, title (the file's name where none is given), summary and ref, their
    tags with that of the file's name; and what is refused (path, error): a kind
    that is not taken in, a file that is not there, cannot be read or has no
    text. A file asked for twice is written twice, which makes one note."""
    kind = F.when(F.coalesce("kind", F.lit("")) == "", "document").otherwise(F.col("kind"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    optional = lambda c: F.trim(F.col(c)) if c in asked.columns else F.lit(None).cast("string")
    rows = asked.withColumns({"kind": kind, "title": F.coalesce(F.nullif(optional("title"), F.lit("")), name), "summary": F.coalesce(optional("summary"), F.lit(""))}).join(texts.select("path", "text", F.col("error").alias("unread"), F.lit(True).alias("there")), "path", "left")
    error = F.when(~F.col("kind").isin(*INGEST_KINDS), F.concat(F.lit("kind: "), "kind")).when(F.col("there").isNull(), "no such file").when(F.col("unread").isNotNull(), F.col("unread")).when(F.coalesce(trim_all(F.col("text")), F.lit("")) == "", "empty")
    rows = rows.withColumn("error", error)
    own, given = file_tag(F.col("path")), F.coalesce("tags", F.array().cast("array<string>"))
    tags = F.when((own == "") | F.array_contains(given, own), given).otherwise(F.array_append(given, own))
    writes = rows.filter("error is null").select("space_id", "kind", "text", tags.alias("tags"), F.concat(F.lit("ingest:"), "path").alias("source"), "title", "summary", F.col("path").alias("ref"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("why"), "at", "seq")
    return writes, rows.filter("error is not null").select("path", "error")


def insert_chunks(chunks: DataFrame, new: DataFrame, key: str = "note_id") -> DataFrame:
    """Chunks after an insert that leaves what is there: per note and ordinal the
    first stays."""
    both = chunks.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    rest = [c for c in chunks.columns if c not in (key, "ordinal")]
    first = both.groupBy(key, "ordinal").agg(F.min(F.struct("_o", *rest)).alias("r"))
    return first.select(key, "ordinal", *(F.col(f"r.{c}") for c in rest)).select(*chunks.columns)


def upsert_embeddings(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (chunk_id, model, vec) after new ones: one per chunk and model, the
    new one wins; of equal new ones the greatest by value, so reruns agree."""
    best = new.groupBy("chunk_id", "model").agg(F.max("vec").alias("vec"))
    return vectors.join(best.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti").select("chunk_id", "model", "vec").unionByName(best)


def project_of(path: Column, home: str = "/root") -> Column:
    """The project of a working folder: its name; '' for the root, the home folder
    and no folder."""
    clean = F.regexp_replace(path, "/+$", "")
    return F.when((F.coalesce(clean, F.lit("")) == "") | (clean == home), "").otherwise(F.regexp_extract(clean, "([^/]+)$", 1))


def _patched(old, patch):
    """RFC 7396: objects are merged field by field, to any depth; a null takes a
    field out, and what is no object replaces what was there."""
    out = dict(old) if isinstance(old, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patched(out.get(k), v) if isinstance(v, dict) else v
    return out


def _object(text: str | None) -> dict:
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _merge_patch(old: str | None, patch: str | None) -> str:
    return json.dumps(_patched(_object(old), _object(patch)), ensure_ascii=False, separators=(",", ":"))


def merge_patch(old: Column, patch: Column) -> Column:
    """A JSON object after a merge patch. Depth has no bound, which no expression
    over columns has, hence a small function in Arrow batches. A broken or null
    side, or one that is no object, is an empty object."""
    return F.udf(_merge_patch, StringType(), useArrow=True)(old, patch)
