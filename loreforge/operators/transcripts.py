"""Transcripts: JSON records to conversation lines, and what models extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import ELLIPSIS, clean_user_text, clip_middle, collapse, trim_all, valid_date

# The fields that say what a tool call is for, in this order.
TOOL_FIELDS = ["description", "command", "file_path", "pattern", "query", "url", "prompt", "skill"]
# Note kinds that an extraction may have.
EXTRACT_KINDS = ["fact", "preference", "decision", "note", "task_hint", "procedure"]

_BLOCKS = "array<struct<type:string,text:string,name:string,input:string>>"
_EXTRACTION = (
    "notes array<struct<kind:string,text:string,tags:array<string>,why:string,who:array<string>,`when`:string,as_of:string,ref:string,alternatives:array<string>,scope:string>>, "
    "tasks array<struct<title:string,next_step:string,why:string,owner:string,waiting_on:string,due:string,constraints:string>>, "
    "task_updates array<struct<id:long,status:string,next_step:string,waiting_on:string,due:string>>, relations array<struct<from:string,to:string,type:string,note_index:int>>"
)


def _tool(name: Column, given: Column) -> Column:
    summary = F.coalesce(*(F.when(trim_all(x) != "", collapse(x)) for x in (F.get_json_object(given, f"$.{k}") for k in TOOL_FIELDS)), F.lit(""))
    text = F.trim(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), summary))
    return F.when(F.length(text) <= 200, text).otherwise(F.concat(F.left(text, F.lit(200)), F.lit(ELLIPSIS)))


def condense(records: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """keys, part and line: what was said and which tools were called. Lines that
    are not JSON objects stay; records of sub-agents, meta turns, thinking and
    tool results go; each message keeps 4000 characters."""
    line = trim_all(F.col(line_col))
    field = lambda p: F.get_json_object("raw", p)
    rows = records.select(*keys, line.alias("raw")).filter("raw <> ''")
    plain = ~F.col("raw").startswith("{") | F.try_parse_json("raw").isNull()
    rows = rows.withColumns({"plain": plain, "type": field("$.type"), "content": F.coalesce(field("$.message.content"), F.when(field("$.message").startswith("{"), None).otherwise(field("$.message")))})
    rows = rows.withColumn("role", F.when(F.col("type") == "user", "User").when(F.col("type") == "assistant", "Assistant"))
    skip = (F.coalesce(field("$.isSidechain"), F.lit("")) == "true") | ((F.col("type") == "user") & (F.coalesce(field("$.isMeta"), F.lit("")) == "true"))
    said = lambda t: F.when(F.col("role") == "User", clean_user_text(t)).otherwise(trim_all(t))
    blocks = F.from_json("content", _BLOCKS)
    is_blocks = F.col("content").startswith("[{") | (F.col("content") == "[]")
    parts = F.transform(
        F.when(F.col("role").isNotNull() & is_blocks, blocks),
        lambda b: F.when(b["type"] == "text", F.struct(F.col("role").alias("r"), said(b["text"]).alias("t"))).when(b["type"] == "tool_use", F.struct(F.lit("Tool").alias("r"), _tool(b["name"], b["input"]).alias("t"))),
    )
    queued = (F.col("type") == "attachment") & (field("$.attachment.type") == "queued_command") & (field("$.attachment.origin.kind") == "human")
    one = (
        F.when(F.col("plain"), F.array(F.struct(F.lit("").alias("r"), F.col("raw").alias("t"))))
        .when(skip, None)
        .when(queued, F.array(F.struct(F.lit("User").alias("r"), clean_user_text(field("$.attachment.prompt")).alias("t"))))
        .when(F.col("role").isNotNull() & ~is_blocks, F.array(F.struct(F.col("role").alias("r"), said(F.col("content")).alias("t"))))
        .otherwise(parts)
    )
    out = rows.select(*keys, F.posexplode(one).alias("part", "x")).filter("x.t <> ''")
    text = clip_middle(F.col("x.t"))
    return out.select(*keys, "part", F.when(F.col("x.r") == "", text).otherwise(F.concat(F.col("x.r"), F.lit(": "), text)).alias("line"))


def json_slice(c: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def parse_extraction(outputs: DataFrame, text_col: str = "output") -> DataFrame:
    """Adds ex (notes, tasks, task_updates, relations) and error. Broken JSON, a
    note of an unknown kind or without text and a task without title are errors
    of the whole output; a bad due date or status is dropped alone."""
    ex = outputs.withColumn("ex", F.from_json(json_slice(F.col(text_col)), _EXTRACTION))
    kind = lambda n: F.lower(trim_all(n["kind"]))
    blank = lambda x: F.coalesce(trim_all(x), F.lit("")) == ""
    bad_kind = F.coalesce(F.exists("ex.notes", lambda n: ~F.coalesce(kind(n).isin(*EXTRACT_KINDS), F.lit(False)) | blank(n["text"])), F.lit(False))
    bad_task = F.coalesce(F.exists("ex.tasks", lambda t: blank(t["title"])), F.lit(False))
    error = F.when(F.col("ex").isNull() | F.try_parse_json(json_slice(F.col(text_col))).isNull(), "json").when(bad_kind, "note").when(bad_task, "task")
    notes = F.transform("ex.notes", lambda n: n.withField("kind", kind(n)))
    tasks = F.transform("ex.tasks", lambda t: t.withField("due", F.coalesce(valid_date(F.trim(t["due"])), F.lit(""))))
    status = lambda u: F.lower(trim_all(u["status"]))
    updates = F.transform("ex.task_updates", lambda u: u.withField("status", F.when(status(u).isin("done", "dropped"), status(u)).otherwise("")).withField("due", F.coalesce(valid_date(F.trim(u["due"])), F.lit(""))))
    fixed = F.struct(notes.alias("notes"), tasks.alias("tasks"), updates.alias("task_updates"), F.col("ex.relations").alias("relations"))
    return ex.withColumn("error", error).withColumn("ex", F.when(F.col("error").isNull(), fixed))
