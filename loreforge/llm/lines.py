"""Line dedup by winnowing over line hashes, in DataFrame functions only.

The lines of a text that hold a word are hashed after trimming. Of every
`min_run` consecutive hashes the leftmost least is a fingerprint, so any two
equal runs of `min_run` lines share one; a line of `long_line` words or more is
long enough to be a run, and so its own fingerprint. Fingerprints that stand at one place
only are dropped; the others carry the windows that chose them, which extend a
match to both sides. Each window is compared with the first place of its lines
in the corpus; windows that come later mark their lines, and overlapping ones
join to runs of any length, which are deleted. Only hashes and places are
shuffled, counted before the shuffle; joins keep their large side splittable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import WORD, let, own_names, row_key
from .storage import written

#: Lines of a run, and words of a line that is a run by itself.
MIN_RUN, LONG_LINE = 2, 50
_WHITE = " \t\n\x0b\x0c\r"


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(_WHITE))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _windows(lines: Column, w: int) -> Column:
    """For each w consecutive lines (hash h, long), and each long line: place and
    number of lines, fingerprint and hashes of all."""

    def runs(h: Column, n: int) -> Column:
        hash_of = lambda s: let(s, lambda s: F.struct(F.array_min(s).alias("fp"), F.array_position(s, F.array_min(s)).alias("j"), F.xxhash64(s).alias("run"), F.xxhash64(F.lit(17), s).alias("run2")))
        at = lambda i, x: F.struct(i.alias("i"), F.lit(n).alias("n"), x["fp"].alias("fp"), (i + x["j"] - 1).alias("at"), x["run"].alias("run"), x["run2"].alias("run2"))
        return F.transform(_upto(F.size(h) - (n - 1)), lambda i: let(hash_of(F.slice(h, i + 1, F.lit(n))), lambda x: at(i, x)))

    def both(x: Column) -> Column:
        all_runs = let(F.transform(x, lambda y: y["h"]), lambda h: runs(h, w))
        if w == 1:
            return all_runs
        alone = let(F.transform(x, lambda y: y["h"]), lambda h: runs(h, 1))
        return F.concat(all_runs, F.when(F.exists(x, lambda y: y["long"]), F.filter(alone, lambda r: F.get(x, r["i"])["long"])).otherwise(F.array()))

    return let(lines, both)


@own_names("n_lines", "n_removed", "kept_text")
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, long_line: int = LONG_LINE) -> DataFrame:
    """Adds to the columns of `docs`: n_lines (lines with a word), n_removed and
    kept_text. A line goes if it lies in `min_run` or more consecutive lines, or
    has `long_line` or more words, that stand, in the same order, at an earlier
    place: in a text with a lesser id, or before in the same text. Runs are
    judged on the input.

    Lines are compared without surrounding white space; lines without a word
    take no part and stay. Null ids come first as 0; ids that are no whole
    numbers have the order of a hash; texts that share an id are ordered by a
    hash of the text; rows that repeat id and text are one text and get one
    result. A null text has no lines and stays null; a text that loses all lines
    is empty. Other columns may have any names; existing n_lines, n_removed and
    kept_text are replaced. An empty table gives an empty result.
    """
    k1, k2 = row_key(docs, id_col, text_col)
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    full = F.filter(F.split(F.col(text_col), "\n"), lambda x: _trim(x) != "")
    # a line of n words has 2 n - 1 characters at least
    is_long = lambda x: F.when(F.length(x) >= 2 * long_line - 1, F.regexp_count(x, F.lit(WORD)) >= long_line).otherwise(False)
    hashes = F.transform(full, lambda x: F.struct(F.xxhash64(_trim(x)).alias("h"), is_long(x).alias("long")))
    win = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.explode(_windows(hashes, min_run)).alias("v")).select("k1", "k2", "v.*")

    # the windows of one fingerprint place travel together; they are made once, and read twice
    places = written(win.groupBy("k1", "k2", "fp", "at").agg(F.collect_set(F.struct("i", "n", "run", "run2")).alias("runs")), "op8-places")
    # counts are read from tables, so that Spark can split the rows of a hot line in the joins
    often = written(places.groupBy("fp").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("fp"), "op8-often")
    runs = places.join(often, "fp").select("k1", "k2", F.explode("runs").alias("r")).select("k1", "k2", "r.*")
    first = written(runs.groupBy("n", "run", "run2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("k1", "k2", "i")).alias("first")).filter("m > 1").drop("m"), "op8-first")
    later = runs.join(first, ["n", "run", "run2"]).filter(F.struct("k1", "k2", "i") > F.col("first"))
    marked = later.groupBy("k1", "k2").agg(F.collect_set(F.struct("i", "n")).alias("__late")).withColumnsRenamed({"k1": "__k1", "k2": "__k2"})

    out = keyed.withColumns({"__lines": F.split(F.col(text_col), "\n"), "__n": F.coalesce(F.size(full), F.lit(0))}).join(marked, ["__k1", "__k2"], "left")
    covered = F.array_distinct(F.flatten(F.transform("__late", lambda r: F.sequence(r["i"], r["i"] + r["n"] - 1))))
    # the places of lines with a word among all lines
    worded = F.filter(_upto(F.size("__lines")), lambda i: _trim(F.get("__lines", i)) != "")
    keep = F.array_except(_upto(F.size("__lines")), let(worded, lambda p: F.transform(covered, lambda j: F.get(p, j))))
    kept = F.when(F.col("__late").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n"))
    out = out.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__n")).cast("long"), "n_removed": F.when(F.col("__late").isNull(), 0).otherwise(F.size(covered)).cast("long"), "kept_text": kept})
    return out.drop("__k1", "__k2", "__lines", "__n", "__late")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), t AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM l
), n AS (
  SELECT doc_id, pos, body, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM t WHERE body <> ''
), w AS (
  SELECT a.doc_id, a.i, 2 AS m, a.body || chr(10) || b.body AS run FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.i = a.i + 1
  UNION ALL SELECT doc_id, i, 1, body FROM n WHERE len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) >= 50
), o AS (
  SELECT doc_id, i, m, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM o WHERE nth > 1
), k AS (
  SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE g.i IS NULL) AS kept, count(n.i) AS n_lines, count(g.i) AS n_removed
  FROM t LEFT JOIN n USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY t.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
