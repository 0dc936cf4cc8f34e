"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that titles are folded to when compared.
FOLD = {"a": "àáạảãâầấậẩẫăằắặẳẵ", "e": "èéẹẻẽêềếệểễ", "i": "ìíịỉĩ", "o": "òóọỏõôồốộổỗơờớợởỡ", "u": "ùúụủũưừứựửữ", "y": "ỳýỵỷỹ", "d": "đ"}

# What is redacted, in this order: rule, pattern, replacement.
REDACTIONS = [
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED:private-key]"),
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*\z", "[REDACTED:private-key]"),
    ("private-key", r"(?s)\A.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED:private-key]"),
    ("aws-key", r"AKIA[0-9A-Z]{16}", "[REDACTED:aws-key]"),
    ("api-key", r"sk-[A-Za-z0-9_-]{20,}", "[REDACTED:api-key]"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{30,}", "[REDACTED:github-token]"),
    ("bearer", r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{20,}", "Bearer [REDACTED:bearer]"),
    ("secret", r"""(?iu)(api[_-]?key|token|secret|pass(?:word|wd|phrase)?|pwd|m[aậ]t[ _]?kh[aẩ]u)(["']?\s*[:=]\s*["']?)([^\s"'\[][^\s"']{5,})""", "$1$2[REDACTED:secret]"),
]
REDACTION_NAMES = list(dict.fromkeys(name for name, _, _ in REDACTIONS))

ELLIPSIS = "…"
CUT = " …[cut]… "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def trim_all(c: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def est_tokens(c: Column) -> Column:
    """(code points + 3) div 4."""
    return F.floor((F.length(c) + 3) / 4).cast("long")


@cache
def _accents() -> tuple[str, str]:
    """Precomposed letters whose decomposition is one base letter and marks."""
    pairs = {}
    for i in range(0xC0, 0x2000):
        full = unicodedata.normalize("NFD", chr(i))
        if len(full) > 1 and full[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in full[1:]):
            pairs[chr(i)] = full[0]
    return "".join(pairs), "".join(pairs.values())


def strip_accents(c: Column) -> Column:
    """Letters that decompose lose their marks; others (đ, ø) stay. ASCII texts
    have none, and are left alone."""
    old, new = _accents()
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(F.translate(c, old, new), r"\p{Mn}+", ""))


def fts_tokens(c: Column) -> Column:
    """Index and query tokens: folded runs of letters and numbers."""
    low = let(F.lower(c), strip_accents)
    ascii_ = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.octet_length(c) == F.length(c), ascii_).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def norm_title(c: Column) -> Column:
    """Lower case, folded, letters and decimal digits only, single spaces."""
    old = "".join(FOLD.values())
    new = "".join(k * len(v) for k, v in FOLD.items())
    return F.trim(F.regexp_replace(F.translate(F.lower(c), old, new), r"[^\p{L}\p{Nd}]+", " "))


def _rule_applies(c: Column, pattern: str) -> Column | None:
    """A cheap test that must hold before a costly rule is tried."""
    return F.contains(c, F.lit("PRIVATE KEY-----")) if "PRIVATE KEY" in pattern else None


def redact(c: Column) -> Column:
    """Secrets replaced by markers, rule by rule; doing it twice changes nothing."""
    for _, pattern, replacement in REDACTIONS:
        new, may = F.regexp_replace(c, pattern, replacement), _rule_applies(c, pattern)
        c = new if may is None else F.when(may, new).otherwise(c)
    return c


def _counted(field: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
    """One rule over a struct of the text t and the counts."""

    def step(x: Column) -> Column:
        n, may = F.regexp_count(x["t"], F.lit(pattern)), _rule_applies(x["t"], pattern)
        n = n if may is None else F.when(may, n).otherwise(0)
        return let(n, lambda k: x.withField(field, x[field] + k).withField("t", F.when(k > 0, F.regexp_replace(x["t"], pattern, replacement)).otherwise(x["t"])))

    return step


def redact_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds how often each rule struck, a column per rule name (- as _), and the
    redacted text in place of the text. Rules are applied one after another, each
    to the text that those before it left; every text is gone through once."""
    state = F.struct(F.col(text_col).alias("t"), *(F.lit(0).alias(n.replace("-", "_")) for n in REDACTION_NAMES))
    for name, pattern, replacement in REDACTIONS:
        state = let(state, _counted(name.replace("-", "_"), pattern, replacement))
    out = rows.withColumn("_r", state)
    counts = {n.replace("-", "_"): F.col("_r")[n.replace("-", "_")].cast("long") for n in REDACTION_NAMES}
    return out.withColumns({text_col: F.col("_r.t"), **counts}).drop("_r")


def slug(c: Column) -> Column:
    """File name from the first line: lower case, forbidden characters as '-',
    60 characters at most, 'note' if nothing is left."""
    line = F.regexp_replace(F.lower(F.substring_index(c, "\n", 1)), r'[ \t\r/\\:*?"<>|]', "-")
    trim = lambda x: F.regexp_replace(x, "^-+|-+$", "")
    out = trim(F.left(trim(line), F.lit(60)))
    return F.when(out == "", "note").otherwise(out)


def file_tag(path: Column) -> Column:
    """file:<name> from a path's base name, '' if the name has no letter or digit."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"\.[^.]*$", "")
    name = F.regexp_replace(F.regexp_replace(F.lower(base), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")
    return F.when(name == "", "").otherwise(F.concat(F.lit("file:"), name))


def clip(c: Column, n: int = 120) -> Column:
    """White space collapsed, n characters at most and then an ellipsis."""
    c = collapse(c)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n)), F.lit(ELLIPSIS)))


def clip_middle(c: Column, n: int = 4000) -> Column:
    """The first two thirds of n characters and the rest from the end."""
    head = n * 2 // 3
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(CUT), F.right(c, F.lit(n - head))))


def clean_user_text(c: Column) -> Column:
    """A user turn without what its client put in; a command keeps its name."""
    c = F.regexp_replace(c, r"(?s)<system-reminder>.*?</system-reminder>", "")
    tags = "local-command-stdout|local-command-stderr|command-message|command-args"
    c = F.regexp_replace(c, rf"(?s)<({tags})>.*?</({tags})>", "")
    return trim_all(F.regexp_replace(c, r"<command-name>(.*?)</command-name>", "$1"))


def embed_text(text: Column, why: Column) -> Column:
    """The text to index: with its reason, unless the text holds it."""
    return F.when((F.coalesce(why, F.lit("")) == "") | F.contains(text, why), text).otherwise(F.concat(text, F.lit("\nWhy: "), why))


def opening(c: Column, n: int = 40) -> Column:
    """The first n normalised characters; null for shorter texts."""
    norm = norm_title(c)
    return F.when(F.length(norm) >= n, F.left(norm, F.lit(n)))


def valid_date(c: Column) -> Column:
    """The text if it is a date YYYY-MM-DD, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), c)


def glob_regex(pattern: str) -> str:
    """A regular expression for a path glob: * and ? within a segment, ** over
    any number of segments."""
    import re

    parts = []
    for seg in pattern.strip("/").split("/"):
        if seg == "**":
            parts.append("(?:/[^/]+)*")
        else:
            parts.append("/" + "".join("[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in seg))
    return "^" + "".join(parts) + "/?$"
