"""Quality rules as weak supervision.

Each rule looks at one property of a text and votes good (1) or bad (-1), or
abstains (0). No rule decides alone: expectation-maximisation over the votes of
all texts estimates how often each rule votes which way on good and on bad texts (its
accuracy on either), and the posterior probability that a text is good weighs its
votes by these estimates.

The counts behind the rules come from one pass over the texts. EM needs only how
often each combination of votes occurs, at most 3 ** rules rows however large
the corpus, so it sees every text and runs on the driver in no time; the
posterior is then a plain column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .columns import own_names
from .storage import written

_U = np.uint64
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_ends", "n_distinct", "n_bare")

_SYMBOL, _LETTER, _UPPER, _END, _ALNUM = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_ALNUM[48:58] = True
_ALNUM |= _LETTER
_END[list(b".!?")] = True


def _repeats(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[at] >= 2


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of FEATURES for a run of texts."""
    starts, ends, at = W.spans(buf, offs)
    n_words = np.diff(at)
    row = np.repeat(np.arange(len(n_words)), n_words)
    h = W.hashes(buf, starts, ends)
    salt = W.mix(np.arange(1, len(n_words) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))

    def within(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int32)  # a text has under 2 GB
        np.cumsum(flags, dtype=np.int32, out=total[1:])
        return np.diff(total[edges])

    inside = ~W.WHITE[buf]
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": within(inside & lead, offs), "n_symbols": within(_SYMBOL[buf], offs), "n_letters": within(_LETTER[buf], offs), "n_upper": within(_UPPER[buf], offs)}
    out["n_ends"] = within(_END[buf[ends - 1]], at)
    alnum = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_ALNUM[buf], dtype=np.int32, out=alnum[1:])
    out["n_bare"] = within(alnum[ends] == alnum[starts], at)
    key = W.mix(h + salt[row])
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    out["n_distinct"] = within(first, at)

    three = W.window_hash(h, 3, 0xC2B2AE3D27D4EB4F)
    ok = np.arange(len(three)) + 3 <= at[1:][row[: len(three)]]
    hit = np.zeros(len(three), bool)
    hit[ok] = _repeats(W.mix(three[ok] + salt[row[: len(three)][ok]]))
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[i : i + len(hit)] |= hit
    out["n_repeat_words"] = within(covered, at)

    newline = np.flatnonzero(buf == 10)
    lo = np.unique(np.r_[offs[:-1][np.diff(offs) > 0], newline + 1])
    lo = lo[lo < len(buf)]
    hi = np.r_[lo[1:], len(buf)][: len(lo)]
    ends_in_newline = buf[hi - 1] == 10 if len(hi) else np.empty(0, bool)
    hi = hi - ends_in_newline
    filled = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi = lo[filled], hi[filled]
    of = np.searchsorted(offs, lo, side="right") - 1
    key = W.mix(W.hashes(buf, lo, hi) + salt[of])
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    out["n_lines"] = np.bincount(of, minlength=len(n_words))
    out["n_dup_lines"] = np.bincount(of[again], minlength=len(n_words))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in W.chunks(W.texts_of(batch, "__text")):
            m = measure(buf, offs)
            rest = [(n, batch.column(i).slice(lo, hi - lo)) for i, n in enumerate(batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *(pa.array(m[f].astype(np.int64)) for f in FEATURES)], [*(n for n, _ in rest), *(f"__{f}" for f in FEATURES)])


def with_features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of docs and, as __<name>, the counts of FEATURES
    of every text; a null text counts as empty. n_dup_lines: lines with a word
    that equal an earlier line; n_repeat_words: words in runs of three that
    occur twice or more in the text; n_ends: words that end in . ! or ?; n_bare:
    words without letter or digit."""
    keep = docs.columns if keep is None else keep
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.select(*keep).schema]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kinds), *(f"__{f} long" for f in FEATURES)])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(_measured, schema)


#: Chances that a rule that votes votes bad or good, on bad and good texts, before any text is seen.
START = np.array([[0.35, 0.65], [0.01, 0.99]])
PSEUDO = 20.0
LEAST_RATIO = 3.0


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, good where `good` holds, and abstains else."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0)


def rules() -> list[Rule]:
    def share(x: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"__{x}"), F.col(f"__{of}")), F.lit(0.0))

    enough = F.col("__n_words") >= 20
    length = share("word_chars", "n_words")
    return [
        Rule("symbols", share("n_symbols", "n_words") > 0.2, enough & (share("n_symbols", "n_words") < 0.05)),
        Rule("repeated_words", share("n_repeat_words", "n_words") > 0.4, enough & (share("n_repeat_words", "n_words") < 0.3)),
        Rule("repeated_lines", share("n_dup_lines", "n_lines") > 0.5, (F.col("__n_lines") >= 3) & (share("n_dup_lines", "n_lines") < 0.2)),
        Rule("word_length", (length < 2.5) | (length > 14), enough & length.between(3, 10)),
        Rule("upper_case", share("n_upper", "n_letters") > 0.4, enough & (share("n_upper", "n_letters") < 0.15)),
        Rule("sentences", enough & ((share("n_ends", "n_words") < 0.005) | (share("n_ends", "n_words") > 0.5)), enough & share("n_ends", "n_words").between(0.02, 0.35)),
        Rule("vocabulary", enough & (share("n_distinct", "n_words") < 0.08), enough & (share("n_distinct", "n_words") > 0.25)),
        Rule("letters", share("n_letters", "word_chars") < 0.8, enough & (share("n_letters", "word_chars") > 0.9)),
        Rule("bare_words", share("n_bare", "n_words") > 0.15, enough & (share("n_bare", "n_words") < 0.03)),
        Rule("length", F.col("__n_words") < 20, F.col("__n_words") >= 80),
    ]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray]:
    """EM: the share of good texts, and chances[y, v, j], how often rule j, where
    it votes, votes v (0 bad, 1 good) on bad (y = 0) and good (y = 1) texts. An
    abstention counts neither way. votes: one row per combination, counts: how
    often each occurs.

    A rule that finds nothing wrong says little about other faults, so each
    class has chances of its own instead of one accuracy for both. EM starts
    from START, and its pseudo counts stay in; a rule's chance of a bad vote
    stays at LEAST_RATIO times higher on bad texts, so the classes keep their
    meaning whatever the corpus.
    """
    hot = np.stack([votes == v for v in (-1, 1)], axis=1).astype(np.float64)  # combination, vote, rule
    chances = np.repeat(START[:, :, None], votes.shape[1], axis=2)
    share, total = 0.85, counts.sum()
    pseudo = chances * np.array([PSEUDO * (1 - share), PSEUDO * share])[:, None, None]
    for _ in range(rounds):
        bad, good = (np.einsum("cvr,vr->c", hot, np.log(chances[y])) for y in (0, 1))
        p = 1 / (1 + np.exp(np.clip(bad + np.log(1 - share) - good - np.log(share), -500, 500)))
        new = np.stack([np.einsum("c,cvr->vr", w, hot) for w in ((1 - p) * counts, p * counts)]) + pseudo
        new /= new.sum(1, keepdims=True)
        low = np.maximum(new[0, 0], LEAST_RATIO * new[1, 0])
        low = np.minimum(low, 0.98)
        new[0, 1:] *= ((1 - low) / np.maximum(new[0, 1:].sum(0), 1e-9))[None]
        new[0, 0] = low
        share = float(np.clip((p @ counts + PSEUDO * 0.85) / (total + PSEUDO), 0.05, 0.99))
        moved = np.abs(new - chances).max(initial=0)
        chances = new
        if moved < 1e-8:
            break
    return share, chances


@dataclass(frozen=True)
class Model:
    """What EM found: the share of good texts and the rules' chances."""

    share: float
    chances: np.ndarray

    def posterior(self) -> Column:
        """Of being good, from the columns of with_features."""
        logit = F.lit(float(np.log(self.share / (1 - self.share))))
        for j, r in enumerate(rules()):
            bad, good = (float(x) for x in np.log(self.chances[1, :, j] / self.chances[0, :, j]))
            logit = logit + F.when(r.vote() < 0, bad).when(r.vote() > 0, good).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def fit(counted: DataFrame) -> Model:
    """Estimates the model from the votes on all rows of with_features."""
    all_rules = rules()
    names = [f"vote_{r.name}" for r in all_rules]
    # at most 3 ** len(rules) combinations
    seen = counted.select(*(r.vote().alias(n) for n, r in zip(names, all_rules, strict=True))).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    votes = np.array([r[:-1] for r in seen], np.float64).reshape(len(seen), len(names))
    return Model(*estimate(votes, np.array([r[-1] for r in seen], np.float64)))


def _base_failed() -> Column:
    return (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The id, FEATURES, each rule's vote (vote_<name>), posterior (probability
    of being good) and base_failed (n_words < 50 or 100 * n_repeat_words > 50 *
    n_words), and kept: not base_failed and posterior >= threshold.

    A null or empty text has counts of 0 and fails the base. Repeated rows each
    get their row and count each in the estimate. Other columns are ignored. An
    empty table gives an empty result.
    """
    counted = written(with_features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"]), "op1-features")
    post = fit(counted).posterior()
    out = counted.withColumns({**{f"vote_{r.name}": r.vote() for r in rules()}, "posterior": post, "base_failed": _base_failed()})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    return out.withColumnsRenamed({"id": id_col, **{f"__{f}": f for f in FEATURES}})


@own_names()
def quality_filter(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that `quality` keeps, all columns as they are, whatever
    their names. The texts
    are measured once and written with their counts, for the estimate and for the
    verdict, and never shuffled."""
    counted = written(with_features(docs, text_col), "op1-filter")
    post = fit(counted).posterior()
    return counted.filter(~_base_failed() & (post >= threshold)).select(*docs.columns)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
