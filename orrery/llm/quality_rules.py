"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is one bit of
``failed_bits`` and the measurements it used stay beside it. Policies are
versioned bit masks over that ledger, so a new policy, or an ablation of an old
one, is bitwise arithmetic over the ledger and never reads a text again.

Everything here is DataFrame expressions: no Python runs on the executors, and
a ledger row depends on its own document only, so there is no shuffle.

Defined results: a null or empty text has no words (it fails ``few_words``);
repeated rows and repeated or null ids give one ledger row each; an empty table
gives an empty ledger; columns of the input whose names clash with the ledger's
are not carried into it.

A text's words, lines and windows are arrays of its row while it is measured:
about ten times its bytes, so a text of a tenth of a task's memory fits.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm import shared

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``failed`` maps the ledger's measurements to a boolean column."""

    bit: int
    name: str
    failed: Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is rejected if it fails any of ``rules``."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in self.rules)


MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule(2, "short_words", lambda m: 10 * m["word_chars"] < 15 * m["n_words"]),
    Rule(3, "long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule(4, "symbols", lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule(5, "duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"]),
)

BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (BASE, Policy("v1", (*BASE.rules, "short_words", "long_words", "symbols", "duplicate_lines")))


def measured(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keys`` and the measurements of each document's whole text.

    n_repeat_words counts the words that lie in an 8-word window found at least
    twice in the text. Windows are compared by 64-bit hashes; only a text in
    which two agree has its windows sorted.
    """
    text = F.coalesce(shared.col(text_col), F.lit(""))
    step = docs.select(
        *keys,
        F.array_remove(F.split(text, WORD_GAP), "").alias("_words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    step = step.select(
        *keys,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"),
    )
    passed = [*keys, *(m for m in MEASUREMENTS if m != "n_repeat_words")]
    step = step.select(
        *passed,
        F.when(
            F.size("_hash") > WINDOW,
            F.transform(
                F.slice("_hash", 1, F.size("_hash") - (WINDOW - 1)),
                lambda h, i: F.xxhash64(h, *(F.get("_hash", i + k) for k in range(1, WINDOW))),
            ),
        ).alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.select(
        *passed,
        F.when(
            repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ).alias("_sorted"),
    )
    twice = F.filter(
        F.transform(
            "_sorted",
            lambda x, j: F.when(
                F.coalesce(F.get("_sorted", j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get("_sorted", j + 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(twice),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
    )["n"]
    return step.select(*passed, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(
    docs: DataFrame, keys: Sequence[str] = ("doc_id",), text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``keys``, the measurements and ``failed_bits`` of each document."""
    m = {name: F.col(name) for name in MEASUREMENTS}
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.failed(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, keys, text_col).select(*keys, *MEASUREMENTS, bits.alias("failed_bits"))


def rejected(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """Whether ``failed_bits`` holds a bit of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def passing(docs: DataFrame, policy: Policy = POLICIES[-1], text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns and no others."""
    whole = shared.whole(docs, text=shared.col(text_col))
    # pushed below the ledger's projections, the filter would spell out every measurement anew; a number that the
    # optimizer can't move keeps it above them
    book = ledger(whole, ["doc"], "text").withColumn("place", F.monotonically_increasing_id())
    return shared.unwrapped(book.where(~rejected(policy) & (F.col("place") >= 0)), docs)


def verdicts(book: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with a column kept_<version> for each policy."""
    return book.withColumns({f"kept_{p.version}": ~rejected(p, rules) for p in policies})


def ablations(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of ``policy``: documents failing it, failing it alone, and kept without it.

    The ledger is first summed by its bits (at most 2^rules rows, combined
    before the shuffle), so the ablation costs one aggregation of small rows.
    """
    mask = policy.mask(rules)
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count("*").alias("n")
    )
    rows = F.explode(
        F.array(
            *(
                F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                for r in rules
                if r.name in policy.rules
            )
        )
    )
    failing = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        patterns.select("bits", "n", rows.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(failing)("failing"),
            total(F.col("bits") == F.col("r.bit"))("failing_alone"),
            total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0)("kept_without"),
        )
    )
