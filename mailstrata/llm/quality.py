"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer with a
bit per failed rule; a policy is a version name and a mask over those bits, so new policies and
ablations are bitwise work over the ledger and never read a text again.

Defined cases: a NULL or empty text has zero words, fails ``few_words`` and is rejected by every
policy that holds that rule; repeated rows are measured alike; a NULL id is carried along; further
columns are ignored by ``ledger`` and passed through by ``keep``; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstrata.llm.common import append_columns, documents, named

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_bangs", "n_upper", "n_letters", "n_bars", "n_stutters")
_DDL = ", ".join(f"{m} long" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` holds for its measurements; the bit is the place in RULES."""

    name: str
    fails: str


#: The place of a rule is its bit and never changes; new rules are added behind the last.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("bars", "10 * n_bars > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "n_letters >= 40 AND 100 * n_upper > 60 * n_letters"),
    Rule("exclamations", "n_bangs >= 5 AND 10 * n_bangs > 2 * n_words"),
    Rule("long_words", "n_words >= 10 AND word_chars > 25 * n_words"),
    Rule("short_words", "n_words >= 10 AND word_chars < 2 * n_words"),
    Rule("stutter", "n_words >= 10 AND 10 * n_stutters > 3 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-1": BASE,
    "prose-1": tuple(r.name for r in RULES),
}
CURRENT = "prose-1"


def bit(rule: str) -> int:
    return 1 << [r.name for r in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(bit(name) for name in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur at least twice, first occurrences included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k: k + n] for k in range(WINDOW))))
    if len(set(windows)) == n:
        return 0
    mark, first = bytearray(len(words)), {}
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            mark[j: j + WINDOW] = mark[i: i + WINDOW] = b"\1" * WINDOW
    return sum(mark)


_CONTINUED = bytes(range(0x80, 0xC0))


def measure(data: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text given as UTF-8."""
    data = data or b""
    words = data.split()  # bytes split at exactly the six white-space characters of a word's end
    lines = [line for line in data.split(b"\n") if line.strip()]
    points = sum(map(len, words)) - sum(len(w) - len(w.translate(None, _CONTINUED)) for w in words) \
        if not data.isascii() else sum(map(len, words))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (len(words), points, len(data) - len(data.translate(None, b"#*$%&|<>")),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), data.count(b"!"),
            upper, upper + lower, data.count(b"|"), sum(map(bytes.__eq__, words, words[1:])))


def _measurer() -> Callable[[list], list]:
    return lambda texts: list(zip(*map(measure, texts))) or [[] for _ in MEASURES]


def _bits() -> Column:
    """The failure bits from the measurement columns, by built-in expressions."""
    out = F.lit(0).cast("long")
    for rule in RULES:
        out = out.bitwiseOR(F.when(F.expr(rule.fails), F.lit(bit(rule.name))).otherwise(0).cast("long"))
    return out


def ledger(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, measurements, failed_bits): one row per document, no shuffle."""
    docs = documents(df, id_column, text_column)
    measured = append_columns(docs, F.col("text"), _measurer, _DDL)
    return measured.select("doc_id", *MEASURES, _bits().alias("failed_bits"))


def accepted(bits: Column, policy: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def ablation(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: documents, failures, rejects, and rejects that only this rule causes.

    The ledger is first counted per bit pattern (at most 2**len(RULES) rows, combined map-side); all
    else is bitwise arithmetic over those counts.
    """
    counts = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    plans = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).cast("long").alias("mask"),
                               F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("rule_bit"))
                      for p in policies for r in POLICIES[p]])
    b, m, r = F.col("failed_bits"), F.col("mask"), F.col("rule_bit")
    n = F.col("n")
    joined = counts.select("failed_bits", "n", F.inline(plans))
    zero = F.lit(0).cast("long")
    return joined.groupBy("policy", "rule").agg(
        F.sum(n).alias("documents"),
        F.sum(F.when(b.bitwiseAND(r) != 0, n).otherwise(zero)).alias("failures"),
        F.sum(F.when(b.bitwiseAND(m) != 0, n).otherwise(zero)).alias("rejected"),
        F.sum(F.when(b.bitwiseAND(m) == r, n).otherwise(zero)).alias("rejected_only_by_rule"))


def keep(df: DataFrame, policy: str = CURRENT, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` whose text the policy accepts, with the columns of ``df``."""
    row = df.select(F.struct(*[named(c) for c in df.columns]).alias("kept_row"),
                    named(text_column).alias("kept_text"))
    measured = append_columns(row, F.col("kept_text"), _measurer, _DDL)
    return measured.where(accepted(_bits(), policy)).select("kept_row.*")
