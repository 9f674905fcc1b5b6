"""Quality rules as a short-circuit cascade (operator 8).  DataFrame functions
only.

Every rule has its own helper columns and a verdict over them.  ``plan_order``
runs each rule alone on a bounded sample of the whole table, takes its running time as cost and
its share of rejected rows as selectivity, and orders the rules by rejection
per cost.  ``cascade`` chains them: the helper columns of a rule are computed
only for rows that all rules before it passed.  The verdict doesn't depend on
the order, only the work does.

Nulls have no words.  Empty texts and texts of white space fail ``too_short``.
Repeated rows are judged each on their own.  Other columns stay as they are,
whatever their names; one that has the name of a result (``kept``, a metric asked
for) is replaced.  There is no shuffle: a text is judged in its own row.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save

#: Word separators, as a Java pattern and as a set of characters.
GAP = r"[\\x20\\x09-\\x0D]+"
GAP_CHARS = r" \u0009\u000a\u000b\u000c\u000d"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Helper columns in order: name -> SQL over ``_q_text`` and earlier ones.
#: The hash of a window is 64 bits and is compared within one text only.
METRICS = {
    "words": [("_q_words", f"array_remove(split(_q_text, '{GAP}'), '')")],
    "n_words": [("_q_n", "cast(size(_q_words) as bigint)")],
    "word_chars": [("_q_chars", f"cast(length(translate(_q_text, '{GAP_CHARS}', '')) as bigint)")],
    "n_symbols": [("_q_symbols", f"cast(length(_q_text) - length(translate(_q_text, '{SYMBOLS}', '')) as bigint)")],
    "n_dup_lines": [
        ("_q_lines", r"filter(split(_q_text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        ("_q_n_lines", "cast(size(_q_lines) as bigint)"),
        ("_q_dup_lines", "_q_n_lines - size(array_distinct(_q_lines))")],
    "n_repeat_words": [
        ("_q_hashes", f"if(_q_n < {WINDOW + 1}, array(), transform(sequence(1, _q_n - {WINDOW - 1}), i -> xxhash64(slice(_q_words, i, {WINDOW}))))"),
        ("_q_sorted", "if(size(array_distinct(_q_hashes)) < size(_q_hashes), sort_array(transform(_q_hashes, (h, i) -> struct(h, i))), null)"),
        ("_q_starts", "sort_array(transform(filter(_q_sorted, (x, k) -> coalesce(x.h = get(_q_sorted, k - 1).h, false) or coalesce(x.h = get(_q_sorted, k + 1).h, false)), x -> x.i))"),
        ("_q_repeat", f"cast(coalesce(aggregate(transform(_q_starts, (p, k) -> least({WINDOW}, coalesce(get(_q_starts, k + 1) - p, {WINDOW}))), 0, (a, b) -> a + b), 0) as bigint)")],
    "n_upper": [("_q_letters", "length(regexp_replace(_q_text, '[^A-Za-z]', ''))"),
                ("_q_upper", "length(regexp_replace(_q_text, '[^A-Z]', ''))")],
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: str          #: the entry of METRICS it reads, "" for none besides the words
    fails: str          #: SQL, true where the text is rejected


#: The default rules; the first two are the base every verdict includes.
RULES = (
    Rule("too_short", "", "_q_n < 20"),
    Rule("repeated_windows", "n_repeat_words", "100 * _q_repeat > 30 * _q_n"),
    Rule("symbols", "n_symbols", "10 * _q_symbols > _q_n"),
    Rule("duplicate_lines", "n_dup_lines", "10 * _q_dup_lines > 3 * _q_n_lines"),
    Rule("word_length", "word_chars", "_q_chars < 2 * _q_n or _q_chars > 20 * _q_n"),
    Rule("capitals", "n_upper", "2 * _q_upper > _q_letters and _q_letters > 40"),
)


def _with(df: DataFrame, steps: list[tuple[str, str]], gate: str | None) -> DataFrame:
    for name, sql in steps:
        df = df.withColumn(name, F.expr(f"case when {gate} then {sql} end" if gate else sql))
    return df


def _base(docs: DataFrame, text_col: str) -> DataFrame:
    df = docs.withColumn("_q_text", F.coalesce(F.col(text_col), F.lit("")))
    return _with(df, METRICS["words"] + METRICS["n_words"], None)


def plan_order(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejection per second on ``sample_rows`` rows drawn from the
    whole table (all rows if there are fewer).  Rows are thinned where they are
    read, to twice the number wanted on average, so one task gets a bounded number
    of texts, whatever the table.  Ties keep the given order."""
    share = 2 * sample_rows / max(docs.count(), 1)
    drawn = docs.select(F.col(text_col).alias("text"), F.rand(7).alias("_at"))
    sample = save(_base(drawn.where(F.col("_at") < share).orderBy("_at").limit(sample_rows).select("text"), "text"), "rule_sample")
    found = []
    for rule in rules:
        run = _with(sample, METRICS.get(rule.needs, []), None).agg(F.expr(f"count_if({rule.fails})"))
        run.collect()  # compiles
        began = time.perf_counter()
        rejected = run.collect()[0][0]
        found.append((rejected / max(time.perf_counter() - began, 1e-3), rule))
    discard(sample)
    return [rule for _, rule in sorted(found, key=lambda x: -x[0])]


def _judge(df: DataFrame, rules, metrics: tuple[str, ...], order: list[Rule]) -> DataFrame:
    for m in metrics:
        df = _with(df, METRICS[m], None)
    df = df.withColumn("_q_failed", F.lit(False))
    for rule in order:
        if rule.needs not in metrics:
            df = _with(df, METRICS.get(rule.needs, []), "not _q_failed")
        df = df.withColumn("_q_failed", F.expr(f"_q_failed or coalesce({rule.fails}, false)"))
    return df


def cascade(docs: DataFrame, rules=RULES, text_col: str = "text", metrics: tuple[str, ...] = (),
            order: list[Rule] | None = None) -> DataFrame:
    """``docs``, the ``metrics`` (names of METRICS, computed for all rows) and
    ``kept``: no rule fails."""
    order = plan_order(docs, rules, text_col) if order is None else order
    judged = _judge(_base(_whole(docs, text_col), "_text"), rules, tuple(m for m in metrics if m != "n_words"), order)
    others = [c for c in docs.columns if c not in (*metrics, "kept")]
    return judged.select(*[F.col("_doc").getField(c).alias(c) for c in others], *[F.col(METRICS[m][-1][0]).alias(m) for m in metrics],
                         (~F.col("_q_failed")).alias("kept"))


def _whole(docs: DataFrame, text_col: str) -> DataFrame:
    """The row as one column, so that no name of it meets a helper's."""
    return docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass every rule, with the columns of ``docs``.  Observed
    as ``quality_rules``: rows read and rejected.  (Rows are counted before the
    filter, which also keeps the optimizer from moving the verdict below the
    helper columns, where it would compute each of them many times.)"""
    order = plan_order(docs, RULES, text_col)
    judged = _judge(_base(_whole(docs, text_col), "_text"), RULES, (), order).select("_doc", "_q_failed")
    counted = judged.observe("quality_rules", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_q_failed")).alias("rejected"))
    return counted.where("not _q_failed").select("_doc.*")
