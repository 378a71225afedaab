"""Quality rules as a bitmask ledger.

Each text is measured once; each rule is evaluated once on the measurements, and its
failure sets one bit of ``failed``.  A policy is a named, versioned set of rules: its
verdict is ``failed & mask = 0``, so changing a policy reads the ledger, never the texts.
An ablation asks how many rows only one rule of a policy drops: rows whose failed bits
under the policy are exactly that rule's bit.

Null texts are measured as empty (no words), which fails ``few_words``; repeated rows are
measured alike; ties play no part; texts of any length are measured whole, in steps of
bounded bytes; an empty table gives an empty ledger.  Only key and text are read, so other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import chunks, mapped, positional

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct"]


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of a text; words are runs of bytes other than ASCII white space."""
    data = text.encode()
    w = data.split()
    n = len(w)
    joined = b"".join(w)
    chars = len(joined.decode())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    triples = list(zip(w, w[1:], w[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        seen: set = set()
        twice = {t for t in triples if t in seen or seen.add(t)}
        last = -1
        for i, t in enumerate(triples):
            if t in twice:
                repeated += i + 3 - max(i, last)
                last = i + 3
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, len(set(w))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # a SQL condition on the measurements


#: Bit i of ``failed`` belongs to RULES[i]; new rules go at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("upper_case", "2 * n_upper > word_chars"),
    Rule("few_distinct_words", "n_distinct * n_distinct < n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
)
#: Policies by version; each names the rules it applies.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(r.name for r in RULES),
}


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[name] for name in POLICIES[policy])


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    source = docs.select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([source.schema[key], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            columns = zip(*map(measure, texts), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], [key, *MEASURES])

    return mapped(source, run, schema)


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """One bit per rule, from the measurements."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    return reduce(lambda a, b: a + b, bits).cast("long")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """*key*, MEASURES and ``failed`` (long): one row per row of *docs*."""
    return measured(docs, key, text).withColumn("failed", failed(rules))


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of *policy*: rows that fail it, rows that nothing else of the policy drops, rows kept without it.

    The ledger is first summed by its failed bits (one row per combination that occurs).
    """
    m = mask(policy, rules)
    combos = book.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    total = combos.agg(F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept"))
    one = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if m >> i & 1))).alias("r")
    per = combos.select("bits", "n", one).select("bits", "n", "r.*").groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
    )
    # one row of totals, joined with one row per rule
    return per.join(F.broadcast(total)).select("rule", "failing", "only_this", (F.coalesce("kept", F.lit(0)) + F.col("only_this")).alias("kept_without"))


def keep(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """*docs* without the rows whose failed bits meet *policy*'s mask; columns stay as they are, whatever their names."""
    plain, (column,) = positional(docs, text)
    schema = T.StructType([*plain.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, column):
            found = (pa.array(c, pa.int64()) for c in zip(*map(measure, texts), strict=True))
            yield pa.RecordBatch.from_arrays([*part.columns, *found], schema.names)

    rows = mapped(plain, run, schema).withColumn("failed", failed())
    return rows.where(passes(policy)).select(*plain.columns).toDF(*docs.columns)
