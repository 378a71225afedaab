"""Fill-in-the-middle examples by an Aho-Corasick event scan.

One automaton holds the ASCII characters at which the class of a text changes (a line feed for
lines, white space for words, none for characters) and the three sentinels.  One pass over a
text gives its events; the gaps between them hold a number of units that follows from their
length alone, so the ends of units are known from the sparse events, and a cut after k units
is a look-up by rank.

A text is cut into prefix, middle and suffix after two ranks drawn from the SHA-256 of the seed
and its key, and written as prefix-suffix-middle or suffix-prefix-middle.  It stays plain if
it is empty, holds a sentinel, or isn't drawn.  :func:`restored` rebuilds the text from output
and form alone: sentinels may not overlap one another, so a plain search finds the three.

Null texts are empty and stay plain; a null key draws as the empty key; repeated rows give
repeated examples; texts of any length are scanned whole; an empty table gives an empty table.
Only key and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import chunks, mapped

#: Characters that end a line, and those that part words, by unit; every character is a unit of "char".
EVENTS = {"line": "\n", "word": "\t\n\x0b\x0c\r ", "char": ""}


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("sentinels must be three different strings")
        for a in marks:
            for b in marks:
                if (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")

    def __iter__(self):
        return iter((self.prefix, self.suffix, self.middle))


def automaton(unit: str, sentinels: Sentinels) -> ahocorasick.Automaton:
    """Class-changing characters have the value 0, sentinels the value 1."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for c in EVENTS[unit]:
        machine.add_word(c, 0)
    for s in sentinels:
        machine.add_word(s, 1)
    machine.make_automaton()
    return machine


def scan(machine: ahocorasick.Automaton, text: str) -> tuple[array, bool]:
    """Where class-changing characters stand, and whether a sentinel occurs."""
    at, found = array("q"), False
    for end, value in machine.iter(text):
        if value:
            found = True
        else:
            at.append(end)
    return at, found


def ends(unit: str, events: array, n: int) -> Sequence[int]:
    """Where each unit of a text of *n* characters ends, from its events.

    A line ends behind its line feed, the last one also at the end of the text.  Words are runs
    of white space and runs of other characters: a gap between events is one unit, and so is
    a run of events without gaps.  Characters are all gap: as many units as it is long.
    """
    if unit == "char":
        return range(1, n + 1)
    out = array("q")
    last = -1  # the event before
    for e in events:
        if unit == "line":
            out.append(e + 1)
        elif e > last + 1:
            if last >= 0:
                out.append(last + 1)
            out.append(e)
        last = e
    if unit == "word" and 0 <= last < n - 1:
        out.append(last + 1)
    if n and (not out or out[-1] < n):
        out.append(n)
    return out


def arrange(text: str, key: str, machine: ahocorasick.Automaton, unit: str, sentinels: Sentinels, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and of middle, and output."""
    events, marked = scan(machine, text)
    stops = ends(unit, events, len(text))
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(stops)
    if not text or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (stops[k - 1] if k else 0 for k in (a, b))
    p, s, m = sentinels
    if h4 % 100 < spm:
        return n, "spm", i, j - i, f"{s}{text[j:]}{p}{text[:i]}{m}{text[i:j]}"
    return n, "psm", i, j - i, f"{p}{text[:i]}{s}{text[j:]}{m}{text[i:j]}"


def examples(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", sentinels: Sentinels | None = None, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """*key*, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``: one row per row of *docs*.

    *rate* is the share of texts to transform, *spm* that of suffix-first ones among them, both in %.
    """
    marks = sentinels or Sentinels()
    if unit not in EVENTS:
        raise ValueError(f"unit must be one of {', '.join(EVENTS)}")
    source = docs.select(F.col(key), F.col(text).alias("text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("drawn"))
    schema = T.StructType([source.schema.fields[0], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(unit, marks)
        for part, texts in chunks(batches, "text"):
            found = [arrange(x, k, machine, unit, marks, seed, rate, spm) for x, k in zip(texts, part.column(2).to_pylist(), strict=True)]
            columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema.names)

    return mapped(source, run, schema)


def restored(output: str = "output", form: str = "form", sentinels: Sentinels | None = None) -> Column:
    """The text again, from output and form."""
    p, s, m = sentinels or Sentinels()
    out = F.col(output)

    def parts(first: str, second: str) -> list[Column]:
        body = F.substring(out, len(first) + 1, 2147483647)
        tail = F.split_part(body, F.lit(second), F.lit(2))
        return [F.split_part(body, F.lit(second), F.lit(1)), F.split_part(tail, F.lit(m), F.lit(1)), F.split_part(tail, F.lit(m), F.lit(2))]

    prefix, suffix, middle = parts(p, s)
    behind, before, between = parts(s, p)
    return F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(before, between, behind)).otherwise(out)
