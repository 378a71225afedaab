"""Infilling, collocations and recurring passages against brute force, with edge rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronlake.llm import collocations, infill, passages

LONG = "\n".join(" ".join(f"w{i * j % 977}" for j in range(40)) for i in range(1500))
TEXTS = [None, "", "\n", "\n\n\n", "one", "a\nb\n", "a\r\nb\x0b\x85c d\n\ne", "say <P> here\nand", "<", "<\n<P\n>", "é😀\nß\x00\n", LONG, LONG, "  lead\n\ttail "]
SCHEMA = "doc_id long, text string, lang string, shard long, `a.b` string, owner long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", 1, "x", 2) for i, t in enumerate(TEXTS)] + [(None, "null\nkey", "en", 1, "x", 2), (3, "\n\n\n", "en", 1, "y", 3)]
    return spark.createDataFrame(rows, SCHEMA)


UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\t-\r ]+|[^\t-\r ]+", "char": r"(?s:.)"}


def infilled(key, text, unit, rate, spm):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_infilling(docs, unit, rate, spm):
    rows = infill.examples(docs, unit=unit, rate=rate, spm=spm).withColumn("again", infill.restored()).collect()
    texts = dict(enumerate(TEXTS)) | {None: "null\nkey"}
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[1:6] == infilled(r.doc_id, texts[r.doc_id], unit, rate, spm)
        assert r.again == (texts[r.doc_id] or "")
    assert {r.form for r in rows} >= {"plain"}
    assert infill.examples(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a\n\t é<P>S", max_size=40), st.sampled_from(["line", "word", "char"]))
def test_unit_ends_follow_from_sparse_events(text, unit):
    marks = infill.Sentinels()
    events, found = infill.scan(infill.automaton(unit, marks), text)
    assert found == any(m in text for m in marks)
    stops = [m.end() for m in re.finditer(UNIT[unit], text)]
    assert list(infill.ends(unit, events, len(text))) == stops


def test_overlapping_sentinels_are_refused():
    for marks in (("ab", "bc", "x"), ("a", "a", "b"), ("<P>", "P", "x"), ("", "a", "b")):
        with pytest.raises(ValueError):
            infill.Sentinels(*marks)


LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_collocations(rows, least, percent, top):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(f for p, f in c.items() if len(p) == 1)
        often = {p: f for p, f in c.items() if len(p) > 1 and f >= least}
        inside = defaultdict(int)
        for p, f in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], f)
        found = []
        for p, a in often.items():
            if 100 * inside[p] >= percent * a:
                continue
            score, _, left, right = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right, n))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right, n) in enumerate(found[:top])]
    return sorted(out)


def phrase_rows():
    draw = random.Random(3)
    words = ["a", "B", "b", "the", "The", "é", "x\x00y", "日本", "of", "zz"]
    texts = [" ".join(draw.choices(words, weights=[9, 5, 5, 9, 3, 4, 2, 2, 6, 1], k=draw.randint(0, 90))).replace("zz", draw.choice([".", "zz,", "\n", "!\t", "zz"])) for _ in range(300)]
    return [(t, draw.choice(["en", "en", None, "fr"])) for t in texts + ["the of the of a", None, "", " . ", "one\x0btwo"] + ["same words every time again"] * 40]


@pytest.mark.parametrize("limit,percent,top", [(1_000_000, 100, 2000), (50, 90, 2000), (400, 100, 7)])
def test_collocations(spark, limit, percent, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, 1, 2) for t, lang in rows], "text string, lang string, shard long, phrase long").repartition(3)
    found = collocations.collocations(docs, min_count=20, percent=percent, top=top, limit=limit).collect()
    assert sorted(map(tuple, found)) == brute_collocations(rows, 20, percent, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocation_products_pass_64_bits(spark):
    """The score's expression, on counts of a corpus of 10^13 words."""
    a, n, left, right = 10**12, 10**13, 3 * 10**12, 10**12 + 7
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(F.expr("(CAST(1000 AS DECIMAL(38,0)) * a * n) div (CAST(l AS DECIMAL(38,0)) * r)")).first()
    assert row[0] == 1000 * a * n // (left * right)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_bitmaps_shift_and_count(stream):
    stream = np.array([x - 1 for x in stream], np.int32)
    words, counts, planes = collocations.packed(stream, list("abc"))
    stream = collocations.unpacked(planes)
    assert counts.tolist() == [int((stream == i).sum()) for i in range(3)]
    pairs = collocations.pair_bitmaps(collocations.word_bitmaps(stream), 3)
    want = Counter((a, b) for a, b in zip(stream.tolist(), stream[1:].tolist(), strict=False) if a >= 0 and b >= 0)
    numbers = np.unique(pairs.owner)
    bits = collocations.Bitmaps(np.searchsorted(numbers, pairs.owner), pairs.part, pairs.bits)
    assert {(int(x) // 3, int(x) % 3): int(c) for x, c in zip(numbers, bits.counts(len(numbers)), strict=True)} == want
    grams = collocations.Grams(bits, np.column_stack([numbers // 3, numbers % 3]))
    got = Counter()
    for names, found in grams.longer(5):
        for p, c in zip(names.tolist(), found.counts(len(names)).tolist(), strict=True):
            got[tuple(p)] += c
    long = Counter(tuple(stream[i : i + k].tolist()) for k in (3, 4, 5) for i in range(len(stream) - k + 1) if (stream[i : i + k] >= 0).all())
    assert got == long
    triples = np.array(sorted(p for p in long if len(p) == 3 and p[0] != 1)).reshape(-1, 3)
    if len(triples):
        got = Counter()
        for names, found in collocations.known_only(grams, triples, 3).longer(5):
            for p, c in zip(names.tolist(), found.counts(len(names)).tolist(), strict=True):
                got[tuple(p)] += c
        assert got == Counter({p: c for p, c in long.items() if len(p) > 3 and all(p[i] != 1 for i in range(len(p) - 2))})


def brute_passages(rows, words):
    split = [(2**63 if key is None else key, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for key, text in rows]
    first = {}
    for key, w in split:
        for i in range(len(w) - words + 1):
            g = tuple(w[i : i + words])
            first[g] = min(first.get(g, key), key)
    out = []
    for (key, _), (order, w) in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - words + 1) if first[tuple(w[i : i + words])] < order for j in range(i, i + words)}
        out.append((str(key), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def passage_rows():
    draw = random.Random(5)
    some = [f"t{i}" for i in range(400)] + ["A", "a", "é", "x\x00"]
    shared = [draw.choices(some, k=draw.randint(3, 60)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [draw.choice(shared) if draw.random() < 0.4 else draw.choices(some, k=draw.randint(0, 40)) for _ in range(draw.randint(0, 6))]
        rows.append((i * 7 % 131, draw.choice([" ", "\n ", "\t"]).join(w for p in parts for w in p)))
    copy = " ".join(draw.choices(some, k=300))
    rows += [(1000 + i, copy) for i in range(40)] + [(2000 + i, f"{i} {copy} {i}") for i in range(20)]
    rows += [(3000 + i, "a " * n) for i, n in enumerate((5, 13, 14, 40, 90, 200, 77))]
    rows += [(4000, None), (4001, ""), (4002, " \n"), (None, copy), (None, copy), (5, rows[3][1]), (5, rows[3][1]), (4003, " ".join(f"w{i % 977}" for i in range(40_000)))]
    return rows


@pytest.mark.parametrize("words,shard_bytes", [(13, 4 << 20), (13, 5_000), (4, 20_000)])
def test_recurring_passages(spark, words, shard_bytes):
    rows = passage_rows()
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], "doc_id long, text string, shard long, owner string, doc long")
    found = passages.remove_repeats(docs, words=words, shard_bytes=shard_bytes).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == brute_passages(rows, words)
    assert passages.remove_repeats(docs.limit(0)).count() == 0


def test_passages_recur_beside_words_of_any_length(spark):
    """A short word's hash doesn't depend on the longer words that its shard or batch holds."""
    common = " ".join(f"w{i}" for i in range(13))
    rows = [(1, common), (2, f"{'x' * 70} {common} {'y' * 300}"), (3, f"tail {common}")]
    found = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=1).collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in found) == [(1, 13, 0, common), (2, 15, 13, f"{'x' * 70} {'y' * 300}"), (3, 14, 13, "tail")]


def test_a_shard_sends_its_counts_as_lists(spark):
    """One row for each part of the keys, however many pairs a shard holds; sums over shards are exact."""
    draw, parts, sums, tables = random.Random(5), 3, Counter(), []
    for shard in (1, 2, 7):
        keys = [draw.choice([draw.randrange(60), draw.randrange(10**17)]) for _ in range(4000)]
        sums.update(keys)
        tables.append(collocations.counted(shard, np.array(keys), np.ones(len(keys), np.int64), parts))
        assert tables[-1].num_rows == parts
        held = Counter(keys)
    everything = pa.Table.from_batches(tables)
    want = {k: f for k, f in sums.items() if f >= 50}
    found, of_seven = {}, {}
    for part in range(parts):
        rows = collocations.often(everything.filter(pc.equal(everything["part"], part)), 50)
        all_ = rows.filter(pc.equal(rows["shard"], -1)).select(["part", "keys", "numbers"]).to_batches()
        named = pa.Table.from_batches(collocations.named(all_, parts)).to_pylist()
        found |= {r["key"]: (r["number"], r["f"]) for r in named}
        keys, numbers = collocations.held(rows.filter(pc.equal(rows["shard"], 7)).to_pylist(), parts)
        of_seven |= dict(zip(keys.tolist(), numbers.tolist(), strict=True))
    assert want and {k: f for k, (_, f) in found.items()} == want
    assert len({number for number, _ in found.values()}) == len(found)
    assert of_seven == {k: number for k, (number, _) in found.items() if k in held}


def test_a_shard_sends_its_words_as_lists(spark):
    """One row for each part of the words, however many words a shard holds; sums over shards are exact, by language."""
    draw, parts, sums, tables, shards = random.Random(6), 3, Counter(), [], {}
    words = [f"é{i}" for i in range(3000)]
    for shard, lang in ((1, "en"), (2, "en"), (5, "en\nx"), (7, "en")):
        held = Counter(draw.choice([draw.choice(words[:60]), draw.choice(words)]) for _ in range(6000))
        shards[shard] = lang, list(held)
        sums.update({(lang, x): f for x, f in held.items()})
        row = pa.table({"shard": [shard], "lang": [lang], "words": [list(held)], "counts": [list(held.values())]})
        tables.append(pa.Table.from_batches(collocations.dealt(row.to_batches(), parts)))
        assert tables[-1].num_rows == parts
    everything, named, known = pa.concat_tables(tables), [], defaultdict(list)
    for part in range(parts):
        rows = collocations.often_words(everything.filter(pc.equal(everything["part"], part)), 50, parts)
        assert rows.num_rows <= 2 + len(shards)
        all_ = rows.filter(pc.equal(rows["shard"], -1)).select(["lang", "words", "numbers", "f"])
        named += pa.Table.from_batches(collocations.numbered(all_.to_batches())).to_pylist()
        for x in rows.filter(pc.greater_equal(rows["shard"], 0)).to_pylist():
            ids, numbers = np.cumsum(collocations.spread(x["ids"])), collocations.spread(x["numbers"])
            known[x["shard"]] += zip(ids.tolist(), numbers.tolist(), strict=True)
    want = {f"{lang}\n{x}": f for (lang, x), f in sums.items() if f >= 50}
    assert 50 < len(want) < 3000 and {x["phrase"]: x["f"] for x in named} == want
    number = {x["phrase"]: x["number"] for x in named}
    assert len(set(number.values())) == len(number)
    for shard, (lang, held) in shards.items():
        assert sorted(known[shard]) == [(i, number[f"{lang}\n{x}"]) for i, x in enumerate(held) if f"{lang}\n{x}" in number]


@pytest.mark.parametrize("longest", [2, 7])
def test_phrases_of_any_length(spark, longest):
    texts = ["a b c d e f g h"] * 3 + ["b c d x", "e f g h i j", "a a a a a a a a a"]
    docs = spark.createDataFrame([(t, "en\nx") for t in texts], "text string, lang string").repartition(2)
    found, _ = collocations.frequent(docs, min_count=2, longest=longest, limit=20)
    want = Counter(" ".join(w[i : i + k]) for w in map(str.split, texts) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    assert {(r.lang, r.phrase): r.f for r in found.collect()} == {("en\nx", p): f for p, f in want.items() if f >= 2}
