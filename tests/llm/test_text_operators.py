"""Operators on document texts against brute-force versions, with edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import cache

import pytest
import xxhash

from heronlake.llm import bpe, crf, decontaminate, langmodel, queries, resemblance, rules, simhash

WORD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
TEXTS = [None, "", "  \n\t ", "one", "One  two\x0bthree", "é😀 ß\x00 <|endoftext|>", "x" * 30_000, LONG, " ".join(WORD * 4), " ".join(WORD * 4), "don't we'll  \n\n 12٣½ a"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0.5) for i, t in enumerate(TEXTS)] + [(None, "null key", "en", "s", 1.0), (3, "one", "en", "s", 0.1), (3, "one", "en", "s", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, ids string, score double")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_bpe_is_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    tool = Tokenizer.from_file(path)
    rows = bpe.decode(bpe.encode(docs.select("doc_id", "text", "fp"), path), path).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        ids = tool.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == tool.decode(ids, skip_special_tokens=False)


def test_bpe_splits_every_code_point_as_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library, tool = Tokenizer.from_file(path).pre_tokenizer, bpe.BytePairCodec(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 1 << 16):
        text = "".join(f"a{c}a1{c}1!{c}! {c} " for c in map(chr, points[start : start + (1 << 16)]))
        assert tool.pieces(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)], hex(points[start])


def test_bpe_round_trip_is_encode_and_decode(docs):
    path = queries.vocabulary_path()
    both = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted(map(str, bpe.round_trip(docs, path).collect())) == sorted(map(str, both))


def test_bpe_long_pieces_and_rows_agree():
    tool = bpe.BytePairCodec(queries.vocabulary_path())
    for piece in ("the" * 20, "ab" * 31, "é" * 30, "internationalization", "a"):
        assert tool.merge_long(piece.encode()) == tool.merge_rows([piece.encode()], 64)[0]


def test_bpe_empty_table(spark, docs):
    path = queries.vocabulary_path()
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).count() == 0
    with pytest.raises(ValueError):
        bpe.decode(docs, path, out="fp")


def brute_measure(text):
    w = words(text)
    t = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(t)
    covered = {j for i, x in enumerate(t) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_measure_like_brute_force(docs):
    book = rules.ledger(docs.select("doc_id", "text")).collect()
    assert len(book) == docs.count()
    for r in book:
        if r.doc_id is not None:
            assert tuple(r)[1:6] == brute_measure(TEXTS[r.doc_id])
    assert rules.ledger(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b a b a b", "# x\n# x\n\n \nb|c", "x y z w x y"])
def test_measure(text):
    assert rules.measure(text)[:5] == brute_measure(text)


def test_rules_policies_and_ablations(docs):
    book = rules.ledger(docs)
    kept = rules.keep(docs, "v1")
    assert kept.columns == docs.columns
    assert kept.count() == book.where(rules.passes("v1")).count()
    verdicts = [r.failed & rules.mask("v1") for r in book.collect()]
    for r in rules.ablations(book, "v1").collect():
        bit = 1 << [x.name for x in rules.RULES].index(r.rule)
        assert r.failing == sum(1 for v in verdicts if v & bit)
        assert r.only_this == sum(1 for v in verdicts if v == bit)
        assert r.kept_without == sum(1 for v in verdicts if v & ~bit == 0)


def brute_print(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash_is_brute_force(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    root = components([r.fp for r in rows])
    for r in rows:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == brute_print(TEXTS[r.doc_id])
        same = [x.doc_id for x in rows if root[x.fp] == root[r.fp] and x.doc_id is not None]
        assert r.component_id == (min(same) if same else None)


@pytest.mark.parametrize("light", [2, 24])
def test_simhash_links_lose_nothing(spark, monkeypatch, light):
    import random

    monkeypatch.setattr(simhash, "LIGHT", light)
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(60)]
    prints = set(seeds)
    for s in seeds[:6]:
        for _ in range(30):
            near = s
            for _ in range(r.randrange(1, 4)):
                near ^= 1 << r.randrange(64)
            prints.add(near)
    prints |= {seeds[9] ^ (1 << r.randrange(16)) ^ (1 << r.randrange(16)) for _ in range(80)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    from heronlake.operators.graph import components as connect

    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 2 for e in edges.collect())
    got = {x.node: x.root for x in connect(edges).collect()}
    want = components(signed)
    assert all(got.get(x, x) == want[x] for x in signed)


def test_simhash_keeps_one_of_each_group(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert kept.count() == len(groups)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_row_numbers_hold_when_files_are_dealt_anew(spark, monkeypatch, tmp_path):
    """Between two steps, Spark packs the files of a table into other partitions."""
    setting = "spark.sql.files.minPartitionNum"
    turn = [0]

    def dealt(of):
        def store(df, name):
            turn[0] += 1
            spark.conf.set(setting, (1, 8)[turn[0] % 2])
            return of(df, name)

        return store

    rows = [(i, " ".join(f"{w}{i % 20}" for w in WORD)) for i in range(40)]
    item = spark.createDataFrame([(1, rows[7][1])], "item_id long, text string")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(simhash, "store", dealt(simhash.store))
    monkeypatch.setattr(decontaminate, "store", dealt(decontaminate.store))
    try:
        kept = simhash.keep_one(docs)
        for n in (1, 8):
            spark.conf.set(setting, n)
            assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
        for bound in (decontaminate.BROADCAST_WORDS, 1):
            monkeypatch.setattr(decontaminate.contamination, "__defaults__", (*decontaminate.contamination.__defaults__[:-1], bound))
            clean = decontaminate.drop_contaminated(docs, item)
            for n in (1, 8):
                spark.conf.set(setting, n)
                assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(40) if i % 20 != 7]
    finally:
        spark.conf.unset(setting)


def similar_groups(texts, links=()):
    """Texts by the least index that chains of similarity 0.8 (five-word shingles) and *links* connect."""
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    alike = [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and len(x) <= 1.25 * len(y) and len(y) <= 1.25 * len(x) and len(x & y) >= 0.8 * len(x | y)]
    for i, j in [*alike, *links]:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("light", [2, 24])
def test_similar_texts_are_linked(spark, monkeypatch, light):
    """Groups of near copies, short and long lists, nulls, repeats and a passage that all share."""
    import random

    from heronlake.operators.graph import components as connect

    monkeypatch.setattr(resemblance, "LIGHT", light)
    r = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \n", "one", "One", "a b c d", LONG, LONG + " end"]
    for size in (1, 1, 2, 5, 40):
        words_ = passage + [f"w{r.randrange(5000)}" for _ in range(200)]
        for _ in range(size):
            w = list(words_)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(60, 260)] = f"x{r.randrange(5000)}"
            texts.append(" ".join(w))
    edges = resemblance.links(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    got = {x.node: x.root for x in connect(edges).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == similar_groups(texts)
    assert resemblance.links(spark.createDataFrame([], "row long, text string")).count() == 0


@pytest.mark.parametrize("split", [1024, 3])
def test_similar_texts_are_linked_within_a_crowd(spark, monkeypatch, split):
    """300 texts of mutual similarity 0.786 or a little less, and among them 60 pairs above 0.8."""
    import random

    from heronlake.operators.graph import components as connect

    monkeypatch.setattr(resemblance, "SPLIT", split)
    r = random.Random(5)
    passage = [f"p{i}" for i in range(180)]
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join(passage + fresh(24 + i % 3)) for i in range(180)]
    for i in range(60):
        first = fresh(4 + i % 12)
        texts += [" ".join(passage + first + fresh(24 - len(first) + j)) for j in (0, i % 2)]
    r.shuffle(texts)
    want = similar_groups(texts)
    assert len(set(want)) == 240
    edges = resemblance.links(spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    got = {x.node: x.root for x in connect(edges).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want


def brute_contamination(text, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        b = split(t)
        for i in range(max(1, len(b) - 12)) if b else ():
            win = b[i : i + 13]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [400_000, 1])
def test_decontamination_is_brute_force(spark, bound):
    import random

    r = random.Random(2)
    make = lambda n: [r.choice(WORD) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([1, 2, 3, 12, 13, 14, 30, 30])] + [(100, None), (101, "!!"), (7, "Again THE same, item"), (8, "one two"), (8, "one two")]
    texts = [None, "", "one TWO", "alpha", *(" ".join(make(40)) for _ in range(15))]
    for i, n in ((3, 0), (5, 1), (6, 4), (7, 9)):
        b = items[i][1].split()
        texts.append(" ".join([*make(10), *b[n : n + 16], *make(300)]))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(2, "one TWO", 1, "x")], "doc_id long, text string, n_hit int, row string")
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), bound=bound)
    rows = found.collect()
    assert len(rows) == len(texts) + 1
    for x in rows:
        assert (x.n_words, x.n_hit, list(x["items"])) == brute_contamination(texts[x.doc_id], items), x.doc_id
    for x in decontaminate.digest(found).collect():
        n, hit, names = brute_contamination(texts[x.doc_id], items)
        assert x.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert x.contaminated == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x.contaminated for x in decontaminate.digest(found).collect())


def test_decontamination_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def brute_scores(train, texts, block):
    """n_tokens, n_known, N, base and score by definition: a filter of plain Python integers, probed level by level."""
    import numpy as np
    import xxhash

    toks = lambda t: [*(x.lower() for x in words(t)), b""]
    key = lambda w: np.array([xxhash.xxh64_intdigest(w)], np.uint64)
    counts, known = Counter(), Counter()
    pair = cache(lambda v, w: int(langmodel.pair_keys(key(v), key(w))[0]))
    one = cache(lambda w: int(key(w).view(np.int64)[0]))
    for t in train:
        before = b""
        for w in toks(t):
            known[w] += 1
            counts[one(w)] += 1
            counts[pair(before, w)] += 1
            before = w
    blocks = max(1, -(-sum(c.bit_length() for c in counts.values()) * langmodel.BITS_PER_ENTRY // block))
    spots = lambda k, at: [(k % blocks, int(p)) for p in langmodel.positions(np.array([k]), at, block)[0]]
    bits = {x for k, c in counts.items() for at in range(1, c.bit_length() + 1) for x in spots(k, at)}

    @cache
    def count(k):
        at = 0
        while all(x in bits for x in spots(k, at + 1)):
            at += 1
        return (3 * 2.0 ** (at - 1) - 1) / 2 if at else 0.0

    n, v, out = sum(known.values()), len(known), []
    for t in texts:
        score, before = 0.0, b""
        for w in toks(t):
            p = (count(one(w)) + 1) / (n + v + 1)
            score += math.log10(min(1.0, (count(pair(before, w)) + langmodel.MU * p) / (count(one(before)) + langmodel.MU)))
            before = w
        base = sum(math.log10((known[w] + 1) / (n + v + 1)) for w in toks(t))
        out.append((len(toks(t)), sum(known[w] > 0 for w in toks(t)), n, base, score))
    return out


@pytest.mark.parametrize("head, held, block", [(1 << 19, 1 << 26, 1 << 18), (3, 1 << 26, 1 << 10), (3, 0, 1 << 10)])
def test_langmodel_is_brute_force(spark, docs, head, held, block):
    """With few head words, with many small blocks, and with a filter too large to broadcast."""
    plain = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    train = plain.where("doc_id <> 4")
    model = langmodel.fit(train, head=head, broadcast_bytes=held, block=block)
    assert len(model.head.value.key) <= head and (model.bloom is None) == (held == 0)
    rows = langmodel.scores(docs, model).collect()
    assert len(rows) == docs.count()
    texts = [TEXTS[r.doc_id] if r.doc_id is not None else "null key" for r in rows]
    for r, want in zip(rows, brute_scores([r.text for r in train.collect()], texts, block), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert (r.base_score, r.score) == pytest.approx(want[3:])


def test_langmodel_without_training_rows(docs):
    rows = langmodel.scores(docs.select("doc_id", "text"), langmodel.fit(docs.limit(0))).collect()
    assert len(rows) == docs.count() and all(r.n_known == 0 for r in rows)
    assert langmodel.scores(docs.limit(0), langmodel.fit(docs.limit(0))).count() == 0


def test_classifier_learns_and_holds_out(spark):
    good = [(i, " ".join(WORD[(i * 7 + j * j) % 19] for j in range(60)) + ".\n" + " ".join(reversed(WORD)) + ".") for i in range(60)]
    bad = [(100 + i, "\n".join("BUY!! NOW$$$ " * (5 + i % 4) for _ in range(1 + i % 3))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in good + bad] + [(500, None, 9, "x"), (501, "", 9, "x"), (None, LONG, 9, "x"), (0, good[0][1], 9, "x")], "doc_id long, text string, score int, quality string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(7, None), (None, 1)], "doc_id long, quality int")
    train = labels.where("doc_id % 3 <> 1 OR doc_id IS NULL")
    model = crf.fit(docs, train)
    rows = crf.scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 500 and r.doc_id % 3 == 1]
    assert sum((r.score >= 0.5) == (r.doc_id < 100) for r in held) >= 0.95 * len(held)
    kept = crf.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in rows)
    untrained = crf.fit(docs, labels.limit(0))
    assert {r.score for r in crf.scores(docs, untrained).collect()} == {0.5}


def test_crf_marginals_are_brute_force():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    model = crf.Model(r.normal(size=crf.WIDTH) / 3, r.normal(size=(2, 2)))
    text = "Some words here.\n\nMORE $$$ words words\nend"
    f, n = crf.text_features(text)
    emit = np.array(f) @ model.weights
    total, good = 0.0, np.zeros(len(n))
    for y in itertools.product((0, 1), repeat=len(n)):
        p = math.exp(sum(e for e, k in zip(emit, y) if k) + sum(model.stay[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    assert model.score([text])[0] == pytest.approx(float((good / total) @ np.array(n) / sum(n)))


def test_held_out_rows_follow_crc32(spark):
    from heronlake.llm.common import crc_mod

    rows = spark.range(50).select("id", crc_mod("id", 7).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in rows)
