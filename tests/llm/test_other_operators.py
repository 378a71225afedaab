"""Sharding, archives, page extraction, chat formatting and the pipeline."""

import base64
import hashlib
import io
import re
import sys
import zipfile
from collections import Counter

import pytest

from heronlake.llm import chat, html, queries, sharding, warc


# sharding ---------------------------------------------------------------
def test_lookup_table_is_full_even_and_stable():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    share = Counter(table.tolist())
    assert min(share.values()) >= 1009 // 7 and max(share.values()) <= 1009 // 7 + 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table.tolist(), fewer.tolist()) if a != 6)
    assert moved < 0.25 * 1009
    weighted = Counter(sharding.lookup_table({"a": 1, "b": 3}, 1009).tolist())
    assert abs(weighted[1] / weighted[0] - 3) < 0.1


def test_lookup_table_takes_turns():
    """Brute force: whoever's turn it is claims the first free slot of its permutation."""
    names, size = ["x", "y", "z"], 31
    order = {n: [(sharding._hash(n, "offset") % size + j * (sharding._hash(n, "skip") % (size - 1) + 1)) % size for j in range(size)] for n in names}
    table, turn = {}, 0
    while len(table) < size:
        n = names[turn % 3]
        table[next(s for s in order[n] if s not in table)] = turn % 3
        turn += 1
    assert sharding.lookup_table(names, size).tolist() == [table[i] for i in range(size)]


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), ({"a": 0}, 7), (["a"], 8)])
def test_lookup_table_refuses(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_place(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (5, "e")], "k long, v string")
    rows = sharding.place(df, "k", ["a", "b", "c"], 101).collect()
    assert len(rows) == 5 and len({r.shard for r in rows if r.k == 1}) == 1 and len({r.slot for r in rows if r.k is None}) == 1
    assert sharding.place(df.limit(0), "k", ["a"], 101).count() == 0
    with pytest.raises(ValueError):
        sharding.place(df.withColumnRenamed("v", "slot"), "k", ["a"], 101)
    odd = sharding.place(df.toDF("a.b", "_slot"), "a.b", ["a", "b", "c"], 101)
    assert odd.columns == ["a.b", "_slot", "slot", "shard"] and sorted(map(str, (tuple(r) for r in odd.collect()))) == sorted(map(str, (tuple(r) for r in rows)))
    placed = sharding.place(df, ["k", "v"], ["a", "b"], 101)
    sharding.write_shards(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 5


def test_place_is_brute_force(spark):
    """A row's slot is the XXH64 (seed 42) of its key's eight bytes modulo the size, its shard the table's."""
    import struct

    import xxhash

    names, size = [f"s{i}" for i in range(5)], 1009
    table = sharding.lookup_table(names, size)
    rows = sharding.place(spark.range(2000), "id", names, size).collect()
    for r in rows:
        h = xxhash.xxh64_intdigest(struct.pack("<q", r.id), 42)
        slot = (h - (1 << 64) if h >> 63 else h) % size
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert len(rows) == 2000


# archives ---------------------------------------------------------------
PAGES = [(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, None), (4, "http://a/é", ""), (5, "u", "é😀" * 40_000), (6, "u", "only\r\n\r\nhere"), (None, "u", "alone"), (None, "u", "same"), (7, "u", "twice"), (7, "u", "twice")]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 2)
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    path = warc.new_path(spark, "archives")
    rows = warc.read(warc.write(pages, path)).collect()
    assert len(rows) == len(PAGES)
    by = {}
    for p, _, h in PAGES:
        by.setdefault(h or "", []).append(p)
    want = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        top = max((x for x in by[h or ""] if x is not None), default=None)
        revisit = top is not None and p != top
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    for r in rows:
        assert r.record_type == "revisit" or base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest
        with zipfile.ZipFile(r.archive.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_revisits_from_a_least_size(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    rows = warc.read(warc.write(pages, warc.new_path(spark, "archives"), min_bytes=3)).collect()
    assert sorted(r.page_id for r in rows if r.record_type == "revisit") == [3]


def test_zip64_directory(monkeypatch):
    """Sizes and offsets over a (lowered) limit go to ZIP64 fields; the reader finds them there."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 40)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for i in range(5):
            z.writestr(f"m{i}", bytes([65 + i]) * (50 + i))
        z.comment = b"PK\x05\x06 not the end"
    data = out.getvalue()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    directory = warc.ZipDirectory(lambda at, n: data[at : at + n], len(data))
    for i in range(5):
        at, n = directory.place(f"m{i}")
        assert data[at : at + n] == bytes([65 + i]) * (50 + i)


def test_zip_errors():
    with pytest.raises(ValueError):
        warc.ZipDirectory(lambda at, n: b"x" * n, 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    data = out.getvalue()
    with pytest.raises(ValueError):
        warc.ZipDirectory(lambda at, n: data[at : at + n], len(data)).place("a")


# pages ------------------------------------------------------------------
def page(body, article=True):
    inner = f"<article>{body}</article>" if article else f"<div>{body}</div>"
    return f"<html><head><title>t</title><style>p{{}}</style></head><body class='has-sidebar'><nav><a>menu</a></nav><div class='x1'>Site slogan</div>{inner}<script>var a='</p><p>no';</script><footer>f</footer></body></html>"


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b  c<br>d", "a\nb c d"), (page("<h1>T</h1><p><b>one<br><p>two &lt;x&gt;</p>"), "T\none\ntwo <x>"),
        (page("<p>x</p><section class='comments'><p>c</p></section><aside>s</aside><form>f</form>"), "x"),
        (page("<header><h1>T</h1></header><p title='a>b'>x <i>y</i>z</p><!-- <p>no</p> -->"), "T\nx yz"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<div hidden>no</div></div></p>yes<script>x", "yes"),
        ("<div class='cookie-notice'>c</div><div id=ad>d</div><p>ok", "ok"), ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_extract_one_page(source, want):
    assert html.Page(source or "").text(set()) == want


def test_templates_go_and_articles_stay(spark):
    rows = [(i, "http://h.example/a", page(f"<p>story {i}</p><p>Share this page with friends</p><div>Share this story</div>" + "".join(f"<p>text {i} {j}</p>" for j in range(9)), True)) for i in range(12)]
    rows += [(20 + i, "http://g.example:80/b", page(f"<p>own {i}</p>", False)) for i in range(12)]
    rows += [(50, None, "<p>x"), (51, "http://lonely.example", None), (51, "http://lonely.example", None)]
    pages = spark.createDataFrame([(*r, 5, "x") for r in rows], "page_id long, url string, html string, n_chars int, host string")
    out = {(r.page_id, r.text) for r in html.extract(pages.drop("n_chars")).collect()}
    assert html.extract(pages).count() == len(rows)
    for i in range(12):
        assert (i, "\n".join([f"story {i}", *(f"text {i} {j}" for j in range(9))])) in out
        assert (20 + i, f"own {i}") in out
    assert {(50, "x"), (51, "")} <= out
    assert html.extract(pages.limit(0)).count() == 0


def test_what_recurs_on_few_pages_or_is_most_of_an_article_stays(spark):
    """Three unmarked pages of a host of forty share a paragraph; four marked ones are the same article."""
    rows = [(i, "http://h.example/a", page(f"<p>own {i} text</p>" + ("<p>short and shared</p>" if i < 3 else ""), False)) for i in range(36)]
    rows += [(100 + i, "http://k.example/a", page("<h1>Title</h1>" + "".join(f"<p>line {j} of it</p>" for j in range(6)))) for i in range(4)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "own 1 text\nshort and shared" and out[30] == "own 30 text"
    assert out[102] == "Title\n" + "\n".join(f"line {j} of it" for j in range(6))


def test_subtrees_are_counted_per_host(spark):
    """Templates by definition: for each host, on how many pages each subtree's hash occurs."""
    rows = [(i, f"http://h{i % 3}.example/{i}", page(f"<p>own {i}</p><div>often</div>" + ("<div>some</div>" if i % 9 < 3 else ""), i % 2 == 0)) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: (set(r.template), set(r.weak)) for r in html.templates(pages).collect()}
    for h in range(3):
        sources = [x for i, _, x in rows if i % 3 == h]
        read = [html.Page(x) for x in sources]
        seen = Counter(k for x in read for k in {*x.hashes(), *x.slots()} - {0})
        often = {k: n for k, n in seen.items() if n >= html.MIN_PAGES and n >= html.SHARE * len(sources)}
        strong = {k for k, n in often.items() if n >= html.STRONG * len(sources)}
        assert got[f"h{h}.example"] == (strong, set(often) - strong)
    sent = {(r.page_id, r.text) for r in html.extract(pages).collect()}
    assert sent == {(r.page_id, r.text) for r in html.extract(pages, bound=0).collect()}


def plain_article(source):
    """The text between the article's tags by patterns alone."""
    import html as entities

    body = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)\b[^>]*>", body)
    return "\n".join(filter(None, (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)))


def test_counts_alone_find_the_article(spark):
    """A site whose pages mark nothing: menus, adverts and footers go by their slots; without counts they stay."""
    site = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url LIKE '%//blog.tionsh.example.com/%'")
    rows = [(r.page_id, r.url, r.html) for r in site.collect()]
    assert len(rows) > 100
    want = {i: plain_article(x) for i, _, x in rows}
    whole = {r.page_id: r.text for r in html.extract(site).collect()}
    assert whole == want
    unmarked = [(i, u, re.sub(r"<(/?)(?:article|nav|footer)", r"<\1div", x).replace(' class="ad"', "")) for i, u, x in rows]
    bare = spark.createDataFrame(unmarked, "page_id long, url string, html string")
    for bound in (1_000_000, 0):
        got = {r.page_id: r.text for r in html.extract(bare, bound=bound).collect()}
        assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    alone = {r.page_id: r.text for r in html.extract(bare.where("page_id % 40 = 0"), min_pages=1000).collect()}
    assert not any(text == want[i] for i, text in alone.items())


def test_names_decide_on_small_hosts_and_inside_articles(spark):
    box = "<aside>box {0}</aside><div class='comments'>said {0}</div>"
    rows = [(i, "http://few.example/", page(f"<p>own {i} a b c</p>{box.format(i)}", False)) for i in range(4)]
    rows += [(10 + i, "http://many.example/", page(f"<p>own {i} a b c d e f g</p>{box.format(i)}")) for i in range(12)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"own {i} a b c" for i in range(4)} | {10 + i: f"own {i} a b c d e f g" for i in range(12)}


@pytest.mark.parametrize("source", ["<a " * 200_000, "<div>" * 60_000 + "</b>" * 60_000, "<main>" + "<article>x" * 40_000, "<a '" * 100_000 + ">", "<a x='>" * 80_000 + '"', "<script>" + "</script " * 80_000, "<p><span>" + "<span>" * 50_000 + "<div>" * 50_000])
def test_odd_pages_are_read_in_linear_time(source):
    import time

    began = time.process_time()
    html.Page(source).text(set())
    assert time.process_time() - began < 20


def test_counts_that_leave_with_the_last_chunk(spark):
    """A task's counts leave when they are many; if that is at its last page, what is left is an empty batch of the same types."""
    many = "".join(f"<div>w{i}</div>" for i in range(201_000))
    pages = spark.createDataFrame([(1, "http://a.b/c", f"<body>{many}</body>")], "page_id long, url string, html string").coalesce(1)
    assert html.extract(pages).select("n_chars").first().n_chars == sum(len(f"w{i}") + 1 for i in range(201_000)) - 1


# chat -------------------------------------------------------------------
def test_chat_expansion_reads_back(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 2, "user", "tail"), (2, 0, "system", "a\\<\\|<|"), (2, 1, "assistant", "é😀\\"), (3, None, None, None), (4, 0, "we\\ird\nrole\\", "x" * 50_000), (4, 0, "assistant", ""), (None, 0, "assistant", "n"), (5, 1, "assistant", "r"), (5, 1, "assistant", "r")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, example int, formatted string")
    made = chat.examples(table)
    for r in made.where("loss_length > 0").collect():
        assert r.formatted[r.loss_start + r.loss_length :] == chat.END + "\n"
        assert r.formatted[: r.loss_start].endswith(chat.START + "assistant\n")
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    convs = {r[0] for r in rows}
    assert set(got) == convs
    for c in convs:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digest(chat.examples(table.limit(0))).count() == 0


def test_chat_has_no_python(spark):
    plan = queries.op8_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# pipeline ---------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline
    from heronlake.llm import bpe, crf, decontaminate, rules, simhash
    from heronlake.llm.common import table

    sf = "/root/testdata/sf0.001"
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.classify, corpus_pipeline.apply_rules, corpus_pipeline.deduplicate, corpus_pipeline.decontaminated, corpus_pipeline.tokenize]
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = table(spark, sf, "documents")
    model = queries.quality_model(docs, table(spark, sf, "labels"))
    from test_text_operators import brute_contamination, brute_print, components, similar_groups

    left = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    left = {i: t for i, t in left.items() if model.score([t])[0] >= 0.5}
    book = {r.doc_id: r.failed for r in rules.ledger(docs).collect()}
    left = {i: t for i, t in left.items() if not book[i] & rules.mask("v1")}
    prints = {i: brute_print(t) for i, t in left.items()}
    root, order = components(list(prints.values())), sorted(left)
    first: dict = {}
    linked = [(first.setdefault(root[prints[i]], at), at) for at, i in enumerate(order)]
    groups = similar_groups([left[i] for i in order], linked)
    left = {i: left[i] for at, i in enumerate(order) if groups[at] == at}
    bad = {i for i, t in left.items() for n, hit, _ in [brute_contamination(t, items)] if hit and 20 * hit >= n}
    assert {r.doc_id for r in rows} == set(left) - bad
    tool = bpe.codec(queries.vocabulary_path())
    for r in rows:
        assert tool.decode(r.ids) == left[r.doc_id]
    assert crf and decontaminate and simhash


def test_pipeline_stages_take_any_rows(spark):
    """Nulls in any column, repeated rows, empty texts and tables, other columns with the operators' names."""
    import corpus_pipeline

    long = " ".join(f"word{i % 300}" for i in range(400)) + "."
    texts = [None, "", " ", long, long, long + " end", "one two", "x" * 200_000]
    rows = [(i if i != 2 else None, t, None if i % 2 else "en", "row", i, "n", 1.0, "x", None, "c") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, size long, n_words string, score double, `a.b` string, _heron_measures string, c1 string")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        kept = out.collect()
        if name != "BPE encoding":
            assert out.columns == docs.columns
            assert {str(r) for r in kept} <= {str(r) for r in docs.collect()}
        else:
            assert len(kept) == docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = corpus_pipeline.deduplicate(spark, docs, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 0), (False, 3), (False, 6), (False, 7)]


def test_subpackage_is_optional():
    """Nothing outside imports the subpackage."""
    from pathlib import Path

    root = Path(__file__).parents[2]
    for f in [*root.glob("heronlake/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in f.relative_to(root).parts and f.exists():
            assert not re.search(r"heronlake\.llm|corpus_pipeline", f.read_text()), f
    assert sys.modules
