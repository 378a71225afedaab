"""The vector index, the matcher's gates, links of posts, labels in turn, against brute force and by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.operators import matching
from heronlake.operators import vector_index as vi


@pytest.fixture(scope="module")
def cloud(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 16))
    x = np.concatenate([centres[i % 12] + 0.5 * draw.normal(size=(1, 16)) for i in range(300)] + [draw.normal(size=(100, 16))])
    x[5], x[9] = x[7], 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (None, x[1].tolist())]
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]
    return spark.createDataFrame(rows, "k long, e array<double>"), unit @ unit.T


@pytest.mark.parametrize("bounds", [{}, {"block": 50}, {"most": 3}, {"most": 1, "block": 7}])
@pytest.mark.parametrize("cut", [0.9, 0.5])
def test_near_pairs_are_all_pairs(cloud, cut, bounds):
    df, s = cloud
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= cut}
    got = vi.near_pairs(df, "k", "e", cut, **bounds).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert all(abs(r.score - s[r.a, r.b]) < 1e-9 for r in got)


def test_recall_of_a_few_cells(cloud):
    df, s = cloud
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= 0.9}
    got = {(r.a, r.b) for r in vi.near_pairs(df, "k", "e", 0.9, probes=3).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_near_takes_empty_sides(cloud):
    df, _ = cloud
    assert vi.near(df.limit(0), "k", "e", df, "k", "e", 0.5).count() == 0
    assert vi.near(df, "k", "e", df.limit(0), "k", "e", 0.5).count() == 0
    assert vi.near(df, "k", "e", df.where("k = 9"), "k", "e", 0.5).count() == 0


def test_sharing_is_a_jaccard_of_some_pair(spark):
    draw = random.Random(2)
    rows = [(g, k, draw.sample("abcdefghijklmnop", draw.randint(0, 6))) for g in range(40) for k in range(5)]
    df = spark.createDataFrame(rows, "g long, k long, w array<string>")
    for least in (0.3, 0.35, 0.5, 1.0):
        sets = {g: [set(w) for h, _, w in rows if h == g] for g in range(40)}
        want = {g for g, s in sets.items() if any(a and b and len(a & b) / len(a | b) >= least for i, a in enumerate(s) for b in s[i + 1 :])}
        assert {r.g for r in matching.sharing(df, "g", "k", "w", least).collect()} == want


SIGNAL = "tokens array<string>, quotes array<string>, numbers array<string>, theatres array<string>"


def test_emerging_groups_need_a_signal_and_one_theatre(spark):
    near = [1.0, 0.1, 0.0]
    rows = [
        (1, [1.0, 0.0, 0.0], ["a", "b"], [], [], []), (2, near, ["a", "b"], [], [], []),  # tokens
        (3, [0.0, 1.0, 0.0], ["c"], ["said"], [], []), (4, [0.0, 1.0, 0.1], ["d"], ["said"], [], []),  # a quotation
        (5, [0.0, 0.0, 1.0], ["e"], [], [], []), (6, [0.0, 0.0, 1.0], ["f"], [], [], []),  # no signal
        (7, [-1.0, 0.0, 0.0], ["g"], [], ["77"], ["east"]), (8, [-1.0, 0.0, 0.0], ["g"], [], ["77"], ["west"]),  # two theatres
        (9, [0.01, 0.0, 0.0], ["a", "b"], [], [], []),  # next to no vector
    ]
    found = matching.emerging(spark.createDataFrame(rows, f"article_id long, embedding array<double>, {SIGNAL}"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 3), (4, 3)]


BASE = {"score": 0.9, "age": 1.0, "count": 20, "trust": 1.0, "a_tokens": ["x", "y"], "b_tokens": ["x", "y"], "a_quotes": [], "b_quotes": [], "a_numbers": [], "b_numbers": [], "a_theatres": [], "b_theatres": [], "generic": []}


@pytest.mark.parametrize(
    "change, verdict",
    [
        ({}, "auto"), ({"score": 0.62}, None), ({"age": 7.1}, None), ({"a_theatres": ["iran"], "b_theatres": ["americas"]}, None), ({"a_theatres": ["iran"]}, "auto"),
        ({"age": 2.5}, "candidate"), ({"b_tokens": ["x", "a", "b", "c", "d"]}, "candidate"), ({"b_tokens": ["a", "b", "c"], "a_numbers": ["200"], "b_numbers": ["200"]}, "auto"), ({"b_tokens": ["a"], "a_quotes": ["q"], "b_quotes": ["q"]}, "auto"),
        ({"b_tokens": ["z"]}, None), ({"age": 3.0, "generic": ["x", "y"]}, None), ({"age": 3.0, "generic": ["x"]}, "candidate"),
        ({"count": 5, "age": 3.0, "b_tokens": ["x"] + list("abcdefghijkl")}, None), ({"count": 5, "age": 3.0, "generic": ["x", "y"]}, "candidate"),
        ({"score": 0.64, "age": 5.0}, None), ({"score": 0.65, "age": 5.0}, "candidate"), ({"score": 0.64, "age": 4.9}, "candidate"),
        ({"trust": 0.85}, "candidate"), ({"trust": 0.1, "score": 0.98}, "candidate"), ({"trust": 0.5, "score": 0.7, "age": 5.0}, None),
    ],
)
def test_gates_in_their_order(spark, change, verdict):
    row = BASE | change
    types = {"score": "double", "age": "double", "count": "long", "trust": "double"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {types.get(k, 'array<string>')}" for k in row))
    assert df.select(matching.judged({k: F.col(k) for k in row}, matching.Gates()).alias("v")).first().v == verdict


def test_thresholds_rise_with_age():
    g = matching.Gates()
    assert g.fresh < g.aged < g.near_freeze and g.aged_age < g.near_freeze_age <= g.reject_age and g.reject < g.auto


def test_matcher_takes_the_youngest_automatic_match(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0], 1.0, ["x"], [], [], []), (2, [0.0, 1.0], 1.0, ["x"], [], [], []), (3, None, 1.0, ["x"], [], [], []), (4, [1.0, 0.0], 1.0, ["x"], [], [], []), (5, [0.7, 0.714], 1.0, ["q"], [], [], [])],
        f"article_id long, embedding array<double>, trust double, {SIGNAL}",
    )
    groups = spark.createDataFrame(
        [(10, [1.0, 0.0], 1.5, 20, ["x"], [], [], []), (11, [1.0, 0.05], 0.5, 20, ["x"], [], [], []), (12, [1.0, 0.0], 3.0, 20, ["x"], [], [], []), (13, [0.0, 1.0], 3.0, 20, ["x"], [], [], []), (14, [0.0, 1.0], 2.5, 20, ["x"], [], [], [])],
        f"story_id long, centroid array<double>, age double, article_count long, {SIGNAL}",
    )
    rejected = spark.createDataFrame([(4, 11), (4, 10)], "article_id long, story_id long")
    reserved = spark.createDataFrame([(99, 99)], "article_id long, component long")
    got = {r.article_id: (r.decision, r.story_id, list(r.candidates)) for r in matching.matched(rows, groups, rejected, reserved, matching.Gates(generic=2.0)).collect()}
    assert got == {1: ("auto", 11, []), 2: ("candidates", None, [14, 13]), 3: ("no vector", None, []), 4: ("candidates", None, [12]), 5: ("new", None, [])}


def test_posts_link_by_address_then_centroid_then_member(spark):
    far = "https://n.example/a/9"
    posts = spark.createDataFrame(
        [(1, [0.0, 1.0], ["https://x.example/1", "http://N.example:80/a/9/?utm=1"]), (2, [1.0, 0.0], [far + "/other"]), (3, [0.0, 1.0], []), (4, [0.6, -0.8], []), (5, None, []), (6, [-1.0, 0.0], [])],
        "post long, vec array<double>, urls array<string>",
    )
    addresses = spark.createDataFrame([(far, 7)], "url string, story_id long")
    stories = spark.createDataFrame([(7, [1.0, 0.0], 1.0), (8, [0.0, 0.3], 3.0), (9, [0.3, -1.0], 1.0)], "story_id long, vec array<double>, age double")
    members = spark.createDataFrame([(7, [0.45, 0.9])] + [(9, [0.6, -0.8])] * 13, "story_id long, vec array<double>")
    got = {r.post: (r.story_id, r.way) for r in matching.linked(posts, addresses, stories, members).collect()}
    assert got == {1: (7, "url"), 2: (7, "vector"), 3: (8, "vector"), 4: (9, "vector"), 5: (None, "none"), 6: (None, "none")}
    only = stories.where("story_id = 7")
    weak = {r.post: r.way for r in matching.linked(posts.where("post = 3"), addresses, only, members).collect()}
    assert weak == {3: "rescue"}
    assert matching.linked(posts.where("post = 3"), addresses, only, members, rescue=0.95).first().way == "none"


def brute_labels(groups, stories):
    known, out = list(stories), []
    for label, _, n in sorted(groups, key=lambda g: g[1]):
        words = set(label.split())
        hit = next((t for t in known if label in t or t in label or (words and set(t.split()) and len(words & set(t.split())) / min(len(words), len(set(t.split()))) > 0.5)), None)
        if hit is None and n >= 2:
            known.append(label)
        out.append((label, "merged" if hit is not None else "new" if n >= 2 else "single", hit))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_labels_join_in_turn(spark, seed):
    draw = random.Random(seed)
    text = lambda: " ".join("".join(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(draw.randint(1, 3)))
    groups = [(x, i, draw.randint(1, 3)) for i, x in enumerate({text() for _ in range(60)})]
    stories = sorted({text() for _ in range(5)})
    found = matching.merged_labels(
        spark.createDataFrame(groups, "label string, place long, n long"), spark.createDataFrame([(i - 100, s) for i, s in enumerate(stories)], "place long, title string")
    )
    assert sorted(map(tuple, found.collect()), key=str) == brute_labels(groups, stories)


def test_best_match_by_cells_is_best_match_by_broadcast(cloud):
    from heronlake.operators import similarity

    df, _ = cloud
    rows, targets = df.where("k < 60 AND e IS NOT NULL"), df.where("k >= 60 AND k < 400").select(F.col("k").alias("t"), F.col("e").alias("v"))
    a, b = (sorted(map(tuple, similarity.best_match(rows, "k", "e", targets, "t", "v", 0.3, bound).select("k", "t", F.round("score", 9)).collect())) for bound in (10_000, 1))
    assert a == b and len(a) > 50
