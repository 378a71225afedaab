"""The homepage's slots, filled in a fixed order from a bounded list, and its cards of opposed words.

The lists have at most sixty rows (the product's own limit), so what is left of each slot is a
small table; slots are chosen by the number of the first rule a story passes, then its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.plans.ranking import CLUSTER_SQL, TREND_ORDER, eligible, trend_order
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables, now
from heronlake.sources.storage import store

#: Ages in hours up to which a story may stand in a slot, and shares that make it one-sided.
HERO, BLIND, DISPUTE, BRIEFING, POPULAR, DROUGHT = 72, 7 * 24, 14 * 24, 14 * 24, 14 * 24, 26 * 24
MAJOR, MINOR, MAJOR_LOOSE, MINOR_LOOSE = 80, 20, 70, 30
#: What a side's summary says when the side is silent.
META = (
    "^پوشش\\s+(برون‌مرزی|درون‌مرزی)", "روایت[^.]{0,40}(متمایز|شکل\\s+نگرفت|غایب)", "هیچ\\s+رسانه", "در\\s+این\\s+(خبر|مجموعه)[^.]{0,20}حضور\\s+ندارن",
    "رسانه[^.]{0,50}حضور\\s+ندار", "حضور[ی]?\\s+ندار", "پوششی[^.]{0,30}ندار", "زیرگروه[^.]{0,40}(ندار|نیست|غایب)",
)

#: Rules of each slot, in their order: SQL over the stories' columns, and what orders the stories that pass one.
RULES = {
    "blind state": ([f"blindspot AND image AND {x} AND diaspora_pct <= {MINOR_LOOSE} AND state_pct >= {MAJOR_LOOSE}" for x in ("update", "true")] + [f"blindspot AND diaspora_pct <= {MINOR_LOOSE} AND state_pct >= {MAJOR_LOOSE}", f"NOT blindspot AND state_pct >= {MAJOR} AND diaspora_pct <= {MINOR}"], BLIND, "CASE WHEN blindspot THEN 0 ELSE diaspora_pct - state_pct END"),
    "blind diaspora": ([f"blindspot AND image AND {x} AND state_pct <= {MINOR_LOOSE} AND diaspora_pct >= {MAJOR_LOOSE}" for x in ("update", "true")] + [f"blindspot AND state_pct <= {MINOR_LOOSE} AND diaspora_pct >= {MAJOR_LOOSE}", f"NOT blindspot AND diaspora_pct >= {MAJOR} AND state_pct <= {MINOR}"], BLIND, "CASE WHEN blindspot THEN 0 ELSE state_pct - diaspora_pct END"),
    "hero": (
        [f"told AND age < {HERO} AND priority > 0", f"told AND age < {HERO} AND update AND both_sides", f"told AND age < {HERO} AND both_sides", f"told AND age < {HERO}", f"told AND age < {BRIEFING}", f"age < {HERO} AND update AND both_sides",
         f"age < {HERO} AND both_sides", f"age < {BRIEFING} AND both_sides", f"age < {HERO}", f"age < {BRIEFING}", f"told AND age < {DROUGHT} AND both_sides", f"told AND age < {DROUGHT}", f"age < {DROUGHT}"], 1 << 30, "pos"),
}


def rule_number(rules: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(rules)) + " END"


SHOWN_SQL = CLUSTER_SQL + f"""
, said AS (SELECT cluster_no AS cluster_id, min_by(substr(body, 1, 90), article_id) FILTER (n % 4 = 0) AS state_summary, min_by(substr(body, 1, 90), article_id) FILTER (n % 4 = 1) AS diaspora_summary, min_by(substr(body, 1, 60), article_id) AS summary, min_by(title, article_id) FILTER (n % 4 = 0) AS cons, min_by(title, article_id) FILTER (n % 4 = 1) AS opp, min_by(title, article_id) AS lead, min_by(language, article_id) AS lang, max(ingested_at) >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AS update
   FROM (SELECT *, CAST(substr(source_id, 4) AS INT) AS n FROM v_articles) GROUP BY cluster_no)
, pool AS (SELECT *, row_number() OVER (PARTITION BY blindspot ORDER BY {TREND_ORDER}) AS pos FROM eligible WHERE article_count >= 3 AND trending > 0.05 QUALIFY pos <= 60)
, shown AS (SELECT cluster_id, blindspot, pos, priority, article_count, trending, NOT is_edited AS image, update, date_diff('second', last_updated_at, TIMESTAMP '2024-01-31') / 3600.0::DOUBLE AS age, 100 * state_count // greatest(state_count + diaspora_count, 1) AS state_pct, 100 * diaspora_count // greatest(state_count + diaspora_count, 1) AS diaspora_pct,
   state_summary, diaspora_summary, summary, CASE WHEN lang = 'en' THEN cons END AS cons, CASE WHEN lang = 'en' THEN opp END AS opp, '«' || array_to_string(string_split(lead, ' ')[1:6], '» «') || '»' AS bias FROM pool JOIN said USING (cluster_id))
, s AS (SELECT *, state_pct >= 5 AND diaspora_pct >= 5 AS both_sides, (state_summary IS NOT NULL OR diaspora_summary IS NOT NULL) AS told, coalesce(length(trim(state_summary)) >= 60 AND length(trim(diaspora_summary)) >= 60 AND NOT ({' OR '.join(f"regexp_matches(state_summary, '{p}') OR regexp_matches(diaspora_summary, '{p}')" for p in META)}), false) AS two_told,
   (coalesce(cons, '') <> '' AND coalesce(opp, '') <> '') OR len(regexp_extract_all(bias, '«[^»]+»')) >= 2 AS worded, CASE WHEN state_summary IS NOT NULL AND diaspora_summary IS NOT NULL THEN 2 ELSE 1 END AS rich FROM shown)
"""


def shown(t: Tables) -> DataFrame:
    """The listed stories, sixty one-sided ones and sixty others at most, with what the slots ask of them."""
    n = F.substring("source_id", 4, 10).cast("int") % 4
    pool = eligible(t).where("article_count >= 3 AND trending > 0.05")
    # each list is a top-k of its own, not a window over all stories
    lists = [pool.where(w).orderBy(*trend_order()).limit(60).withColumn("pos", F.row_number().over(Window.partitionBy("blindspot").orderBy(*trend_order()))) for w in ("blindspot", "NOT blindspot")]
    pool = store(lists[0].unionByName(lists[1]), "listed")
    a = t.articles.join(pool.select(F.col("cluster_id").alias("cluster_no")), "cluster_no", "left_semi").select("cluster_no", "article_id", "title", "body", "language", "ingested_at", n.alias("n"))
    first = lambda c, side: F.min_by(c, F.when(F.col("n") == side, F.col("article_id")))
    said = a.groupBy(F.col("cluster_no").alias("cluster_id")).agg(
        first(F.substring("body", 1, 90), 0).alias("state_summary"), first(F.substring("body", 1, 90), 1).alias("diaspora_summary"), F.min_by(F.substring("body", 1, 60), "article_id").alias("summary"), first("title", 0).alias("cons"), first("title", 1).alias("opp"),
        F.min_by("title", "article_id").alias("lead"), F.min_by("language", "article_id").alias("lang"), F.max("ingested_at").alias("last"),
    )
    both = F.greatest(F.col("state_count") + F.col("diaspora_count"), F.lit(1))
    s = pool.join(said, "cluster_id").select(
        "cluster_id", "blindspot", "pos", "priority", "article_count", "trending", (~F.col("is_edited")).alias("image"), (F.timestamp_diff("SECOND", "last", now()) <= 86400).alias("update"), (F.timestamp_diff("SECOND", "last_updated_at", now()) / 3600).alias("age"),
        F.floor(100 * F.col("state_count") / both).alias("state_pct"), F.floor(100 * F.col("diaspora_count") / both).alias("diaspora_pct"), "state_summary", "diaspora_summary", "summary", F.when(F.col("lang") == "en", F.col("cons")).alias("cons"), F.when(F.col("lang") == "en", F.col("opp")).alias("opp"),
        F.concat(F.lit("«"), F.array_join(F.slice(F.split("lead", " "), 1, 6), "» «"), F.lit("»")).alias("bias"),
    )
    silent = reduce(lambda x, y: x | y, (F.col(c).rlike(p) for p in META for c in ("state_summary", "diaspora_summary")))
    two = F.coalesce((F.length(F.trim("state_summary")) >= 60) & (F.length(F.trim("diaspora_summary")) >= 60) & ~silent, F.lit(False))
    worded = ((F.coalesce("cons", F.lit("")) != "") & (F.coalesce("opp", F.lit("")) != "")) | (F.regexp_count("bias", F.lit("«[^»]+»")) >= 2)
    told = F.col("state_summary").isNotNull() | F.col("diaspora_summary").isNotNull()
    return store(s.withColumns({"both_sides": F.expr("state_pct >= 5 AND diaspora_pct >= 5"), "told": told, "two_told": two, "worded": worded, "rich": F.when(F.col("state_summary").isNotNull() & F.col("diaspora_summary").isNotNull(), 2).otherwise(1)}), "shown")


GATE = "state_pct > 0 AND diaspora_pct > 0 AND NOT blindspot AND two_told AND worded"
SPREAD = ["abs(state_pct - diaspora_pct) DESC", "pos"]
BRIEF = ["rich DESC", "pos"]
SCORE = ["trending + greatest(0, 1 - age / 72) * 10 + article_count * 0.5 DESC", "pos"]


def pool_sql(name: str, used: list[str], gate: str, ages: list[str], order: list[str], most: int, enough: int = 3) -> str:
    """A slot of several stories: of the first age limit that leaves *enough*, else the last one's."""
    free = " AND ".join(["true", *(f"cluster_id NOT IN (SELECT cluster_id FROM {u})" for u in used)])
    step = " ".join(f"WHEN (SELECT count(*) FROM s WHERE {free} AND {gate} AND {a}) >= {enough} THEN {a}" for a in ages[:-1])
    limit = f"CASE {step} ELSE {ages[-1]} END" if step else ages[-1]
    return f"\n, {name} AS (SELECT cluster_id, row_number() OVER (ORDER BY {', '.join(order)}) AS place FROM s WHERE {free} AND {gate} AND {limit} QUALIFY place <= {most})"


SLOT_SQL = SHOWN_SQL
for _name, (_rules, _age, _order) in RULES.items():
    _used = "" if _name != "hero" else " AND NOT blindspot"
    SLOT_SQL += f"\n, {_name.replace(' ', '_')} AS (SELECT cluster_id, 1 AS place FROM (SELECT *, {rule_number(_rules)} AS rule FROM s WHERE age < {_age}{_used}) WHERE rule IS NOT NULL ORDER BY rule, {_order}, pos LIMIT 1)"
_blind = ["blind_state", "blind_diaspora"]
SLOT_SQL += pool_sql("battle", [*_blind, "hero"], GATE, [f"age < {DISPUTE}", f"age < {DROUGHT}"], SPREAD, 4)
SLOT_SQL += pool_sql("briefing", [*_blind, "hero", "battle"], "NOT blindspot", [f"age < {BRIEFING}", f"age < {DROUGHT}"], BRIEF, 3)
SLOT_SQL += pool_sql("popular", [*_blind, "hero", "battle", "briefing"], "NOT blindspot", [f"age < {POPULAR}", f"age < {DROUGHT}", "true"], SCORE, 3)


def single(s: DataFrame, slot: str) -> DataFrame:
    rules, age, order = RULES[slot]
    rows = s.where(f"age < {age}") if slot != "hero" else s.where("NOT blindspot")
    found = rows.withColumn("rule", F.expr(rule_number(rules))).where("rule IS NOT NULL")
    return found.orderBy("rule", F.expr(order), "pos").limit(1).select(F.lit(slot).alias("slot"), F.lit(1).alias("place"), "cluster_id")


def several(s: DataFrame, slot: str, used: DataFrame, gate: str, ages: list[str], order: list[str], most: int, enough: int = 3) -> DataFrame:
    """The stories of the first of *ages* that leaves *enough* of them, else of the last one."""
    free = s.where(gate).join(used.select("cluster_id"), "cluster_id", "left_anti")
    counts = free.agg(*(F.count_if(F.expr(a)).alias(f"n{i}") for i, a in enumerate(ages)))
    chosen: Column = F.lit(len(ages) - 1)
    for i in reversed(range(len(ages) - 1)):
        chosen = F.when(F.col(f"n{i}") >= enough, i).otherwise(chosen)
    fits = F.lit(False)
    for i, a in enumerate(ages):
        fits = fits | ((F.col("chosen") == i) & F.expr(a))
    # one row of counts
    rows = free.join(F.broadcast(counts.select(chosen.alias("chosen")))).where(fits)
    by = [F.expr(x.removesuffix(" DESC")).desc() if x.endswith(" DESC") else F.col(x) for x in order]
    # at most sixty rows
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by))).where(F.col("place") <= most).select(F.lit(slot).alias("slot"), "place", "cluster_id")


def slots(s: DataFrame) -> DataFrame:
    out = store(single(s, "blind state").unionByName(single(s, "blind diaspora")).unionByName(single(s, "hero")), "slots")
    for slot, gate, ages, order, most in (
        ("battle", GATE, [f"age < {DISPUTE}", f"age < {DROUGHT}"], SPREAD, 4), ("briefing", "NOT blindspot", [f"age < {BRIEFING}", f"age < {DROUGHT}"], BRIEF, 3), ("popular", "NOT blindspot", [f"age < {POPULAR}", f"age < {DROUGHT}", "true"], SCORE, 3),
    ):
        out = store(out.unionByName(several(s, slot, out, gate, ages, order, most)), "slots")
    return out


@query("L12", SLOT_SQL + "".join(f"{' UNION ALL ' if i else ''}SELECT '{x.replace('_', ' ')}' AS slot, place, cluster_id FROM {x}" for i, x in enumerate(["blind_state", "blind_diaspora", "hero", "battle", "briefing", "popular"])))
def homepage_cascade(t: Tables) -> DataFrame:
    """Every slot of the homepage with its stories: each slot by the first of its rules that a story passes, no story twice after the one-sided ones."""
    return slots(shown(t)).select("slot", "place", "cluster_id")


def word_list(words: Column, most: int = 6) -> Column:
    """Different words of three letters or more without quotation marks, the shortest first (equal ones as they came)."""
    plain = F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(F.regexp_replace(w, "[«»]", ""))), lambda w: F.length(w) >= 3))
    placed = F.transform(plain, lambda w, i: F.struct(F.length(w).alias("n"), i.alias("i"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(placed), lambda x: x["w"]), 1, most)


def unused_first(words: Column, used: Column) -> Column:
    """Words that no card before has led with, then the others."""
    return F.concat(F.filter(words, lambda w: ~F.array_contains(used, w)), F.filter(words, lambda w: F.array_contains(used, w)))


def battle_items(stories: DataFrame) -> DataFrame:
    """``cluster_id``, ``place``, ``cons`` and ``opp``: cards of at most four stories (``place``), whose first words differ where
    they can.  The words used so far go from card to card in one fold over those four."""
    quotes = F.regexp_extract_all("bias", F.lit("(«[^»]+»)"), F.lit(1))
    half = F.greatest(F.floor(F.size(quotes) / 2), F.lit(1)).cast("int")
    own = (F.coalesce("cons", F.lit("")) != "") & (F.coalesce("opp", F.lit("")) != "")
    loaded = F.struct(word_list(F.split("cons", " ")).alias("c"), word_list(F.split("opp", " ")).alias("o"))
    quoted = F.struct(word_list(F.slice(quotes, F.lit(1), half)).alias("c"), word_list(F.slice(quotes, half + 1, F.greatest(F.size(quotes) - half, F.lit(0)))).alias("o"))
    filled = lambda x: (F.size(x["c"]) > 0) & (F.size(x["o"]) > 0)
    pair = F.when(own & filled(loaded), loaded).when(F.size(quotes) >= 2, quoted)
    rows = stories.where("two_told").select("cluster_id", "place", pair.alias("p")).where(F.col("p").isNotNull() & filled(F.col("p")))
    four = rows.agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "cluster_id", "p"))), 1, 4).alias("all"))
    none = F.array().cast("array<string>")
    item = "array<struct<cluster_id: bigint, cons: array<string>, opp: array<string>>>"
    start = F.struct(F.array().cast(item).alias("items"), none.alias("c"), none.alias("o"))

    def step(s: Column, x: Column) -> Column:
        c, o = unused_first(x["p"]["c"], s["c"]), unused_first(x["p"]["o"], s["o"])
        made = F.struct(x["cluster_id"].cast("bigint").alias("cluster_id"), c.alias("cons"), o.alias("opp"))
        return F.struct(F.array_append(s["items"], made).alias("items"), F.array_append(s["c"], F.get(c, F.lit(0))).alias("c"), F.array_append(s["o"], F.get(o, F.lit(0))).alias("o"))

    folded = four.select(F.posexplode(F.aggregate("all", start, step)["items"]).alias("place", "i"))
    return folded.select("i.cluster_id", (F.col("place") + 1).alias("place"), "i.cons", "i.opp")


def words_sql(words: str) -> str:
    plain = f"list_filter(list_transform({words}, lambda w: trim(regexp_replace(w, '[«»]', '', 'g'))), lambda w: length(w) >= 3)"
    once = f"list_filter({plain}, lambda w, i: list_position({plain}, w) = i)"
    return f"list_transform(list_sort(list_transform({once}, lambda w, i: {{'n': length(w), 'i': i, 'w': w}})), lambda x: x.w)[1:6]"


@query("L15 L14 L16", SLOT_SQL + f"""
, q AS (SELECT b.place AS at_, s.*, regexp_extract_all(bias, '«[^»]+»') AS q FROM battle b JOIN s USING (cluster_id) WHERE two_told)
, w AS (SELECT at_, cluster_id, q, coalesce(cons, '') <> '' AND coalesce(opp, '') <> '' AS own, {words_sql("string_split(coalesce(cons, ''), ' ')")} AS c1, {words_sql("string_split(coalesce(opp, ''), ' ')")} AS o1, {words_sql("q[1:greatest(len(q) // 2, 1)]")} AS c2, {words_sql("q[greatest(len(q) // 2, 1) + 1:]")} AS o2 FROM q)
, p AS (SELECT at_, cluster_id, CASE WHEN own AND len(c1) > 0 AND len(o1) > 0 THEN c1 WHEN len(q) >= 2 THEN c2 END AS c, CASE WHEN own AND len(c1) > 0 AND len(o1) > 0 THEN o1 WHEN len(q) >= 2 THEN o2 END AS o FROM w)
, r AS (SELECT row_number() OVER (ORDER BY at_) AS i, cluster_id, c, o FROM p WHERE len(c) > 0 AND len(o) > 0)
, go(i, cluster_id, cons, opp, uc, uo) AS (SELECT 0::BIGINT, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]
  UNION ALL SELECT i, cluster_id, c2, o2, list_append(uc, c2[1]), list_append(uo, o2[1]) FROM (SELECT r.i, r.cluster_id, list_concat(list_filter(c, lambda x: NOT list_contains(uc, x)), list_filter(c, lambda x: list_contains(uc, x))) AS c2, list_concat(list_filter(o, lambda x: NOT list_contains(uo, x)), list_filter(o, lambda x: list_contains(uo, x))) AS o2, uc, uo FROM go JOIN r ON r.i = go.i + 1))
SELECT cluster_id, i AS place, array_to_string(cons, ' ') AS cons, array_to_string(opp, ' ') AS opp FROM go WHERE i BETWEEN 1 AND 4""")
def battle_cards(t: Tables) -> DataFrame:
    """The words of both sides for the stories where two narratives meet, on each card first those that no card before leads with."""
    s = shown(t)
    battle = slots(s).where("slot = 'battle'").select("cluster_id", "place").join(s, "cluster_id")
    return battle_items(battle).select("cluster_id", "place", F.array_join("cons", " ").alias("cons"), F.array_join("opp", " ").alias("opp"))
