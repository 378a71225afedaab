"""Kinds of articles, and analyses as models return them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions import content as C
from heronlake.plans.judging import SILENT
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables

#: What titles, addresses, categories and bodies get in turn, so that every rule has texts that pass it and texts that just don't.
TITLES = ("یادداشت/ ", "یادداشت تفاهم امضا شد ", "ورزشگاه آزادی ", "فوتبال: ", "گفت‌وگو | ", "خبرهای کوتاه ", "مکزیک ۱-۰ کانادا ", "ماده ۵-۳ قانون ", "کاسمیرو و تحریم ", "", "", "گل دوم ")
URLS = ("https://bbc.co.uk/persian/live/", "https://a.example/opinion/", "https://a.example/panel/", "https://a.example/analysis/", "https://a.example/n/", "https://a.example/n/", "https://a.example/n/")
CATEGORIES = ("", "Sport", "یادداشت", "panel", "تحلیل", "", "world", "", "")
BODIES = ("به گزارش الف. به نقل از ب. ", "وزیر اعلام کرد ", "سفارت ", "", "", "", "")


def turn(parts: tuple[str, ...], by: str = "article_id") -> Column:
    return F.element_at(F.array(*map(F.lit, parts)), (F.col(by) % len(parts) + 1).cast("int"))


def turn_sql(parts: tuple[str, ...], by: str = "article_id") -> str:
    return "([" + ", ".join(f"'{p}'" for p in parts) + f"])[CAST({by} % {len(parts)} + 1 AS BIGINT)]"


def any_sql(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def labelled_sql(x: str, labels: tuple[str, ...]) -> str:
    head, after = f"substr({x}, 1, 60)", ", ".join(f"'{a}'" for a in C.AFTER_LABEL)
    return "(" + " OR ".join(f"((strpos({head}, '{w}') = 1 OR strpos({head}, '{w}') BETWEEN 1 AND {31 - len(w)}) AND substr({head}, strpos({head}, '{w}') + {len(w)}, 1) IN ('', {after}))" for w in labels) + ")"


@query("F62", f"""
, d AS (SELECT article_id, trim({turn_sql(TITLES)} || title) AS t, trim({turn_sql(BODIES)} || CASE WHEN article_id % 5 = 0 THEN '«' || replace(replace(body, '«', ''), '»', '') || '»' ELSE body END) AS b, lower({turn_sql(URLS)} || article_id) AS u, lower({turn_sql(CATEGORIES)}) AS r FROM v_articles)
, v AS (SELECT article_id, CASE WHEN NOT {any_sql("(t || ' ' || substr(b, 1, 600))", C.POLITICAL)} AND ({any_sql('r', C.OFF_RSS)} OR {labelled_sql('t', C.OFF_TITLES)} OR {any_sql('t', C.OFF_CONTENT)} OR (regexp_matches(t, '{C.SCORE}') AND NOT {any_sql('t', C.CLAUSES)})) THEN 'off_topic 0.9'
  WHEN {any_sql('t', C.ROUNDUPS)} OR (contains(u, '{C.LIVE}') AND length(b) >= {C.LIVE_CHARS}) THEN 'aggregation 0.9' WHEN {any_sql('u', C.OPINION_URLS)} THEN 'opinion 0.95' WHEN {any_sql('u', C.DISCUSSION_URLS)} THEN 'discussion 0.95' WHEN {any_sql('u', C.OTHER_URLS)} THEN 'other 0.85'
  WHEN {any_sql('r', C.OPINION_RSS)} THEN 'opinion 0.9' WHEN {any_sql('r', C.DISCUSSION_RSS)} THEN 'discussion 0.9' WHEN {any_sql('r', C.OTHER_RSS)} THEN 'other 0.85'
  WHEN ({labelled_sql('t', (C.NOTE,))} AND NOT {any_sql('t', C.MEMORANDA)}) OR {labelled_sql('t', tuple(x for x in C.OPINION_TITLES if x != C.NOTE))} THEN 'opinion 0.9' WHEN {labelled_sql('t', C.DISCUSSION_TITLES)} THEN 'discussion 0.9'
  WHEN {' + '.join(f"(length(b) - length(replace(b, '{w}', ''))) // {len(w)}" for w in C.ATTRIBUTIONS)} >= 3 OR (length(b) >= 300 AND length(array_to_string(regexp_extract_all(b, '«[^»]+»'), '')) > 0.6 * length(b)) THEN 'aggregation 0.85'
  WHEN {any_sql('substr(b, 1, 400)', C.NEWS_VERBS)} THEN 'news 0.85' END AS v FROM d)
SELECT article_id, split_part(v, ' ', 1) AS label, split_part(v, ' ', 2)::DOUBLE AS confidence FROM v""")
def content_kinds(t: Tables) -> DataFrame:
    """News, opinion, discussion, aggregation, other or off topic, by an ordered list of rules; null is left to a model."""
    body = F.when(F.col("article_id") % 5 == 0, F.concat(F.lit("«"), F.translate("body", "«»", ""), F.lit("»"))).otherwise(F.col("body"))
    k = C.kind(F.concat(turn(TITLES), "title"), F.concat(turn(BODIES), body), F.concat(turn(URLS), "article_id"), turn(CATEGORIES))
    return t.articles.select("article_id", k.alias("k")).select("article_id", "k.label", "k.confidence")


def unfenced(x: Column) -> Column:
    """What stands in a reply's code fence, if it has one."""
    fence = F.when(x.contains("```json"), F.split_part(F.split_part(x, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))).when(x.contains("```"), F.split_part(x, F.lit("```"), F.lit(2))).otherwise(x)
    return F.trim(fence)


def plain_side(x: Column) -> Column:
    """A summary without "this side" at the head of its sentences."""
    return F.trim(F.regexp_replace(x, rf"(^|[.؟!؛\n]\s*)این\s+(?:سمت|طرف)\s+(?!{SILENT})", "$1"))


def bullets(v: Column, side: str) -> Column:
    """All strings of all subgroups of a side, in their order, as one paragraph; null if the side is no object or has none."""
    groups = F.try_variant_get(v, f"$.narrative.{side}", "map<string, variant>")
    lists = F.flatten(F.transform(F.map_values(groups), lambda g: F.coalesce(F.try_variant_get(g, "$", "array<variant>"), F.array().cast("array<variant>"))))
    said = F.filter(F.transform(lists, lambda b: F.when(F.schema_of_variant(b) == "STRING", F.trim(F.try_variant_get(b, "$", "string")))), lambda s: F.coalesce(s, F.lit("")) != "")
    return F.when(F.size(said) > 0, F.array_join(said, " "))


TEXTS = ("state_summary_fa", "diaspora_summary_fa", "independent_summary_fa", "bias_explanation_fa", "summary_fa")
DEFAULTED = ("title_fa", "title_en", "narrative", "scores", "article_neutrality", "dispute_score", "loaded_words", "narrative_arc", "delta")


def analysis(reply: Column) -> dict[str, Column]:
    """A story analysis from a model's reply as columns: ``parsed``, its texts, and whether each other field is there.

    A missing field is null; the sides' summaries are filled from the narrative's bullets if they are missing or empty, and lose
    "this side" at the head of sentences.  A reply that is no JSON object gives nulls.
    """
    v = F.try_parse_json(unfenced(reply))
    v = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    out = {"parsed": v.isNotNull()}
    for name in TEXTS:
        own = F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
        side = {"state_summary_fa": "inside", "diaspora_summary_fa": "outside"}.get(name)
        out[name] = plain_side(F.coalesce(own, bullets(v, side)) if side else own)
    for name in DEFAULTED:
        field = F.try_variant_get(v, f"$.{name}", "variant")
        out[f"has_{name}"] = field.isNotNull() & ~F.coalesce(F.is_variant_null(field), F.lit(False))
    out["dispute_score"] = F.try_variant_get(v, "$.dispute_score", "double")
    out["conservative"] = F.array_join(F.try_variant_get(v, "$.loaded_words.conservative", "array<string>"), " ")
    return out


INSIDE = ("این سمت بر مذاکره تأکید دارد. این طرف سکوت کرده است", "بند یک؛ این طرف رد کرد", "")


def replies(t: Tables) -> DataFrame:
    """Replies made from events: with and without a fence, broken, with summaries, with bullets only, with nested fields of odd kinds."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    summary = F.when(i % 3 == 0, F.concat(F.lit(', "state_summary_fa": "'), turn(INSIDE, "event_id"), F.lit('"'))).otherwise("")
    sides = F.concat(F.lit(', "narrative": {"inside": {"a": ["  one '), i, F.lit(' ", 7, "", "'), turn(INSIDE, "event_id"), F.lit('"], "b": "x", "c": ["three"]}, "outside": '), F.when(i % 4 == 0, '"none"').otherwise(F.concat(F.lit('{"z": ["out '), k, F.lit('"]}'))), F.lit("}"))
    words = F.when(i % 2 == 0, F.concat(F.lit(', "loaded_words": {"conservative": ["w'), k, F.lit('", "v"]}'))).otherwise(', "loaded_words": null')
    body = F.concat(F.lit('{"title_fa": "t", "dispute_score": '), F.format_string("%s", (k / 80).cast("double")), summary, F.when(i % 5 != 0, sides).otherwise(""), words, F.lit("}"))
    raw = F.when(i % 7 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n``` ok"))).when(i % 7 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(i % 7 == 2, F.substring(body, 1, 25)).when(i % 7 == 3, '["a list"]').otherwise(body)
    return t["events"].select("event_id", raw.alias("raw"))


_IN = turn_sql(INSIDE, "event_id")
_SIDE = "trim(replace(regexp_replace(regexp_replace({0}, 'این(\\s+(?:سمت|طرف)\\s+(?:" + SILENT + "))', '⟦\\1', 'g'), '(^|[.؟!؛\\n]\\s*)این\\s+(?:سمت|طرف)\\s+', '\\1', 'g'), '⟦', 'این'))"


@query("F49", f"""
, r AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k, {_IN} AS said, event_id % 7 IN (2, 3) AS bad FROM events)
, x AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN 'one ' || event_id || CASE WHEN trim(said) <> '' THEN ' ' || said ELSE '' END || ' three' END AS ins, CASE WHEN event_id % 5 <> 0 AND event_id % 4 <> 0 THEN 'out ' || k END AS outs FROM r)
SELECT event_id, NOT bad AS parsed, CASE WHEN NOT bad THEN {_SIDE.format("coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN said END, ''), ins)")} END AS state_summary_fa, CASE WHEN NOT bad THEN outs END AS diaspora_summary_fa, NOT bad AS has_title_fa, NOT bad AND event_id % 5 <> 0 AS has_narrative, NOT bad AND event_id % 2 = 0 AS has_loaded_words, false AS has_delta,
 CASE WHEN NOT bad THEN k / 80::DOUBLE END AS dispute_score, CASE WHEN NOT bad AND event_id % 2 = 0 THEN 'w' || k || ' v' END AS conservative FROM x""")
def story_analyses(t: Tables) -> DataFrame:
    """Analyses as models return them: texts, nested bullets joined, missing fields null, broken replies nulls."""
    found = analysis(F.col("raw"))
    names = ["parsed", "state_summary_fa", "diaspora_summary_fa", "has_title_fa", "has_narrative", "has_loaded_words", "has_delta", "dispute_score", "conservative"]
    return replies(t).select("event_id", *(F.coalesce(found[n], F.lit(False)).alias(n) if n.startswith(("has_", "parsed")) else found[n].alias(n) for n in names))
