"""Text rules over posts as channels write them: normalising, splitting, cleaning, judging.

The provided posts are plain prose, so each is dressed with what the rules are about:
letter forms, quotes, digits, links, mentions, marks and tails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import text
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables

RAW_SQL = r"""
, raw AS (SELECT channel_id, message_id, '🔻 **' || substr(text, 1, 30) || '** كتاب  «' || substr(text, 4, 9) || '» ' || (channel_id * 37 + message_id) || ' ۱۲۳' || chr(10) || '• ' || text || ' [src](https://s.example/' || message_id || '?utm_source=x) @chan' || channel_id
  || ' https://t.me/c/' || message_id || ' https://news.example/a/' || channel_id || ').' || repeat('🔥', CAST(message_id % 8 AS INTEGER)) || chr(10) || chr(10) || chr(10) || chr(10) || 'é‍ ئ ' || chr(101) || chr(769) || chr(10) || '| کانال خبر' AS x FROM v_posts)
"""
#: Unicode white space apart, RE2's classes and Java's agree; strip() drops white space at both ends.
STRIP = "regexp_replace({}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


def raw_posts(t: Tables) -> DataFrame:
    c, m = F.col("channel_id"), F.col("message_id")
    x = F.concat(
        F.lit("🔻 **"), F.substring("text", 1, 30), F.lit("** كتاب  «"), F.substring("text", 4, 9), F.lit("» "), c * 37 + m, F.lit(" ۱۲۳\n• "), "text", F.lit(" [src](https://s.example/"), m, F.lit("?utm_source=x) @chan"), c,
        F.lit(" https://t.me/c/"), m, F.lit(" https://news.example/a/"), c, F.lit(")."), F.repeat(F.lit("🔥"), (m % 8).cast("int")), F.lit("\n\n\n\né‍ ئ é\n| کانال خبر"),
    )
    return t.posts.select("channel_id", "message_id", x.alias("x"))


def stored_sql(x: str) -> str:
    return STRIP.format(f"regexp_replace(regexp_replace(nfc_normalize(translate({x}, 'كيىؤئ', 'کییوی')), '[\\x{{200b}}\\x{{200d}}\\x{{200e}}\\x{{200f}}\\x{{feff}}]', '', 'g'), '\\s+', ' ', 'g')")


def words_sql(x: str) -> str:
    return STRIP.format(f"regexp_replace(nfc_normalize(translate({x}, 'كيى', 'کیی')), '\\s+', ' ', 'g')")


SPLIT = r"list_filter(string_split_regex({}, '[\s\x{{200c}},.;:!?؟«»()\[\]{{}}\x{{060c}}\x{{061b}}\\]+'), lambda w: w <> '')"
CLEAN = STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), 'https?://[^\s]+', '', 'g'), '@[\p{L}\p{M}\p{N}_]+', '', 'g'), '(?m)\|\s*[^\n]+$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
SHOWN = STRIP.format(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(clean, '\*\*([^*]+)\*\*', '\1', 'g'), '(?m)^[\s\x{202B}\x{202C}]*[🔻🔺🔸🔹📢📻🎥▶⚠🔥⭐📌🔗🕑]+[\s\x{202B}\x{202C}]*', '', 'g'), '(?m)^[\s\x{202B}\x{202C}]*[•·▪◾◼·]\s*', '', 'g'), '(?m)[│|]\s*(کانال|@)\s*[^\n│|]+\s*$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)


def truncate_sql(x: str, most: int, mark: str) -> str:
    head = f"substr({x}, 1, {most})"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE CASE WHEN contains({head}, ' ') AND length({head}) - strpos(reverse({head}), ' ') > {most // 2} THEN substr({head}, 1, length({head}) - strpos(reverse({head}), ' ')) ELSE {head} END || '{mark}' END"


@query("F1 F2 F3 F4 F7 F8 F12 F13 F30", RAW_SQL + rf"""
, n AS (SELECT channel_id, message_id, x, {stored_sql('x')} AS kept, {words_sql('x')} AS plain FROM raw)
, m AS (SELECT *, {SPLIT.format('plain')} AS w, {words_sql("substr(x, 1, 40)")} AS head FROM n)
SELECT channel_id, message_id, md5(kept) AS kept, md5(plain) AS plain, len(list_filter(list_transform(string_split_regex(x, '[.!?؟۔]\s+'), lambda s: {STRIP.format('s')}), lambda s: s <> ''))::INT AS sentences, len(w)::INT AS words,
 md5(head || ' ' || array_to_string(w[1 : greatest(20 - len({SPLIT.format('head')}), 0)], ' ')) AS embedded, {truncate_sql('plain', 200, '...')} AS short,
 array_to_string(list_sort(list_distinct(regexp_extract_all(x, '«([^«»]+)»', 1))), '|') AS quotes, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '[0-9۰-۹]{{2,}}'))), '|') AS numbers, translate(CAST(message_id + 10 AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS digits FROM m""")
def post_wording(t: Tables) -> DataFrame:
    """Normal forms, sentences, words, the embedding text (20 words here), quotes and numbers of each post."""
    x, plain = F.col("x"), text.normalize_words(F.col("x"))
    n = raw_posts(t).select("channel_id", "message_id", "x", plain.alias("plain"))
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    return n.select(
        "channel_id", "message_id", F.md5(text.normalize_glyphs(x).cast("binary")).alias("kept"), F.md5(F.col("plain").cast("binary")).alias("plain"), F.size(text.split_sentences(x)).alias("sentences"), F.size(text.split_words(F.col("plain"))).alias("words"),
        F.md5(text.embedding_text(F.substring("x", 1, 40), x, 20).cast("binary")).alias("embedded"), text.truncate(F.col("plain")).alias("short"),
        joined(text.quoted(x)).alias("quotes"), joined(text.numbers(x)).alias("numbers"), text.persian_digits(F.col("message_id") + 10).alias("digits"),
    )


@query("F17 F20 F21 F23 F24 F25 P12 P13", RAW_SQL + rf"""
, c AS (SELECT *, {CLEAN} AS clean FROM raw), s AS (SELECT *, {SHOWN} AS shown FROM c)
, u AS (SELECT *, list_filter(list_transform(regexp_extract_all(x, '(?i)https?://[^\s<>"'')\],؛]+'), lambda u: regexp_replace(u, '[.,;:!?)]+$', '')), lambda u: length(u) > 10) AS urls,
  list_filter(list_transform(regexp_extract_all(x, '(?i)https?://[^\s]+'), lambda u: regexp_replace(u, '[.,;:!؟،؛»)>\]]+$', '')), lambda u: NOT (contains(lower(u), 't.me/') OR contains(lower(u), 'telegram.me/') OR contains(lower(u), 'telegram.org/')))[1:5] AS outbound FROM s)
, l AS (SELECT *, list_filter(list_transform(string_split(shown, chr(10)), lambda y: {STRIP.format('y')}), lambda y: regexp_replace(y, '[\s\x{{200c}}]+', '', 'g') <> '') AS lines, regexp_replace(x, '[\x{{1F000}}-\x{{1FAFF}}\x{{2190}}-\x{{21FF}}\x{{2300}}-\x{{23FF}}\x{{25A0}}-\x{{27BF}}\x{{2B00}}-\x{{2BFF}}]', '', 'g') AS bare FROM u)
SELECT channel_id, message_id, array_to_string(urls, ' ') AS urls, array_to_string(outbound, ' ') AS outbound, md5(clean) AS clean, md5(shown) AS shown, {truncate_sql('lines[1]', 100, '…')} AS title,
 substr(trim(regexp_replace(regexp_replace(lower(shown), '[^\p{{L}}\p{{N}}\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '-'), 1, 150) || '-' || substr(sha1(channel_id || '/' || message_id), 1, 6) AS slug,
 length(shown) >= 120 AND (len(lines) <> 1 OR length(shown) >= 200) AND coalesce(list_sum(list_transform(outbound, lambda u: length(u))), 0) <= 0.4 * length(x) AS discussion,
 length(regexp_replace(bare, '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g')) < 15 OR (length(x) - length(bare) >= 5 AND length(x) - length(bare) > len(list_filter(string_split_regex(bare, '\s+'), lambda w: length(w) >= 2))) AS low_quality FROM l""")
def post_cleaning(t: Tables) -> DataFrame:
    """Links, cleaned and shown text, title, slug, and whether a post discusses or is of low quality."""
    x = F.col("x")
    p = raw_posts(t).select("*", text.display_post(x).alias("shown"), text.post_urls(x).alias("outbound"))
    suffix = text.short_hash(F.concat("channel_id", F.lit("/"), "message_id"), 6)
    return p.select(
        "channel_id", "message_id", F.array_join(text.urls_in(x), " ").alias("urls"), F.array_join("outbound", " ").alias("outbound"), F.md5(text.clean_post(x).cast("binary")).alias("clean"), F.md5(F.col("shown").cast("binary")).alias("shown"),
        text.first_line(F.col("shown")).alias("title"), F.concat(text.slug(F.col("shown")), F.lit("-"), suffix).alias("slug"), text.discussion(x, F.col("outbound")).alias("discussion"), text.low_quality(x).alias("low_quality"),
    )
