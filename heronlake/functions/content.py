"""What kind of text an article is, by its address, category, title and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section labels that titles begin with.
OPINION_TITLES = ("یادداشت", "سرمقاله", "ستون", "نقد ", "اپ‌اد", "اپ ـ اد", "opinion", "editorial")
DISCUSSION_TITLES = ("گفت‌وگو", "گفت و گو", "گفتگو", "مصاحبه", "میزگرد", "پرسش و پاسخ", "interview")
#: Parts of addresses.
OPINION_URLS = ("/opinion", "/yaddasht", "/sarmaghaleh", "/editorial", "/column", "/note", "/یادداشت", "/سرمقاله")
DISCUSSION_URLS = ("/interview", "/goftogu", "/goft-o-gu", "/mosahebe", "/panel", "/roundtable", "/مصاحبه", "/گفتگو")
OTHER_URLS = ("/analysis", "/explainer", "/feature", "/تحلیل")
#: Parts of feed categories.
OPINION_RSS = ("opinion", "editorial", "column", "یادداشت", "سرمقاله")
DISCUSSION_RSS = ("interview", "panel", "گفت", "مصاحبه", "میزگرد")
OTHER_RSS = ("analysis", "explainer", "تحلیل")
#: Sport, entertainment and life style in categories, at the head of titles, and anywhere in them.
OFF_RSS = (
    "ورزش", "ورزشی", "فوتبال", "والیبال", "بسکتبال", "هندبال", "sport", "sports", "football", "سینما", "موسیقی", "هنری", "تلویزیون", "سرگرمی", "سلبریتی", "entertainment", "celebrity", "music", "cinema",
    "آشپزی", "طالع", "فال", "مد", "آرایش", "گردشگری", "سبک زندگی", "lifestyle", "cooking", "horoscope", "fashion", "tourism",
)
OFF_TITLES = ("ورزش", "ورزشی", "فوتبال", "والیبال", "بسکتبال", "هندبال", "جام جهانی", "المپیک", "پرسپولیس", "سینما", "موسیقی", "سلبریتی", "جشنواره فیلم", "آشپزی", "طالع", "فال", "گردشگری")
OFF_CONTENT = (
    "لیگ برتر", "لیگ قهرمانان", "جام جهانی", "جام ملت", "سرمربی", "نیمکت ذخیره", "نقل و انتقالات", "وزنه‌برداری", "وزنه برداری", "گل‌زنی", "هتریک", "تیم ملی فوتبال", "تیم ملی والیبال", "تیم ملی کشتی", "قهرمان جهان شد",
    "قهرمانی جوانان وزنه", "مسابقات وزنه‌برداری", "مدال طلا گرفت", "صعود به لیگ برتر", "گل اول", "گل دوم", "گل سوم", "گل چهارم", "گل پنجم", "گل ششم", "خلاصه بازی", "خلاصه نیمه", "دیدار تیم ملی", "بازی تیم ملی", "بازی ایران و بلژیک", "به مصاف بلژیک",
    "مقابل کیپ‌ورد", "کیپ‌ورد", "دوکو", "رافینیا", "امباپه", "هالند", "football match", "رئال مادرید", "بارسلونا", "منچسترسیتی", "منچستر یونایتد", "گواردیولا", "آرتتا", "لیونل مسی", "کریستیانو رونالدو", "رافائل نادال", "کاسمیرو",
    "اینفانتینو", "قلعه‌نویی", "لامین یامال", "کی‌روش", "رونالدینیو", "جشنواره فیلم", "باکس آفیس", "اکران کمدی", "آلبوم موسیقی", "مولتی ویتامین", "طالع بینی", "فال روز", "انتشارات کتاب شرق",
)
#: What makes such a text news nevertheless.
POLITICAL = ("ویزا", "تحریم", "وزارت خارجه", "وزارت امور خارجه", "کاخ سفید", "سفارت", "دیپلمات", "پاسپورت", "گذرنامه")
#: Verbs of reports, attributions to others, titles of roundups.
NEWS_VERBS = ("اعلام کرد", "خبر داد", "گزارش داد", "اظهار داشت", "تأکید کرد", "تاکید کرد", "گفت:", "افزود:", "اعلام شد", "منتشر کرد", "announced", "reported")
ATTRIBUTIONS = ("به نقل از", "به گزارش", "نقل از")
ROUNDUPS = ("تازه‌ترین خبرهای جهان", "خبرهای کوتاه", "چند خبر کوتاه", "اخبار کوتاه", "مرور مطبوعات", "نگاهی به مطبوعات", "گزیده اخبار", "بسته خبری", "تیتر روزنامه‌ها", "مهم‌ترین عناوین", "مرور رسانه‌ها")
#: A rolling page's address and least length; a score of two digits between words, and what isn't one.
LIVE, LIVE_CHARS = "bbc.co.uk/persian/live/", 5000
SCORE = "[؀-ۿ]\\s*[۰-۹0-9]\\s*[-–—]\\s*[۰-۹0-9]\\s*[؀-ۿ]"
CLAUSES = ("ماده", "بند", "تبصره", "اصل ", "قطعنامه", "صفحه")
#: A memorandum, which the label of a note is part of; what may follow a label.
MEMORANDA, NOTE = ("یادداشت تفاهم", "تفاهم‌نامه", "تفاهم نامه"), "یادداشت"
AFTER_LABEL = (" ", "/", ":", "|", "،", "-", "—", "ـ")


def any_of(x: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: x.contains(p))


def labelled(title: Column, labels: tuple[str, ...]) -> Column:
    """Whether one of *labels* stands at the head of a title, or within its first thirty characters, as a word of its own."""
    head = F.substring(title, 1, 60)
    out = F.lit(False)
    for label in labels:
        at, behind = F.locate(label, head), len(label)
        near = (at == 1) | ((at > 0) & (at + (behind - 1) <= 30))
        after = F.substring(head, at + behind, F.lit(1))
        out = out | (near & ((after == "") | after.isin(*AFTER_LABEL)))
    return out


def kind(title: Column, body: Column, url: Column, category: Column) -> Column:
    """``label`` and ``confidence``: the first rule that applies; null where none does, so that a model is asked.

    Null texts count as empty.
    """
    title, body = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    url, rss = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    political = any_of(F.concat(title, F.lit(" "), F.substring(body, 1, 600)), POLITICAL)
    off = any_of(rss, OFF_RSS) | labelled(title, OFF_TITLES) | any_of(title, OFF_CONTENT) | (title.rlike(SCORE) & ~any_of(title, CLAUSES))
    others = tuple(x for x in OPINION_TITLES if x != NOTE)
    opinion = (labelled(title, (NOTE,)) & ~any_of(title, MEMORANDA)) | labelled(title, others)
    said = sum((F.regexp_count(body, F.lit(v)) for v in ATTRIBUTIONS), F.lit(0))
    quoted = F.aggregate(F.regexp_extract_all(body, F.lit("(«[^»]+»)"), F.lit(1)), F.lit(0), lambda n, q: n + F.length(q))
    rules = [
        (~political & off, "off_topic", 0.9), (any_of(title, ROUNDUPS), "aggregation", 0.9), (url.contains(LIVE) & (F.length(body) >= LIVE_CHARS), "aggregation", 0.9),
        (any_of(url, OPINION_URLS), "opinion", 0.95), (any_of(url, DISCUSSION_URLS), "discussion", 0.95), (any_of(url, OTHER_URLS), "other", 0.85),
        (any_of(rss, OPINION_RSS), "opinion", 0.9), (any_of(rss, DISCUSSION_RSS), "discussion", 0.9), (any_of(rss, OTHER_RSS), "other", 0.85),
        (opinion, "opinion", 0.9), (labelled(title, DISCUSSION_TITLES), "discussion", 0.9),
        (said >= 3, "aggregation", 0.85), ((F.length(body) >= 300) & (quoted > 0.6 * F.length(body)), "aggregation", 0.85), (any_of(F.substring(body, 1, 400), NEWS_VERBS), "news", 0.85),
    ]
    out = F
    for rule, label, confidence in rules:
        out = out.when(rule, F.struct(F.lit(label).alias("label"), F.lit(confidence).cast("double").alias("confidence")))
    return out
