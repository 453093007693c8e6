"""Identity, URL, phone and text functions as columns. Patterns stay inside what Java and RE2 share where they can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
STAGING = r"(?i)(cloudwaysapps\.com|wpengine\.com|\bstaging\b)"
FEED = r"(?i)/(feed|rss|rss2|atom)/?$"
CRUFT = r"(?i)-(old|copy|delete)(-\d+)?/?$"
KEYPAD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
NANP = r"^1?([2-9]\d{2}[2-9]\d{6})$"
PHONE = r"(?:\+?1[\s.-]?)?\(?[2-9]\d{2}\)?[\s.-]?[2-9]\d{2}[\s.-]?\d{4}"
ADDRESS_WORDS = {
    "street": "st", "avenue": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd", "suite": "ste", "highway": "hwy", "lane": "ln", "court": "ct",
    "place": "pl", "parkway": "pkwy", "circle": "cir", "north": "n", "south": "s", "east": "e", "west": "w",
}
SEVERITIES = ("error", "warning", "info")


def squeeze(col: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def norm_whitespace(col: Column) -> Column:
    """As ``squeeze``, with no-break and zero-width characters gone too."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, "[​‌‍﻿]", ""), "(?U)[\\s ]+", " "))


def fingerprint(*parts: Column | str) -> Column:
    """Parts with squeezed white space, blanks left out, joined by colons."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(":", *[F.nullif(squeeze(c.cast("string")), F.lit("")) for c in columns])


def fp_hash(fp: Column) -> Column:
    return F.sha2(fp, 256)


def slot(name: Column | str, nth: Column) -> Column:
    """``name`` for the first repeat of a key, ``name#n`` after it; ``nth`` counts from 0."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(nth == 0, name).otherwise(F.concat(name, F.lit("#"), nth.cast("string")))


def severity_rank(col: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(col == s, i).otherwise(rank)
    return rank


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def url_key(url: Column) -> Column:
    """Host in lower case and path, without scheme, query, fragment and last slashes; ``www`` stays."""
    return F.concat(host(F.trim(url)), F.regexp_replace(path(F.trim(url)), "/+$", ""))


def registrable(host_col: Column) -> Column:
    """The last two labels: the rule for structured data and off-brand landings."""
    return F.regexp_extract(host_col, r"([^.]*\.)?[^.]*$", 0)


def link_domain(host_col: Column) -> Column:
    """The host without a leading ``www.``: the rule for links."""
    return F.regexp_replace(host_col, r"^www\.", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def first_segment(url: Column) -> Column:
    return F.coalesce(F.get(segments(url), F.lit(0)), F.lit(""))


def depth(url: Column) -> Column:
    return F.size(segments(url))


def slug(url: Column) -> Column:
    return F.regexp_extract(path(url), r"([^/]*)/*$", 1)


def is_collision_slug(url: Column) -> Column:
    return slug(url).rlike(r"(^|[^0-9])-2$")


def is_cruft(url: Column) -> Column:
    return path(url).rlike(CRUFT)


def is_feed(url: Column) -> Column:
    return path(url).rlike(FEED)


def is_malformed(url: Column) -> Column:
    return ~host(url).contains(".")


def has_double_slash(url: Column) -> Column:
    return scheme(url).isin("http", "https", "") & path(url).contains("//")


def has_embedded_scheme(url: Column) -> Column:
    return scheme(url).isin("http", "https") & F.concat(host(url), path(url)).rlike("https?://?")


def e164_us(text: Column) -> Column:
    """+1 and ten digits of a US number, letters by keypad; null where the North American plan has no such number."""
    digits = F.regexp_replace(F.translate(F.upper(text), *KEYPAD), r"[^0-9]", "")
    ten = F.regexp_extract(digits, NANP, 1)
    return F.when(ten != "", F.concat(F.lit("+1"), ten))


def phones_in_text(text: Column) -> Column:
    """Distinct E.164 numbers in the text, sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda p: e164_us(p))
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: p.isNotNull())))


def format_phone(e164: Column) -> Column:
    return F.regexp_replace(e164, r"^\+1(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")


def norm_address(text: Column) -> Column:
    """Lower case, no punctuation, common street words shortened."""
    words = F.split(squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")), " ")
    short = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def address_key(text: Column) -> Column:
    """House number and ZIP code; null unless the text has both."""
    house, zip_code = F.regexp_extract(text, r"^\D*(\d+)\b", 1), F.regexp_extract(text, r"\b(\d{5})(?:-\d{4})?\s*$", 1)
    return F.when((house != "") & (zip_code != ""), F.concat_ws("|", house, zip_code))


def norm_paragraph(text: Column) -> Column:
    """Lower case, punctuation and white space as one space."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^\w\s]+", " "))


def context(text: Column, start: Column, end: Column, pad: int = 45) -> Column:
    """The text around code points start..end (from 0), ``pad`` on each side, trimmed."""
    first = F.greatest(start - pad, F.lit(0))
    return F.trim(F.substring(text, (first + 1).cast("int"), (end + pad - first).cast("int")))


def shape(text: Column) -> Column:
    """Digits as N, at most 120 characters, lower case."""
    return F.lower(F.substring(F.regexp_replace(text, r"\d+", "N"), 1, 120))


def detail(details: Column, key: str) -> Column:
    """The value of a key in a finding's details (JSON text); null where there is none or the text is broken."""
    return F.try_variant_get(F.try_parse_json(details), f"$['{key}']", "string")


def clean_caveats(text: Column) -> Column:
    """Old caveats of number lists in their present words."""
    return F.replace(F.replace(text, F.lit("(NAP 2026-07-02 snapshot; sheet ID unverified)"), F.lit("(from your NAP sheet)")), F.lit("NAP 2026-07-02 snapshot; sheet ID unverified"), F.lit("from your NAP sheet"))


def without_count(text: Column) -> Column:
    """Without a page count at the end, which reports print themselves."""
    return F.regexp_replace(text, r"(?i)\s*[—-]\s*on\s+[\d,]+\s+pages?\s*$", "")


def trim_sentence(text: Column, most: int = 400) -> Column:
    """At most ``most`` characters, cut after a full sentence where there is one."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])(\s|$)", 1)
    return F.when(F.length(text) <= most, text).when(whole != "", whole).otherwise(F.concat(F.rtrim(F.regexp_replace(head, r"\S*$", "")), F.lit("…")))


def period_label(period: Column) -> Column:
    """``2026-06-13..2026-09-12`` as ``13 Jun – 12 Sep 2026``; anything else as it is."""
    parts = F.split(period, r"\.\.")
    a, b = F.try_to_date(F.get(parts, F.lit(0))), F.try_to_date(F.get(parts, F.lit(1)))
    label = F.concat(F.date_format(a, "d MMM"), F.lit(" – "), F.date_format(b, "d MMM yyyy"))
    return F.coalesce(label, period)


def default_period(today: Column) -> Column:
    """The 92 days that end three days ago."""
    return F.concat(F.date_format(F.date_sub(today, 94), "yyyy-MM-dd"), F.lit(".."), F.date_format(F.date_sub(today, 3), "yyyy-MM-dd"))
