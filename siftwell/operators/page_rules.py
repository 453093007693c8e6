"""Rules on single pages. Each takes pages (columns of ``sources.extract``) and returns findings.

Findings: url, check, class, fingerprint, severity, issue, location, snippet, matched. A rule is narrow: no
shuffle but the window that numbers repeats of a key on one page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.functions import text as T

COLUMNS = ("url", "check", "class", "fingerprint", "severity", "issue", "location", "snippet", "matched")

# fixed values: word lists and patterns of the rules
LABEL_MARKERS = r"\(pillar\)|\[pillar\]|pillar copy| copy|\(copy\)"
TITLE_SEPARATOR = r"\s*\|\s*|\s+[-–—]\s+"
LOREM_PLACEHOLDER = (
    "lorem ipsum dolor consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco "
    "laboris aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident "
    "culpa officia deserunt mollit anim laborum"
).split()
LOREM_PAGE = (
    "lorem ipsum dolor consectetur adipiscing eiusmod incididunt labore aliqua pellentesque curabitur praesent nullam phasellus suspendisse vestibulum "
    "malesuada condimentum tincidunt sagittis ultricies bibendum dapibus volutpat feugiat facilisis sodales venenatis tristique imperdiet scelerisque euismod "
    "lacinia ornare porttitor egestas molestie rhoncus vulputate hendrerit tortor ligula risus lectus faucibus luctus nisl purus augue justo felis arcu mattis "
    "varius potenti cursus nibh erat urna metus parturient montes nascetur ridiculus aenean fermentum sollicitudin pharetra gravida"
).split()
EMPTY_STATE = r"(?im)^[\s\W]*no\s+[\w'’\- ]{0,40}?found(?:\s+in\s+this\s+field)?[\s\W]*$"
SHORTCODE = r"\[(?:[a-z][a-z0-9]*(?:[_-][a-z0-9]+)+|[a-z_]{6,})(?:\s+[^\]\n]{0,80})?\]"
VARIABLE_NAME = r"(?<![\w-])(?<![A-Z]{2}\s)(GEO|CITY|STATE|TOPIC|DRUG|FULL_GEO|NEAR_IN|NEAR-IN)(?![\w-])(?!\s+[A-Z][a-z])(?!\s+[A-Z]{2,})"
ACF = r"\[acf field=[\"']?([\w-]+)"
CURLY = r"\{\{[^}]+\}\}"
_PLACE_WORDS = "(?:in|on|at|of|to|by|for|from|during|within|near|across|between|through|until|since)"
_FIGURE = r"\d+(?:[.,]\d+)*"
_MEASURES = "miles?|mi|km|kilometers?|metres?|meters?|m|feet|ft|blocks?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|percent|%"
EMPTY_SLOT = (
    ("orphan_comma", rf"(?i)\b{_PLACE_WORDS}\s+,\s+\w", "error"),
    ("double_preposition", rf"(?i)\b{_PLACE_WORDS}\s{{2,}}{_PLACE_WORDS}\b|\b{_PLACE_WORDS}\s+(?:of|in)\s+(?![a-z]*-)", "error"),
    ("empty_percent", r"(?<![\d.])\s%", "error"),
    ("missing_unit", rf"(?i)\bwithin\s+(?>{_FIGURE}(?:(?:\s*(?:,|to|through|and|or|[-–—])\s*)+{_FIGURE})*)(?!\s*(?:{_MEASURES})\b)", "error"),
    ("not_found_sentinel", r"\bNot found\b", "error"),
    ("count_disagreement", r"(?i)(?<![\w.\-])1\s+(?:programs|facilities|centers|centres|clinics|rehabs|providers|options|services|beds|reviews|results|locations|hospitals|sites)\b", "error"),
    ("truncated_word", r"(?<![\d.])\b[a-z]+\s+([bcdfghjklmnpqrstvwyz])\s+[a-z]+\b(?!\.)", "warning"),
)
# what every match of a class holds, as literals (one of them) or as a pattern that is quick to try: a text without it is not searched for the class
SIGNS = {
    "shortcode": ("[",), "acf": ("[acf field=",), "curly": ("{{",), "variable_name": ("GEO", "CITY", "STATE", "TOPIC", "DRUG", "NEAR"),
    "empty_percent": ("%",), "not_found_sentinel": ("Not found",), "count_disagreement": ("1",),
}
PARTS = {
    "orphan_comma": r"\s,\s", "truncated_word": r"\s[bcdfghjklmnpqrstvwyz]\s", "missing_space": r"\.[A-Z]", "repeated_letters": r"([a-z])\1\1",
}
URL_IN_TEXT = r"https?://\S+|www\.\S+|\S+\.(?:com|org|net|gov|edu|html?)\b\S*"
URL_SIGNS = ("://", "www.", ".com", ".org", ".net", ".gov", ".edu", ".htm")  # each match of it holds one
LEGIT_DOUBLE = "had that blah no very so ha bye night new york walla sing pago baden well now long".split()
TLD = "com org net gov edu io co uk us info health".split()
ABBREVIATIONS = "mr mrs ms dr prof st ave inc ltd co vs etc eg ie jr sr ph approx dept est fig no vol".split()
SHORT_WORDS = "a i an at be by do go he if in is it me my no of on or so to up us we am as ok oh hi id tv pm ad rx er iv mg ml dr mr st co re ii".split()
MISSPELLINGS = {
    "inpateint": "inpatient", "residental": "residential", "tennesse": "Tennessee", "rennaisance": "Renaissance", "alchohol": "alcohol", "programing": "programming",
    "athough": "although", "faciltiy": "facility", "recovey": "recovery", "relaspe": "relapse", "treatmed": "treated", "trazadone": "trazodone", "percoet": "Percocet",
    "asssited": "assisted", "graditude": "Gratitude", "txreatment": "treatment", "stres": "stress", "goint": "going",
}
LOWER_ONLY = {"heath": "health"}
TEXT_CHECKS = ("blank", "placeholder", "empty_slot", "misspelling", "scope", "phone", "spelling")
BARE_COUNTY = r"(?i)\b(?:across|in|throughout|around|within|serving|nationwide in)\s+the\s+county\b(?!\s+of\b)"
CALL_TO_ACTION = (
    r"(?i)^\s*(?:verify|apply|call|get\s+in\s+touch|get\s+started|get\s+help|learn\s+more|read\s|view\s|see\s+(?:our|all|centers)|contact|start|begin|book|schedule|check\s|download|"
    r"submit|send|request|enroll|join|find\s+(?:a|out|help)|talk\s+to|speak|reach|tour|explore|claim|register|sign\s+up|subscribe|donate)\b"
)
BUTTON_CLASS = r"(?i)(?:^|[\s_-])(btn|button|cta)(?:$|[\s_-])"
SOCIAL_WORD = r"(facebook|instagram|linked\s?-?in|youtube|twitter|tiktok|pinterest)"
SOCIAL_HOSTS = {
    "facebook": "facebook", "fb": "facebook", "instagram": "instagram", "linkedin": "linkedin", "youtube": "youtube", "youtu": "youtube", "twitter": "twitter", "x": "twitter",
    "tiktok": "tiktok", "pinterest": "pinterest",
}

RULES: dict[str, dict] = {}


def _holds(text: Column, signs: tuple[str, ...]) -> Column:
    may = F.lit(False)
    for sign in signs:
        may = may | F.contains(text, F.lit(sign))
    return may


def may_hold(text: Column, cls: str) -> Column:
    """Whether the text can have a match of the class, by ``SIGNS`` or ``PARTS``."""
    if cls in SIGNS:
        return _holds(text, SIGNS[cls])
    return text.rlike(PARTS[cls]) if cls in PARTS else F.lit(True)


def without_urls(text: Column) -> Column:
    """The text with a space for each web address. What ends in a domain is tried from the start of a token only, so a long token takes one pass;
    a text without any of the signs that each address has is not searched."""
    return F.when(_holds(text, URL_SIGNS), F.regexp_replace(text, URL_IN_TEXT.replace(r"\S+\.(?:com", r"(?<!\S)\S+\.(?:com"), " ")).otherwise(text)


def rule(name: str, components: tuple[str, ...], reads_visible_text: bool = False) -> Callable:
    """Register a rule and what its findings depend on: a change of a component makes vanished findings ``rule_changed``."""

    def keep(f: Callable) -> Callable:
        RULES[name] = {"run": f, "components": components, "reads_visible_text": reads_visible_text}
        return f

    return keep


def findings(df: DataFrame, check: str, cls: Column | str, severity: Column | str, key: list, issue: Column | str, location: Column | str = "page body", snippet: Column | None = None, matched: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    as_col = lambda v: F.lit(v) if isinstance(v, str) or v is None else v
    return df.select(
        "url", F.lit(check).alias("check"), as_col(cls).alias("class"), T.fingerprint(check, as_col(cls), F.col("url"), *[as_col(k) for k in key]).alias("fingerprint"),
        as_col(severity).alias("severity"), as_col(issue).alias("issue"), as_col(location).alias("location"),
        (snippet if snippet is not None else F.lit(None).cast("string")).alias("snippet"),
        (matched if matched is not None else F.lit(None).cast("string")).alias("matched"), *keep,
    )


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def numbered(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """``nth``: 0 for the first row of a key on a page, 1 for the next, by position."""
    return df.withColumn("nth", F.row_number().over(W.partitionBy("url", *key).orderBy(*order)) - 1)


def matches(df: DataFrame, text: Column, pattern: str, group: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """url, ``keep``, pos and matched of every match of ``pattern``; texts without one go before the explode."""
    found = df.where(text.rlike(pattern)).select("url", *keep, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("pos", "matched"))
    return found


@rule("meta", ("meta", "thresholds"))
def check_meta(pages: DataFrame, title_min: int = 15, title_max: int = 70, bounds: DataFrame | None = None) -> DataFrame:
    """``bounds``: brand, title_min, title_max of brands with bounds of their own; ``pages`` then need brand."""
    low, high = F.lit(title_min), F.lit(title_max)
    if bounds is not None:
        pages = pages.join(bounds.select("brand", F.col("title_min").alias("_low"), F.col("title_max").alias("_high")), "brand", "left")
        low, high = F.coalesce("_low", low), F.coalesce("_high", high)
    title, desc = F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit(""))
    slug = T.slug(F.col("url"))
    parts = F.filter(F.transform(F.split(title, TITLE_SEPARATOR), lambda s: F.lower(F.trim(s))), lambda s: F.length(s) > 2)
    case = lambda c, severity, issue: F.struct(F.lit(c).alias("c"), F.lit(severity).alias("s"), F.lit(issue).alias("i"))
    cases = F.array_compact(F.array(
        F.when(title == "", case("missing_title", "error", "missing meta title")),
        F.when((title != "") & ~F.length(title).between(low, high), case("title_length", "warning", "title length out of bounds")),
        F.when(F.size(F.array_distinct(parts)) < F.size(parts), case("repeated_segment", "warning", "repeated segment in title")),
        F.when(desc == "", case("missing_desc", "warning", "missing meta description")),
        F.when(T.is_collision_slug(F.col("url")), case("collision_slug", "warning", "address ends in -2")),
        F.when((slug != "") & ~slug.rlike("^[a-z0-9-]+$"), case("malformed_slug", "warning", "malformed slug")),
    ))
    hit = pages.select("url", F.explode(cases).alias("c"), F.substring(title, 1, 90).alias("t"), slug.alias("g"))
    in_url = F.col("c.c").isin("collision_slug", "malformed_slug")
    return findings(hit, "meta", F.col("c.c"), F.col("c.s"), [], F.col("c.i"), F.when(in_url, "url").otherwise("head"), F.when(in_url, F.col("g")).otherwise(F.col("t")))


@rule("heading_structure", ("heading_structure",))
def check_headings(pages: DataFrame) -> DataFrame:
    high = pages.select("url", F.filter("headings", lambda h: h["level"] <= 3).alias("hs"))
    h1 = F.filter("hs", lambda h: h["level"] == 1)
    many = findings(high.where(F.size(h1) > 1), "heading_structure", "multi_h1", "warning", [], "multiple <h1>", "page", F.array_join(F.transform(F.slice(h1, 1, 4), lambda h: F.substring(h["text"], 1, 50)), " | "))
    one = high.select("url", F.explode("hs").alias("h")).select("url", "h.*")
    level = F.concat(F.lit("H"), F.col("level").cast("string"))
    empty = findings(one.where(F.trim("text") == ""), "heading_structure", "empty", "warning", [level], "empty heading", level)
    step = one.withColumn("prev", F.lag("level").over(W.partitionBy("url").orderBy("pos"))).where("level > prev + 1")
    jump = F.concat(F.lit("H"), F.col("prev").cast("string"), F.lit("->"), level)
    skipped = findings(step, "heading_structure", "skipped", "info", [jump, F.col("text")], F.concat(F.lit("skipped level "), jump), level, F.substring("text", 1, 60))
    leaks = numbered(one.where(F.lower("text").rlike(LABEL_MARKERS)), ["level", "text"], ["pos"])
    leaked = findings(leaks, "heading_structure", "label_leak", "error", [T.slot(level, F.col("nth")), F.col("text")], "template label leaked into heading", level, F.substring("text", 1, 80))
    return union(many, empty, skipped, leaked)


@rule("blank", ("blank",), reads_visible_text=True)
def check_blank(pages: DataFrame, least: int = 500) -> DataFrame:
    no_h1 = findings(pages.where(~F.exists("headings", lambda h: h["level"] == 1)), "blank", "missing_h1", "error", [], "missing <h1>", "page")
    thin = findings(pages.where(F.length("visible_text") < least), "blank", "thin", "warning", [], "thin content", "page", F.substring("visible_text", 1, 80))
    return union(no_h1, thin)


def lorem_markers(text: Column, words: list[str]) -> Column:
    return F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), F.array(*[F.lit(w) for w in words]))


def all_matches(df: DataFrame, text: Column, patterns: list[tuple[str, str, int]], keep: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """url, ``keep``, cls, pos and matched of every match of every (class, pattern, group): one scan of the text and one explode for all."""

    def one(cls: str, pattern: str, group: int) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, i: F.struct(F.lit(cls).alias("cls"), i.alias("pos"), m.alias("matched")))
        return F.when(may_hold(text, cls) & text.rlike(pattern), found).otherwise(F.array().cast("array<struct<cls:string,pos:int,matched:string>>"))

    every = F.concat(*[one(*p) for p in patterns], *more)
    return df.select("url", *keep, F.explode(every).alias("m")).select("url", *keep, "m.cls", "m.pos", "m.matched")


@rule("placeholder", ("placeholder",), reads_visible_text=True)
def check_placeholder(pages: DataFrame) -> DataFrame:
    text = F.coalesce("visible_text", F.lit(""))
    lorem = F.when(F.size(lorem_markers(text, LOREM_PLACEHOLDER)) >= 3, F.array(F.struct(F.lit("lorem_ipsum").alias("cls"), F.lit(0).alias("pos"), F.lit("").alias("matched"))))
    lorem = F.coalesce(lorem, F.array().cast("array<struct<cls:string,pos:int,matched:string>>"))
    patterns = [("empty_state", EMPTY_STATE, 0), ("shortcode", SHORTCODE, 0), ("variable_name", VARIABLE_NAME, 0), ("acf", ACF, 1), ("curly", CURLY, 0)]
    token = F.col("cls").isin("acf", "curly")
    hit = all_matches(pages, text, patterns, more=(lorem,)).withColumn("matched", F.when(token, F.col("matched")).otherwise(F.trim("matched")))
    n = numbered(hit.withColumn("key", F.when(token, F.col("matched")).otherwise(F.lower("matched"))), ["cls", "key"], ["pos"]).where(~token | (F.col("nth") == 0))
    issue = (
        F.when(F.col("cls") == "lorem_ipsum", "placeholder Latin is visible on the page").when(F.col("cls") == "empty_state", "a widget's empty message shows as content")
        .when(F.col("cls") == "shortcode", "an unrendered shortcode is visible").when(F.col("cls") == "variable_name", "a template field name shows in place of its value")
        .when(F.col("cls") == "acf", "unresolved field token").otherwise("leftover template token")
    )
    location = F.when(token, "body").otherwise("page body")
    return findings(n, "placeholder", T.slot(F.col("cls"), F.col("nth")), "error", [F.col("key")], issue, location, matched=F.nullif("matched", F.lit("")))


@rule("empty_slot", ("empty_slot",), reads_visible_text=True)
def check_empty_slot(pages: DataFrame) -> DataFrame:
    """Residue of merge fields that came out empty."""
    hit = all_matches(pages, F.coalesce("visible_text", F.lit("")), [(cls, pattern, 0) for cls, pattern, _ in EMPTY_SLOT])
    n = numbered(hit.withColumn("key", F.lower("matched")), ["cls", "key"], ["pos"])
    warn = [cls for cls, _, severity in EMPTY_SLOT if severity == "warning"]
    severity = F.when(F.col("cls").isin(*warn), "warning").otherwise("error")
    return findings(n, "empty_slot", T.slot(F.col("cls"), F.col("nth")), severity, [F.col("key")], "empty template variable left broken text", matched=F.col("matched"))


def body_blocks(pages: DataFrame) -> DataFrame:
    """url, pos, tag, text, region, group, has_media of body blocks with text."""
    return pages.select("url", F.explode("blocks").alias("b")).select("url", "b.*").where("region = 'body' and text <> ''")


@rule("corruption", ("empty_slot",))
def check_corruption(blocks: DataFrame) -> DataFrame:
    """``blocks``: url, pos, text. Doubled words, missing spaces, letter runs and stacked marks, one block at a time."""
    clean = blocks.select("url", F.col("pos").alias("block"), without_urls(F.col("text")).alias("clean"))
    patterns = [
        ("doubled_word", r"(?i)\b([A-Za-z]{2,}+)[^\S\n]++\1\b", 0), ("missing_space", r"\b[A-Za-z]{2,}+\.[A-Z][a-z]{2,}\b", 0),
        ("repeated_letters", r"\b[a-z]*([a-z])\1{2,}[a-z]*\b", 0), ("stacked_punctuation", r"[?!]\s*\.|[,;:]\s*[,;:]|\.{4,}", 0),
    ]
    hit = all_matches(clean, F.col("clean"), patterns, keep=("block",))
    legit = (F.col("cls") == "doubled_word") & F.lower(F.regexp_extract("matched", r"^(\w+)", 1)).isin(LEGIT_DOUBLE)
    before, after = F.lower(F.split_part("matched", F.lit("."), F.lit(1))), F.lower(F.split_part("matched", F.lit("."), F.lit(2)))
    legit = legit | ((F.col("cls") == "missing_space") & (before.isin(ABBREVIATIONS) | after.isin(TLD)))
    n = numbered(hit.where(~legit).withColumn("key", F.lower("matched")), ["cls", "key"], ["block", "pos"])
    return findings(n, "empty_slot", T.slot(F.col("cls"), F.col("nth")), "warning", [F.col("key")], F.concat(F.lit("broken text: "), F.col("cls")), matched=F.col("matched"))


@rule("shattered", ("empty_slot",))
def check_shattered(blocks: DataFrame, least_words: int = 12, least_odd: int = 5, share: float = 0.10) -> DataFrame:
    """Blocks whose words are broken apart by stray spaces; leaked style sheets are left out."""
    clean = without_urls(F.col("text"))
    words = F.transform(F.regexp_extract_all(clean, F.lit(r"[A-Za-z0-9][A-Za-z0-9'’-]*"), F.lit(0)), lambda w: F.lower(w))
    odd = F.filter("words", lambda w: w.rlike("^[a-z]{1,2}$") & ~w.isin(SHORT_WORDS))
    counted = blocks.where(F.regexp_count(clean, F.lit(r"[{};]|(?<!\w)\w++-\w++:")) < 3).withColumn("words", words).withColumn("odd", F.size(odd))
    hit = counted.where((F.size("words") >= least_words) & (F.col("odd") >= least_odd) & (F.col("odd") / F.greatest(F.size("words"), F.lit(1)) >= share))
    n = numbered(hit.withColumn("key", F.lower(F.substring("text", 1, 60))), ["key"], ["pos"])
    return findings(n, "empty_slot", T.slot("shattered_text", F.col("nth")), "error", [F.col("key")], "spaces broken into the middle of words", snippet=F.substring("text", 1, 180))


@rule("lorem_page", ("empty_slot",), reads_visible_text=True)
def check_lorem_page(pages: DataFrame) -> DataFrame:
    hit = pages.where(F.size(lorem_markers(F.col("visible_text"), LOREM_PAGE)) >= 3)
    return findings(hit, "empty_slot", "lorem_ipsum", "error", ["lorem"], "placeholder Latin text is live", snippet=F.substring("visible_text", 1, 160))


@rule("misspelling", ("misspelling",), reads_visible_text=True)
def check_known_misspellings(pages: DataFrame, known: dict[str, str] | None = None, lower_only: dict[str, str] | None = None) -> DataFrame:
    known, lower_only = known if known is not None else MISSPELLINGS, lower_only if lower_only is not None else LOWER_ONLY
    every = "|".join(known)
    body = matches(pages, F.col("visible_text"), rf"(?i)\b({every})\b", 1).withColumn("rank", F.lit(0))
    low = matches(pages, F.col("visible_text"), rf"\b({'|'.join(lower_only)})\b", 1).withColumn("rank", F.lit(1))
    in_url = matches(pages.select("url", T.path(F.col("url")).alias("p")), F.col("p"), rf"(?i)(?:^|[^a-z])({every})(?![a-z])", 1).withColumn("rank", F.lit(0))
    hit = union(body.unionByName(low).withColumn("cls", F.lit("body")), in_url.withColumn("cls", F.lit("slug")))
    n = numbered(hit.withColumn("key", F.lower("matched")), ["cls", "key"], ["rank", "pos"])
    fix = F.create_map(*[F.lit(x) for pair in {**known, **lower_only}.items() for x in pair])
    issue = F.concat(F.lit("confirmed misspelling: "), F.col("matched"), F.lit(" -> "), F.element_at(fix, F.col("key")))
    return findings(n, "misspelling", T.slot(F.col("cls"), F.col("nth")), "error", [F.col("key")], issue, F.when(F.col("cls") == "slug", "url").otherwise("page body"), matched=F.col("matched"))


@rule("scope", ("scope",), reads_visible_text=True)
def check_scope(pages: DataFrame) -> DataFrame:
    """"the county" on pages that are not about a county."""
    h1 = F.coalesce(F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"], F.lit(""))
    scoped = T.path(F.col("url")).rlike(r"(?i)-county(?:/|$)|/county/") | F.concat_ws(" ", h1, F.col("title")).rlike(r"\b[A-Z][a-z]+\s+County\b")
    open_pages = pages.where(~scoped)
    surface = F.concat(
        F.array(F.struct(F.lit("page body").alias("location"), F.coalesce("visible_text", F.lit("")).alias("text"))),
        F.transform("headings", lambda h: F.struct(F.concat(F.lit("H"), h["level"].cast("string")).alias("location"), h["text"].alias("text"))),
        F.array(F.struct(F.lit("title").alias("location"), F.coalesce("title", F.lit("")).alias("text"))),
    )
    each = open_pages.select("url", F.posexplode(surface).alias("at", "s")).select("url", "at", "s.*")
    n = numbered(matches(each, F.col("text"), BARE_COUNTY, keep=("at", "location")).withColumn("key", T.squeeze(F.lower("matched"))), ["key"], ["at", "pos"])
    return findings(n, "scope", T.slot("county_for_country", F.col("nth")), "error", [F.col("key")], "county where country is meant", F.col("location"), matched=T.squeeze(F.col("matched")))


def _actionables(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.explode("actionables").alias("a")).select("url", "a.*")


@rule("dead_cta", ("actions",))
def check_dead_cta(pages: DataFrame) -> DataFrame:
    """Links that look like calls to action and lead nowhere. Without an address, or in a menu, only their words count, not their looks."""
    href = F.lower(F.trim("href"))
    nowhere = F.col("href").isNull() | href.isin("", "#") | href.startswith("javascript:")
    looks = (F.col("role") == "button") | F.col("classes").rlike(BUTTON_CLASS)
    acts = F.col("text").rlike(CALL_TO_ACTION)
    strict = F.col("href").isNull() | F.col("in_nav")
    hit = _actionables(pages).where(
        (F.col("tag") == "a") & nowhere & ~F.col("has_js_hooks") & ~F.col("role").isin("tab", "menuitem") & ~F.col("has_submenu")
        & (F.trim("text") != "") & (F.size(F.split(F.trim("text"), r"\s+")) <= 6) & F.when(strict, acts).otherwise(acts | looks)
    )
    n = numbered(hit.withColumn("key", F.lower("text")), ["key"], ["pos"])
    return findings(n, "actions", T.slot("dead_cta", F.col("nth")), "error", [F.col("key")], "a call to action leads nowhere", snippet=F.col("text"), matched=F.col("selector"))


@rule("social_misrouted", ("actions",))
def check_social_misrouted(pages: DataFrame) -> DataFrame:
    """A social icon whose network is not that of the address behind it; share links are left out."""
    named = F.regexp_extract(F.lower(F.concat_ws(" ", "aria_label", "classes", "text")), SOCIAL_WORD, 1)
    want = F.regexp_replace(named, r"[\s-]", "")
    host = F.element_at(F.split(F.regexp_replace(T.host(F.col("href")), r"www\.", ""), "@"), -1)
    network = F.create_map(*[F.lit(x) for pair in SOCIAL_HOSTS.items() for x in pair])
    actual = F.get(F.array_compact(F.transform(F.split(host, r"\."), lambda part: F.try_element_at(network, part))), F.lit(0))
    share = F.col("href").contains("/sharer") | F.col("href").contains("/share") | F.col("href").contains("intent/tweet")
    hit = _actionables(pages).withColumns({"want": want, "actual": actual}).where(F.col("href").startswith("http") & (F.col("want") != "") & (F.col("want") != F.col("actual")) & ~share)
    n = numbered(hit, ["want", "actual"], ["pos"])
    return findings(n, "actions", T.slot("social_misrouted", F.col("nth")), "error", [F.concat_ws("->", "want", "actual")], F.concat(F.col("want"), F.lit(" icon leads to "), F.col("actual")), matched=F.col("href"))


@rule("duplicate_paragraph", ("duplication",))
def check_duplicate_paragraph(blocks: DataFrame, least_chars: int = 120, least_words: int = 18) -> DataFrame:
    """``blocks``: url, pos, tag, text."""
    long = blocks.where(~F.col("tag").rlike("^(h[1-6]|th)$") & (F.length("text") >= least_chars) & (F.regexp_count("text", F.lit(r"\S+")) >= least_words))
    same = long.withColumn("norm", T.norm_paragraph(F.col("text"))).groupBy("url", "norm").agg(F.count("*").alias("n"), F.min_by("text", "pos").alias("first")).where("n > 1")
    return findings(same, "duplication", "duplicate_paragraph", "warning", [F.substring(F.sha1(F.col("norm").cast("binary")), 1, 16)], F.concat(F.lit("the same paragraph appears "), F.col("n").cast("string"), F.lit(" times")), snippet=F.substring("first", 1, 200), matched=F.col("n").cast("string"))


@rule("duplicate_link", ("duplication",))
def check_duplicate_link(pages: DataFrame) -> DataFrame:
    """The same text and address more than once inside one container."""
    links = _actionables(pages).where((F.col("region") == "body") & (F.trim(F.coalesce("href", F.lit(""))) != "") & ~F.trim("href").startswith("#") & (F.trim("text") != ""))
    same = links.groupBy("url", "group", T.squeeze(F.col("text")).alias("label"), F.trim("href").alias("to")).agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n > 1")
    n = numbered(same, ["label", "to"], ["pos"])
    return findings(n, "duplication", T.slot("duplicate_link", F.col("nth")), "warning", [F.lower("label"), F.col("to")], F.concat(F.lit("the link is listed "), F.col("n").cast("string"), F.lit(" times")), snippet=F.concat_ws(" -> ", "label", "to"))


@rule("empty_row", ("empty_row",))
def check_empty_slot_group(pages: DataFrame, least: int = 3, most_empty: int = 2, populated: float = 0.6) -> DataFrame:
    """One or two blanks inside a group of table cells or list entries that is filled otherwise; blanks at its end do not count."""
    cells = pages.select("url", F.explode("blocks").alias("b")).select("url", "b.*").where("region = 'body' and tag in ('td', 'li', 'dd')")
    group = W.partitionBy("url", "group", "tag")
    filled = (F.col("text") != "") | F.col("has_media")
    placed = cells.withColumn("filled", filled).withColumns({"i": F.row_number().over(group.orderBy("pos")) - 1, "size": F.count("*").over(group)})
    placed = placed.withColumn("last", F.max(F.when(F.col("filled"), F.col("i"))).over(group)).where((F.col("size") >= least) & (F.col("i") < F.col("last")))
    sums = placed.groupBy("url", "group", "tag").agg(F.count("*").alias("total"), F.count_if(~F.col("filled")).alias("empty"), F.min_by("text", F.when(F.col("text") != "", F.col("i"))).alias("example"), F.min("pos").alias("pos"))
    hit = sums.where((F.col("total") >= least) & F.col("empty").between(1, most_empty) & ((F.col("total") - F.col("empty")) / F.col("total") >= populated))
    n = numbered(hit.withColumn("start", F.substring(F.coalesce("example", F.lit("")), 1, 40)), ["tag", "empty", "total", "start"], ["pos"])
    issue = F.format_string("%d blank of a group of %d", "empty", "total")
    return findings(n, "empty_row", T.slot("empty_row", F.col("nth")), "warning", [F.col("tag"), F.substring(F.coalesce("example", F.lit("")), 1, 60)], issue, snippet=F.col("example"))


@rule("markup", ("markup",))
def check_markup_access(pages: DataFrame) -> DataFrame:
    """What markup alone can decide: links without a name, fields without a label, a view port that blocks zoom."""
    bare = F.filter("actionables", lambda a: (a["tag"] == "a") & a["href"].isNotNull() & (F.trim(a["text"]) == "") & (F.trim(a["aria_label"]) == ""))
    cases = F.array_compact(F.array(
        F.when(F.size(bare) > 0, F.struct(F.lit("link-name").alias("c"), F.size(bare).alias("n"))),
        F.when(F.col("unlabelled_fields") > 0, F.struct(F.lit("label").alias("c"), F.col("unlabelled_fields").alias("n"))),
        F.when(F.col("viewport").rlike(r"(?i)user-scalable\s*=\s*(no|0)|maximum-scale\s*=\s*(1(\.0+)?|0\.\d+)\s*(,|$)"), F.struct(F.lit("meta-viewport").alias("c"), F.lit(1).alias("n"))),
    ))
    hit = pages.select("url", F.explode(cases).alias("v"))
    return findings(hit, "markup", F.col("v.c"), "error", [], F.concat(F.lit("accessibility: "), F.col("v.c")), "page", matched=F.col("v.n").cast("string"))


@rule("brands", ("brands",))
def texts_with_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts``: url, brand, text. ``names``: other, name, pattern. Texts that have the rarest word of a name, of all that might have the name.

    Words are runs of plain letters, digits and underscores, as at the edges of a pattern; names of other scripts alone go by their own runs.
    """
    runs = lambda c: F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0)), F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))))
    plain = F.regexp_extract_all("name", F.lit(r"\w+"), F.lit(0))
    of_names = names.select("other", "name", "pattern", F.explode(F.when(F.size(plain) > 0, plain).otherwise(runs(F.col("name")))).alias("word")).distinct()
    wanted = of_names.select("word").distinct()
    words = texts.select("url", "brand", F.explode(runs(F.col("text"))).alias("word")).join(wanted, "word")
    counts = words.groupBy("word").agg(F.count("*").alias("texts"))
    rarest = of_names.join(counts, "word", "left").groupBy("other", "name", "pattern").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "word"))["word"].alias("word"))
    return words.join(rarest, "word")


def check_sister_brand(texts: DataFrame, names: DataFrame, window: int = 90) -> DataFrame:
    """``texts``: url, brand, text (body), subject (text that says what the page is about). ``names``: brand, name.

    Another brand's exact name in the body; pages that name two or more, that are about that brand, or
    that speak of a relationship right before the name, are left out. Each name is looked for by its rarest word: texts and names
    meet in an equi-join on the word of each name that the fewest texts have, and only those pages are searched for the whole name.
    """
    relation = r"(?i)\b(partner\w*|network|affiliat\w*|sister|family\s+of|part\s+of|owned\s+by|operated\s+by|refer\w*\s+to|alongside|our\s+other)\b"
    names = names.select(F.col("brand").alias("other"), "name").withColumn("pattern", F.concat(F.lit(r"(?<![\w-])\Q"), F.col("name"), F.lit(r"\E(?![\w-])")))
    near = texts_with_names(texts, names).where("brand <> other").select("url", "other", "name", "pattern").distinct()
    hit = texts.join(near, "url").where(F.expr("regexp_like(text, pattern)"))
    hit = hit.withColumn("at", F.expr("regexp_instr(text, pattern)")).withColumn("brands", F.size(F.collect_set("other").over(W.partitionBy("url"))))
    before = F.substring("text", F.greatest(F.col("at") - window, F.lit(1)), F.least(F.col("at") - 1, F.lit(window)))
    kept = hit.where((F.col("brands") == 1) & ~F.expr("regexp_like(subject, pattern)") & ~before.rlike(relation))
    return findings(kept, "brands", "sister_brand", "error", [F.col("name")], F.concat(F.lit("names another brand: "), F.col("name")), snippet=T.context(F.col("text"), F.col("at") - 1, F.col("at") + F.length("name"), 60), matched=F.col("name"))


def with_confidence(found: DataFrame, css: DataFrame) -> DataFrame:
    """``css``: url, css_status. Findings from text on pages with style sheets missing have low confidence."""
    bad = css.where(~F.col("css_status").isin("ok", "none")).select("url", F.lit("low").alias("_low"))
    return found.join(bad, "url", "left").withColumn("confidence", F.when(F.col("check").isin(*TEXT_CHECKS), F.coalesce("_low", F.lit("normal"))).otherwise("normal")).drop("_low")
