"""HTML to typed columns: one row a page, put together from the interval table of its elements.

Broken markup, empty or null pages give empty fields, never a failed task. The only Python is the tokeniser of
``elements.events``; texts, regions, visibility, blocks, menus and paths are windows and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.sources import elements as E

PAGE_SCHEMA = (
    "title string, meta_description string, is_noindex boolean, visible_text string, css_status string, content_hash string, "
    "headings array<struct<level:int,text:string,pos:int>>, links array<struct<href:string,url:string>>, "
    "actionables array<struct<pos:int,tag:string,text:string,href:string,classes:string,role:string,aria_label:string,has_js_hooks:boolean,in_nav:boolean,"
    "has_submenu:boolean,region:string,selector:string,group:int>>, "
    "blocks array<struct<pos:int,tag:string,text:string,region:string,group:int,has_media:boolean>>, "
    "json_ld array<string>, unlabelled_fields int, viewport string, error string"
)
PATH_LEVELS, GROUP_LEVELS = 8, 4


def stable_hash(html: Column) -> Column:
    """Hash of the markup without scripts, styles and rotating e-mail protection."""
    kept = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", "")
    return F.sha2(F.regexp_replace(kept, r"(?i)/cdn-cgi/l/email-protection[^\"'\s>]*|data-cfemail=\"[^\"]*\"", ""), 256)


def _attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def _hooks() -> Column:
    """Whether scripts are likely to act on the element."""
    named = F.exists(F.map_keys("attrs"), lambda k: F.coalesce(*[F.when(k.startswith(s), True) for s in E.HOOK_STARTS], F.lit(False)))
    words = F.exists(F.split(_attr("class"), r"\s+"), lambda c: c.rlike("|".join(E.HOOK_WORDS)) | F.lower(c).isin(*sorted(E.DROPDOWNS)))
    filled = F.lit(False)
    for name in E.HOOKS:
        filled = filled | (_attr(name) != "")
    return filled | named | words


def _sorted(what: Column, *fields: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(what, F.struct(*fields))))


def _inner(x: Column) -> Column:
    """The visible text of an element in one line, from the pieces of its page."""
    own = F.slice("texts", x["text_from"] + 1, x["text_to"] - x["text_from"])
    return F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda t: t["piece"]), ""), r"\s+", " "))


def _path(number: Column) -> Column:
    """The element and its ancestors, ``PATH_LEVELS`` at most, each with its place among siblings of its tag."""
    kind = "struct<at:int,path:string>"
    start = F.struct(number.alias("at"), F.lit("").alias("path")).cast(kind)

    def up(acc: Column, _: Column) -> Column:
        here = F.get("tree", acc["at"] - 1)
        longer = F.struct(here["parent"].alias("at"), F.concat(here["step"], F.when(acc["path"] == "", "").otherwise(">"), acc["path"]).alias("path")).cast(kind)
        return F.when(acc["at"] > 0, longer).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(PATH_LEVELS)), start, up)["path"]


def _list_of(number: Column, parent: Column) -> Column:
    """The nearest list among the next ancestors, or the parent."""
    kind = "struct<at:int,found:int>"

    def up(acc: Column, _: Column) -> Column:
        here = F.get("tree", acc["at"] - 1)
        is_list = F.coalesce(here["tag"].isin(*sorted(E.LISTS)), F.lit(False))
        return F.struct(here["parent"].alias("at"), F.coalesce(acc["found"], F.when(is_list, acc["at"])).alias("found")).cast(kind)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(GROUP_LEVELS)), F.struct(parent.alias("at"), F.lit(None).alias("found")).cast(kind), up)["found"]
    return F.coalesce(found, parent)


def extract_pages(df: DataFrame, html_col: str = "html", base_col: str = "url", css_col: str | None = None, keep: tuple[str, ...] = ("url",), keep_hidden: bool = False, parts: int | None = None) -> DataFrame:
    """``keep`` columns with the fields of ``PAGE_SCHEMA``; ``base_col`` resolves relative links, ``error`` says what broke the parser; ``parts`` as for ``elements.events``."""
    given = df.withColumn("_hash", stable_hash(F.col(html_col)))
    rows = E.placed(E.events(given, html_col, base_col, css_col, (*keep, "_hash"), parts), keep_hidden)
    tag, number, live = F.col("tag"), F.col("number"), F.col("live")
    is_element, is_a = number > 0, tag == "a"
    step = F.when(F.col("siblings") > 1, F.concat(tag, F.lit(":nth-of-type("), F.col("nth").cast("string"), F.lit(")"))).otherwise(tag)
    span = ("text_from", "text_to")
    kind = F.lower(_attr("type"))
    field = live & tag.isin("input", "select", "textarea") & ~kind.isin("hidden", "submit", "button", "image", "reset")
    unnamed = (_attr("aria-label") == "") & (_attr("aria-labelledby") == "") & (_attr("title") == "") & ~F.col("in_label")
    actionable = live & tag.isin("a", "button")
    per_page = rows.groupBy("page").agg(
        F.first("given", ignorenulls=True).alias("given"),
        F.first(F.when(number == 0, F.struct("css_status", "error")), ignorenulls=True).alias("root"),
        F.min(F.when(tag == "title", number)).alias("title_at"),
        _sorted(tag == "#title", F.col("at"), F.col("parent"), F.col("text")).alias("titles"),
        _sorted(is_element & (tag == "meta"), number.alias("pos"), F.lower(_attr("name")).alias("name"), F.trim(_attr("content")).alias("content")).alias("metas"),
        _sorted(tag == "#text", F.col("at"), F.col("piece")).alias("texts"),
        _sorted(is_element, number, F.col("parent"), tag, step.alias("step")).alias("tree"),
        _sorted(live & tag.isin(*sorted(E.HEADINGS)), number.alias("pos"), F.substring(tag, 2, 1).cast("int").alias("level"), *map(F.col, span)).alias("headings"),
        _sorted(F.col("first_url"), number.alias("pos"), F.trim(_attr("href")).alias("href"), F.col("url")).alias("links"),
        _sorted(
            actionable, number.alias("pos"), tag, *map(F.col, span), F.trim(F.when(is_element, F.col("attrs")["href"])).alias("href"), _attr("class").alias("classes"), _attr("role").alias("role"),
            F.coalesce(F.nullif(_attr("aria-label"), F.lit("")), _attr("title")).alias("aria_label"), _hooks().alias("has_js_hooks"), F.col("in_nav"), F.col("has_submenu"), F.col("region"), F.col("parent"),
        ).alias("actionables"),
        _sorted(live & F.col("leaf"), number.alias("pos"), tag, *map(F.col, span), F.col("region"), F.col("parent").alias("group"), F.col("has_media")).alias("blocks"),
        _sorted(tag == "#ld", F.col("at"), F.col("text")).alias("ld"),
        F.collect_set(F.when(is_element & (tag == "label"), F.col("attrs")["for"])).alias("labelled"),
        F.collect_list(F.when(field & unnamed, F.struct(F.col("attrs")["id"].alias("id")))).alias("fields"),
    )
    named = lambda name: F.coalesce(F.get(F.filter("metas", lambda m: m["name"] == name), F.lit(0))["content"], F.lit(""))
    title = F.array_join(F.transform(F.filter("titles", lambda t: t["parent"] == F.col("title_at")), lambda t: t["text"]), "")
    bare = F.filter("fields", lambda f: ~F.coalesce(F.array_contains("labelled", f["id"]), F.lit(False)))
    fields = {
        "title": F.trim(F.regexp_replace(title, r"(?U)\s+", " ")),
        "meta_description": named("description"),
        "is_noindex": F.contains(F.lower(named("robots")), F.lit("noindex")),
        "visible_text": F.regexp_replace(F.array_join(F.transform("texts", lambda t: t["piece"]), ""), r"^[\n ]+", ""),
        "css_status": F.col("root.css_status"),
        "content_hash": F.col("given._hash"),
        "headings": F.transform("headings", lambda h: F.struct(h["level"], _inner(h).alias("text"), h["pos"])),
        "links": F.transform("links", lambda x: F.struct(x["href"], x["url"])),
        "actionables": F.transform("actionables", lambda x: F.struct(
            x["pos"], x["tag"], F.substring(_inner(x), 1, 120).alias("text"), x["href"], x["classes"], x["role"], x["aria_label"], x["has_js_hooks"], x["in_nav"], x["has_submenu"], x["region"],
            _path(x["pos"]).alias("selector"), _list_of(x["pos"], x["parent"]).alias("group"),
        )),
        "blocks": F.transform("blocks", lambda b: F.struct(b["pos"], b["tag"], _inner(b).alias("text"), b["region"], b["group"], b["has_media"])),
        "json_ld": F.transform("ld", lambda x: x["text"]),
        "unlabelled_fields": F.size(bare),
        "viewport": named("viewport"),
        "error": F.col("root.error"),
    }
    return per_page.select(*[F.col(f"given.`{k}`").alias(k) for k in keep], *[v.alias(k) for k, v in fields.items()])


def body_text():
    """Text of body blocks; the whole visible text where a page has none."""
    body = F.filter("blocks", lambda b: (b["region"] == "body") & (b["text"] != ""))
    return F.coalesce(F.nullif(F.array_join(F.transform(body, lambda b: b["text"]), "\n"), F.lit("")), F.col("visible_text"))


def to_projection(pages: DataFrame, robots_col: str | None = None) -> DataFrame:
    """One compact row per page. ``robots_col`` names the column of the response's robots header, which keeps a page out of indexes as its meta tag does."""
    by_header = F.contains(F.lower(F.coalesce(robots_col, F.lit(""))), F.lit("noindex")) if robots_col else F.lit(False)
    h1 = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    return pages.select(
        "url", "title", "meta_description", (F.col("is_noindex") | by_header).alias("is_noindex"), "content_hash", F.coalesce(h1, F.lit("")).alias("h1_text"),
        F.transform("links", lambda x: x["url"]).alias("link_urls"), F.length("visible_text").alias("visible_chars"),
    )


def title_of(html):
    """The title by pattern alone: for plans that need nothing else of a page."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def headings_of(html):
    """(level, text, pos) of all headings by pattern alone."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"), F.lit(0))
    clean = lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "(?s)<[^>]*>", " "), r"\s+", " "))
    return F.transform(found, lambda h, i: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), clean(h).alias("text"), i.alias("pos")))


def description_of(html):
    return F.trim(F.regexp_extract(html, r"(?is)<meta\s+name=[\"']description[\"']\s+content=[\"']([^\"']*)[\"']", 1))


def plain_text(html):
    """Text without tags, scripts and styles, by pattern alone."""
    kept = F.regexp_replace(html, r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, "(?s)<[^>]*>", " "), r"\s+", " "))
