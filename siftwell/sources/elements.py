"""HTML as an interval table: one row an element, and what follows from the containment of intervals.

An Arrow-batched map turns each page into events: the begin of every element with the place of its end, every text, and the end of
every element that breaks a line. All else is column code: windows over one page in the order of the events give visibility, regions,
leaf blocks, media, submenus and the separators of texts, as an element holds another if its interval does. Pages are told apart by
the place of their row, so an input that is not the same when it is read again must be stored first.

Broken markup, empty or null pages give what was read of them, never a failed task; ``error`` says what broke the parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
BLOCK = frozenset("p li td th h1 h2 h3 h4 h5 h6 dd dt blockquote figcaption".split())
BREAKING = BLOCK | frozenset("address article aside br dl div fieldset figure footer form header hr main nav ol pre section table tbody tfoot thead tr ul body html option".split())
MEDIA = frozenset("img svg picture video iframe canvas object embed input select textarea".split())
LANDMARKS = frozenset("nav header footer aside".split())
LISTS = frozenset("ul ol dl table tbody nav menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "a": {"a"}, "button": {"button"},
    "p": BREAKING - {"br", "td", "th", "li", "option", "html", "body", "tr", "tbody", "thead", "tfoot", "dd", "dt", "figcaption"},
} | {h: HEADINGS for h in HEADINGS}
SCOPES = {"li": LISTS, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}, "p": {"td", "th", "li", "body"}}
FURNITURE = (
    r"(?i)(?:^|\s)(?:(?:site|main|global|primary|sticky|top|bottom)[_-](header|footer|nav|navigation|menu|bar)|(masthead)|(colophon)|(navbar|nav-?menu|mega-?menu|breadcrumbs?)|(sidebar|widget-area))(?:\s|$)"
)
ICON = r"(?i)(?:^|\s)(?:fa[srbld]?|fa-[\w-]+|e?icon|e?icon-[\w-]+|[\w-]*-icon|dashicons(?:-[\w-]+)?|material-icons|glyphicon)(?:\s|$)"
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LD = "application/ld+json"
HOOKS = ("onclick", "aria-controls", "aria-haspopup", "data-toggle", "data-bs-toggle", "data-target")
HOOK_STARTS = ("data-elementor", "data-popup")
HOOK_WORDS = ("popup", "modal", "toggle", "accordion", "tab")
DROPDOWNS = frozenset("dropbtn dropdown dropdown-toggle submenu sub-menu has-children menu-item-has-children expander disclosure".split())
SENT = frozenset(("class", "id", "href", "role", "aria-label", "aria-labelledby", "title", "for", "type", "name", "content", *HOOKS))  # attributes that columns read

SPREAD = 16  # partitions of events for each of pages

EVENTS = (
    "page bigint, at int, last int, number int, parent int, depth int, tag string, attrs map<string,string>, text string, url string, hides boolean, "
    "text_from int, text_to int, css_status string, error string"
)


class Events(HTMLParser):
    """The events of a page in order, with implied ends for lists, tables, paragraphs, headings and links; stray ends are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"at": 0, "last": 0, "number": 0, "parent": None, "depth": 0, "tag": "#root", "all": {}, "text_from": 0, "text_to": 0}
        self.rows, self.open = [self.root], [self.root]
        self.count, self.numbers, self.texts = 1, 0, 0
        self.css: list[str] = []

    def _next(self) -> int:
        self.count += 1
        return self.count - 1

    def _close_to(self, depth: int) -> None:
        """Elements deeper than ``depth`` end here."""
        while len(self.open) > depth + 1:
            node = self.open.pop()
            node["last"], node["text_to"] = self._next(), self.texts
            if node["tag"] in BREAKING:
                self.rows.append({"at": node["last"], "tag": "/", "parent": node["number"]})

    def handle_starttag(self, tag, attrs):
        top = self.open[-1]["tag"]
        if top == "head" and tag not in IN_HEAD:
            self._close_to(len(self.open) - 2)
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth]["tag"]
            if name in SCOPES.get(top, ()):
                break
            if tag in CLOSED_BY.get(name, ()):
                self._close_to(depth - 1)
                break
            if name in BREAKING and name != "p":
                break
        self.numbers += 1
        node = {
            "at": self._next(), "last": self.count - 1, "number": self.numbers, "parent": self.open[-1]["number"], "depth": len(self.open), "tag": tag, "all": {k: v or "" for k, v in reversed(attrs)},
            "text_from": self.texts, "text_to": self.texts,
        }
        self.rows.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_to(len(self.open) - 2)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth]["tag"] == tag:
                self._close_to(depth - 1)
                return

    def handle_data(self, data):
        inside = self.open[-1]
        kind = inside["tag"]
        if kind == "style":
            self.css.append(data)
        elif kind == "title" or kind == "script" and inside["all"].get("type", "").lower() == LD:
            self.rows.append({"at": self._next(), "tag": "#title" if kind == "title" else "#ld", "parent": inside["number"], "text": data})
        elif kind not in SKIPPED:
            self.texts += 1
            self.rows.append({"at": self._next(), "tag": "#text", "parent": inside["number"], "text": data})

    def finish(self) -> None:
        self._close_to(0)
        self.root["last"], self.root["text_to"] = self._next(), self.texts


def hiding_rules(css: str) -> tuple[list[list[tuple]], bool]:
    """Selectors that hide, as chains of (tag, id, classes); and whether some could not be read."""
    rules, complete = [], True
    css = re.sub(r"(?s)/\*.*?\*/", "", css)
    css = re.sub(r"(?s)@[^{;]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", "", css)
    for selectors, body in re.findall(r"([^{}]+)\{([^{}]*)\}", css):
        if not HIDING.search(body):
            continue
        for selector in selectors.split(","):
            steps = selector.split()
            if any(not re.fullmatch(r"[\w-]*(?:[.#][\w-]+)*", s) for s in steps):
                complete = complete and ":" in selector
                continue
            chain = [(re.match(r"[\w-]*", s)[0].lower(), set(re.findall(r"#([\w-]+)", s)), set(re.findall(r"\.([\w-]+)", s))) for s in steps]
            if chain:
                rules.append(chain)
    return rules, complete


def _mark_hiding(rows: list[dict], rules: list[list[tuple]]) -> None:
    """Sets ``hides`` on elements that hide by themselves. ``done`` holds how many steps of each rule an element and its ancestors fit."""
    done: dict[int, tuple] = {0: (0,) * len(rules)}
    for row in rows:
        if "all" not in row or row["tag"] == "#root":
            continue
        attrs, before = row["all"], done[row["parent"]]
        row["hides"] = "hidden" in attrs or bool(HIDING.search(attrs.get("style", "")))
        if rules:
            now, classes = list(before), set(attrs.get("class", "").split())
            for i, chain in enumerate(rules):
                fits = lambda step: (not step[0] or row["tag"] == step[0]) and step[1] <= {attrs.get("id", "")} and step[2] <= classes  # noqa: E731, B023
                if before[i] >= len(chain) - 1 and fits(chain[-1]):
                    row["hides"] = True
                if before[i] < len(chain) - 1 and fits(chain[before[i]]):
                    now[i] += 1
            done[row["number"]] = tuple(now)
        else:
            done[row["number"]] = before


def events_of(html: str | None, base: str | None, extra_css: str | None) -> list[dict]:
    """All events of one page; the first is that of the root, with ``css_status`` and ``error``."""
    parser = Events()
    parser.root["error"] = None
    try:
        parser.feed(html or "")
        parser.close()
    except Exception as e:  # a page that the parser gives up on keeps what was read so far
        parser.root["error"] = f"{type(e).__name__}: {e}"[:200]
    parser.finish()
    css = "\n".join(parser.css) + "\n" + (extra_css or "")
    rules, complete = hiding_rules(css)
    parser.root["css_status"] = ("ok" if complete else "partial") if css.strip() else "none"
    _mark_hiding(parser.rows, rules)
    for row in parser.rows:
        attrs = row.pop("all", None)
        if attrs is None:
            continue
        row["attrs"] = [(k, v) for k, v in attrs.items() if k in SENT or k.startswith(HOOK_STARTS)]
        href = attrs.get("href", "").strip()
        if row["tag"] == "a" and href and not href.lower().startswith(("mailto:", "tel:", "javascript:", "#")):
            try:
                row["url"] = urldefrag(urljoin(base or "", href)).url
            except ValueError:
                pass
    return parser.rows


def parts_of(df: DataFrame) -> int:
    """Into how many partitions the events of these pages are dealt."""
    return SPREAD * max(df.rdd.getNumPartitions(), 1)


def events(df: DataFrame, html_col: str = "html", base_col: str = "url", css_col: str | None = None, keep: tuple[str, ...] = ("url",), parts: int | None = None) -> DataFrame:
    """Rows of ``EVENTS``, dealt by page; the ``keep`` columns of a page stand on its root, in ``given``.

    They are dealt into ``parts``, by default ``SPREAD`` for each partition of the pages: events press so well that partitions joined by their
    size would hold gigabytes once they are read. Give ``parts`` where ``df`` has a shuffle, which is else run to count its partitions.
    """
    given = F.struct(*[F.col(f"`{k}`").alias(k) for k in keep])
    css = F.col(css_col) if css_col else F.lit("")
    pages = df.select(F.monotonically_increasing_id().alias("page"), F.col(html_col).alias("html"), F.col(base_col).alias("base"), css.alias("css"), given.alias("given"))
    kind = dict(pages.dtypes)["given"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = "at last number parent depth tag attrs text url hides text_from text_to css_status error".split()
        types = [pa.int32()] * 5 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string()]

        def out(rows, pages, roots, given):
            columns = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)]
            return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), *columns, given.take(pa.array(roots, pa.int32()))], names=["page", *names, "given"])

        for batch in batches:
            rows, pages, roots = [], [], []
            for i, (page, html, base, css) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(4)])):
                made = events_of(html, base, css)
                rows += made
                pages += [page] * len(made)
                roots += [i] + [None] * (len(made) - 1)
                if len(rows) >= 20_000:
                    yield out(rows, pages, roots, batch.column(4))
                    rows, pages, roots = [], [], []
            if rows:
                yield out(rows, pages, roots, batch.column(4))

    return pages.mapInArrow(run, f"{EVENTS}, given {kind}").repartition(parts or parts_of(df), "page")


def _any(words, of: Column) -> Column:
    return of.isin(*sorted(words))


def _region(tag: Column, classes: Column, inside: Column) -> Column:
    """The region that an element opens, by landmark or by the class of site furniture; null for none."""
    word = F.lower(F.regexp_extract(classes, FURNITURE, 1))
    part = lambda i: F.regexp_extract(classes, FURNITURE, i) != ""
    furniture = F.when(part(2) | word.isin("header", "bar"), "header").when(part(3) | (word == "footer"), "footer").when(part(5), "aside").otherwise("nav")
    landmark = F.when(_any(LANDMARKS, tag) & ~(inside & tag.isin("header", "footer")), tag)
    return F.coalesce(landmark, F.when(~tag.isin("html", "body") & classes.rlike(FURNITURE), furniture))


def placed(rows: DataFrame, keep_hidden: bool = False) -> DataFrame:
    """``events`` with what the intervals say.

    For elements: ``live`` (neither hidden nor inside what is never shown), ``region``, ``leaf`` (a block without a block inside), ``has_media``, ``in_nav``, ``in_label``,
    ``has_submenu`` (the next list, division or nav beside it has two links or more), ``nth`` of ``siblings`` of one tag, ``first_url`` (no earlier link of the page goes there).
    For texts: ``piece``, the words with the separator ahead of them; null where nothing is visible.
    """
    tag, at, last = F.col("tag"), F.col("at"), F.col("last")
    classes = F.coalesce(F.col("attrs")["class"], F.lit(""))
    order, back = W.partitionBy("page").orderBy("at"), W.partitionBy("page").orderBy(F.desc("at"))
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    after = back.rowsBetween(W.unboundedPreceding, -1)
    within = lambda what, frame: F.coalesce(F.max(F.when(what, last)).over(frame) >= at, F.lit(False))  # noqa: E731  some open element is of this kind
    nearest = lambda what, value: F.last(F.when(what, value), ignorenulls=True).over(after)  # noqa: E731  the first one that follows

    is_element = F.col("number") > 0
    block, link = _any(BLOCK, tag), (tag == "a") & F.col("attrs")["href"].isNotNull()
    media = _any(MEDIA, tag) | (tag.isin("i", "span") & classes.rlike(ICON))
    hidden = F.lit(False) if keep_hidden else within(F.col("hides"), upto)
    rows = rows.withColumns({
        "_hidden": hidden, "_skipped": within(_any(SKIPPED, tag), upto), "_unshown": within(_any(SKIPPED - {"head"}, tag), before), "_inside": within(tag.isin("article", "main"), upto),
        "in_nav": within(tag.isin("nav", "header"), before), "in_label": within(tag == "label", before),
        "_next_block": nearest(block, at), "_next_media": nearest(media, at), "_next_link": nearest(link, at),
    })
    shown = ~F.col("_hidden") & ~F.col("_skipped")
    plain = F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " ")
    rows = rows.withColumns({
        "live": is_element & ~F.col("_hidden") & ~F.col("_unshown"), "leaf": block & F.coalesce(F.col("_next_block") > last, F.lit(True)), "has_media": F.coalesce(F.col("_next_media") <= last, F.lit(False)),
        "_opens": F.when(is_element, _region(tag, classes, F.col("_inside"))), "_plain": F.when(shown & (tag == "#text"), plain), "_breaks": shown & (_any(BREAKING, tag) | (tag == "/")),
        "_two": F.when(link, F.struct(at.alias("first"), F.col("_next_link").alias("second"))),
    })
    blank = F.trim("_plain") == ""
    piece = F.coalesce(F.trim("_plain") != "", F.lit(False))
    two = F.last("_two", ignorenulls=True).over(after)
    rows = rows.withColumns({
        "_outer": F.col("_opens").isNotNull() & ~within(F.col("_opens").isNotNull(), before), "_n_breaks": F.count(F.when(F.col("_breaks"), 1)).over(upto),
        "_n_blanks": F.count(F.when(blank, 1)).over(upto), "_menu": F.coalesce((two["first"] <= last) & (two["second"] <= last), F.lit(False)),
    })
    region = F.last(F.when(F.col("_outer"), F.struct("last", F.col("_opens").alias("name"))), ignorenulls=True).over(upto)
    previous = F.last(F.when(piece, F.struct("_n_breaks", "_n_blanks", F.col("_plain").rlike(" $").alias("space"), F.col("_plain").rlike(r"[\p{L}\p{N}] ?$").alias("word"))), ignorenulls=True).over(before)
    rows = rows.withColumns({"_region": region, "_previous": previous})
    p = F.col("_previous")
    apart = (
        F.when(p.isNull(), "").when(p["_n_breaks"] != F.col("_n_breaks"), "\n")
        .when(p["space"] | F.col("_plain").startswith(" ") | (p["_n_blanks"] != F.col("_n_blanks")), " ")
        .when(p["word"] & F.col("_plain").rlike(r"^[\p{L}\p{N}]"), " ").otherwise("")
    )
    beside = W.partitionBy("page", "parent").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    same = W.partitionBy("page", "parent", "tag")
    return rows.withColumns({
        "region": F.when(F.coalesce(F.col("_region.last") >= at, F.lit(False)), F.col("_region.name")).otherwise("body"),
        "piece": F.when(piece, F.concat(apart, F.trim("_plain"))),
        "has_submenu": F.coalesce(F.last(F.when(tag.isin("ul", "div", "nav"), F.col("_menu")), ignorenulls=True).over(beside), F.lit(False)),
        "nth": F.row_number().over(same.orderBy("at")), "siblings": F.count("*").over(same),
        "first_url": F.col("url").isNotNull() & (F.row_number().over(W.partitionBy("page", "url").orderBy("at")) == 1),
    }).drop("_hidden", "_skipped", "_unshown", "_inside", "_next_block", "_next_media", "_next_link", "_opens", "_plain", "_breaks", "_two", "_outer", "_n_breaks", "_n_blanks", "_menu", "_region", "_previous")


def elements(df: DataFrame, html_col: str = "html", base_col: str = "url", css_col: str | None = None, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row an element: ``keep``, number (in the order of the page), parent, depth, at and last (its interval), tag, attrs and what ``placed`` finds."""
    rows = placed(events(df, html_col, base_col, css_col, keep))
    given = F.first("given", ignorenulls=True).over(W.partitionBy("page").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("given", given).where("number > 0")
    columns = "number parent depth at last tag attrs live region leaf has_media has_submenu nth siblings".split()
    return found.select(*[F.col(f"given.`{k}`").alias(k) for k in keep], *columns)
