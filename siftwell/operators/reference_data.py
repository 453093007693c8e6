"""Reference data and the rules that need it: number and location grids, phones of pages, structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.functions import text as T
from siftwell.operators.collapse import first_of
from siftwell.operators.ordered import forward_fill
from siftwell.operators.page_rules import findings, numbered, rule, union
from siftwell.sources.elements import HIDING

# fixed values
BUSINESS_TYPES = ("Organization", "LocalBusiness", "MedicalBusiness", "MedicalClinic", "MedicalOrganization", "Hospital", "Physician", "HealthAndBeautyBusiness")
LOCAL_TYPES = ("LocalBusiness", "MedicalBusiness", "MedicalClinic", "Hospital")


def parse_number_grid(rows: DataFrame) -> DataFrame:
    """``rows``: row_no, brand_cell, channel, number, retired. A brand cell opens a block that the rows below belong to.

    brand, e164, kind (national, location, retired); a number that is live anywhere in its brand is not retired.
    """
    cell = F.nullif(T.norm_whitespace(F.col("brand_cell")), F.lit(""))
    filled = forward_fill(rows.withColumn("_cell", cell), "row_no", "_cell", "brand")
    live = filled.withColumn("e164", T.e164_us(T.norm_whitespace(F.col("number")))).where("e164 is not null and brand is not null")
    live = live.select("brand", "e164", F.when(F.lower("channel").contains("national"), "national").otherwise("location").alias("kind")).distinct()
    gone = filled.withColumn("e164", T.e164_us(T.norm_whitespace(F.col("retired")))).where("e164 is not null and brand is not null").select("brand", "e164", F.lit("retired").alias("kind")).distinct()
    return live.unionByName(gone.join(live.select("brand", "e164"), ["brand", "e164"], "left_anti"))


def parse_location_grid(cells: DataFrame) -> DataFrame:
    """``cells``: row_no, row_label, values array. Rows are found by label, the first of several; a bare code in the code row opens a block of columns.

    brand, name, address of every column with an address.
    """
    label, labels = F.lower(T.norm_whitespace(F.col("row_label"))), ("code", "name", "address")
    starts = cells.select("row_no", "values", F.explode(F.array(*[F.when(label.startswith(x), x) for x in labels])).alias("label")).where("label is not null")
    first = starts.groupBy("label").agg(F.min_by("values", "row_no").alias("values"))  # three rows
    each = first.select("label", F.posexplode("values").alias("col", "value"))
    wide = each.groupBy("col").pivot("label", list(labels)).agg(F.first(T.norm_whitespace(F.col("value"))))
    code = F.when(F.col("code").rlike("^[A-Z]{2,6}$"), F.col("code"))
    block = forward_fill(wide.withColumn("_code", code), "col", "_code", "brand")
    return block.where("coalesce(address, '') <> '' and brand is not null").select("brand", "name", "address")


def hotline_numbers(grid: DataFrame, columns: tuple[int, ...]) -> DataFrame:
    """``grid``: values array. Distinct numbers of fixed columns: third parties that pages may name."""
    cells = grid.select(F.posexplode("values").alias("col", "value")).where(F.col("col").isin(*columns))
    return cells.select(T.e164_us(F.col("value")).alias("e164")).where("e164 is not null").distinct()


def number_owners(numbers: DataFrame) -> DataFrame:
    """e164, owners of numbers that are not retired."""
    return numbers.where("kind <> 'retired'").groupBy("e164").agg(F.array_sort(F.collect_set("brand")).alias("owners"))


def validate_numbers(brands: DataFrame, numbers: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Brands without any national number, which must not pass silently."""
    national = numbers.where("kind = 'national'").select("brand").distinct()
    return brands.select("brand").distinct().where(~F.col("brand").isin(*ignored) if ignored else F.lit(True)).join(national, "brand", "left_anti")


@rule("phone_dial", ("phone", "numbers"))
def check_phones_dial(pages: DataFrame, numbers: DataFrame) -> DataFrame:
    """``pages``: url, brand, actionables. Every tel: link against its text and the owners of the number it dials."""
    tel = pages.select("url", "brand", F.explode("actionables").alias("a")).where((F.col("a.tag") == "a") & F.lower(F.trim("a.href")).startswith("tel:"))
    raw = F.trim(F.expr("substring(trim(a.href), 5)"))
    tel = tel.select("url", "brand", F.col("a.pos").alias("pos"), F.col("a.text").alias("shown"), raw.alias("raw"))
    plain = F.regexp_replace(F.replace("raw", F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")  # a plus sign stands for itself, as does a percent sign without two digits
    tel = tel.withColumn("decoded", F.coalesce(F.try_url_decode(plain), "raw"))
    tel = tel.withColumns({"dials": T.e164_us(F.col("decoded")), "shows": F.when(F.col("shown").rlike(r"\d"), T.e164_us(F.col("shown")))})
    encoded = findings(tel.where("raw <> decoded"), "phone", "encoded_tel", "warning", [F.col("raw")], "tel: address is URL-encoded", F.lit("tel"), matched=F.col("raw"))
    malformed = findings(tel.where("dials is null"), "phone", "malformed", "warning", [F.col("decoded")], "malformed tel: number", F.lit("tel"), matched=F.col("decoded"))
    own = numbers.select("brand", F.col("e164").alias("dials"), "kind").groupBy("brand", "dials").agg(F.min(F.when(F.col("kind") == "retired", 1).otherwise(0)).alias("retired"))
    off = tel.where("shows is not null and dials is not null and shows <> dials").join(own, ["brand", "dials"], "left").join(number_owners(numbers).withColumnRenamed("e164", "dials"), "dials", "left")
    others = F.array_except(F.coalesce("owners", F.array().cast("array<string>")), F.array("brand"))
    off = off.withColumn("others", others).withColumn(
        "cls",
        F.when(F.col("retired") == 1, "dials_retired").when(F.col("retired") == 0, "display_dial_mismatch").when(F.size("others") == 1, "cross_brand_dial")
        .when(F.size("others") > 1, "display_dial_ambiguous").otherwise("display_dial_unknown"),
    )
    n = numbered(off, ["cls", "dials", "shows"], ["pos"])
    severity = F.when(F.col("cls").isin("dials_retired", "cross_brand_dial"), "error").otherwise("warning")
    dial = findings(n, "phone", T.slot(F.col("cls"), F.col("nth")), severity, [F.col("dials"), F.col("shows")], F.concat(F.lit("click-to-call: "), F.col("cls")), F.lit("tel"), F.concat_ws(" dials ", "shown", "dials"), F.col("dials"))
    return union(encoded, malformed, dial)


@rule("phone_page", ("phone", "numbers"), reads_visible_text=True)
def check_phones_page(pages: DataFrame, numbers: DataFrame, hotlines: DataFrame | None = None, judge_unlisted: bool = True) -> DataFrame:
    """``pages``: url, brand, visible_text. Numbers in the text that are not the brand's: retired, hotline or unknown.

    A brand whose numbers are all of kind ``flat`` has only a list of its own: what the list lacks is non_canonical, not unknown.
    Of brands without any number, all numbers are unknown; without ``judge_unlisted`` their pages are not judged.
    """
    lists = numbers.groupBy("brand").agg(F.bool_and(F.col("kind") == "flat").alias("flat"))
    seen = pages.select("url", "brand", F.explode(T.phones_in_text(F.col("visible_text"))).alias("e164"))
    own = numbers.groupBy("brand", "e164").agg(F.min(F.when(F.col("kind") == "retired", 1).otherwise(0)).alias("retired"))
    joined = seen.join(lists, "brand", "left" if judge_unlisted else "inner").join(own, ["brand", "e164"], "left").where("retired is null or retired = 1")
    if hotlines is not None:
        joined = joined.join(hotlines.select("e164", F.lit(True).alias("hotline")).distinct(), "e164", "left")
    else:
        joined = joined.withColumn("hotline", F.lit(None).cast("boolean"))
    cls = F.when(F.col("retired") == 1, "retired").when(F.col("hotline"), "hotline").when(F.col("flat"), "non_canonical").otherwise("unknown")
    severity = F.when(F.col("cls") == "retired", "error").when(F.col("cls") == "hotline", "info").otherwise("warning")
    return findings(joined.withColumn("cls", cls), "phone", F.col("cls"), severity, [F.col("e164")], F.concat(F.col("cls"), F.lit(" number on the page")), matched=F.col("e164"))


def cross_brand_rollup(found: DataFrame, owners: DataFrame) -> DataFrame:
    """``found``: brand, matched of dial findings. Leaks by (brand, owner): numbers and findings."""
    joined = found.join(owners.select(F.col("e164").alias("matched"), F.explode("owners").alias("owner")), "matched").where("brand <> owner")
    return joined.groupBy("brand", "owner").agg(F.count_distinct("matched").alias("numbers"), F.count("*").alias("findings"))


def unlisted_numbers(found: DataFrame, examples: int = 3) -> DataFrame:
    """``found``: brand, url, class, matched of dial findings. Dialled numbers that are in no list or in several others': findings, brands, shared, pages.

    ``shared``: several brands dial it, so that it is likely one line which the lists lack and not as many mistakes. ``pages``: the first by address.
    """
    hits = found.where(F.regexp_replace("class", "#.*$", "").isin("display_dial_unknown", "display_dial_ambiguous"))
    sums = hits.groupBy("matched", "brand").agg(F.count("*").alias("n")).groupBy("matched").agg(F.sum("n").alias("findings"), F.count("brand").alias("brands"))
    return sums.join(first_of(hits, ["matched"], "url", examples, "pages"), "matched").withColumn("shared", F.col("brands") > 1)


def json_ld_nodes(pages: DataFrame) -> DataFrame:
    """url, block, valid, and of every node (top level, list item or ``@graph`` child): types, name, telephone, address.

    Invalid JSON gives one row with ``valid`` false.
    """
    raw = pages.select("url", F.posexplode("json_ld").alias("block", "raw")).withColumn("v", F.try_parse_json("raw"))
    text = lambda path: F.try_variant_get("n", path, "string")
    shape = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.coalesce(F.try_variant_get("v", "$.@graph", "array<variant>"), F.array("v")))
    nodes = raw.select("url", "block", F.col("v").isNotNull().alias("valid"), F.explode_outer(F.when(F.col("v").isNotNull(), shape)).alias("n"))
    kinds = F.coalesce(F.try_variant_get("n", "$.@type", "array<string>"), F.when(text("$.@type").isNotNull(), F.array(text("$.@type"))), F.array().cast("array<string>"))
    address = F.coalesce(F.concat_ws(", ", text("$.address.streetAddress"), text("$.address.addressLocality"), text("$.address.addressRegion"), text("$.address.postalCode")), F.lit(""))
    address = F.coalesce(F.nullif(address, F.lit("")), text("$.address"))
    return nodes.select("url", "block", "valid", kinds.alias("types"), text("$.name").alias("name"), text("$.telephone").alias("telephone"), address.alias("address"))


@rule("schema", ("schema", "numbers", "locations"))
def check_structured_data(pages: DataFrame, brands: DataFrame, numbers: DataFrame, locations: DataFrame) -> DataFrame:
    """``pages``: url, brand, json_ld. ``brands``: brand, name. Business nodes against the brand's name, numbers and addresses."""
    nodes = json_ld_nodes(pages)
    invalid = findings(nodes.where("not valid").select("url", "block").distinct(), "schema", "invalid_json", "error", [F.col("block")], "structured data is not valid JSON", "head")
    kinds = lambda names: F.arrays_overlap("types", F.array(*[F.lit(t) for t in names]))
    business = nodes.where(F.col("valid") & kinds(BUSINESS_TYPES)).join(pages.select("url", "brand").distinct(), "url")
    none = pages.select("url").distinct().join(business.select("url").distinct(), "url", "left_anti")
    missing = findings(none, "schema", "missing", "error", [], "no business in the structured data", "head")
    local = kinds(LOCAL_TYPES)
    gaps = F.array_compact(F.array(F.when(local & (F.coalesce("telephone", F.lit("")) == ""), "no_telephone"), F.when(local & (F.coalesce("address", F.lit("")) == ""), "no_address")))
    named = business.join(brands.select("brand", F.col("name").alias("brand_name")), "brand", "left")
    gap = findings(business.withColumn("c", F.explode(gaps)), "schema", F.col("c"), "warning", [F.col("block")], F.concat(F.lit("structured data: "), F.col("c")), "head")
    other = findings(named.where(~F.contains(F.lower("name"), F.lower("brand_name"))), "schema", "name", "warning", [F.col("name")], "the name lacks the brand", "head", matched=F.col("name"))
    e164 = business.where("telephone is not null").withColumn("e164", T.e164_us(F.col("telephone"))).where("e164 is not null")
    foreign = e164.join(numbers.select("brand", "e164").distinct(), ["brand", "e164"], "left_anti").join(number_owners(numbers), "e164", "left")
    phone = findings(foreign, "schema", F.when(F.col("owners").isNotNull(), "phone_other_brand").otherwise("phone_unknown"), F.when(F.col("owners").isNotNull(), "error").otherwise("warning"), [F.col("e164")], "the telephone is not the brand's", "head", matched=F.col("e164"))
    keyed = lambda c: F.array_compact(F.array(T.norm_address(c), T.address_key(c)))
    known = locations.select("brand", F.explode(keyed(F.col("address"))).alias("k")).distinct()
    with_address = business.where("coalesce(address, '') <> ''").withColumn("row", F.xxhash64("url", "block", "name", "address"))
    fine = with_address.select("row", "brand", F.explode(keyed(F.col("address"))).alias("k")).join(known, ["brand", "k"], "left_semi").select("row").distinct()
    strange = with_address.join(locations.select("brand").distinct(), "brand", "left_semi").join(fine, "row", "left_anti")
    address = findings(strange, "schema", "address", "warning", [F.col("address")], "the address is none of the brand's", "head", matched=F.col("address"))
    return union(invalid, missing, gap, other, phone, address)


def css_health(sheets: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """``sheets``: brand, url, status (null: no answer), capped. none, ok, partial or unavailable; a sheet that does not exist (404, 410) is no loss.

    ``brands``: brand. Those without any sheet are none; they have no row where it is not given.
    """
    read = F.coalesce(F.col("status") == 200, F.lit(False))
    lost = ~read & ~F.coalesce(F.col("status").isin(404, 410), F.lit(False))
    sums = sheets.groupBy("brand").agg(F.count_if(read).alias("read"), F.count_if(lost).alias("lost"), F.bool_or("capped").alias("capped"))
    status = F.when((F.col("read") == 0) & (F.col("lost") > 0), "unavailable").when((F.col("lost") > 0) | F.col("capped"), "partial").otherwise("ok")
    known = sums.select("brand", status.alias("css_status"))
    return known if brands is None else brands.select("brand").distinct().join(known, "brand", "left").na.fill("none", ["css_status"])


def hiding_styles(sheets: DataFrame) -> DataFrame:
    """``sheets``: brand, pos, status, body. brand, css: rules of the sheets that were read, as far as they hide something, in order.

    A sheet is cut at its braces and the depth of each piece is a running sum, so rules inside media queries and other at-rules are left out
    however they nest. Only rules that hide reach the pages: whole sheets, joined to each page of their brand, would be larger than the pages.
    """
    plain = F.regexp_replace(F.regexp_replace("body", r"(?s)/\*.*?\*/", ""), "@[^{};]*;", "")
    cut = sheets.where("status = 200").select("brand", "pos", F.posexplode(F.regexp_extract_all(plain, F.lit(r"[^{}]*[{}]"), F.lit(0))).alias("i", "piece"))
    opens = F.endswith("piece", F.lit("{"))
    w = W.partitionBy("brand", "pos").orderBy("i")
    placed = cut.withColumns({"depth": F.sum(F.when(opens, 1).otherwise(-1)).over(w), "body": F.lead("piece").over(w)})
    rule_ = placed.where(opens & (F.col("depth") == 1) & ~F.ltrim("piece").startswith("@") & F.endswith("body", F.lit("}")) & F.col("body").rlike("(?i)" + HIDING.pattern))
    kept = rule_.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("pos", "i", F.concat("piece", "body").alias("rule")))).alias("rules"))
    return kept.select("brand", F.array_join(F.transform("rules", lambda r: r["rule"]), "\n").alias("css"))


def masked_number(e164: Column) -> Column:
    """For reports that must not print whole numbers."""
    return F.regexp_replace(e164, r"\d(?=\d{4})", "•")
