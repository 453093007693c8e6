"""Text mining over a whole site: token ledger, typos by fuzzy join, spelling habits, run-together words, vocabularies, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.functions import text as T
from siftwell.operators.edit_join import near_pairs, within_one_edit
from siftwell.operators.page_rules import LOREM_PAGE, RULES, check_known_misspellings, check_scope, findings, lorem_markers, numbered, without_urls
from siftwell.sources.extract import extract_pages

# fixed values
SURFACES = (("visible_text", "page text"), ("title", "search-result title"), ("meta_description", "search-result description"))
OPENED_WORD = r"(?:(?:^|[.!?:;“\"])\s*)?[A-Za-z][A-Za-z']*(?:-[A-Za-z']+)*"
ENDINGS = ("s", "es", "'s", "ed", "d", "ing", "ly", "er", "ers", "est")
TOKEN = r"[A-Za-z][A-Za-z'’-]*"
PLACE_AFTER = r"^\s*,\s*(?:A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|P[AR]|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])\b"
ADDRESS_WORDS = "county counties city township borough parish avenue street road drive boulevard suite highway district village province".split()
BRITISH = (
    ("our", "or"), ("re$", "er"), ("res$", "ers"), ("ise", "ize"), ("isation", "ization"), ("yse", "yze"), ("lling", "ling"), ("lled", "led"),
    ("llor", "lor"), ("ence$", "ense"), ("ogue$", "og"), ("ae", "e"), ("oe", "e"),
)
CREDENTIALS = (
    "LMFT", "AMFT", "LCSW", "ACSW", "LPCC", "APCC", "MFTI", "CADC", "RADT", "CATC", "PsyD", "MSW", "LVN", "CDCA", "Licensed Marriage and Family Therapist",
    "Clinical Director", "Program Director",
)
BIOGRAPHY = (
    r"Attended\s+[A-Z]", "graduated from", "graduate of", "Originally from", "earned (his|her)", "received (his|her)", "holds a (BA|MA|BS|MS|degree)", "alma mater",
    "years of dedicated experience",
)
REVIEW_PHRASES = (
    "highly recommend", "would recommend", "recommend this place", "saved my life", "living proof", "best decision", "thank you so much", "the staff (is|are|was|were)",
    "staff really", "really cared", "changed my life", "forever grateful",
)
FIRST_PERSON = ("I", "I’m", "I'm", "I’ve", "I've", "my", "me")
EVALUATIVE = ("amazing", "wonderful", "helpful", "caring", "incredible", "awesome", "great", "beyond helpful", "top notch", "grateful", "blessed", "life[- ]changing")
PERSONAL_PAGES = ("about-us", "about", "our-team", "team", "staff", "leadership", "meet-the-team", "testimonial", "testimonials", "reviews", "alumni")
PREFIXES = "re de un non pre post over under anti semi multi co mis sub inter intra extra micro macro hyper hypo dis out self".split()
SUFFIXES = "s es ed ing ly er ers ion ions al able ment ments ness".split()


def one_of(words: list[str]) -> str:
    """A pattern of any of the words that tries one branch for each next letter, not each word."""
    heads = sorted({w[0] for w in words if w})
    branches = [h + one_of([w[1:] for w in words if w.startswith(h)]) for h in heads]
    return ("(?:" + "|".join(branches) + ")" + "?" * ("" in words) if len(branches) > 1 or "" in words else branches[0]) if branches else ""


def without_latin(blocks: DataFrame) -> DataFrame:
    """Blocks without three words of placeholder Latin; only blocks that have one are searched for all."""
    some = F.lower("text").rlike(f"(?<![a-z]){one_of(LOREM_PAGE)}(?![a-z])")
    latin = F.col("text").rlike(r"(?i)\b(?:" + "|".join(LOREM_PAGE) + r")\b") & (F.size(lorem_markers(F.col("text"), LOREM_PAGE)) >= 3)
    return blocks.where(~(some & latin))


def tokens(blocks: DataFrame, keep: tuple[str, ...] = ("brand", "url")) -> DataFrame:
    """``keep``, raw, token of every word of the blocks; blocks of placeholder Latin and web addresses are left out."""
    clean = without_latin(blocks).select(*keep, without_urls(F.col("text")).alias("clean"))
    words = clean.select(*keep, F.posexplode(F.regexp_extract_all("clean", F.lit(TOKEN), F.lit(0))).alias("at", "raw"))
    trimmed = words.withColumn("raw", F.btrim("raw", F.lit("'’-")))
    whole = (F.length("raw") >= 5) & (F.translate("raw", "'’-", "") == F.col("raw"))  # a match of TOKEN has no other letters than A-Z
    return trimmed.where(whole).withColumn("token", F.lower("raw"))


def places(blocks: DataFrame) -> DataFrame:
    """brand, token of words that a state code follows, as in a town's address; not words one edit from a word of addresses, as "coutny" is one misspelled."""
    found = F.regexp_extract_all("text", F.lit(rf"({TOKEN}){PLACE_AFTER[1:]}"), F.lit(1))
    named = blocks.select("brand", F.explode(found).alias("t")).select("brand", F.lower("t").alias("token")).distinct()
    misspelled = F.lit(False)
    for word in ADDRESS_WORDS:
        misspelled = misspelled | within_one_edit(F.col("token"), F.lit(word)) | (F.col("token") == word)
    return named.where(~misspelled)


def token_ledger(blocks: DataFrame) -> DataFrame:
    """brand, token, freq, ever_lower, example_url. Counts are partial sums before the shuffle; no text is kept.

    The least of strings is found by sorting, whose first key is the token: of brands, one prefix is that of most rows.
    """
    lower = F.substring("raw", 1, 1) == F.substring("token", 1, 1)
    sums = tokens(blocks).groupBy("token", "brand").agg(F.count("*").alias("freq"), F.bool_or(lower).alias("ever_lower"), F.min("url").alias("example_url"))
    return sums.select("brand", "token", "freq", "ever_lower", "example_url")


def with_places_and_examples(ledger: DataFrame, blocks: DataFrame, pad: int = 60) -> DataFrame:
    """Adds placelike (a state code follows the word somewhere) and example_text: the words around its first place on its example page.

    Blocks meet the list of words that their page is to show; a block's text is cut before anything but its few matches is dealt again.
    """
    wanted = ledger.groupBy("brand", F.col("example_url").alias("url")).agg(F.collect_set("token").alias("wanted"))
    words = F.transform(F.regexp_extract_all("whole", F.lit(TOKEN), F.lit(0)), lambda w: F.regexp_replace(w, "^['’-]+|['’-]+$", ""))
    shown = without_latin(blocks).join(wanted, ["brand", "url"]).select("brand", "url", "pos", "wanted", without_urls(F.col("text")).alias("whole")).withColumn("raws", words)
    shown = shown.withColumn("lows", F.transform("raws", F.lower))
    met = shown.select("brand", "url", "pos", "whole", "raws", "lows", F.explode(F.array_intersect("lows", "wanted")).alias("token"))
    raw = F.element_at("raws", F.array_position("lows", F.col("token")).cast("int"))
    at = F.instr(F.col("whole"), F.col("raw")) - 1
    example = F.trim(F.substring(F.col("whole"), F.greatest(at - pad, F.lit(0)) + 1, F.length("raw") + pad + F.least(at, F.lit(pad))))
    met = met.withColumn("raw", raw).select("brand", F.col("url").alias("example_url"), "token", "pos", example.alias("example_text"))
    first = met.groupBy("brand", "example_url", "token").agg(F.min_by("example_text", "pos").alias("example_text"))
    marked = ledger.join(places(blocks).withColumn("placelike", F.lit(True)), ["brand", "token"], "left").withColumn("placelike", F.coalesce("placelike", F.lit(False)))
    return marked.join(first, ["brand", "example_url", "token"], "left")


def fuzzy_pairs(rare: DataFrame, common: DataFrame) -> DataFrame:
    """Both: brand, token. Pairs of one site one edit apart."""
    return near_pairs(rare, common, 1, ("brand",)).select("brand", F.col("a").alias("rare"), F.col("b").alias("common"))


def fuzzy_pairs_two(rare: DataFrame, common: DataFrame) -> DataFrame:
    """Both: token. Pairs two edits apart or fewer."""
    return near_pairs(rare, common, 2).select(F.col("a").alias("rare"), F.col("b").alias("common"))


def affix_stems(word: Column, least: int = 6) -> Column:
    """What is left of the word without a common prefix or suffix."""
    stems = [F.when(word.startswith(p) & (F.length(word) >= len(p) + least), F.substring(word, F.lit(len(p) + 1), F.length(word))) for p in PREFIXES]
    stems += [F.when(word.endswith(s) & (F.length(word) >= len(s) + least), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in SUFFIXES]
    return F.array_compact(F.array(*stems))


def mined_typos(ledger: DataFrame, dictionary: DataFrame | None = None, rare_most: int = 3, common_least: int = 100, place_names: DataFrame | None = None) -> DataFrame:
    """Rare words one edit from a common one of the same site; brand, token, correct (all candidates in order), freq.

    ``dictionary`` (token) only acquits: the word itself, or its stem without an affix. Plurals of the common word, place
    names and, for words never seen in lower case, common words that are, are no candidates.
    """
    rare = ledger.where(F.col("freq") <= rare_most)
    if dictionary is not None:
        stems = rare.select("brand", "token", F.explode(F.concat(F.array("token"), affix_stems(F.col("token")))).alias("stem"))
        known = stems.join(dictionary.select(F.col("token").alias("stem")).distinct(), "stem", "left_semi").select("brand", "token").distinct()
        rare = rare.join(known, ["brand", "token"], "left_anti")
    if place_names is not None:
        rare = rare.join(place_names, ["brand", "token"], "left_anti")
    common = ledger.where(F.col("freq") >= common_least)
    pairs = fuzzy_pairs(rare, common).where((F.col("rare") != F.concat("common", F.lit("s"))) & (F.col("rare") != F.concat("common", F.lit("es"))))
    a = ledger.select("brand", F.col("token").alias("rare"), "freq", F.col("ever_lower").alias("rare_lower"), "example_url")
    b = ledger.select("brand", F.col("token").alias("common"), F.col("ever_lower").alias("common_lower"))
    fit = pairs.join(a, ["brand", "rare"]).join(b, ["brand", "common"]).where(F.col("rare_lower") | ~F.col("common_lower"))
    return fit.groupBy("brand", F.col("rare").alias("token")).agg(F.array_sort(F.collect_set("common")).alias("candidates"), F.first("freq").alias("freq"), F.first("example_url").alias("url"))


def is_british(wrong: Column, correct: Column) -> Column:
    """A suffix or letter rule turns ``wrong`` into exactly ``correct``."""
    fits = F.lit(False)
    for uk, us in BRITISH:
        if uk.endswith("$"):
            fits = fits | (wrong.endswith(uk[:-1]) & (F.concat(F.substring(wrong, F.lit(1), F.length(wrong) - len(uk[:-1])), F.lit(us)) == correct))
        else:
            fits = fits | (wrong.contains(uk) & (F.regexp_replace(wrong, f"^(.*?){uk}", f"$1{us}") == correct))
    return fits


def american_forms(word: Column) -> Column:
    """The word by each British rule that fits it."""
    out = []
    for uk, us in BRITISH:
        if uk.endswith("$"):
            out.append(F.when(word.endswith(uk[:-1]), F.concat(F.substring(word, F.lit(1), F.length(word) - len(uk[:-1])), F.lit(us))))
        else:
            out.append(F.when(word.contains(uk), F.regexp_replace(word, f"^(.*?){uk}", f"$1{us}")))
    return F.array_compact(F.array(*out))


def british_variants(typos: DataFrame, least: int = 2) -> DataFrame:
    """Splits ``mined_typos``: a site with ``least`` British forms or more has one finding for all, the rest stay single."""
    marked = typos.withColumn("british", is_british(F.col("token"), F.get("candidates", F.lit(0))))
    sums = marked.where("british").groupBy("brand").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    site = sums.where(F.col("n") >= least).select("brand", F.lit("british_spelling").alias("class"), F.lit("").alias("token"), "url", "n")
    single = marked.join(site.select("brand", F.lit(True).alias("british")), ["brand", "british"], "left_anti")
    return site.unionByName(single.select("brand", F.lit("mined").alias("class"), "token", "url", F.lit(1).cast("long").alias("n")))


def run_together(words: DataFrame, vocabulary: DataFrame, dictionary: DataFrame | None = None, least_chars: int = 16, parts: int = 3, coverage: float = 0.8, tail: int = 4) -> DataFrame:
    """``words``: token. ``vocabulary``: token of frequent words. Long tokens that are ``parts`` frequent words or more without spaces.

    Works on distinct tokens: all substrings meet the vocabulary in one semi-join, which can send the words to the tasks but never the substrings,
    many times more than the tokens they are estimated by; and a fold over the token's matches in order of
    their ends keeps for each place the split whose last word is longest. Of the ends that leave at most ``tail`` letters the last one counts.
    Words of the vocabulary have 3 to 24 letters.
    """
    long = words.select("token").distinct().where(F.col("token").rlike("^[a-z]{%d,}$" % least_chars))
    if dictionary is not None:
        long = long.join(dictionary.select("token").distinct(), "token", "left_anti")
    starts = F.sequence(F.lit(1), F.length("token") - 2)
    spans = long.select("token", F.explode(starts).alias("i")).select("token", "i", F.explode(F.sequence(F.lit(3), F.least(F.length("token") - F.col("i") + 1, F.lit(24)))).alias("n"))
    hit = spans.withColumn("part", F.expr("substring(token, i, n)")).join(vocabulary.select(F.col("token").alias("part")).distinct(), "part", "left_semi")
    edges = hit.groupBy("token").agg(F.sort_array(F.collect_list(F.struct((F.col("i") + F.col("n") - 1).alias("end"), (F.col("i") - 1).alias("start"), F.col("n").alias("n")))).alias("edges"))
    size = F.length("token")
    kind = "array<struct<covered:int,parts:int>>"
    start = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.when(i == 0, 0).otherwise(-1).alias("covered"), F.lit(0).alias("parts"))).cast(kind)

    def step(best: Column, e: Column) -> Column:
        before, here = F.get(best, e["start"]), F.get(best, e["end"])
        better = (before["covered"] >= 0) & (before["covered"] + e["n"] > here["covered"])
        new = F.struct((before["covered"] + e["n"]).alias("covered"), (before["parts"] + 1).alias("parts"))
        return F.transform(best, lambda b, i: F.when((i == e["end"]) & better, new).otherwise(b)).cast(kind)

    best = F.aggregate("edges", start, step)
    ends = F.filter(F.slice(F.reverse(best), 1, tail + 1), lambda b: b["covered"] >= size * coverage)
    return edges.select("token", F.get(ends, F.lit(0))["parts"].alias("parts")).where(F.col("parts") >= parts)


def check_run_together(blocks: DataFrame, vocabulary: DataFrame, dictionary: DataFrame | None = None, least_chars: int = 16) -> DataFrame:
    """``blocks``: url, text. A finding for each page and long small-letter token that ``run_together`` can split; a token beside a full stop is part of an address."""
    word = rf"(?<![\p{{L}}\p{{N}}_.])[a-z]{{{least_chars},}}(?![\p{{L}}\p{{N}}_.])"
    seen = blocks.select("url", F.explode(F.regexp_extract_all("text", F.lit(word), F.lit(0))).alias("token")).distinct()
    split = run_together(seen, vocabulary, dictionary, least_chars)
    return findings(seen.join(split, "token"), "empty_slot", "run_together", "warning", [F.col("token")], F.concat(F.col("parts").cast("string"), F.lit(" words run together")), matched=F.col("token"))


def unknown_words(words: DataFrame, dictionary: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``words``: brand, token. Tokens that neither the dictionary nor the allow list has, stems included."""
    stems = words.select("brand", "token").distinct().select("brand", "token", F.explode(F.concat(F.array("token"), affix_stems(F.col("token"), 3))).alias("stem"))
    known = dictionary.select(F.col("token").alias("stem"))
    if allowed is not None:
        known = known.unionByName(allowed.select(F.col("token").alias("stem")))
    ok = stems.join(known.distinct(), "stem", "left_semi").select("brand", "token").distinct()
    return words.select("brand", "token").distinct().join(ok, ["brand", "token"], "left_anti")


def words_as_written(pages: DataFrame) -> DataFrame:
    """url, brand, turn, location, pos, original of every place of the words of ``page_words``."""
    surfaces = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(where).alias("location"), F.translate(F.col(c), "’‘", "''").alias("text")) for i, (c, where) in enumerate(SURFACES)])
    texts = pages.select("url", "brand", F.explode(surfaces).alias("s")).where("s.text <> ''")
    found = texts.select("url", "brand", "s.turn", "s.location", F.posexplode(F.regexp_extract_all("s.text", F.lit(OPENED_WORD), F.lit(0))).alias("pos", "raw"))
    original = F.regexp_replace("raw", "^[^A-Za-z]+|['-]+$", "")
    opens = ~F.col("raw").rlike("^[A-Z]")
    return found.withColumn("original", original).where(F.col("original").rlike("^[a-z][a-z'-]{3,}$") | (opens & F.col("original").rlike("^[A-Z][a-z'-]{3,}$")))


def page_words(pages: DataFrame) -> DataFrame:
    """``pages``: url, brand, visible_text, title, meta_description. Words a dictionary can judge: url, brand, turn, location, word, original (as first written).

    Words of four letters or more without inner capitals; a capital counts as a name unless it opens a sentence.
    """
    fit = words_as_written(pages)
    return fit.groupBy("url", "brand", "turn", "location", F.lower("original").alias("word")).agg(F.min_by("original", "pos").alias("original"))


def inflection_stems(word: Column) -> Column:
    """What the word may be an ending of: the bare stem, with an e, or with y for i."""
    stems = []
    for s in ENDINGS:
        stem = F.substring(word, F.lit(1), F.length(word) - len(s))
        fits = word.endswith(s) & (F.length(stem) >= 3)
        short = F.substring(stem, F.lit(1), F.length(stem) - 1)
        stems += [F.when(fits, stem), F.when(fits, F.concat(stem, F.lit("e"))), F.when(fits & stem.endswith("i"), short), F.when(fits & stem.endswith("i"), F.concat(short, F.lit("y")))]
    return F.array_compact(F.array(*stems))


def corrections(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``unknown``: word; ``dictionary``: token, freq. word, fix: the most frequent token one edit away, else two; ties by letters."""
    no_brand = F.lit("").alias("brand")
    words, sums = unknown.select(F.col("word").alias("token")).distinct(), dictionary.groupBy("token").agg(F.max("freq").alias("freq"))
    best = lambda pairs: pairs.join(sums.withColumnRenamed("token", "common"), "common").groupBy(F.col("rare").alias("word")).agg(F.min(F.struct(-F.col("freq"), "common"))["common"].alias("fix"))
    one = best(fuzzy_pairs(words.select(no_brand, "token"), sums.select(no_brand, "token")))
    left = words.join(one.select(F.col("word").alias("token")), "token", "left_anti")
    return one.unionByName(best(fuzzy_pairs_two(left, sums)))


def check_vocabulary(pages: DataFrame, dictionary: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``vocabulary_findings`` with ``fix``, the word that was meant (null: none). On large tables, store the judged words in between."""
    return vocabulary_findings(pages, dictionary, allowed, with_fixes(unexplained_words(pages, dictionary, allowed), dictionary))


def with_fixes(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``words``: word. Adds ``fix``."""
    return words.join(corrections(words, dictionary), "word", "left").select(*words.columns, "fix")


def _words_and_slugs(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages whose brand is never null, and the words of their addresses as ``page_words`` has those of their texts."""
    pages = pages.withColumn("brand", F.coalesce("brand", F.lit("")))
    last = F.regexp_extract(F.regexp_replace(T.path(F.col("url")), "/+$", ""), "[^/]*$", 0)
    slugs = pages.select("url", "brand", F.lit(-1).alias("turn"), F.lit("page address").alias("location"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(last), F.lit("[a-z]{4,}"), F.lit(0)))).alias("word")).withColumn("original", F.col("word"))
    return pages, slugs


def unexplained_words(pages: DataFrame, dictionary: DataFrame, allowed: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """brand, word of ``vocabulary_findings``. Words meet the lists as a brand's distinct words; no address is dealt with them. ``keep`` stores those, as they are read four times."""
    pages, slugs = _words_and_slugs(pages)
    names = F.regexp_extract_all(F.lower(F.concat_ws(" ", "brand", F.regexp_extract("url", "^[^:]*://[^/?#]*", 0))), F.lit("[a-z]{3,}"), F.lit(0))
    of_brand = pages.select("brand", F.explode(names).alias("token")).distinct()
    words = words_as_written(pages).select("brand", F.lower("original").alias("word")).union(slugs.select("brand", "word")).distinct()
    words = keep(words, "words")
    lists = dictionary.select("token")
    if allowed is not None:
        each = F.explode(F.concat(F.array(F.lower("token")), F.filter(F.split(F.lower("token"), r"[\s/]+"), lambda p: F.length(p) >= 3)))
        lists = lists.union(allowed.select(each.alias("token")))
    parts = words.select("brand", "word", F.explode(F.when(F.contains("word", F.lit("-")), F.filter(F.split("word", "-"), lambda p: F.length(p) >= 4)).otherwise(F.array("word"))).alias("part"))
    forms = parts.select("brand", "word", "part", F.explode(F.concat(F.array("part"), inflection_stems(F.col("part")))).alias("token"))
    key = ["brand", "word", "part"]
    fine = forms.join(lists.distinct(), "token", "left_semi").select(*key).union(forms.join(of_brand, ["brand", "token"], "left_semi").select(*key)).distinct()
    whole = words.withColumn("token", F.col("word")).join(lists.distinct(), "token", "left_semi").select("brand", "word")
    return parts.join(fine, key, "left_anti").select("brand", "word").distinct().join(whole, ["brand", "word"], "left_anti")


def vocabulary_findings(pages: DataFrame, dictionary: DataFrame, allowed: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """``pages``: as for ``page_words``. ``dictionary``: token, freq. ``allowed``: token, of one word or several. Findings.

    Words in texts, titles, descriptions and the last part of the address that no list, no inflection and no word of the brand's name or
    host explains; of words with hyphens, each part of four letters or more is judged. Off by default: most of what it finds is rare, not wrong.
    ``judged``: what ``unexplained_words`` gives for the same pages, if it is stored; its further columns stay.
    """
    bad = unexplained_words(pages, dictionary, allowed) if judged is None else judged
    pages, slugs = _words_and_slugs(pages)
    seen = page_words(pages).unionByName(slugs)
    wrong = numbered(seen.join(bad, ["brand", "word"]).withColumn("in_slug", F.col("turn") < 0), ["word", "in_slug"], ["turn"])
    slot = F.when(F.col("in_slug"), "slug").otherwise(T.slot("word", F.col("nth")))
    issue = F.concat(F.lit("possible misspelling: "), F.col("original"))
    return findings(wrong, "spelling", slot, F.when(F.col("in_slug"), "error").otherwise("warning"), [F.col("word")], issue, F.col("location"), F.col("original"), F.col("word"), keep=tuple(c for c in bad.columns if c not in ("brand", "word")))


def domain_vocabulary(words: DataFrame, unknown: DataFrame, common: DataFrame, brands: int = 2, contexts: int = 3, span: int = 6, dictionary: DataFrame | None = None, two_edits: int = 10, ledger: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """``words``: brand, url, at, token. ``unknown``, ``common``, ``dictionary``: token. Unknown words over all sites, classed.

    british: a rule makes it a word of the dictionary (or a common one). typo: one edit from a common word, or two for words of up to
    ``two_edits`` letters in too few contexts. vocab: on several sites in several contexts. template_copy: the same context everywhere. else rare.

    A context is one hash of 64 bits from the window on: occurrences are dealt with that, not with their neighbours, and met by lists only as sums of a word.
    ``keep`` stores the sums and the pairs of words under a name: sums and pairs of one edit are read twice, and a plan with both joins in it fills the driver;
    words are sorted by a hash of their page first, as addresses begin alike. ``ledger``: token, brand of the words, if it is stored.
    """
    order = W.partitionBy(F.xxhash64("url"), "url", "brand").orderBy("at")
    around = F.concat_ws(" ", *[F.lag("token", i).over(order) for i in range(span, 0, -1)], *[F.lead("token", i).over(order) for i in range(1, span + 1)])
    rare, common = unknown.select("token").distinct(), common.select("token").distinct()
    met = words.select("token", F.xxhash64(around).alias("context")).groupBy("token", "context").agg(F.count("*").alias("n"))
    sums = met.groupBy("token").agg(F.count("*").alias("contexts"), F.sum("n").alias("freq"))
    sites = (words if ledger is None else ledger).select("token", "brand").distinct().groupBy("token").agg(F.count("brand").alias("brands"))
    sums = keep(sums.join(rare, "token", "left_semi").join(sites, "token").select("token", "brands", "contexts", "freq"), "sums")
    known = common if dictionary is None else common.union(dictionary.select("token")).distinct()
    forms = rare.select("token", F.explode(american_forms(F.col("token"))).alias("american")).join(known.select(F.col("token").alias("american")), "american")
    british = forms.groupBy("token").agg(F.min("american").alias("american"))
    no_brand = F.lit("").alias("brand")
    one = fuzzy_pairs(rare.select(no_brand, "token"), common.select(no_brand, "token")).groupBy(F.col("rare").alias("token")).agg(F.min("common").alias("one"))
    one = keep(one, "one")
    short = sums.where((F.length("token") <= two_edits) & (F.col("contexts") < contexts)).join(one, "token", "left_anti")
    two = keep(fuzzy_pairs_two(short.select("token"), common).groupBy(F.col("rare").alias("token")).agg(F.min("common").alias("two")), "two")
    cls = F.when(F.col("american").isNotNull(), "british").when(F.col("correct").isNotNull(), "typo").when((F.col("brands") >= brands) & (F.col("contexts") >= contexts), "vocab").when((F.col("freq") > 1) & (F.col("contexts") == 1), "template_copy").otherwise("rare")
    return sums.join(british, "token", "left").join(one, "token", "left").join(two, "token", "left").withColumn("correct", F.coalesce("american", "one", "two")).withColumn("class", cls).drop("american", "one", "two")


def proper_noun_allowlist(labels: DataFrame, gazetteer: DataFrame | None = None, wrong: DataFrame | None = None, brands: int = 2, name: str = r"\b[A-Z][a-z]{2,}\b") -> DataFrame:
    """``labels``: brand, text of titles and first headings. Capitalised words on several sites, with place names, without known mistakes.

    ``name`` is the pattern of a word; as it stands, letters beside A-Z are no edge of one.
    """
    words = labels.select("brand", F.explode(F.regexp_extract_all("text", F.lit(name), F.lit(0))).alias("w")).select("brand", F.lower("w").alias("token"))
    out = words.groupBy("token").agg(F.count_distinct("brand").alias("brands")).where(F.col("brands") >= brands).select("token")
    if gazetteer is not None:
        out = out.union(gazetteer.select("token")).distinct()
    return out if wrong is None else out.join(wrong.select("token").distinct(), "token", "left_anti")


def coverage_gate(found: DataFrame, audited: DataFrame, least: float = 0.9) -> DataFrame:
    """``audited``: brand, pages, read, partial. Findings of brands that were read nearly whole and are no sample."""
    fit = audited.where(~F.col("partial") & (F.col("read") >= F.col("pages") * least))
    return found.join(fit.select("brand"), "brand", "left_semi")


def precision_report(verdicts: DataFrame, floor: float = 0.8, least: int = 10) -> DataFrame:
    """``verdicts``: rule, verdict (true, false or unclear). Unclear rows count nowhere; too few judged rows decide nothing."""
    sums = verdicts.groupBy("rule").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("true", "false", "unclear")])
    judged = F.col("true") + F.col("false")
    return sums.withColumn("precision", F.round(F.try_divide(F.col("true"), judged), 6)).withColumn("passes", F.when(judged >= least, F.col("true") >= judged * floor))


def locator_report(attempts: DataFrame, intended: DataFrame, floor: float = 0.7, least: int = 10) -> DataFrame:
    """``attempts``: class, outcome (captured, uncapturable: found but without a box, none, many), copies (equal elements met). ``intended``: class, wanted.

    ``located`` is the share of selectors that found one element, ``hit`` that of pictures; the floor judges the former, as a missing box is the
    page's matter. Few attempts decide nothing, and a class that was wanted and never tried is ``not_measured``, not passed.
    """
    outcomes = ("captured", "uncapturable", "none", "many")
    sums = attempts.groupBy("class").agg(F.count("*").alias("attempted"), *[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes], F.count_if(F.col("copies") > 1).alias("via_copies"))
    both = sums.join(intended.groupBy("class").agg(F.sum("wanted").alias("wanted")), "class", "full").na.fill(0, ["attempted", *outcomes, "via_copies", "wanted"])
    found, n = F.col("captured") + F.col("uncapturable"), F.col("attempted")
    verdict = F.when(n == 0, "not_measured").when(n < least, "no_verdict").when(found >= n * floor, "ships").otherwise("below_floor")
    return both.withColumns({
        "located": F.round(F.try_divide(found, n), 6), "hit": F.round(F.try_divide(F.col("captured"), n), 6), "verdict": verdict, "partial": (n > 0) & (n < F.col("wanted")),
    })


def seed_mistakes(texts: DataFrame, mistakes: dict[str, str]) -> DataFrame:
    """``texts``: url, text. The texts with right words replaced by known wrong ones; url, text, wrong."""
    out = []
    for wrong, right in mistakes.items():
        hit = texts.where(F.col("text").rlike(rf"\b{right}\b"))
        out.append(hit.select("url", F.regexp_replace("text", rf"\b{right}\b", wrong).alias("text"), F.lit(wrong).alias("wrong")))
    frame = out[0]
    for f in out[1:]:
        frame = frame.unionByName(f)
    return frame


def known_defect_sweep(pages: DataFrame, known: dict[str, str], lower_only: dict[str, str]) -> DataFrame:
    """``pages``: brand and the columns of the rules. Per brand: pages, known mistakes in addresses and in bodies, pages that say county for country."""
    brands = pages.select("url", "brand").distinct()
    hits = check_known_misspellings(pages, known, lower_only).select("url", F.when(F.col("class").startswith("slug"), "slug_hits").otherwise("body_hits").alias("what"))
    scope = check_scope(pages).select("url", F.lit("scope_pages").alias("what")).distinct()
    each = brands.select("brand", F.lit("pages").alias("what")).union(hits.union(scope).join(brands, "url").select("brand", "what"))
    return each.groupBy("brand").pivot("what", ["pages", "slug_hits", "body_hits", "scope_pages"]).count().na.fill(0)


def hidden_text_impact(raw: DataFrame, rules: tuple[str, ...] = ("blank", "lorem_page", "placeholder", "empty_slot", "misspelling", "scope"), keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """``raw``: url, html. Findings of each rule, and visible characters, with hidden text read and without: what, before, after.

    ``keep`` stores the pages of either reading under a name, as all rules read them.
    """
    out = None
    for name, hidden in (("before", True), ("after", False)):
        pages = keep(extract_pages(raw, keep_hidden=hidden), name)
        counts = pages.agg(F.sum(F.length("visible_text")).alias("n")).select(F.lit("visible_chars").alias("what"), "n")
        for rule in rules:
            counts = counts.union(RULES[rule]["run"](pages).agg(F.count("*").alias("n")).select(F.lit(rule), "n"))
        counts = counts.withColumnRenamed("n", name)
        out = counts if out is None else out.join(counts, "what")
    return out


def seeded_recall(seeded: DataFrame, found: DataFrame) -> DataFrame:
    """``found``: url, matched. Share of seeded mistakes that were found, by mistake."""
    hit = seeded.join(found.select("url", F.lower("matched").alias("wrong")).distinct(), ["url", "wrong"], "left_semi").groupBy("wrong").agg(F.count("*").alias("hits"))
    return seeded.groupBy("wrong").agg(F.count("*").alias("n")).join(hit, "wrong", "left").na.fill(0, ["hits"]).withColumn("recall", F.round(F.col("hits") / F.col("n"), 6))


def visible_char_quantiles(pages: DataFrame) -> DataFrame:
    return pages.agg(F.min("visible_chars").alias("lo"), F.percentile("visible_chars", 0.1).alias("p10"), F.percentile("visible_chars", 0.5).alias("median"), F.max("visible_chars").alias("hi"))


def person_or_review(text: Column, url: Column) -> Column:
    """Staff biographies and reviews, by what they say or by the page they stand on: not the site's own claims."""
    review = (F.length(text) < 260) & text.rlike(_any(FIRST_PERSON)) & text.rlike("(?i)" + _any(EVALUATIVE))
    page = url.rlike("(?i)/(" + "|".join(PERSONAL_PAGES) + ")(/|$)")
    return text.rlike(_any(CREDENTIALS)) | text.rlike(_any(BIOGRAPHY)) | text.rlike("(?i)" + _any(REVIEW_PHRASES)) | review | page


def _any(words: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(words) + r")\b"
