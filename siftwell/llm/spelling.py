"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Words are counted over all texts. The gram dictionary holds the most frequent grams of 3 to ``q_max`` code points (``max_grams`` at most;
any dictionary gives the same links, a good one shorter lists); grams of 2 always count as in it. A word is decomposed into the longest
dictionary gram from each place, without those that an earlier one covers. For each place of an edit, a bound of the grams
it can touch follows from the dictionary's prefixes and suffixes; the most of all places is the word's bound. Two words one edit apart share
all grams but so many, left of the edit at the same place from the start, right of it at the same place from the end. So both
words need only their rarest grams in the index, one more than the bound. On one side of a shared gram nothing is edited, so the lists of a
gram meet by length, place and that side. What meets is verified by its edit distance.

A word whose bound leaves no shared gram (short words of long grams) has all its grams in the index, and a second index with grams of 2 and
3 only joins two words of this kind: there an edit touches five code points at most, so words of seven always keep a gram.

Null texts have no words, null ids count as empty text in the hash. Words of any length are read whole. Equal rows are
separate occurrences. Ties of counts go by code point. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import give_back, stored, text_slices

Q_MIN, Q_MAX, MAX_GRAMS = 2, 4, 2_000  # more or longer grams leave words of few grams without a bound, which doubles their lists
LEAST = 7  # code points of a word; below six, an edit may leave no gram of 2 and 3
_HELD = 200_000  # distinct words a task counts before it hands them on


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, every: int = 31) -> DataFrame:
    """(word, n) of all runs of letters of ``least`` code points or more, A-Z lower-cased.

    Where ``every`` divides the CRC-32 of ``<id>:<run>``, the run has lost a code point (0: never).
    """

    def run(batches: Iterator) -> Iterator:
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        letters = re.compile(f"[a-z\\u00C0-\\u00FF]{{{least},}}")
        total: Counter = Counter()
        held = 0

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for part in text_slices(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    for word, n in Counter(letters.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                        h = zlib.crc32(f"{key or ''}:{word}".encode()) if every else 1
                        if every and h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        if word not in total:
                            held += 1 + len(word) // 64
                        total[word] += n
                if held >= _HELD:
                    yield out()
                    held = 0
        if total:
            yield out()
        give_back()

    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, q_max: int = Q_MAX) -> DataFrame:
    """(gram, n): how many places of the words each gram of 3 to ``q_max`` code points stands at."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        total: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])
            total.clear()
            return batch

        for batch in batches:
            for word in batch.column(0).to_pylist():
                for q in range(Q_MIN + 1, q_max + 1):
                    total.update([word[i : i + q] for i in range(len(word) - q + 1)])
                if len(total) >= _HELD:
                    yield out()
        if total:
            yield out()

    return words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class GramIndex:
    """Decomposes words by a dictionary of grams with their counts."""

    def __init__(self, counts: dict[str, int], q_max: int = Q_MAX):
        self.counts, self.q_max = counts, q_max
        self.prefixes = {g[:i] for g in counts for i in range(1, len(g))}  # proper ones
        self.suffixes = {g[i:] for g in counts for i in range(1, len(g))}

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """(begin, end) of the longest dictionary gram from each place that no earlier one covers."""
        out, reach, size, counts = [], 0, len(word), self.counts
        for begin in range(size - Q_MIN + 1):
            end = begin + Q_MIN
            for longest in range(min(begin + self.q_max, size), end, -1):
                if word[begin:longest] in counts:
                    end = longest
                    break
            if end > reach:
                out.append((begin, end))
                reach = end
        return out

    def bound(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can touch.

        An edit at a place changes the grams over it; a gram that ends before it changes only if the dictionary can run on from there
        into the edit, from its begin or an earlier one, and likewise to the right. Begins and ends of grams both rise, so they are neighbours.
        """
        size, q_max, prefixes, suffixes = len(word), self.q_max, self.prefixes, self.suffixes
        n, most = len(grams), 0
        left = []  # for each gap, the least begin from which a gram can run into it
        for gap in range(size + 1):
            least = gap
            for begin in range(max(0, gap - q_max + 1), gap):
                if gap - begin < Q_MIN or word[begin:gap] in prefixes:
                    least = begin
                    break
            left.append(least)
        right = []  # for each gap, the greatest end to which a gram can run from before it
        for gap in range(size + 1):
            last = gap
            for end in range(min(size, gap + q_max - 1), gap, -1):
                if end - gap < Q_MIN or word[gap:end] in suffixes:
                    last = end
                    break
            right.append(last)
        begins, ends = [g[0] for g in grams], [g[1] for g in grams]
        for width in (1, 0):  # a code point replaced or deleted, then one inserted
            first = after = 0  # grams [first, after) are touched
            for at in range(size + 1 - width):
                # a gram is touched if it ends after `at` or could run into it, and begins before `at + width` or could be run over from it
                least, last = left[at], right[at + width]
                while first < n and ends[first] <= at and begins[first] < least:
                    first += 1
                after = max(after, first)
                while after < n and (begins[after] < at + width or ends[after] <= last):
                    after += 1
                most = max(most, after - first)
        return most

    def rarest_first(self, word: str, grams: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
        return sorted((self.counts.get(word[b:e], 0), word[b:e], b) for b, e in grams)

    def posted(self, word: str) -> tuple[list[tuple[str, int]], bool]:
        """((gram, begin) to be indexed, whether the bound leaves a shared gram)."""
        grams = self.decompose(word)
        bound = self.bound(word, grams)
        ranked = [(g, b) for _, g, b in self.rarest_first(word, grams)]
        return (ranked[: bound + 1], True) if bound < len(grams) else (ranked, False)


_POSTED = "word string, n bigint, level int, size int, grams array<string>, begins array<int>"


def postings(words: DataFrame, counts: dict[str, int], q_max: int = Q_MAX) -> DataFrame:
    """What of each word goes into the index: grams with their begins, one row for each index that the word is in."""
    sent = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        levels = [GramIndex(sent.value, q_max)]
        if q_max > Q_MIN + 1:
            levels.append(GramIndex({g: n for g, n in sent.value.items() if len(g) == Q_MIN + 1}, Q_MIN + 1))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for level, index in enumerate(levels):
                    grams, shared = index.posted(word)
                    rows.append((word, n, level, len(word), [g for g, _ in grams], [b for _, b in grams]))
                    if shared:
                        break
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n", "level", "size", "grams", "begins"])

    return words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(run, _POSTED)


def near_words(words: DataFrame, q_max: int = Q_MAX, max_grams: int = MAX_GRAMS) -> DataFrame:
    """``words``: word, n. (a, n_a, b, n_b) of all pairs of the distinct words, of ``LEAST`` code points or more, that are one edit apart, each once."""
    frequent = gram_counts(words, q_max).where("n >= 8").orderBy(F.desc("n"), "gram").limit(max_grams).collect()
    lists = stored(postings(words, {r.gram: r.n for r in frequent}, q_max), "lists")
    each = lists.select("word", "n", "level", "size", F.explode(F.arrays_zip("grams", "begins")).alias("_g")).select("word", "n", "level", "size", "_g.grams", "_g.begins")
    size, begin, gram = F.col("size"), F.col("begins"), F.col("grams")
    left, right = F.substring("word", F.lit(1), begin), F.substring("word", begin + F.length(gram) + 1, size)
    key = lambda size, begin, side, same: F.xxhash64("level", "grams", size, begin, F.lit(side), same)
    lists_of = F.array(key(size, begin, "left", left), key(size, begin, "right", right))
    looked = F.array(key(size, begin, "left", left), key(size, begin, "right", right), key(size + 1, begin, "left", left), key(size + 1, begin + 1, "right", right))
    found = each.select(F.explode(lists_of).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    looks = each.select(F.posexplode(looked).alias("kind", "key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    fits = (F.col("kind") > 1) | (F.col("a") < F.col("b"))  # of one size, each pair once
    one_edit = (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    return looks.join(found, "key").where(fits & one_edit).select("a", "n_a", "b", "n_b").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form of each chain, by doubling the step until none goes on."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "steps")
    for _ in range(6):  # the count rises tenfold at each step, so a chain of longs has 19 at most
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if longer.where("moved").isEmpty():
            break
        steps = longer.drop("moved")
    return longer.select("word", "root")


def spelling_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = 2, ratio: int = 10) -> DataFrame:
    """One row per word with ``n``, ``n_near``, ``form`` (the near word of largest count if that is ``ratio`` times the word's, else null), ``form_n`` and ``root``."""
    if ratio < 10:
        raise ValueError("a ratio below 10 allows chains longer than follow() goes")
    words = stored(count_words(df, id_col, text_col).where(F.col("n") >= least_count), "words")
    pairs = stored(near_words(words), "near")
    one, other = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    both = one.unionByName(other)
    sums = both.groupBy("word").agg(F.count("*").alias("n_near"))
    forms = both.where(F.col("near_n") >= ratio * F.col("n")).groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))  # few
    joined = words.join(sums, "word", "left").join(forms, "word", "left")
    form = F.col("best.near")
    rows = stored(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), (-F.col("best.order")).alias("form_n")), "forms"
    )
    roots = follow(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
