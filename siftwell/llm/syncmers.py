"""Document fingerprints of closed syncmers, with built-in functions only.

A token is a word, a piece of 32 characters of a longer word, or one character of a script that is written without
spaces. A k-mer is ``K`` consecutive tokens, an s-mer ``S`` of them; both ends of a text are padded with ``K - 1`` empty
tokens, so texts of one token and more have k-mers, of one kind for all sizes. A k-mer is a closed syncmer, and so
an anchor, if the smallest hash of its s-mers stands at its first or last place. Whether it is
one depends on its own tokens alone, so an edit moves no anchor outside its reach, and any
``K - S`` neighbouring k-mers hold at least one. The fingerprint is the 32-bit hashes of the
anchors in text order, eight hex digits each; its positions in the string follow those in the text.

Likeness is positional. Each anchor has the number of the token where it starts. The n-th occurrence of
an anchor in one text is matched to the n-th in the other, and the matches of the most frequent
difference of positions are counted, as a share of the anchors of the larger text, repeats included.

Null texts count as empty; an empty fingerprint is like another empty one (1.0) and unlike any other (0.0).
Very long texts are one array of longs a row; repeated rows and equal texts have equal fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K, S = 5, 2
# fixed values: blocks of scripts without spaces, and what is left of the code points without them and white space
UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{30000}-\x{3134F}"
SPACED = r"!-~\x{7F}-\x{DFF}\x{F00}-\x{FFF}\x{10A0}-\x{177F}\x{1800}-\x{303F}\x{3100}-\x{33FF}\x{A000}-\x{F8FF}\x{FB00}-\x{1FFFF}\x{2FA20}-\x{2FFFF}\x{31350}-\x{10FFFF}\x{0}-\x{8}\x{E}-\x{1F}"
TOKEN = f"[{SPACED}]{{1,32}}|[{UNSPACED}]"
MAX_PARTS = 65_536  # parts of the order of ids; their bounds, sent to all tasks, are two megabytes at most


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, whatever number of times lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash32(*parts: Column) -> Column:
    return F.shiftright(F.xxhash64(*parts), 32).cast("int")


def _packed(hashed: Column, at: Column) -> Column:
    """Hash above, word position below, in one long."""
    return F.shiftleft(hashed.cast("long"), 32).bitwiseOR(at.cast("long"))


def hashes_of(placed: Column) -> Column:
    """The hashes of placed anchors, ``array<int>``."""
    return F.transform(placed, lambda x: F.shiftright(x, 32).cast("int"))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchor hashes of a text in order, ``array<int>``."""
    return hashes_of(placed_anchors(text, k, s))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def placed_anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text in order with the number of their first (padded) token, ``array<bigint>``, packed."""
    width = k - s + 1
    pad = F.array(*[F.lit(0).cast("long")] * (k - 1))
    padded = F.concat(pad, F.transform(tokens(text), lambda w: F.xxhash64(w)), pad)

    def picked(h: Column) -> Column:
        smers = F.transform(F.slice(h, 1, F.size(h) - (s - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))

        def closed_ones(m: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(m) - width)

            def closed(i: Column) -> Column:
                return F.least(F.get(m, i), F.get(m, i + (width - 1))) <= F.least(*[F.get(m, i + j) for j in range(1, width - 1)])

            return F.transform(F.filter(starts, closed), lambda i: _packed(_hash32(*[F.get(h, i + j) for j in range(k)]), i))

        return F.when(F.size(h) > 2 * (k - 1), _let(smers, closed_ones)).otherwise(F.array().cast("array<bigint>"))

    return _let(padded, picked)


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _starts(x: Column, key: Callable[[Column], Column]) -> Column:
    """Where runs of equal keys start in a sorted array, and its size as the last."""
    inside = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (key(F.get(x, i)) != key(F.get(x, i - 1))))
    return F.concat(inside, F.array(F.size(x)))


def _differences(a: Column, b: Column) -> Column:
    """Position in ``b`` less position in ``a`` of the n-th occurrences of the same anchor, for all anchors and n."""
    side = 1 << 31  # above any position, below the hash
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(side)))))

    def pairs(m: Column) -> Column:
        def of_runs(starts: Column) -> Column:
            # an anchor of both texts is a run of the first's, then one of the second's
            shared = F.filter(
                F.sequence(F.lit(0), F.size(starts) - 2),
                lambda r: (r < F.size(starts) - 2) & (F.shiftright(F.get(m, F.get(starts, r)), 32) == F.shiftright(F.get(m, F.get(starts, r + 1)), 32)),
            )

            def run(r: Column) -> Column:
                first, second, end = F.get(starts, r), F.get(starts, r + 1), F.get(starts, r + 2)
                return F.transform(F.sequence(F.lit(0), F.least(second - first, end - second) - 1), lambda n: F.get(m, second + n) - F.get(m, first + n) - F.lit(side))

            return F.flatten(F.transform(shared, run))

        return _let(_starts(m, lambda x: F.shiftright(x, 31)), of_runs)

    return _let(both, pairs)


def _largest_group(x: Column) -> Column:
    """How many values of a sorted array are equal at most."""
    return F.when(F.size(x) == 0, 0).otherwise(
        _let(_starts(x, lambda v: v), lambda at: F.array_max(F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.get(at, i) - F.get(at, i - 1))))
    )


def likeness(a: Column, b: Column) -> Column:
    """Of placed anchors: the largest group of matches of equal position difference, as a share of the larger text's anchors."""
    larger, smaller = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    aligned = _let(F.sort_array(_differences(a, b)), _largest_group)
    return F.when(larger == 0, F.lit(1.0)).when(smaller == 0, F.lit(0.0)).otherwise(aligned.cast("double") / larger.cast("double"))


def _part_bounds(df: DataFrame, key: Column, n_parts: int) -> DataFrame:
    """One row of ``_last`` and ``_every``: quantiles of the key from the largest down, in blocks, and the last of each block."""
    ids = df.select(key.alias("id"))
    found = ids.approxQuantile("id", [i / n_parts for i in range(1, n_parts)], 1 / (4 * n_parts)) if n_parts > 1 else []
    falling = sorted({math.floor(x) for x in found}, reverse=True)
    step = math.isqrt(len(falling)) + 1
    blocks = [falling[i : i + step] for i in range(0, len(falling), step)]
    row = (1, step, [b[-1] for b in blocks], blocks)
    return df.sparkSession.createDataFrame([row], "_one int, _step int, _last array<bigint>, _every array<array<bigint>>")


def _falling_part(key: Column) -> Column:
    """How many of the bounds are above ``key``: blocks of bounds are tried first, then the bounds of one block."""
    full = F.size(F.filter("_last", lambda b: b > key))
    return _let(full, lambda n: n * F.col("_step") + F.coalesce(F.size(F.filter(F.get("_every", n), lambda b: b > key)), F.lit(0)))


def with_next(df: DataFrame, id_col: str, columns: dict[str, Column], rows_per_part: int = 5_000) -> DataFrame:
    """id and ``columns`` of each row, and as ``next_...`` those of the row that follows by falling id; the first follows the last.

    Ids are cut into parts at their quantiles, ``MAX_PARTS`` at most. The first row of a part is copied to the end of
    the part before it, so one window inside each part finds every follower and no
    task sees more than a part. Bounds and first ids of all parts go to the tasks as one row. Null ids come last; equal ids are ordered by the columns.
    """
    names = list(columns)
    # doubles of the quantiles are exact to 53 bits; beyond that parts are cut a little off, by all rows alike
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    n_parts = min(MAX_PARTS, max(1, -(-df.count() // rows_per_part)))
    bounds = F.broadcast(_part_bounds(df.where(F.col(id_col).isNotNull()), F.col(id_col).cast("long"), n_parts))
    one = F.lit(1).alias("_one")
    heads = df.select(key.alias("_key"), one).join(bounds, "_one").groupBy(_falling_part(F.col("_key")).alias("part")).agg(F.max("_key").alias("head"))
    found = sorted((r.part, r.head) for r in heads.collect())  # a row for each part, MAX_PARTS at most
    size = max((p for p, _ in found), default=0) + 1
    head, before = [None] * size, [None] * size
    for (part, top), (previous, _) in zip(found, found[-1:] + found):
        head[part], before[part] = top, previous
    heads = df.sparkSession.createDataFrame([(1, head, before)], "_one int, _head array<bigint>, _before array<int>")
    rows = df.select(F.col(id_col).alias("_id"), key.alias("_key"), one, *[c.alias(n) for n, c in columns.items()]).join(bounds, "_one").withColumn("_part", _falling_part(F.col("_key")))
    rows = rows.select("_id", "_key", "_one", "_part", *names).join(F.broadcast(heads), "_one")
    before = F.when(F.get("_head", F.col("_part")) == F.col("_key"), F.get("_before", F.col("_part")))
    places = F.array_compact(F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("copy")), F.when(before.isNotNull(), F.struct(before.alias("part"), F.lit(True).alias("copy")))))
    placed = rows.select("_id", "_key", *names, F.explode(places).alias("_place")).select(
        "_id", "_key", *names, F.col("_place.part").alias("_part"), F.col("_place.copy").alias("_copy")
    )
    order = W.partitionBy("_part").orderBy("_copy", F.desc("_key"), F.col("_id").isNull(), *names)
    following = [F.lead(n).over(order).alias(f"next_{n}") for n in names]
    return placed.select("_id", *names, "_copy", *following).where("not _copy").drop("_copy").withColumnRenamed("_id", id_col)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the anchors of each text."""
    return df.select(F.col(id_col), anchors(F.col(text_col)).alias("anchors"))
