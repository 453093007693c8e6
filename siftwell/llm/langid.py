"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its character n-grams (n of 1 to 3 inside words, with
word edges), hashed into a fixed number of buckets; a linear softmax on top gives the languages.
Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows (``per_lang`` rows a language, the first by a seeded hash; the bound is a parameter). A held
part of the sample fits the temperature, so the score is a probability, and two thresholds
below which a prediction is rejected. As both layers are linear, prediction needs only their
product, one row of logits per bucket, which is what the tasks receive.

One threshold is on the score: the conformal quantile of the held part, interpolated from chance where
the held part is too small to have one. As a softmax is also sure of what no language has, the
other is on the fit: how often, as a mean logarithm, the n-grams of the text are met in the training texts of
the language that has each most often. It stands between the fits of the held texts and those of
the same texts with their letters shuffled. Fewer than five labelled rows have no held part and no such threshold.

Null texts and texts without a letter are ``und`` with score 0 and are rejected. Without any
labelled row every text is ``und``. Long texts are read whole. The prediction depends on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from siftwell.llm.shared import named_again, numbered_columns

UND = "und"
BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
PRIOR = 10  # n-grams of usual fit that every text has besides its own, so that a few odd ones do not reject a short text


def hashed_grams(texts: list[str]):
    """(bucket, text number) of every n-gram of the lower-cased words, text by text, and the number of letters of each text."""
    import numpy as np

    lowered = [t.lower() for t in texts]
    joined = "\0" + "\0".join(lowered) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    letter = _letters()[codes]
    which = np.repeat(np.arange(len(texts) + 1), np.array([1] + [len(t) + 1 for t in lowered]))
    which = np.maximum(which - 1, 0)
    codes = np.where(letter, codes, 0)
    # of several characters between two words one edge is enough
    keep = letter | np.append(letter[1:], False) | np.append(False, letter[:-1])
    codes, letter, which = codes[keep], letter[keep], which[keep]
    n_letters = np.bincount(which[letter], minlength=len(texts))
    buckets, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint32)
    inner = np.ones(len(codes), dtype=bool)
    for n in range(1, max(GRAMS) + 1):
        if n > len(codes):
            break
        h = (h[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1 :].astype(np.uint32) * np.uint32(0x9E3779B1))
        last = letter[n - 1 :]
        if n == 1:
            valid = letter
        else:
            inner = inner[: len(h)] & (letter[n - 2 : len(letter) - 1] if n > 2 else True)
            valid = inner & (letter[: len(h)] | last) & (n > 2 or letter[: len(h)] | last)
        if n in GRAMS:
            at = np.flatnonzero(valid)
            mixed = h[at] ^ (h[at] >> np.uint32(15))
            mixed = (mixed * np.uint32(0x85EBCA6B)) + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            buckets.append((mixed >> np.uint32(17)).astype(np.int64))
            owners.append(which[at + n // 2])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    return buckets, owners, n_letters


_LETTERS = None


def _letters():
    global _LETTERS
    if _LETTERS is None:
        import numpy as np

        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS


@dataclass
class Model:
    langs: list[str]
    logits: object  # BUCKETS x languages: embedding times softmax weights
    bias: object
    temperature: float
    threshold: float
    met: object  # BUCKETS: logarithm of the share of a language's training texts that have the bucket
    usual: object  # languages: mean of ``met`` over the n-grams of its held texts
    least_fit: float

    def probabilities(self, texts: list[str]):
        """Calibrated probabilities (texts x languages) and whether the text has a letter."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str]):
        """Calibrated probabilities (texts x languages), whether the text has a letter, and whether it is rejected."""
        import numpy as np

        buckets, owners, n_letters = hashed_grams(texts)
        sums = np.stack([np.bincount(owners, weights=self.logits[buckets, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        counts = np.bincount(owners, minlength=len(texts))
        p = softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        fit = fits(np.bincount(owners, weights=self.met[buckets], minlength=len(texts)), counts, self.usual[p.argmax(axis=1)])
        return p, n_letters > 0, (n_letters == 0) | (p.max(axis=1) < self.threshold) | (fit < self.least_fit)


def fits(met, counts, usual):
    """How far the n-grams of a text are above (or below) the usual fit of its language; few n-grams say little."""
    return (met - counts * usual) / (counts + PRIOR)


def shuffled_letters(text: str, seed: int) -> str:
    """The text with its letters in another order; words keep their lengths."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    at = np.flatnonzero(_letters()[codes])
    codes[at] = np.random.default_rng(seed % 2**63).permutation(codes[at])
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple], dim: int = 16, epochs: int = 12, rate: float = 1.0, seed: int = 7, reject_rate: float = 0.001) -> Model | None:
    """``rows``: language, buckets and their counts of each sample text, then of its shuffled form. Every fifth row calibrates. None without rows."""
    import numpy as np

    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out, bias = rng.uniform(-1 / dim, 1 / dim, (dim, len(langs))), np.zeros(len(langs))
    features = [(np.array(b), np.array(c) / sum(c), number[x]) for x, b, c, *_ in fit]
    steps, done = epochs * len(features), 0
    for _ in range(epochs):
        for i in rng.permutation(len(features)):
            bucket, share, lang = features[i]
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ embed[bucket]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= 0.01 * now * p
            # a bucket's step is scaled by the text's concentration, or long texts would hardly move it
            embed[bucket] -= now * np.outer(share / (share @ share), back) * 0.05
    logits = embed @ out

    def scores(some):
        return np.array([(np.array(c) / sum(c)) @ logits[np.array(b)] + bias for _, b, c, *_ in some])

    checked = held or fit
    z, y = scores(checked), np.array([number[r[0]] for r in checked])
    grid = np.geomspace(0.05, 20, 121)
    # smoothed targets, or a sample without an error would ask for certainty
    target = np.full((len(y), len(langs)), 1 / (len(y) + 2) / max(len(langs) - 1, 1))
    target[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)
    losses = [-np.mean((target * np.log(softmax(z / t) + 1e-12)).sum(axis=1)) for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    true = np.sort(softmax(z / temperature)[np.arange(len(y)), y])
    chance = 1.05 / len(langs) if len(langs) > 1 else 0.0
    ranked = np.maximum(np.append(chance, true), chance)  # the quantile of rate k / (n + 1) is the k-th; rate 0 rejects what chance gives
    threshold = float(np.interp(reject_rate * (len(true) + 1), np.arange(len(ranked)), ranked))
    met, usual, least_fit = _fit_threshold(fit, held, number, reject_rate)
    return Model(langs, logits, bias, temperature, threshold, met, usual, least_fit)


def _fit_threshold(fit: list[tuple], held: list[tuple], number: dict[str, int], reject_rate: float):
    """``met``, ``usual`` and ``least_fit`` of the model."""
    import numpy as np

    met = np.full(BUCKETS, -np.inf)
    for lang in number:
        of_lang = [r for r in fit if r[0] == lang]
        seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *[np.array(r[1]) for r in of_lang]]).astype(np.int64), minlength=BUCKETS)
        met = np.maximum(met, np.log((seen + 0.5) / (len(of_lang) + 1)))
    if not held:
        return met, np.zeros(len(number)), -np.inf

    def sums(b, c):
        return float(met[np.array(b, np.int64)] @ np.array(c, float)), sum(c)

    true, at = np.array([sums(r[1], r[2]) for r in held]), np.array([number[r[0]] for r in held])
    means = true[:, 0] / true[:, 1]
    usual = np.array([means[at == i].mean() if (at == i).any() else means.mean() for i in range(len(number))])
    wrong = np.array([sums(r[3], r[4]) for r in held])
    low = np.quantile(fits(true[:, 0], true[:, 1], usual[at]), reject_rate)
    high = np.quantile(fits(wrong[:, 0], wrong[:, 1], usual[at]), 0.95)
    return met, usual, float(min(low, (low + high) / 2))


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, seed: int) -> list[tuple]:
    """A bounded sample, as bucket counts made on the executors, of each text and of its shuffled form: at most ``per_lang`` rows of each language.

    Of each language somewhat more than wanted is drawn by a hash and ranked by it, without the texts, so a rare language loses nothing to
    frequent ones and no task ranks more than that; counts and choice are less than the sample that comes back, and so they are sent to all tasks.
    """
    usable = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2))
    usable = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language, where the sample has up to per_lang
    share = F.least(F.lit(1_000_000), F.floor(F.lit(1.2e6 * per_lang) / F.col("n")) + 1)
    few = usable.select("lang", "draw").join(F.broadcast(counts), "lang").where(F.pmod("draw", F.lit(1_000_000)) < share).select("lang", "draw").distinct()
    chosen = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= per_lang).select("lang", "draw")
    drawn = usable.join(F.broadcast(chosen), ["lang", "draw"]).select("lang", "text", "draw").dropDuplicates(["lang", "draw"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = []
            for text, seed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                both = [np.unique(hashed_grams([t])[0], return_counts=True) for t in (text, shuffled_letters(text.lower(), seed))]
                made.append([x.tolist() for pair in both for x in pair])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in range(4)]],
                names=["lang", "draw", "buckets", "counts", "shuffled", "shuffled_counts"],
            )

    rows = drawn.mapInArrow(run, "lang string, draw long, buckets array<int>, counts array<int>, shuffled array<int>, shuffled_counts array<int>")
    return [(r.lang, r.buckets, r.counts, r.shuffled, r.shuffled_counts) for r in rows.orderBy("draw", "lang").collect()]


def _marked(df: DataFrame, model: Model | None, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` by ``numbered_columns``, with _lang, _score and _rejected. The model is sent to each executor once."""
    from siftwell.llm.shared import text_slices

    numbered, names = numbered_columns(df)
    schema = StructType([*numbered.schema.fields, StructField("_lang", StringType()), StructField("_score", DoubleType()), StructField("_rejected", BooleanType())])
    at = numbered.columns.index(names[text_col])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = sent.value
        for whole in batches:
            for batch in text_slices(whole, at, 1 << 19):
                lang, score = np.full(batch.num_rows, UND, dtype=object), np.zeros(batch.num_rows)
                rejected = np.ones(batch.num_rows, dtype=bool)
                if model is not None:
                    p, ok, rejected = model.judged([t or "" for t in batch.column(at).to_pylist()])
                    lang = np.where(ok, np.array(model.langs, dtype=object)[p.argmax(axis=1)], UND)
                    score = np.where(ok, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, "_lang", "_score", "_rejected"]
                )

    return numbered.mapInArrow(run, schema), names


def identify(df: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score and rejected, one row per row."""
    out, names = _marked(df.select(*dict.fromkeys([*keep, text_col])), model, text_col)
    return out.select(*[F.col(names[k]).alias(k) for k in keep], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, seed: int = 11) -> Model | None:
    return train(training_rows(df, id_col, text_col, lang_col, per_lang, seed))


def keep_identified(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose language is not rejected."""
    out, names = _marked(df, fit(df, text_col=text_col, **options), text_col)
    return named_again(out.where("not _rejected"), names)
