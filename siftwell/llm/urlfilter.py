"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Every rule is a glob over ``host`` and ``path``. All rules are packed side by side into
words of 64 bits; one shift, and and or over the words moves all of them by one byte of
the URL. A batch of URLs is stepped together, so the work per byte is a few numpy calls.

Results: null URLs and URLs without ``://`` have an empty host and path; of several rules
that fit, the longest (host plus path) wins, then the one that blocks, then the first by code point.
Very long URLs are stepped to their end; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = 0xFF  # never a byte of UTF-8; stands between host and path
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and its subdomains, ``path`` any path that it starts; ``*`` and ``?`` are wildcards."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class GlobAutomaton:
    """Shift-And masks of all rules. State j of a rule: its first j bytes are matched."""

    def __init__(self, rules: Sequence[Rule]):
        import numpy as np

        self.rules = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
        states: list[tuple[int | None, bool]] = []  # the byte that leads into the state (None: any), whether it loops
        first, final = [], []
        for rule in self.rules:
            first.append(len(states))
            states.append((-1, True))  # any labels may precede the host
            for char in b"." + rule.host.encode() + bytes([SEP]) + rule.path.encode():
                if char == ord("*"):
                    states[-1] = (states[-1][0], True)
                else:
                    states.append((None if char == ord("?") else char, False))
            final.append(len(states) - 1)
        self.n_words = max(1, -(-len(states) // 64))
        bits = np.zeros((256 + 3, self.n_words * 64), dtype=np.uint8)
        for i, (char, loops) in enumerate(states):
            if char is None:
                bits[:SEP, i] = 1
            elif char >= 0:
                bits[char, i] = 1
            bits[256, i] = loops
        bits[257, first], bits[258, final] = 1, 1
        words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        self.into, self.loop, self.start, self.final = words[:256], words[256], words[257], words[258]
        self.final_bits = np.array(final, dtype=np.int64)

    def best(self, data, offsets):
        """For each string of the Arrow-like buffers the index in ``rules`` of the winner, -1 for none."""
        import numpy as np

        n = len(offsets) - 1
        if not n or not self.rules:
            return np.full(n, -1)
        size = np.diff(offsets)
        by_size = np.argsort(-size, kind="stable")
        begin, left = offsets[:-1][by_size], size[by_size]
        state = np.repeat(self.start[None, :], n, axis=0)
        running = n
        for step in range(int(left[0])):
            running = int(np.searchsorted(-left[:running], -step, side="left"))  # those longer than step
            now, char = state[:running], data[begin[:running] + step]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            stays = np.where((char == SEP)[:, None], np.uint64(0), self.loop[None, :]) | self.final
            state[:running] = (moved & self.into[char]) | (now & stays)
        hits = np.unpackbits(state.view(np.uint8), axis=1, bitorder="little")[:, self.final_bits]
        found = np.where(hits.any(axis=1), hits.argmax(axis=1), -1)
        out = np.empty(n, dtype=np.int64)
        out[by_size] = found
        return out


def judge_urls(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null: none fits) and verdict."""
    rules = tuple(rules)
    parts = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        automaton = GlobAutomaton(rules)
        names = np.array([r.text for r in automaton.rules] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in automaton.rules] + [default], dtype=object)
        for batch in batches:
            canonical = [b"." + h.encode() + b"\xff" + p.encode() for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            data = np.frombuffer(b"".join(canonical), dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in canonical], dtype=np.int64)]).astype(np.int64)
            won = automaton.best(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[won], pa.string()), pa.array(verdicts[won], pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    out = parts.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
