"""SentencePiece encoding and decoding with byte offsets into the original text.

Normalisation walks the text by the longest prefix in the model's compiled character map (a
double array over UTF-8 bytes followed by a pool of replacement strings) and keeps, for every
byte it writes, the offset of the source bytes it came from. Every piece is a byte range of
the normalised text, so its original span is read off that alignment.

Segmentation is byte-pair merging, best score first and leftmost on ties. No piece of the model
has a space mark after another character, so merging never crosses the start of a word:
the text is cut there and repeated words are looked up. Characters outside
the vocabulary fall back to their UTF-8 bytes; the last byte carries the span.

Null texts count as empty; an empty text has the end id alone. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
LONG = 64  # characters of a word above which its pairs are kept in a heap
CACHE = 100_000  # words a task remembers before it starts afresh; a bound on memory only


class CharMap:
    """The compiled character map: longest known prefix of some bytes and its replacement."""

    def __init__(self, blob: bytes):
        import numpy as np

        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :]
        self.leads = np.zeros(256, dtype=bool)  # bytes that a key starts with
        if self.units:
            root = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)
            for byte in range(1, 256):
                self.leads[byte] = (root ^ byte) < len(self.units) and self.units[root ^ byte] & 0x800000FF == byte

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key at ``start``; None if no key fits."""
        units = self.units
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        best = None
        for i in range(start, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - start, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.pool[best[1] : self.pool.index(b"\0", best[1])]


class Normalizer:
    def __init__(self, char_map: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.map = CharMap(char_map)
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = MARK.encode() if escape else b" "

    def __call__(self, text: str):
        """The normalised text and, for each of its bytes and its end, the offset in the original bytes."""
        import numpy as np

        data = text.encode()
        if not data:
            return "", np.zeros(1, dtype=np.int32)
        if not self.squeeze:
            return self._walk(data)
        out, align = bytearray(), []
        at, was_space = 0, True
        while at < len(data):
            used, new = self._step(data, at)
            if new != b" ":
                break
            at += used
        if at == len(data):
            return "", np.zeros(1, dtype=np.int32)
        if self.dummy_prefix and at < len(data):
            out += self.space
            align += [at] * len(self.space)
        while at < len(data):
            used, new = self._step(data, at)
            while was_space and new[:1] == b" ":
                new = new[1:]
            if new:
                was_space = new[-1:] == b" "
            for byte in new:
                piece = self.space if byte == 32 else bytes([byte])
                out += piece
                align += [at] * len(piece)
            at += used
        while out.endswith(self.space):
            del out[-len(self.space) :]
            at = align[len(out)]
            del align[len(out) :]
        return out.decode(), np.array([*align, at], dtype=np.int32)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at)
        if found:
            return found
        lead = data[at]
        used = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return used, data[at : at + used]

    def _walk(self, data: bytes):
        """Longest prefixes are looked for where a key may start; the stretches between keep their bytes and offsets."""
        import numpy as np

        parts, offsets, at = [], [], 0
        for start in np.flatnonzero(self.map.leads[np.frombuffer(data, np.uint8)]).tolist():
            if start >= at and (found := self.map.longest(data, start)):
                parts += [data[at:start], found[1]]
                offsets += [np.arange(at, start, dtype=np.int32), np.full(len(found[1]), start, dtype=np.int32)]
                at = start + found[0]
        new = b"".join([*parts, data[at:]])
        align = np.concatenate([*offsets, np.arange(at, len(data), dtype=np.int32)])
        width, space = len(self.space), self.space.decode()
        align = np.repeat(align, np.where(np.frombuffer(new, np.uint8) == 32, width, 1))
        prefix = width if self.dummy_prefix else 0
        return (space if self.dummy_prefix else "") + new.decode().replace(" ", space), np.concatenate([np.zeros(prefix, np.int32), align, np.array([len(data)], np.int32)])


class Pieces:
    """Vocabulary and merges of a byte-pair model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        parsed = proto.ModelProto()
        parsed.ParseFromString(model)
        if parsed.trainer_spec.model_type != 2 or any(p.type == UNUSED for p in parsed.pieces):
            raise ValueError("only byte-pair models without unused pieces are read")
        spec = parsed.normalizer_spec
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.names = [p.piece for p in parsed.pieces]
        self.ids = {p.piece: i for i, p in enumerate(parsed.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.scores = {p.piece: p.score for p in parsed.pieces if p.type in (NORMAL, USER_DEFINED)}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(parsed.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(parsed.pieces) if p.type == UNKNOWN)
        self.end = next((i for i, p in enumerate(parsed.pieces) if p.type == CONTROL and p.piece == "</s>"), None)
        self.types = [p.type for p in parsed.pieces]
        self.prefixed = spec.add_dummy_prefix
        mixed = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.words = re.compile(r"(?s).+" if mixed else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.surface = [self._bytes_of(i) for i in range(len(self.names))]
        self._compile_merges()
        self.table = dict(zip(self.pairs.tolist(), zip(self.pair_rank.tolist(), self.pair_symbol.tolist())))
        self._forget()

    def _bytes_of(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else self.names[i].replace(MARK, " ").encode()

    def _compile_merges(self) -> None:
        """Symbols are pieces and single characters; ``pairs`` has every two of them that join to a piece."""
        import numpy as np

        chars = sorted({c for p in self.ids for c in p} - self.ids.keys())
        symbols = {**self.ids, **{c: len(self.names) + i for i, c in enumerate(chars)}}
        self.n_symbols = len(self.names) + len(chars)  # from here on: code points that no piece has
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.n_symbols
        for char, i in symbols.items():
            if len(char) == 1:
                self.symbol_of[ord(char)] = i
        self.char_of = {i: c for c, i in symbols.items() if i >= len(self.names)}
        rank = dict(zip(self.scores, np.unique([-v for v in self.scores.values()], return_inverse=True)[1].tolist()))
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[piece], i)
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pairs.tolist()], dtype=np.int64)
        self.pair_symbol = np.array([pairs[k][1] for k in self.pairs.tolist()], dtype=np.int64)
        self.symbol_bytes = np.array([len(p.encode()) for p in self.names] + [len(c.encode()) for c in chars], dtype=np.int64)

    def merge_many(self, words: list[str]):
        """Symbols of all words, one after the other, and their number in each word.

        All words are merged together, each by its best pair (leftmost on ties) in every round.
        """
        import numpy as np

        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbol = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbol, done_word = [], []
        never = np.iinfo(np.int64).max
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            key[word[:-1] != word[1:]] = -1
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.append(np.where(self.pairs[at] == key, self.pair_rank[at], never), never)
            new = np.append(True, word[1:] != word[:-1])
            nth = np.cumsum(new) - 1
            best = np.minimum.reduceat(rank, np.flatnonzero(new))[nth]
            over = best == never
            done_symbol.append(symbol[over])
            done_word.append(word[over])
            hit = np.flatnonzero((rank == best) & ~over)
            hit = hit[np.append(True, nth[hit[1:]] != nth[hit[:-1]])] if len(hit) else hit
            symbol[hit] = self.pair_symbol[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol, word = np.concatenate([*done_symbol, symbol]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: str) -> list[int]:
        """The same for one long word, with a heap of pairs: the rounds of ``merge_many`` would each pass over all of it."""
        parts: list[int | None] = self.symbol_of[[ord(c) for c in word]].tolist()
        n = len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self.table
        heap = [(table[k][0], i, k) for i in range(n - 1) if (k := parts[i] << 32 | parts[i + 1]) in table]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            if parts[i] is None or right[i] >= n or parts[i] << 32 | parts[right[i]] != key:
                continue
            j = right[i]
            parts[i], parts[j] = table[key][1], None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                if (k := parts[i] << 32 | parts[right[j]]) in table:
                    heapq.heappush(heap, (table[k][0], i, k))
            if left[i] >= 0 and (k := parts[left[i]] << 32 | parts[i]) in table:
                heapq.heappush(heap, (table[k][0], left[i], k))
        return [p for p in parts if p is not None]

    def _learn(self, words: list[str]) -> None:
        """Segment words and append them to the table of known ones."""
        import numpy as np

        short = [w for w in words if len(w) <= LONG]
        symbols, counts = self.merge_many(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        long = [w for w in words if len(w) > LONG]
        merged = [np.array(self.merge_long(w), dtype=np.int64) for w in long]
        short += long
        symbols, counts = np.concatenate([symbols, *merged]), np.concatenate([counts, np.array([len(m) for m in merged], dtype=np.int64)])
        known = symbols < len(self.names)
        code = np.maximum(symbols - self.n_symbols, 0)
        width = np.where(symbols < self.n_symbols, self.symbol_bytes[np.minimum(symbols, self.n_symbols - 1)], 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        word = np.repeat(np.arange(len(short)), counts)
        stop = np.cumsum(width)
        total = np.bincount(word, weights=width, minlength=len(short)).astype(np.int64)
        stop -= (np.cumsum(total) - total)[word]
        times = np.where(known | (not self.byte_ids), 1, width)
        ids = np.repeat(np.where(known, symbols, self.unknown), times)
        begins, ends = np.repeat(stop - width, times), np.repeat(stop, times)
        place = np.cumsum(times) - times
        for i in np.flatnonzero(~known) if self.byte_ids else ():
            char = self.char_of.get(int(symbols[i])) or chr(int(code[i]))
            at, data = place[i], char.encode()
            ids[at : at + len(data)] = [self.byte_ids[b] for b in data]
            ends[at : at + len(data) - 1] = begins[at]
        for store, values in ((self.flat_ids, ids), (self.flat_begins, begins), (self.flat_ends, ends)):
            store.frombytes(values.astype(np.int32).tobytes())
        start = len(self.n_ids)
        self.n_ids.frombytes(np.bincount(word, weights=times, minlength=len(short)).astype(np.int64).tobytes())
        self.n_bytes.frombytes(total.tobytes())
        self.rows.update(zip(short, range(start, start + len(short))))

    def _rows_of(self, words: list[str]):
        """The row of each word in the table of segmented words; new words are added first."""
        import numpy as np

        rows = self.rows
        if len(rows) > CACHE:
            self._forget()
            rows = self.rows
        if new := list(set(words).difference(rows)):
            self._learn(new)
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat_ids, self.flat_begins, self.flat_ends = array("i"), array("i"), array("i")
        self.n_ids, self.n_bytes = array("q"), array("q")

    def encode_all(self, texts: list[str]) -> list[tuple]:
        """For each text its ids (without the end id) and the begin and end of each in the text's bytes."""
        import numpy as np

        normals, words, n_words = [], [], []
        for text in texts:
            normal, align = self.normalize(text)
            found = self.words.findall(normal)
            normals.append(align)
            words += found
            n_words.append(len(found))
        rows = self._rows_of(words)
        per_word, sizes = np.array(self.n_ids)[rows], np.array(self.n_bytes)[rows]
        first = np.cumsum(np.array(self.n_ids)) - np.array(self.n_ids)
        place = np.repeat(first[rows] - (np.cumsum(per_word) - per_word), per_word) + np.arange(per_word.sum())
        ids = np.array(self.flat_ids, dtype=np.int32)[place]
        base = np.repeat(np.cumsum(sizes) - sizes, per_word)
        begins, ends = np.array(self.flat_begins)[place] + base, np.array(self.flat_ends)[place] + base
        word_ends = np.cumsum(n_words)
        id_ends, byte_ends = np.append(0, np.cumsum(per_word))[word_ends], np.append(0, np.cumsum(sizes))[word_ends]
        out, at, start = [], 0, 0
        for align, stop, end in zip(normals, id_ends.tolist(), byte_ends.tolist()):
            out.append((ids[at:stop], align[begins[at:stop] - start], align[ends[at:stop] - start]))
            at, start = stop, end
        return out

    def encode(self, text: str) -> tuple:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """Surface text of ids; bytes that are no UTF-8 become replacement marks, control ids nothing."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        if self.prefixed and data[:1] == b" ":
            first = next((i for i in ids if self.types[i] != CONTROL), None)
            if first is not None and self.names[first].startswith(MARK):
                data = data[1:]
        return data.decode("utf-8", "replace")


@functools.lru_cache(1)
def pieces_of(model: bytes) -> Pieces:
    """One a worker, for all its tasks."""
    return Pieces(model)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep`` columns, ids, begins, ends (byte spans in the text; the end id's is empty) and the decoded text.

    Columns to keep that are named like the id or one of these results are left out.
    """
    from siftwell.llm.shared import text_slices

    with open(model_path, "rb") as f:
        model = f.read()  # half a megabyte, fixed by the vocabulary
    fields = [df.schema[id_col], *(df.schema[k] for k in keep if k not in (id_col, "ids", "begins", "ends", "decoded"))]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>, begins array<int>, ends array<int>, decoded string"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pieces = pieces_of(model)
        tail = [pieces.end] if add_end else []

        def column(arrays: list) -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))

        for whole in batches:
            for batch in text_slices(whole, len(names)):
                ids, begins, ends, texts = [], [], [], []
                given = [t or "" for t in batch.column(len(names)).to_pylist()]
                for text, (got, begin, end) in zip(given, pieces.encode_all(given)):
                    last = np.full(len(tail), len(text.encode()), dtype=np.int32)
                    ids.append(np.concatenate([got, np.array(tail, dtype=np.int32)]))
                    begins.append(np.concatenate([begin, last]))
                    ends.append(np.concatenate([end, last]))
                    texts.append(pieces.decode(got.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], column(ids), column(begins), column(ends), pa.array(texts, pa.string())],
                    names=[*names, "ids", "begins", "ends", "decoded"],
                )

    return df.select(*[F.col(n) for n in names], F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
