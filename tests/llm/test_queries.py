"""The last step of each query: what it derives from its operator, against Python."""

import hashlib
import json
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece

from siftwell.llm import isomedia, queries
from tests.llm.test_jaccard import brute
from tests.llm.test_url_media import URLS
from tests.llm.test_url_media import brute as brute_url

TEXTS = [None, "", " ", "one", "Ein Satz mit Wörtern, der etwas länger ist als die anderen", "a b c d e f", "A b c d  e f", "x" * 64, "日本語", "the same text", "the same text", "word " * 5000]
SHA = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('queries')}"
    rows = [(i if i != 3 else None, t, "de" if i == 4 else "en", f"s{i % 3}" if i % 5 else None, "clash", "clash") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, size string").write.parquet(f"{path}/documents.parquet")
    pages = [(i, u, "<p>long page</p>" * (80 if i % 2 else 1), "clash") for i, u in enumerate(URLS)]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").write.parquet(f"{path}/pages.parquet")
    return path


def docs():
    return [(i if i != 3 else None, t or "") for i, t in enumerate(TEXTS)]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_op1(spark, sf):
    got = queries.op1_language_id(spark, sf).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        t = TEXTS[3 if r.doc_id is None else r.doc_id] or ""
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", t)) and 0 <= r.score <= 1


def test_op2(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in docs():
        ids = library.encode(t, add_eos=True)
        want.append((i, len(ids), SHA(" ".join(map(str, ids))), SHA(library.decode(ids))))
    assert rows(queries.op2_sentencepiece(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_op3(spark, sf):
    got = queries.op3_mixing(spark, sf).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs()}
    assert len(got) == len(TEXTS) and all(r["size"] == sizes[r.doc_id] and r.taken <= 3 * r["size"] for r in got)
    first = [2.0 if r.first_position is None else r.first_position for r in got]
    assert first == sorted(first)


def test_op5(spark, sf):
    assert rows(queries.op5_ngram_jaccard(spark, sf), "doc_id", "n_shingles", "component_id") == brute(docs())


def test_op7(spark, sf):
    got = queries.op7_sharding(spark, sf).collect()
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    want = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs()]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(want, key=str)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_op4_and_op8(spark, sf):
    big = [i for i in range(len(URLS)) if i % 2]
    html = lambda i: ("<p>long page</p>" * (80 if i % 2 else 1)).encode()
    want = [(i, len(html(i)), hashlib.sha1(html(i)).hexdigest(), "revisit" if i in big[:-1] else "response", big[-1] if i in big[:-1] else None) for i in range(len(URLS))]
    assert rows(queries.op4_warc(spark, sf), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    assert rows(queries.op8_url_filters(spark, sf), "page_id", "host", "path", "rule", "verdict") == sorted(((i, *brute_url(u)) for i, u in enumerate(URLS)), key=str)


def boxes(data, start, end):
    """A second reader of boxes, by name, for the test alone."""
    while start < end:
        size = int.from_bytes(data[start : start + 4], "big")
        yield data[start + 4 : start + 8], start + 8, start + size
        start += size


def find(data, *path):
    start, end = 0, len(data)
    for kind in path:
        start, end = next((a, b) for k, a, b in boxes(data, start, end) if k == kind)
    return data[start:end]


def test_op9(spark, sf):
    got = {r.doc_id: r for r in queries.op9_media_columns(spark, sf).collect()}
    assert len(got) == len(TEXTS)
    for i, t in docs():
        r, data = got[i], t.encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        media = isomedia.mux_payload(payload)
        assert find(media, b"mdat") == payload and find(media, b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd")[12:16] == b"raw "
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), SHA(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), SHA(media))
        start, n = media.rindex(b"mdat") + 4, len(payload) // 64
        keys = ",".join(f"{k + 1}:{start + 64 * k}:64" for k in range(0, n, 16))
        assert r.feature == f"codec=raw;timescale=8000;duration={len(payload)};samples={n};keyframes={keys}", json.dumps(r.feature[:200])
