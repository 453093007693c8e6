import hashlib
import random
import re
import zlib

from siftwell.llm import isomedia, urlfilter
from siftwell.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/es/1", "https://a.example.org/en/12?q#f", "http://badexample.org/en/1", "http://x.com/de",
    "http://x.com/de/", "http://x.com/fr/é", "ftp://org", "http://org/", "http://com?/fr/", "x://y://z.org/es/", "http://ÀÉ.org/x\ny", "http://h.com#/de/",
    "http://long.org/" + "a" * 70000,
]


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_urls_against_a_brute_force(spark):
    rng = random.Random(1)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'a.', 'example.'])}{rng.choice(['example.org', 'x.com', 'org', 'com', 'net'])}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randrange(200)}" for _ in range(300)]
    urls = URLS + made + made[:5]
    df = spark.createDataFrame([(i if i else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i if i else None] == brute(u), u
    assert urlfilter.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(df, (), default="block").collect()} == {"block"}


def test_many_rules_span_words(spark):
    rules = [urlfilter.Rule("block", f"h{i}.example.com", f"/p{i}/") for i in range(120)] + [urlfilter.Rule("block", "*.cdn.net", "/a?c/*/z")]
    df = spark.createDataFrame([(i, f"http://www.h{i}.example.com/p{i}/x") for i in range(120)] + [(500, "http://q.cdn.net/abc/d/e/z"), (501, "http://cdn.net/abc/d/z")], "page_id long, url string")
    got = {r.page_id: r.rule for r in urlfilter.judge_urls(df, rules).collect()}
    assert all(got[i] == rules[i].text for i in range(120)) and got[500] == "*.cdn.net/a?c/*/z" and got[501] is None


def test_media_round_trip(spark):
    texts = [None, "", "a", "b" * 64, "é" * 33, "long " * 40000, "a"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    media = isomedia.texts_to_media(df)
    got = {r.doc_id: r for r in isomedia.probe_media(media, keep=("doc_id", "n_bytes")).collect()}
    for i, t in enumerate(texts):
        data, r = (t or "").encode(), got[i]
        payload = isomedia.padded(data)
        assert r.n_bytes == len(data) and bytes(r.payload) == payload and len(payload) % 64 == 0 and len(payload) > 0
        assert r.codec == "raw " and r.duration == len(payload) and r.n_samples == len(payload) // 64
        for k in r.keyframes:
            assert bytes(r.media)[k.start : k.start + k["size"]] == payload[(k.number - 1) * 64 : k.number * 64]
    assert bytes(got[2].media) == bytes(got[6].media)
    assert isomedia.texts_to_media(df.limit(0)).count() == 0


def test_tables_of_other_writers_and_broken_files(spark):
    import struct

    payload = bytes(range(200)) + bytes(56)
    whole = isomedia.mux_payload(payload)
    for cut in (0, 5, 40, 300, len(whole) - 1):
        assert isomedia.probe(whole[:cut]) is None
    full = isomedia._full
    table = isomedia._box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), isomedia._box(b"avc1", bytes(8))), full(b"stsz", struct.pack(">IIIII", 0, 3, 10, 20, 30)),
        full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1) [:4] + struct.pack(">III", 1, 2, 1)), full(b"stco", struct.pack(">III", 2, 500, 100)),
    )
    moov = isomedia._box(b"moov", isomedia._box(b"trak", isomedia._box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 90, 270)), isomedia._box(b"minf", table))))
    data = (moov + isomedia._box(b"mdat", bytes(700)))[:700] if len(moov) > 700 else moov + isomedia._box(b"mdat", bytes(700))
    got = isomedia.probe(data)
    assert got["codec"] == "avc1" and got["duration"] == 270 and [(k["start"], k["size"]) for k in got["keyframes"]] == [(500, 10), (510, 20), (100, 30)]
    df = spark.createDataFrame([(1, None), (2, bytearray(b"junk junk"))], "doc_id long, media binary")
    assert all(r.codec is None for r in isomedia.probe_media(df, keep=("doc_id",)).collect())
    assert hashlib.sha256(payload).hexdigest() and zlib.crc32(payload) >= 0


def test_broken_counts_give_nulls_without_memory(spark):
    import struct

    whole = bytearray(isomedia.mux_payload(bytes(range(64))))
    at = {kind: whole.index(kind) for kind in (b"stsz", b"co64", b"stsc", b"stss")}
    broken = []
    for kind, shift, value in ((b"stsz", 12, 2**32 - 1), (b"co64", 8, 2**32 - 1), (b"stsc", 16, 2**32 - 1), (b"stsc", 8, 2**32 - 1), (b"stss", 8, 2**32 - 1), (b"stss", 12, 0), (b"stsz", 8, 2**31)):
        data = bytearray(whole)
        struct.pack_into(">I", data, at[kind] + shift, value)
        broken.append(bytes(data))
    nested = b"".join(struct.pack(">I4s", 8 * (5000 - i), b"moov") for i in range(5000))
    rows = [(i, bytearray(d), "clash") for i, d in enumerate([*broken, nested, bytes(whole)])]
    got = isomedia.probe_media(spark.createDataFrame(rows, "doc_id long, media binary, codec string"), keep=("doc_id", "codec")).collect()
    assert [r.doc_id for r in got if r.payload is not None] == [len(rows) - 1] and got[-1].codec == "raw "
