"""License scans against plain matching of word lists, and expressions against a parser by Python's own precedence."""

import random
import re

import pytest

from siftwell.llm import license_scan, queries

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered(text))


def brute_places(words, phrases):
    found = []
    for phrase, label in phrases:
        wanted = phrase.split()
        found += [(label, i) for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
    return found


def brute_base(text):
    places = brute_places(words_of(text), BASE.items())
    starts = [i for _, i in places]
    return len(words_of(text)), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places}))


TEXTS = [
    None, "", "no licence here", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "CC BY-NC-SA and cc_by_nc",
    "under the MIT  license under the mit license UNDER\nTHE\tMIT-LICENSE", "thunder the mit license", "under the mit licenses", "apache license version 2apache license version 2", "ünder the mit license é",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "SPDX-License-Identifier:", "spdx-license-identifier: Foo and then text", "x" * 60000 + " cc by nc " + "cc by nc " * 5000,
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved. SPDX-License-Identifier: MIT", "Released under the MIT License.", "日本語 cc by nc 日本語", "\x00cc\x01by\x7fnc{", "cc by by nc cc by",
]


def test_query_against_a_brute_force(spark, tmp_path):
    rng = random.Random(3)
    bits = "cc by nc sa under the mit license apache version 2 2.0 UNDER THE, é× \n gnu general public 3 all rights reserved".split(" ")
    texts = TEXTS + [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i if i != 3 else None, t, "clash", 1.0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, labels string, score double").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op12_license_scans(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(texts)
    found = {r.doc_id: r for r in got}
    phrases = [(n.phrase, n.label) for n in license_scan.NOTICES]
    for i, t in enumerate(texts):
        r = found[i if i != 3 else None]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        labels = {x for x, _ in brute_places(words_of(t), phrases)}
        if "spdx" not in lowered(t):
            assert r.labels == ",".join(sorted(labels))
            assert r.score == min((license_scan.GRADES[x] for x in labels), default=license_scan.UNKNOWN)
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert found[12].labels == "apache-2,gpl-2,mit" and found[12].n_expressions == 1 and found[12].score == 0.75
    assert found[13].n_expressions == 0 and found[14].labels == "other" and found[17].labels == "mit,proprietary" and found[17].score == 0
    assert queries.license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_of_notices_in_order_of_the_text(spark):
    df = spark.createDataFrame([("a", TEXTS[7])], "key string, body string")
    r = license_scan.scan_licenses(df, "key", "body").first()
    assert [(n.label, n.word, n.base) for n in r.notices] == [("mit", 0, True), ("mit", 4, True), ("mit", 8, True)]
    assert [x.key for x in license_scan.usable(df, 0.9, "key", "body").collect()] == ["a"]


@pytest.mark.parametrize(
    "text, end, grade, labels",
    [
        ("mit", 3, 1.0, ["mit"]),
        ("mit and gpl-3.0-only", None, 0.4, ["gpl-3", "mit"]),
        ("mit or gpl-3.0-only and cc-by-nc-4.0", None, 1.0, ["cc-by-nc", "gpl-3", "mit"]),
        ("(mit or gpl-3.0-only) and cc-by-nc-4.0", None, 0.1, ["cc-by-nc", "gpl-3", "mit"]),
        ("gpl-2.0+ with classpath-exception-2.0 or agpl-3.0", None, 0.75, ["agpl-3", "gpl-2"]),
        ("((mit))", None, 1.0, ["mit"]),
        ("mit and then text", 3, 1.0, ["mit"]),
        ("apache-2.0. next sentence", 11, 1.0, ["apache-2"]),
        ("mit) or isc", 3, 1.0, ["mit"]),
        ("(mit or isc", "none", None, None),
        ("and mit", "none", None, None),
        ("*/", "none", None, None),
        ("mit with", 3, 1.0, ["mit"]),
        ("(mit) with llvm-exception", 5, 1.0, ["mit"]),
        ("licenseref-own and mit", None, 0.5, ["mit", "other"]),
        ("mit\nor isc", 3, 1.0, ["mit"]),
        ("mit mit", 3, 1.0, ["mit"]),
        ("apache-2.0 with llvm-exception", None, 1.0, ["apache-2"]),
    ],
)
def test_expressions(text, end, grade, labels):
    parsed = license_scan.parse_expression(text)
    if end == "none":
        assert parsed is None
        return
    assert parsed[0] == (len(text) if end is None else end)
    assert license_scan.evaluate(parsed[1]) == (pytest.approx(grade), labels)


def test_random_expressions_against_python():
    rng = random.Random(8)
    ids = {"mit": 1.0, "mpl-2.0": 0.75, "lgpl-3.0-only": 0.6, "gpl-2.0-only": 0.4, "cc-by-nc-4.0": 0.1}

    class Grade:
        def __init__(self, x):
            self.x = x

        def __add__(self, other):  # or
            return Grade(max(self.x, other.x))

        def __mul__(self, other):  # and
            return Grade(min(self.x, other.x))

    def build(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(list(ids))
            return name, f"Grade({ids[name]})"
        (a, pa), (b, pb) = build(depth - 1), build(depth - 1)
        word, sign = rng.choice([("or", "+"), ("and", "*")])
        return (f"({a} {word} {b})", f"({pa} {sign} {pb})") if rng.random() < 0.5 else (f"{a} {word} {b}", f"{pa} {sign} {pb}")

    for _ in range(500):
        text, python = build(4)
        end, postfix = license_scan.parse_expression(text)
        assert end == len(text) and license_scan.evaluate(postfix)[0] == eval(python, {"Grade": Grade}).x, text  # noqa: S307
