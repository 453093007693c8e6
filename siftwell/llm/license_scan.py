"""License scans: an Aho-Corasick automaton for tags and notices, a shunting-yard parser for licence expressions.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; the words joined by one
space each go through an automaton of all notice phrases, so that one pass finds every place, overlapping ones
included. A second automaton finds identifier tags in the lower-cased text; the expression behind a tag is read by a
shunting-yard parser with the precedence WITH, AND, OR and parentheses.

Every notice and every licence id of an expression has a label and a grade, from 1 (any use) to 0 (none).
Of an expression, OR takes the better grade and AND the worse one; WITH adds what an exception allows. The score of a text is the worst
grade of its notices and expressions, as all of them hold; ``UNKNOWN`` without any. Licences that the tables lack count as ``other`` with that grade.

Null texts count as empty: no words, no findings. A tag without a licence id behind it is none. An expression ends ahead of the first token that
does not continue it, as in running text. Texts are scanned whole; equal rows have equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import text_slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNKNOWN = 0.5

# fixed values: grade of each label
GRADES = {
    "0bsd": 1.0, "apache-2": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "bsl-1": 1.0, "cc-by": 1.0, "cc0": 1.0, "isc": 1.0, "mit": 1.0, "ncsa": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "artistic-2": 0.75, "cddl-1": 0.75, "epl-1": 0.75, "epl-2": 0.75, "mpl-1": 0.75, "mpl-2": 0.75,
    "cc-by-sa": 0.6, "lgpl": 0.6, "lgpl-2": 0.6, "lgpl-2.1": 0.6, "lgpl-3": 0.6,
    "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4,
    "agpl": 0.25, "agpl-3": 0.25,
    "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nd": 0.1, "cc-by-nc-nd": 0.05,
    "proprietary": 0.0,
}

# fixed values: what an exception adds to the grade of its licence
EXCEPTIONS = {
    "classpath-exception-2.0": 0.35, "gcc-exception-2.0": 0.35, "gcc-exception-3.1": 0.35, "linux-syscall-note": 0.2, "llvm-exception": 0.0,
    "autoconf-exception-3.0": 0.35, "bison-exception-2.2": 0.35, "openjdk-assembly-exception-1.0": 0.2,
}

# fixed values: tags that stand ahead of an expression
TAGS = ("spdx-license-identifier:", "license-expression:")


@dataclass(frozen=True)
class Notice:
    phrase: str  # words with one space between
    label: str
    base: bool = False


# fixed values
NOTICES = (
    Notice("under the mit license", "mit", True),
    Notice("apache license version 2", "apache-2", True),
    Notice("cc by nc", "cc-by-nc", True),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    Notice("licensed under the apache license", "apache-2"),
    Notice("redistribution and use in source and binary forms", "bsd"),
    Notice("bsd 2 clause", "bsd-2-clause"),
    Notice("bsd 3 clause", "bsd-3-clause"),
    Notice("gnu general public license", "gpl"),
    Notice("gnu general public license version 2", "gpl-2"),
    Notice("gnu general public license version 3", "gpl-3"),
    Notice("gnu lesser general public license", "lgpl"),
    Notice("gnu affero general public license", "agpl"),
    Notice("mozilla public license version 2", "mpl-2"),
    Notice("mozilla public license v 2", "mpl-2"),
    Notice("eclipse public license", "epl-2"),
    Notice("boost software license", "bsl-1"),
    Notice("under the isc license", "isc"),
    Notice("this is free and unencumbered software released into the public domain", "unlicense"),
    Notice("cc by sa", "cc-by-sa"),
    Notice("cc by nd", "cc-by-nd"),
    Notice("cc by nc sa", "cc-by-nc-sa"),
    Notice("cc by nc nd", "cc-by-nc-nd"),
    Notice("cc0 1 0", "cc0"),
    Notice("creative commons attribution", "cc-by"),
    Notice("creative commons attribution noncommercial", "cc-by-nc"),
    Notice("creative commons attribution sharealike", "cc-by-sa"),
    Notice("all rights reserved", "proprietary"),
)

NOTICE = "struct<label:string,word:bigint,base:boolean>"
EXPRESSION = "struct<start:bigint,end:bigint,labels:array<string>,grade:double>"
FINDINGS = f"n_words bigint, notices array<{NOTICE}>, expressions array<{EXPRESSION}>, score double"
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def label_of(licence: str) -> str:
    """The label of a licence id: without -only, -or-later, + and .0; Creative Commons without a version."""
    name = re.sub(r"(-only|-or-later|\+)$", "", licence.rstrip("."))
    name = re.sub(r"^(cc-by(?:-nc|-nd|-sa)*|cc0)-[0-9.]+$", r"\1", name)
    name = re.sub(r"\.0$", "", name)
    return name if name in GRADES else "other"


def _is_licence(token: str) -> bool:
    return label_of(token) != "other" or token.startswith("licenseref-")


def parse_expression(text: str, start: int = 0) -> tuple[int, list[str]] | None:
    """(end, postfix) of the longest licence expression at ``start`` of a lower-cased text; null if there is none.

    Shunting-yard: operators wait on a stack until one of no higher rank, a closing parenthesis or the end comes. The first id may be
    any word; later ones must be known or start with ``licenseref-``, so that running text behind a tag is not read as an expression.
    """
    output: list[str] = []
    stack: list[str] = []
    best = None
    wants_operand, after_with, at = True, False, start
    while match := _TOKEN.match(text, at):
        token = match[1]
        if wants_operand:
            if token == "(" and not after_with:
                stack.append(token)
            elif token == ")" or token == "(" or token in _RANK:
                break
            elif after_with:
                name = token.rstrip(".")
                if name not in EXCEPTIONS and output[1:]:
                    break
                output.append(name)
                wants_operand = after_with = False
            elif output and not _is_licence(token):
                break
            else:
                output.append(token.rstrip("."))
                wants_operand = False
        elif token in _RANK and (token != "with" or output[-1] not in _RANK and text[at - 1] != ")"):
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                output.append(stack.pop())
            stack.append(token)
            wants_operand, after_with = True, token == "with"
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        else:
            break
        at = match.end()
        if not wants_operand and "(" not in stack:
            best = at, [*output, *reversed(stack)]
    return best


def evaluate(postfix: Sequence[str]) -> tuple[float, list[str]]:
    """(grade, labels) of an expression in postfix order."""
    grades: list[float] = []
    labels = []
    for i, token in enumerate(postfix):
        if token == "with":
            more = grades.pop()
            grades[-1] = min(1.0, grades[-1] + more)
        elif token in _RANK:
            other = grades.pop()
            grades[-1] = max(grades[-1], other) if token == "or" else min(grades[-1], other)
        elif i + 1 < len(postfix) and postfix[i + 1] == "with":
            grades.append(EXCEPTIONS.get(token, 0.0))
        else:
            label = label_of(token)
            labels.append(label)
            grades.append(GRADES.get(label, UNKNOWN))
    return grades[0], sorted(set(labels))


class Scanner:
    """Both automata, for texts one by one."""

    def __init__(self, notices: Sequence[Notice] = NOTICES, tags: Sequence[str] = TAGS):
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        by_phrase: dict[str, list[Notice]] = {}
        for notice in notices:
            by_phrase.setdefault(notice.phrase, []).append(notice)
        for phrase, same in by_phrase.items():
            self.phrases.add_word(f" {phrase} ", (len(phrase.split(" ")), same))
        for tag in tags:
            self.tags.add_word(tag, len(tag))
        for automaton in (self.phrases, self.tags):
            if len(automaton):
                automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple], list[tuple], float]:
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only A-Z
        words = WORD.findall(lowered)
        notices, grades = [], []
        if words and len(self.phrases):
            joined = f" {' '.join(words)} "
            ended, seen = 0, 0  # words that have ended by the place looked at
            for end, (n, same) in self.phrases.iter(joined):
                ended += joined.count(" ", seen, end + 1)
                seen = end + 1
                for notice in same:
                    notices.append((notice.label, ended - 1 - n, notice.base))
                    grades.append(GRADES.get(notice.label, UNKNOWN))
        expressions = []
        if len(self.tags):
            for end, _ in self.tags.iter(lowered):
                if parsed := parse_expression(lowered, end + 1):
                    grade, labels = evaluate(parsed[1])
                    expressions.append((end + 1, parsed[0], labels, grade))
                    grades.append(grade)
        return len(words), notices, expressions, min(grades, default=UNKNOWN)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[Notice] = NOTICES, tags: Sequence[str] = TAGS) -> DataFrame:
    """One row per input row: the id and

    * ``n_words``;
    * ``notices``: label, number of the first word and whether the phrase is of the base, by the place where they end;
    * ``expressions``: code points from the end of the tag to the end of the expression, labels and grade;
    * ``score``.
    """
    notices, tags = tuple(notices), tuple(tags)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(notices, tags)
        kinds = pa.struct([("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())])
        parsed = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("labels", pa.list_(pa.string())), ("grade", pa.float64())])
        for batch in batches:
            for part in text_slices(batch, 1):
                found = [scanner.scan(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([[dict(zip(("label", "word", "base"), n)) for n in f[1]] for f in found], pa.list_(kinds)),
                        pa.array([[dict(zip(("start", "end", "labels", "grade"), e)) for e in f[2]] for f in found], pa.list_(parsed)),
                        pa.array([f[3] for f in found], pa.float64()),
                    ],
                    names=["id", "n_words", "notices", "expressions", "score"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {FINDINGS}").withColumnRenamed("id", id_col)


def usable(df: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of the rows whose score is ``least`` or more."""
    return scan_licenses(df, id_col, text_col).where(F.col("score") >= least).select(id_col)
