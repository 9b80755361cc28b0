"""License scans: Aho-Corasick over the words of a text, licence expressions by a shunting-yard parser.

Words are the maximal runs of ASCII letters and digits and of non-ASCII characters after A-Z are lower-cased.
Base places are those where the words of a base phrase stand consecutively. The same automaton finds further
notice phrases and the identifier tag; the expression behind a tag is parsed from the whole text and evaluated:
an `or` offers the labels of either side, an `and` asks for both, a `with` keeps the licence and adds every
identifier of the exception. An expression stays a formula: its labels and the number of its alternatives come from one
pass over the Polish form, whatever that number is. Of a line that isn't well formed, the longest beginning that is counts.

`scan_licenses` keeps each input row: null text counts as empty (no words, no labels, score 0), repeated rows give
repeated results, further columns are not read, an empty table gives none. A text of any length is scanned whole in time
proportional to it; a worker holds about four megabytes of text at a time, or one text. Labels of equal places are distinct and sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import byte_list, small_batches, table
from gleaner.operators.sizes import spread

# Base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, in words, with their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(rb"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*)", re.I)
# Identifier prefixes and the labels of their families.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "unlicense": "unlicense"}
BINDING = {"or": 1, "and": 2, "with": 3}

# Upper case becomes lower case, other ASCII but digits a blank; bytes of non-ASCII characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def parse_beginning(expression: str) -> tuple[list[str] | None, int]:
    """Reverse Polish form of the longest well-formed beginning by the shunting-yard method, and its end; None if there is none.

    One pass: wherever an operand or a closing bracket leaves no bracket open, the tokens so far are well formed.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, depth, best, end = False, 0, (0, ()), 0
    for match in re.finditer(r"[()]|[^\s()]+", expression):
        token, low = match[0], match[0].lower()
        if low in BINDING:
            if not operand:
                break
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if operand:
                break
            out.append(token)
            operand = True
        if operand and not depth:  # operators still waiting: three at most, of rising strength
            best, end = (len(out), tuple(stack[::-1])), match.end()
    return (out[: best[0]] + list(best[1]), end) if end else (None, 0)


def parse_expression(expression: str) -> list[str] | None:
    """Reverse Polish form of a licence expression; None if it isn't well formed."""
    rpn, end = parse_beginning(expression)
    return rpn if end and not expression[end:].strip() else None


def _family(identifier: str) -> str:
    low = identifier.lower().rstrip("+")
    return next((FAMILIES[x] for x in sorted(FAMILIES, key=len, reverse=True) if low == x or low.startswith(f"{x}-")), low)


def evaluate_expression(rpn: list[str]) -> tuple[set[str], int]:
    """All labels named, and how many alternatives the expression offers, counted without writing them out (2 ** 62 at most)."""
    stack: list[tuple[list[str], int]] = []
    for token in rpn:
        if token not in BINDING:
            stack.append(([_family(token)], 1))
            continue
        (right, n), (left, m) = stack.pop(), stack.pop()
        if token == "with":
            right, n = [f"with-{x}" for x in right], 1
        small, large = sorted((left, right), key=len)  # the shorter list moves: n log n in all
        large.extend(small)
        stack.append((large, min(m + n if token == "or" else m * n, 1 << 62)))
    labels, options = stack.pop()
    return set(labels), options


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        out.add_word(f" {phrase} ", ("notice", label, phrase.count(" ") + 1))
    for phrase, label in BASE.items():
        out.add_word(f" {phrase} ", ("base", label, phrase.count(" ") + 1))
    out.add_word(f" {TAG} ", ("tag", "", 3))
    out.make_automaton()
    return out


def scan_one(data: bytes, automaton: ahocorasick.Automaton) -> dict:
    """Words, places and expressions of one UTF-8 text."""
    words = data.translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    places, notices, tags = [], set(), False
    before, done = 0, 0  # blanks counted so far: a blank stands before each word
    for last, (kind, label, size) in automaton.iter(line.decode("latin-1")):
        if kind == "base":
            before, done = before + line.count(b" ", done, last), last
            places.append((before - size, label))
        elif kind == "notice":
            notices.add(label)
        else:
            tags = True
    expressions, named, best = [], set(), 0.0
    for match in TAG_TEXT.finditer(data) if tags else ():
        said = re.sub(r"\s+", " ", match[1].decode()).strip().rstrip(".")
        rpn, end = parse_beginning(said)
        if rpn:
            labels, options = evaluate_expression(rpn)
            named |= labels
            expressions.append(said[:end])
            best = max(best, 1.0 if options == 1 or len(labels) == 1 else 0.95)
    base = {label for _, label in places}
    score = max(best, 0.9 if base else 0.0, 0.6 if notices else 0.0)
    return {"n_words": len(words), "places": [{"word": w, "label": x} for w, x in sorted(places)], "labels": sorted(base | notices | named), "expressions": expressions, "score": score}


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, places (word, label), labels, expressions, score."""
    key_type = docs.schema[key].dataType.simpleString()
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    rest = {"n_words": pa.int64(), "places": pa.list_(place), "labels": pa.list_(pa.string()), "expressions": pa.list_(pa.string()), "score": pa.float64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in small_batches(batches, text):
            found = [scan_one(data, automaton) for data in byte_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[name] for x in found], kind) for name, kind in rest.items())], [key, *rest])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {key_type}, n_words bigint, places array<struct<word:bigint,label:string>>, labels array<string>, expressions array<string>, score double")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spread(table(spark, sf_dir, "documents")))
    words = F.transform("places", lambda x: x["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", "; ").alias("expressions"),
    )


def brute_force(text: str | None) -> dict:
    """The base part of one row by plain comparison of words."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return {"n_words": len(words), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted({x for _, x in places}))}
