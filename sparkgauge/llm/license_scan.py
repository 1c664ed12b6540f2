"""Licence notices and identifier expressions in texts.

An Aho-Corasick automaton finds phrases and identifier tags at word level in the whole text.
After a tag a shunting-yard parser reads the licence expression, to the end of its line, and
evaluates it: AND needs all of its parts, OR any, WITH keeps the licence on its left. Every
identifier is labelled with its family; one of no known family is labelled `unknown` and listed
in `unknown_ids`. Null and empty texts have no words and no labels; a broken expression gives
the labels of the identifiers that can be read. Rows are scanned one by one, so repeated rows
and ids do no harm; extra columns are ignored. The work is linear in the length of a text.
"""

import functools
import re
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.shared import map_texts

# Phrases that have to be found, and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Further notice phrases and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "cc by 3": "cc-by",
    "cc by 4": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
# Names that public licence identifiers (SPDX) begin with, and the labels of their
# families. A version or variant follows a name after one of - . + or a digit; the longest fits.
FAMILIES = {
    name: family
    for family, names in {
        "mit": "mit mitnfa x11 hpnd ntp ntp-0 xfree86 jsfl",
        "apache": "apache",
        "bsd": "bsd 0bsd",
        "isc": "isc",
        "zlib": "zlib libpng zlib-acknowledgement",
        "boost": "bsl",
        "unlicense": "unlicense wtfpl",
        "cc0": "cc0",
        "public-domain": "libselinux pddl sax-pd blessing",
        "cc-by": "cc-by",
        "cc-by-sa": "cc-by-sa",
        "cc-by-nc": "cc-by-nc",
        "cc-by-nd": "cc-by-nd",
        "gpl": "gpl",
        "lgpl": "lgpl lgpllr",
        "agpl": "agpl",
        "gfdl": "gfdl",
        "sspl": "sspl",
        "busl": "busl",
        "mpl": "mpl npl",
        "epl": "epl",
        "cddl": "cddl",
        "cpl": "cpl ipl",
        "eupl": "eupl",
        "cecill": "cecill",
        "artistic": "artistic clartistic",
        "python": "python psf cnri-python",
        "php": "php",
        "ruby": "ruby",
        "postgresql": "postgresql",
        "openssl": "openssl ssleay",
        "unicode": "unicode",
        "ncsa": "ncsa",
        "ofl": "ofl",
        "osl": "osl",
        "afl": "afl",
        "upl": "upl",
        "ms-pl": "ms-pl",
        "ms-rl": "ms-rl",
        "mulanpsl": "mulanpsl",
        "odbl": "odbl odc-by",
        "bittorrent": "bittorrent",
        "blueoak": "blueoak",
        "curl": "curl",
        "imagemagick": "imagemagick",
        "vim": "vim",
        "w3c": "w3c",
        "qpl": "qpl",
        "sleepycat": "sleepycat",
        "tcl": "tcl",
        "zpl": "zpl",
        "sgi-b": "sgi-b",
        "lppl": "lppl",
        "licenseref": "licenseref documentref",
    }.items()
    for name in names.split()
}
#: Families that ask for no more than notices.
PERMISSIVE = frozenset(
    "mit apache bsd isc zlib boost unlicense cc0 public-domain cc-by python php postgresql unicode "
    "ncsa upl blueoak curl tcl".split()
)
UNKNOWN = "unknown"
_SIZES = sorted({len(name) for name in FAMILIES})
# Words of an identifier tag, and how it is written.
TAG, _WRITTEN = "spdx license identifier", b"spdx-license-identifier:"
_LINE = re.compile(rb"[^\r\n]*")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
# Bytes that end words: all of ASCII but digits and letters. Capitals are folded first.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A
    else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
    else 0x20
    for c in range(256)
)


def label_of(identifier: str) -> str | None:
    """Family of an identifier, by the longest known name that it begins with."""
    name = identifier.lower()
    ends = [n for n in _SIZES if len(name) == n or len(name) > n and name[n] in "-.+:0123456789"]
    fits = [name[:n] for n in ends if name[:n] in FAMILIES]
    return FAMILIES[max(fits, key=len)] if fits else None


def to_postfix(expression: str) -> list[str]:
    """Identifiers and operators of a licence expression in postfix order (shunting-yard).

    Reading stops at the first word that fits neither; unclosed brackets close at the end.
    """
    out, stack, operand = [], [], False
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK and operand:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == ")" and operand:
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif token == "(" and not operand:
            stack.append(token)
        elif low not in _RANK and token not in "()" and not operand:
            out.append(token)
            operand = True
        else:
            break
    return out + [op for op in reversed(stack) if op != "("]


def evaluate(postfix: list[str]) -> tuple[list[str], list[str], bool]:
    """Labels named by an expression, its identifiers of no known family, and whether it can be
    met by permissive licences alone. What follows WITH is an exception and no licence."""
    stack: list[tuple[set, set, bool]] = []
    for token in postfix:
        if token in _RANK and len(stack) < 2:
            continue  # an operator at the end of a broken expression
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
                continue
            free = left[2] or right[2] if token == "or" else left[2] and right[2]
            # The smaller set goes into the larger one: long expressions stay cheap.
            small, large = sorted((left, right), key=lambda x: len(x[0]) + len(x[1]))
            large[0].update(small[0])
            large[1].update(small[1])
            stack.append((large[0], large[1], free))
        else:
            label = label_of(token)
            stack.append(({label or UNKNOWN}, set() if label else {token}, label in PERMISSIVE))
    labels, unknown = (set().union(*[x[k] for x in stack]) for k in (0, 1))
    return sorted(labels), sorted(unknown), bool(stack) and all(x[2] for x in stack)


@functools.lru_cache(2)
def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        automaton.add_word(f" {phrase} ", phrase)
    automaton.make_automaton()
    return automaton


class Scan(NamedTuple):
    """What a text holds: its number of words, (phrase, first word) places, the expressions after
    its tags as written and in postfix order, their labels and unknown identifiers, and whether
    all of them can be met by permissive licences alone."""

    n_words: int = 0
    places: list[tuple[str, int]] = []
    expressions: list[str] = []
    parsed: list[str] = []
    labels: list[str] = []
    unknown_ids: list[str] = []
    permissive: bool = False


def _expressions(raw: bytes, folded: bytes, tags: list[int]) -> list[str]:
    """What is written behind the tags that begin at the given words, to the end of each line."""
    starts = [m.start() for m in re.finditer(rb"[^ ]+", folded)]
    found, done = [], 0
    for tag in tags:
        begin = starts[tag]
        behind = begin + len(_WRITTEN)
        if begin < done or raw[begin:behind].lower() != _WRITTEN:
            continue  # inside the expression of the tag before, or words without the signs
        done = _LINE.match(raw, behind).end()
        found.append(raw[behind:done].decode("utf-8", "replace").strip(" \t"))
    return found


def scan_text(text: str | None) -> Scan:
    if not text:
        return Scan()
    raw = text.encode("utf-8", "replace")
    folded = raw.translate(_FOLD)
    listed = folded.split()
    line = " " + b" ".join(listed).decode("latin-1") + " "
    found = _automaton((*BASE, *NOTICES, TAG)).iter(line)
    # In the order of their starts, so that blanks are counted once from one to the next.
    places, tags, word, last = [], [], -1, 0
    for start, phrase in sorted((end - len(phrase) - 1, phrase) for end, phrase in found):
        word, last = word + line.count(" ", last, start + 1), start + 1
        if phrase == TAG:
            tags.append(word)
        else:
            places.append((phrase, word))
    if not tags:
        return Scan(len(listed), places)
    expressions = _expressions(raw, folded, tags)
    parsed = [to_postfix(e) for e in expressions]
    read = [evaluate(p) for p in parsed]
    labels, unknown = (sorted({x for r in read for x in r[k]}) for k in (0, 1))
    free = bool(read) and all(r[2] for r in read)
    postfix = [" ".join(p) for p in parsed]
    return Scan(len(listed), places, expressions, postfix, labels, unknown, free)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, expressions, parsed, expression_labels, unknown_ids, permissive)
    per row; `parsed` has the expressions in postfix order, which shows how they were read."""
    table = BASE | NOTICES
    place = pa.struct([("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())])
    strings = pa.list_(pa.string())

    def work(run: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan_text(t) for t in run.column("text").to_pylist()]
        places = [
            [{"label": table[p], "word": w, "base": p in BASE} for p, w in row.places]
            for row in found
        ]
        return pa.RecordBatch.from_arrays(
            [
                run.column("doc_id"),
                pa.array([r.n_words for r in found], pa.int64()),
                pa.array(places, pa.list_(place)),
                pa.array([r.expressions for r in found], strings),
                pa.array([r.parsed for r in found], strings),
                pa.array([r.labels for r in found], strings),
                pa.array([r.unknown_ids for r in found], strings),
                pa.array([r.permissive for r in found], pa.bool_()),
            ],
            [
                "doc_id", "n_words", "places", "expressions", "parsed", "expression_labels",
                "unknown_ids", "permissive",
            ],
        )

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(
        picked,
        work,
        "doc_id long, n_words long, places array<struct<label:string,word:bigint,base:boolean>>, "
        "expressions array<string>, parsed array<string>, expression_labels array<string>, "
        "unknown_ids array<string>, permissive boolean",
    )


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, positions, label lists and a score per row of `scan`: 1 - 2^-(labels found)."""
    base = F.filter("places", lambda p: p["base"])
    words = F.transform(base, lambda p: p["word"])
    own = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    every = F.array_sort(
        F.array_distinct(
            F.concat(F.transform("places", lambda p: p["label"]), F.col("expression_labels"))
        )
    )
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        (F.lit(1.0) - F.pow(F.lit(2.0), -F.size(every))).alias("score"),
        F.array_join("parsed", "; ").alias("parsed"),
        F.array_join("unknown_ids", ",").alias("unknown_ids"),
        "permissive",
    )
