"""Licence scans: an Aho-Corasick automaton over the words of whole texts finds
notice phrases and identifier tags; a shunting-yard parser reads the licence
expression after a tag and evaluates and/or/with.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .spark_io import arrow_stage, documents

#: The phrases (in words) that count as base places, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices, found by the same automaton.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license": "mpl-2",
    "eclipse public license": "epl-2",
    "boost software license": "bsl-1",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "cc by 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier",)
#: Labels that a text may bear and still be used, by default.
PERMITTED = frozenset({"mit", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "cc0", "cc-by", "bsl-1", "zlib", "unlicense"})
#: What one place of each kind is worth; a text's score is 1 minus the product of what is left.
WEIGHT = {"base": 0.6, "notice": 0.5, "tag": 0.9}
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id long, n_words long, places array<struct<kind:string,label:string,word:long,words:long>>, expressions array<struct<text:string,labels:array<string>,permitted:boolean>>, score double"


def label_of(identifier: str) -> str:
    """A licence identifier's label: lower case, without -only, -or-later, + and a trailing .0 or CC version."""
    x = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    return re.sub(r"-\d\.\d$", "", x) if x.startswith("cc-") else re.sub(r"\.0$", "", x)


def parse(raw: bytes) -> tuple[list, int]:
    """(postfix, bytes read) of the longest licence expression that begins raw; shunting-yard.

    Postfix holds identifiers and the operators "and", "or", "with". An empty list: there is none."""
    out: list[str] = []
    stack: list[str] = []
    best: tuple[int, list, int] = (0, [], 0)  # of `out` so much, then the waiting operators
    at, operand, open_ = 0, True, 0  # operand: one is expected
    while m := _TOKEN.match(raw, at):
        token = m[1].decode()
        low = token.lower()
        if operand and token == "(":
            stack.append(token)
            open_ += 1
        elif operand and low not in _PRECEDENCE and token != ")":
            out.append(token)
            operand = False
        elif not operand and low in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif not operand and token == ")" and open_:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            open_ -= 1
        else:
            break
        at = m.end()
        if not operand and not open_:
            best = (len(out), stack[::-1], at)
    return out[: best[0]] + best[1], best[2]


def evaluate(postfix: list, permitted: frozenset[str] = PERMITTED) -> tuple[list[str], bool]:
    """(labels, permitted): "or" needs one side permitted, "and" both; "with" adds an
    exception to a licence and leaves its permission as it is."""
    labels: set[str] = set()
    stack: list[tuple[bool, set[str]]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            (b, bl), (a, al) = stack.pop(), stack.pop()
            stack.append((a, al) if token == "with" else (a and b, al | bl) if token == "and" else (a or b, al | bl))
        else:
            name = label_of(token)
            stack.append((name in permitted, {name}))
    ok, labels = stack[-1] if stack else (False, labels)
    return sorted(labels), ok


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, label))
    for phrase, uses in found.items():
        a.add_word(phrase, (len(phrase), phrase.count(" ") + 1, uses))
    a.make_automaton()
    return a


def scan_piece(data: np.ndarray, offs: np.ndarray, permitted: frozenset[str] = PERMITTED):
    """(words per text, {row: places}, {row: expressions}) of some texts."""
    low = tv.LOWER[data]
    starts, ends, first = tv.words(low, offs, tv.ALNUM)
    n = len(offs) - 1
    counts = np.diff(first)
    places: dict[int, list] = {}
    expressions: dict[int, list] = {}
    if not len(starts):
        return counts, places, expressions
    # words of one text joined by blanks, texts by line feeds: the automaton reads them as Latin-1, a byte a letter
    size = ends - starts
    begin = np.append(0, np.cumsum(size + 1))
    joined = np.full(begin[-1], 0x20, dtype=np.uint8)
    inner = np.repeat(begin[:-1] - starts, size) + (at := np.flatnonzero(_inside(starts, ends, len(low))))
    joined[inner] = low[at]
    last = first[1:][counts > 0]
    joined[begin[last] - 1] = 0x0A
    text = joined.tobytes().decode("latin-1")
    lines = np.flatnonzero(data == 0x0A)
    for end, (length, n_words, uses) in automaton().iter(text):
        left = end - length + 1
        if (left and text[left - 1] not in " \n") or text[end + 1] not in " \n":
            continue
        word = int(np.searchsorted(begin, left))
        row = int(np.searchsorted(first, word, side="right")) - 1
        for kind, label in uses:
            if kind == "tag":
                after = word + n_words
                if after >= first[row + 1]:
                    continue
                lo = int(starts[after])
                while lo > ends[after - 1] and data[lo - 1] == 0x28:
                    lo -= 1
                line = int(np.searchsorted(lines, lo))
                stop = min(int(offs[row + 1]), int(lines[line])) if line < len(lines) else int(offs[row + 1])
                # a little of the line at first, as many tags may share a very long one
                width = 1024
                while True:
                    raw = data[lo : min(stop, lo + width)].tobytes()
                    postfix, used = parse(raw)
                    if lo + width >= stop or used < width // 2:
                        break
                    width *= 4
                labels, ok = evaluate(postfix, permitted)
                if labels:
                    expressions.setdefault(row, []).append((raw[:used].decode("utf-8", "replace").strip(), labels, ok))
                    places.setdefault(row, []).extend(("tag", x, word - int(first[row]), n_words) for x in labels)
            else:
                places.setdefault(row, []).append((kind, label, word - int(first[row]), n_words))
    return counts, places, expressions


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def scan(docs: DataFrame, permitted: frozenset[str] = PERMITTED) -> DataFrame:
    """Every document's words, places and licence expressions; columns as in SCHEMA.

    A place has its first word (from 0) and its length in words; kind is base, notice or
    tag. Null and empty texts have no words and score 0. Repeated rows are scanned as they stand; an empty
    table gives an empty result; further columns are ignored."""
    place = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))
    expression = pa.list_(pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("permitted", pa.bool_())]))

    def each(batch):
        for a, b, data, offs in tv.batches(batch.column(1)):
            counts, found, read = scan_piece(data, offs, permitted)
            rows = [[dict(zip(("kind", "label", "word", "words"), p, strict=True)) for p in found.get(i, ())] for i in range(b - a)]
            said = [[dict(zip(("text", "labels", "permitted"), e, strict=True)) for e in read.get(i, ())] for i in range(b - a)]
            score = [1 - float(np.prod([1 - WEIGHT[p[0]] for p in found.get(i, ())])) for i in range(b - a)]
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(counts), pa.array(rows, place), pa.array(said, expression), pa.array(score)], ["doc_id", "n_words", "places", "expressions", "score"])

    return arrow_stage(documents(docs), each, SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document with its counts, base and all labels. Without places, words are null, labels empty and the
    score 0; repeated rows stay, an empty table gives an empty result."""
    base = F.filter("places", lambda p: p["kind"] == "base")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["word"])).alias("first_word"), F.array_max(F.transform(base, lambda p: p["word"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), "score", F.size("expressions").alias("n_expressions"),
    )
