"""Licence notices and expressions: an Aho-Corasick automaton over words, another over tags, and a shunting-yard parser."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases, as words, and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "boost software license": "bsl",
}
#: Tags that an expression follows, up to the end of its line.
TAGS = ("spdx-license-identifier:", "license-expression:", "license_expression:")
#: How far a licence restricts: 1 gives all away, 6 nothing. Identifiers take the class of the longest name that begins them.
CLASSES = {"public-domain": 1, "cc0": 1, "unlicense": 1, "0bsd": 1, "mit": 2, "apache": 2, "bsd": 2, "isc": 2, "zlib": 2, "bsl": 2, "cc-by": 2, "lgpl": 3, "mpl": 3, "epl": 3, "gpl": 4, "agpl": 4, "cc-by-sa": 4, "cc-by-nc": 5, "cc-by-nd": 5, "reserved": 6, "proprietary": 6}
MOST, UNKNOWN = 6, 5
#: Words bind more tightly the greater the number; `with` holds an exception to a licence, which takes a copyleft licence down a class.
BINDING = {"or": 1, "and": 2, "with": 3}
#: Letters of a line after a tag that can be an expression.
LINE_END = ("\n", "\r")
#: A-Z become small; in words other ASCII signs than letters and digits part them.
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def class_of(name: str) -> tuple[str, int]:
    """(label, class) of an identifier: the longest known name that it equals or begins with before a hyphen, else itself and UNKNOWN."""
    name = name.rstrip("+")
    while name not in CLASSES:
        name, cut, _ = name.rpartition("-")
        if not cut:
            return "", UNKNOWN
    return name, CLASSES[name]


def tokens(text: str) -> list[str]:
    """Parentheses, operators and identifiers of an expression; it ends at the first sign that none of them can hold."""
    out, word = [], ""
    for c in text:
        if c.isalnum() or c in "-.+:_":
            word += c
            continue
        if word:
            out.append(word)
            word = ""
        if c in "()":
            out.append(c)
        elif c not in " \t":
            break
    return [*out, word] if word else out


def to_postfix(items: list[str]) -> list[str]:
    """Shunting yard: operands leave at once, operators wait on a stack until one that binds less or a parenthesis comes.

    Two operands without an operator end the expression, for text may follow on its line. Raises ValueError for an
    operator without both operands and for parentheses that do not match.
    """
    out, waiting, operand = [], [], False
    for item in items:
        if item in BINDING:
            if not operand:
                raise ValueError(f"nothing before {item}")
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[item]:
                out.append(waiting.pop())
            waiting.append(item)
            operand = False
        elif item == ")":
            if not operand:
                raise ValueError("nothing before )")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("a ) without (")
            waiting.pop()
        elif operand:
            break
        elif item == "(":
            waiting.append(item)
        else:
            out.append(item)
            operand = True
    if not operand or "(" in waiting:
        raise ValueError("the expression does not end")
    return out + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], int]:
    """(labels, class): of `or` the freer side counts, of `and` the stricter one; `with` takes copyleft (3, 4) a class down."""
    stack: list[tuple[set[str], int]] = []
    for item in postfix:
        if item not in BINDING:
            label, rank = class_of(item)
            stack.append(({label} if label else {"other"}, rank))
            continue
        b, a = stack.pop(), stack.pop()
        if item == "with":
            stack.append((a[0] | {"exception"}, a[1] - 1 if a[1] in (3, 4) else a[1]))
        else:
            stack.append((a[0] | b[0], (min if item == "or" else max)(a[1], b[1])))
    return stack.pop()


def read_expression(text: str) -> tuple[set[str], int] | None:
    """Labels and class of an expression in small letters, None if it is none."""
    try:
        return evaluate(to_postfix(tokens(text)))
    except ValueError:
        return None


@lru_cache(maxsize=1)
def automata():
    """The automaton of phrases between blanks, and that of tags; made once a worker."""
    import ahocorasick

    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        words.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scan(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, n_expressions, class) of one whole text."""
    words, tags = automata()
    parts = text.translate(_WORDS).split()
    body = f" {b' '.join(parts).decode()} "
    base, labels, n_base, first, last, strict, at, upto = set(), set(), 0, None, None, 0, 0, 0
    for end, (size, label, is_base) in words.iter(body):
        labels.add(label)
        strict = max(strict, class_of(label)[1])
        if is_base:
            start = end - size + 1
            at += body.count(" ", upto, start) if start >= upto else -body.count(" ", start, upto)
            upto = start
            n_base += 1
            base.add(label)
            first, last = at if first is None else min(first, at), at if last is None else max(last, at)
    n_expressions, small = 0, text.translate(_SMALL).decode()
    for end, _ in tags.iter(small):
        stop = min((x for x in (small.find(e, end) for e in LINE_END) if x >= 0), default=len(small))
        if found := read_expression(small[end + 1 : stop]):
            n_expressions += 1
            labels |= found[0]
            strict = max(strict, found[1])
    return len(parts), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels | base)), n_expressions, strict


_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "n_expressions": pa.int64(), "class": pa.int64()}


def _scanned(batches):
    for batch in batches:
        rows = [scan(t.as_py() or b"") for t in batch.column(batch.num_columns - 1)]
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_FIELDS.values())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *_FIELDS])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, n_expressions, score): licence notices of every text.

    Words are runs of letters, digits and signs beyond ASCII, A-Z in small letters; a phrase stands wherever its words
    are consecutive, whatever parts them, and places may overlap. n_base, first_word, last_word and base_labels are of
    BASE alone. labels adds NOTICES and the identifiers of expressions after TAGS. score is the strictest of all notices
    and expressions, as a share of MOST; 0 without any. Null and empty texts have no words; a null key stays; repeated
    rows are scanned alike; other columns are dropped; no rows give no rows. Nothing is shuffled.
    """
    arrow_batches(docs.sparkSession, 500)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    made = rows.mapInArrow(_scanned, f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, n_expressions long, class long")
    return made.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_expressions", (F.col("class") / MOST).alias("score"))
