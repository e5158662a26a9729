"""op11, op12 and op13 against plain versions on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandwork.llm import divergence, licenses, trie

# --- op11


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t, key=lambda x: (x[0], x[1], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()))] for c, t in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = set()
    for k, cs in members.items():
        under = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        out.add((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), kids[k], sum(not kids[x] for x in under), saved, hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def made_trie(spark, rows, extra=()):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in extra:
        frame = frame.withColumn(name, frame["turn"])
    return [tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(frame).collect()]


def check_trie(spark, rows, extra=()):
    found = made_trie(spark, rows, extra)
    assert len(found) == len(set(found)) and set(found) == plain_trie(rows)


def test_trie_of_families_with_shared_starts(spark):
    rng = random.Random(5)
    texts = ["", "a", "bé", "ccc", None]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(-7, 60) for t in range(rng.randrange(0, 12))]
    check_trie(spark, rows, extra=("depth", "p1", "digest", "i", "h"))


def test_trie_with_copies_ties_null_turns_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, t, "user", f"x{t}") for c in range(0, 200, 5) for t in range(3)]
    rows += [(7, None, "user", "first"), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (None, 0, "user", "gone")]
    rows += [(1001, t, "user", "y" * (t % 3)) for t in range(40)]
    check_trie(spark, rows)


def test_trie_of_nothing(spark):
    assert made_trie(spark, []) == []
    only = [(3, 0, None, None)]  # its donor is absent, its own first turns are cut off: a turnless member of the root
    check_trie(spark, only)


# --- op12


def plain_audit(rows):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, w = lang or "", source or "", words(text)
        groups.add((lang, source))
        df[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    value = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, k in df[lang].items() if k >= 10)
        mine = sorted(s for x, s in groups if x == lang)
        count = {s: {t: n[lang, s][t] for t in kept} for s in mine}
        count[None] = {t: sum(count[s][t] for s in mine) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 2) // (sum(v.values()) + 2 * len(kept)) for t, c in v.items()} for s, v in count.items()}
        for s in mine:
            pairs = [(-sum(value(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(-value(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > p[None][t]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


def check_audit(spark, rows):
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "lang string, source string, text string, term string, n int")
    found = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(frame).collect()]
    assert sorted(found) == plain_audit(rows)


def test_audit_of_many_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 3)
    monkeypatch.setattr(divergence, "TERMS", 5)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "STRETCH", 7)
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "The", "of", "é", "ÉA", "x1y", "naïve", "zz", "it's"]) + rng.choice(["", "", "b", "c"])
    rows = [(rng.choice(["en", "de", None]), f"s{int(rng.random() ** 3 * 8)}", " ".join(word() for _ in range(rng.randrange(0, 30)))) for _ in range(300)]
    rows += [("fr", "a", "rare words only"), ("fr", "b", None), ("fr", None, ""), ("en", "empty", " 1 2 3 ")]
    check_audit(spark, rows)


def test_audit_ties_and_empty(spark):
    check_audit(spark, [("en", s, "a b c d e f g h i j k l") for s in ("q", "r", "s") for _ in range(10)])
    check_audit(spark, [])


def test_scaled_is_exact_for_great_counts(spark):
    cases = [(0, 0, 1), (10**12, 3 * 10**12, 10**9), (999_999_999_999, 10**15, 7), (5, 5, 0), (0, 0, 0)]
    frame = spark.createDataFrame(cases, "c long, t long, v long")
    found = [r.p for r in frame.select("c", divergence.scaled("c", "t", "v").alias("p")).collect()]
    assert found == [1 + 10**9 * (c + 2) // (t + 2 * v) if t + 2 * v else 0 for c, t, v in cases]


def test_difference_floors():
    p, q = np.array([10**9 + 1, 1, 7, 0]), np.array([1, 10**9, 7, 0])
    assert divergence.difference(p, q).tolist() == [(10**9) ** 2 // (10**9 + 2), (10**9 - 1) ** 2 // (10**9 + 1), 0, 0]


# --- op13


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(text):
    w, out = plain_words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), out


def climbed(items, least=1):
    """The same grammar by precedence climbing."""
    item = items.pop(0) if items else ")"
    if item == "(":
        left = climbed(items)
        if not items or items.pop(0) != ")":
            raise ValueError
    elif item in licenses.BINDING or item == ")":
        raise ValueError
    else:
        label, rank = licenses.class_of(item)
        left = ({label or "other"}, rank)
    while items and licenses.BINDING.get(items[0], 0) >= least:
        op = items.pop(0)
        right = climbed(items, licenses.BINDING[op] + 1)
        if op == "with":
            left = (left[0] | {"exception"}, left[1] - (left[1] in (3, 4)))
        else:
            left = (left[0] | right[0], min(left[1], right[1]) if op == "or" else max(left[1], right[1]))
    return left


def test_expressions_equal_precedence_climbing():
    rng = random.Random(3)

    def made(depth):
        x = rng.random()
        if depth == 0 or x < 0.3:
            return rng.choice(["mit", "gpl-2.0-only", "apache-2.0", "lgpl-2.1+", "unknown-1", "cc-by-nc-4.0", "bsd-3-clause"])
        if x < 0.4:
            return f"({made(depth - 1)})"
        return f"{made(depth - 1)} {rng.choice(['and', 'or', 'with'])} {made(depth - 1)}"

    for _ in range(500):
        text = made(4)
        assert licenses.read_expression(text) == climbed(licenses.tokens(text)), text


@pytest.mark.parametrize("text", ["", "and mit", "(mit", "mit)", "mit or", "()", "mit and or gpl", "mit with"])
def test_broken_expressions_are_none(text):
    assert licenses.read_expression(text) is None


def test_expression_values():
    assert licenses.read_expression("(mit or gpl-3.0) and apache-2.0 */") == ({"mit", "gpl", "apache"}, 2)
    assert licenses.read_expression("gpl-2.0 with classpath-exception-2.0") == ({"gpl", "exception"}, 3)
    assert licenses.read_expression("mit and text that follows") == ({"mit", "other"}, licenses.UNKNOWN)
    assert licenses.read_expression("mit") == ({"mit"}, 2)


TEXTS = [
    None,
    "",
    "All rights reserved. ALL\nRIGHTS--RESERVED all rights  reserved",
    "cc by cc by cc, BY-NC 4.0",
    "the lesser General Public License and the Affero general public license",
    "xall rights reservedx all rights éreserved all rights reserved",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\ncode",
    "/* SPDX-License-Identifier: MIT */ rest of it",
    "SPDX-License-Identifier: AND\nReleased under the MIT License.",
    "a " * 200_000 + "all rights reserved " + "b " * 200_000,
]


def test_scan_against_plain_words(spark):
    rng = random.Random(9)
    bits = ["all", "rights", "reserved", "cc", "by", "general", "public", "license", "é", "All", "9"]
    texts = TEXTS + ["".join(rng.choice(bits) + rng.choice([" ", "-", "\n", ". ", "é", ""]) for _ in range(60)) for _ in range(100)]
    rows = [(i if i else None, t, 0.5, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, labels string")
    for r in licenses.scan_licenses(frame).collect():
        n, places = plain_places(texts[r.doc_id or 0])
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    assert by[3].labels == "cc-by,cc-by-nc" and by[4].labels == "agpl,gpl,lgpl"
    assert by[6].labels == "apache,exception,gpl,mit" and by[6].n_expressions == 1 and by[6].score == 3 / 6
    assert by[7].labels == "mit" and by[8].labels == "mit" and by[8].n_expressions == 0
    assert by[9].n_base == 1 and by[9].first_word == 200_000 and by[2].score == 1.0 and by[1].score == 0.0
    assert licenses.scan_licenses(frame.limit(0)).collect() == []
