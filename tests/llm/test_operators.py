"""Each operator against a brute-force version or an exact round trip, with null, empty, repeated and extra columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from strandwork.llm import bpe, common, embeddings, lines, media, packing, queries, sharding, simhash, tokens, toolcalls, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu".split()


def make_texts():
    rng = random.Random(3)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(40)]
    near = [b + " omega" for b in base[:6]]
    odd = [None, "", " ", "  two  blanks ", "tab\tand\nline\n\n end\n", "it's we'll don't 123 45.6 !!??", "日本語 テスト　全角", "a" * 300, "x y z", "\x1c sep", "<|endoftext|> stays text", "long " * 3000, "x" * 97 + " end"]
    return base + near + base[:5] + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(make_texts())]
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "fp")  # a name that clashes with inner ones


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_png_round_trip(docs, empty):
    got = {r.doc_id: r for r in media.media_features(media.store_as_png(docs)).collect()}
    for i, t in enumerate(make_texts()):
        body = (t or "").encode()
        payload = body + bytes(-len(body) % 64 if body else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.media_features(media.store_as_png(empty)).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (25, 9), dtype=np.uint8)
    rows[:, 0] = np.arange(25) % 5
    want = np.zeros((25, 8), dtype=int)
    for y in range(25):
        for x in range(8):
            a, b, c = (want[y, x - 1] if x else 0), (want[y - 1, x] if y else 0), (want[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c
            want[y, x] = (int(rows[y, x + 1]) + [0, a, b, (a + b) // 2, paeth][rows[y, 0]]) % 256
    assert (media._unfilter(rows) == want).all()
    png = bytearray(media.encode_png(bytes(range(256))))
    png[60] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))


def test_bpe_equals_tiktoken(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(make_texts()):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_fold_leads_to_every_token(spark):
    """Every 25th token by the fold alone, and the same ones as whole tokens."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    some = list(ranks)[::25]
    for whole in ([-1] * len(some), [ranks[w] for w in some]):
        words = spark.createDataFrame([([list(w) for w in some], whole)], "words array<array<smallint>>, whole array<int>")
        got = words.select(bpe.merged_words(F.col("words"), F.col("whole"), path).alias("made")).first()["made"]
        assert [(r.ids, bytes(r.body)) for r in got] == [([ranks[w]], w) for w in some]


def test_bpe_folds_long_words(spark, monkeypatch):
    """Words of thousands of bytes, with and without places to cut, and packs that remember, forget and start anew."""
    rng = random.Random(6)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5000)), "a" * 5000, "".join(rng.choices("QXZJqxzj", k=5000)), "日本語" * 400]
    texts += [" ".join(rng.choices(WORDS, k=30)) for _ in range(60)]
    assert len(bpe.parts_of(texts[2].encode(), path)) > 100 and b"".join(bpe.parts_of(texts[0].encode(), path)) == texts[0].encode()
    monkeypatch.setattr(bpe, "PACK_CHARS", 400)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 9)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe.encode_documents(rows, path, public_tokenizers.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_cuts_short_words():
    """Words of 6 to 24 bytes are cut as well, so folds are short; the ids of the parts are those of the word."""
    rng = random.Random(8)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    words = ["".join(rng.choices("abdefgijknqrtvwxzQXZé", k=rng.randint(1, 20))) for _ in range(3000)]
    parts = [bpe.parts_of(w.encode(), path) for w in words]
    assert sum(len(p) > 1 for w, p in zip(words, parts, strict=True) if len(w.encode()) <= 24) > 1000
    assert 2 * sum(len(x) ** 2 for x in {x for p in parts for x in p}) < sum(len(w.encode()) ** 2 for w in set(words))
    for w, p in zip(words, parts, strict=True):
        assert b"".join(p) == w.encode()
        assert [i for x in p for i in enc._encode_single_piece(x)] == enc.encode_ordinary(w)


def test_unit_encoder_equals_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = tokens.unit_encoder(path), Tokenizer.from_file(path)
    for t in make_texts() + ["a <|endoftext|> b", "<|endoftext|>", " a", "a ", "a \n b", "\n\n a", "a\t b", "a\r\nb"]:
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_warc_round_trip(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i % 4}?q={i}", h) for i, h in enumerate(["one", "two", "one", None, "", "WARC/1.1\r\n\r\nx\r\n\r\n", "one", "é" * 500])] + [(20, None, "two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    got = warc.archive_and_index(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        h = dict((i, x) for i, _, x in rows)[r.page_id] or ""
        want = None if first[h] == r.page_id else first[h]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if want is not None else "response", want)
    order = [(r.url_key, r.ts, r.page_id) for r in sorted(got, key=lambda r: (r.range_no, r.place))]
    assert order == sorted(order)
    assert warc.archive_and_index(pages.limit(0)).count() == 0
    big = {r.page_id: r.record_type for r in warc.archive_and_index(pages, least_bytes=3).collect()}
    assert big[4] == "response" and big[2] == "revisit"


def test_loser_tree():
    rng = random.Random(5)
    for k in range(7):
        runs = [sorted(rng.choices(range(20), k=rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_line_spread(spark):
    rows = [(i, "\n".join([f"own {i}", "shared by all", "pair" if i < 2 else f"x{i}", ""]), f"s{i}") for i in range(12)] + [(12, None, "s0"), (13, "", None), (14, "shared by all", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("at", __import__("pyspark").sql.functions.lit(1))
    got = {r.doc_id: r for r in lines.remove_boilerplate(df, sites=10).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    assert got[3].text == "own 3\nx3\n" and got[3].n_removed == 1 and got[3].n_lines == 4
    assert got[12].text is None and got[12].n_lines == 0 and got[14].text == "" and got[14].n_removed == 1
    assert lines.remove_boilerplate(df.limit(0)).count() == 0


def brute_components(ids, linked):
    of = {i: i for i in ids}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                of[y] = x
    return {i: find(i) for i in ids}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(150):
        v = base[i % 30] + rng.standard_normal(16) * 0.12 * (i // 30)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, [2 * x for x in rows[0][1]], 0), (207, [1.0, 2.0], 0), (208, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: np.array(v, dtype=float) for i, v, l in rows if v and None not in v and l is not None and np.isfinite(np.array(v)).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    cos = lambda a, b: len(good[a]) == len(good[b]) and label[a] == label[b] and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.93
    comp = brute_components(list(good), cos)
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        want = sum(cos(i, j) for j in good if j != i) if i in good else 0
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (want, comp.get(i, i), comp.get(i, i) == i)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_embedding_blocks(spark):
    """A crowded bucket cut into small blocks, a chain whose ends do not link, copies: equal to all pairs."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(24)
    crowd = [centre + rng.standard_normal(24) * s for s in np.linspace(0.05, 0.35, 300)]
    chain = [np.concatenate([[np.cos(a), np.sin(a)], np.zeros(22)]) for a in np.arange(40) * 0.3]
    rows = [(i, [float(v) for v in x], "a" if i % 3 else "b") for i, x in enumerate([*crowd, *chain, *crowd[:30]])]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    low = np.arange(len(rows))
    while True:
        new = np.minimum(low, np.where(near, low[None, :], len(rows)).min(1))
        if (new == low).all():
            break
        low = new
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for block in (1, 7, 512):
        got = embeddings.near_duplicate_vectors(df, block=block).orderBy("vec_id").collect()
        assert [r.n_links for r in got] == near.sum(1).tolist()
        assert [r.component_id for r in got] == low.tolist()


def plain_fingerprint(text):
    words = regex.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, empty):
    texts = make_texts()
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    comp = brute_components(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == comp
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_keep_one_keeps_a_row_of_each_class(spark):
    """Null keys, repeated rows and a key on two texts, against brute force over whole rows."""
    rng = random.Random(12)
    text = [" ".join(rng.choices(WORDS, k=40)) for _ in range(6)]
    rows = [(None, text[0], "a"), (None, text[1], "b"), (None, text[1], "a"), (3, text[2], "a"), (3, text[2], "a"), (3, text[2], "b"), (None, text[2], "a"), (4, text[3], "a"), (4, text[4], "a"), (2, text[4], "a"), (None, None, "a"), (9, text[5], None)]
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    want = {}
    for k, t, _ in rows:
        fp, at = plain_fingerprint(t), (k is None, k or 0)
        want[fp] = min(want.get(fp, at), at)
    assert all((a ^ b).bit_count() > 4 for a in want for b in want if a != b)
    assert sorted((plain_fingerprint(t), (k is None, k or 0)) for k, t, _ in got) == sorted(want.items())
    assert set(got) <= set(rows)


def test_grid_join_finds_every_link(spark):
    rng = random.Random(9)
    values = set()
    for _ in range(60):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            values.add(v)
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r.fp: r.component for r in simhash.fingerprint_classes(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    comp = brute_components(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    groups = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert groups(got) == groups(comp)


def best_fit_one_by_one(sizes, cap):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= s]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= s
        else:
            bins.append(cap - s)
    return len(bins), sorted(bins)


def test_bulk_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for cap in (1, 7, 64, 100):
        for _ in range(40):
            sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 80))]
            plan, bins = packing.plan_best_fit(dict(Counter(sizes)), cap)
            used = {}
            for length, _, items, first, per, offset in plan.tolist():
                for j in range(items):
                    used.setdefault(first + j // per, []).append((offset + j % per * length, length))
            assert sum(len(v) for v in used.values()) == len(sizes)
            for v in used.values():
                at = 0
                for o, n in sorted(v):
                    assert o == at
                    at += n
                assert at <= cap
            assert (bins, sorted(cap - sum(n for _, n in v) for v in used.values())) == best_fit_one_by_one(sizes, cap)


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(make_texts())}
    got = packing.pack(docs, path).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    for i, whole in ids.items():
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))] and sum(p.length for p in parts) == len(whole)
        assert len(parts) == 1 or all(p.length == 1024 for p in parts[1:])
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(empty, path).count() == 0


def test_sharding(docs, empty, spark):
    many = spark.range(4000).selectExpr("id as doc_id", "cast(id % 50 as string) as text").union(spark.createDataFrame([(None, None), (7, "7"), (7, "7")], "doc_id long, text string"))
    got = sharding.assign_shards(many, sharding.even_tree(24)).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got) and any(r.grown_shard == 24 for r in got)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    counts = Counter(r.shard for r in got)
    assert len(counts) == 24 and max(counts.values()) < 1.5 * 4003 / 24
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id is None} == {(8, 0)}
    assert sharding.assign_shards(empty, sharding.even_tree(24)).count() == 0
    weighted = sharding.Tree((((3.0, 1.0),), ((0.0, 2.0),)))
    share = Counter(r.s for r in sharding.with_shard(spark.range(6000).toDF("doc_id"), __import__("pyspark").sql.functions.col("doc_id"), weighted, "s").collect())
    assert share[2] == 0 and abs(share[0] / 6000 - 0.5) < 0.05 and abs(share[3] / 6000 - 1 / 3) < 0.05


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", "reply", '{"turn": 1, "prompt": "x"}', [], 0), (1, "b", "reply", '{"prompt": 5, "extra": 1}', ["a"], 1), (1, "c", "nope", "{}", ["a", "b"], 2), (1, "d", "reply", "not json", ["e"], 3), (1, "e", "configure", None, ["d"], 4), (1, "a", "reply", "{}", [], 9), (2, None, "reply", "{}", [], 0)],
        "conv_id long, call_id string, name string, arguments string, waits_for array<string>, position long",
    )
    results = spark.createDataFrame([(1, "a", 'say "hi"\n', 5), (1, "a", "later", 6), (1, "zz", "lost", 7)], "conv_id long, call_id string, content string, position long")
    got = {r.call_id: r for r in toolcalls.link_tool_calls(calls, results, toolcalls.SCHEMAS).collect()}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}
    assert got["a"].valid and got["a"].n_results == 2 and got["a"].canonical == '{"arguments":{"prompt":"x","turn":1},"id":"a","name":"reply","result":"say \\"hi\\"\\n"}'
    assert got["b"].errors == "missing turn; prompt is not string; unknown field extra" and got["c"].errors == "unknown tool nope"
    assert got["d"].errors == "not an object" and not got["e"].valid


def test_tool_calls_from_turns(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "user", None), (2, 0, "user", "alone"), (None, 0, "user", "x"), (1, 3, "user", None)]
    calls, results = toolcalls.calls_from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.call_id: r for r in toolcalls.link_tool_calls(calls, results, toolcalls.SCHEMAS).collect()}
    assert {k: r.level for k, r in got.items()} == {"1:0": 0, "1:1": 1, "1:3": 2, "2:0": 0}
    assert got["1:1"].result_position == 2 and got["1:3"].n_results == 0 and got["1:3"].errors == "prompt breaks minLength"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    labels = common.table(spark, sf, "labels").where("toxic is not null").collect()
    judged = [(rows[r.doc_id].predicted, r.toxic) for r in labels if rows[r.doc_id].held_out]
    assert sum(p == t for p, t in judged) / len(judged) > 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())


def test_toxicity_held_out_of_both_kinds(spark):
    """Recall and precision, which no constant reaches, and single letters put into learnt insults at every inner place."""
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = toxicity.train_from_tables(docs, labels, queries.MAX_TRAIN)
    told = labels.where("toxic is not null").where(toxicity.held_out("doc_id")).select("doc_id", "toxic")
    rows = toxicity.score(docs.join(told, "doc_id", "left_semi"), model).join(told, "doc_id").collect()
    hit, found, toxic = sum(r.predicted and r.toxic for r in rows), sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    assert toxic > 50 and hit / toxic >= 0.9 and hit / found >= 0.7
    learnt = ["idiot", "loser", "moron", "stupid"]
    hidden = [w[:i] + x + w[i:] for w in learnt for i in range(1, len(w)) for x in "xq"]
    calm = "the house stood on a hill and nobody asked who had built it or when the road had come there".split()
    probe = spark.createDataFrame(list(enumerate(learnt + hidden + calm)), "doc_id long, text string")
    got = [r.predicted for r in sorted(toxicity.score(probe, model).collect(), key=lambda r: r.doc_id)]
    assert got[:4] == [1] * 4 and sum(got[4 : 4 + len(hidden)]) / len(hidden) >= 0.8 and not any(got[4 + len(hidden) :])


def test_kernel_against_a_naive_one():
    """Every common subsequence of three and four letters within SPAN, listed."""
    def listed(word):
        s, out = f"\x02{word}\x03", {}
        for size in (3, 4):
            for at in combinations(range(len(s)), size):
                if at[-1] - at[0] < toxicity.SPAN:
                    u = "".join(s[i] for i in at)
                    out[u] = out.get(u, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["loser", "lxoser", "losser", "closer", "idiot", "a", "abcabcabc", "éàü"]
    plain = [listed(w) for w in words]
    dot = lambda a, b: sum(v * b.get(u, 0) for u, v in a.items())
    want = np.array([[dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for b in plain] for a in plain])
    base = toxicity.dense(words)
    assert np.abs(base @ base.T - want).max() < 0.02 and want[0, 1] > 0.5 > want[0, 4]


def test_toxicity_tolerates_insertions(spark):
    rng = random.Random(1)
    calm = [" ".join(rng.choices(WORDS, k=30)) for _ in range(80)]
    rude = [c + " " + rng.choice(["blockhead", "dunderpate"]) for c in calm[:40]]
    df = spark.createDataFrame([(i, t, int(i >= 80)) for i, t in enumerate(calm + rude)], "doc_id long, text string, toxic int")
    model = toxicity.train(df)
    probe = ["you blockhead", "you bl0ockhead!", "you blockkhead", "b l o c k h e a d", "alpha beta", "", None, "x" * 5000]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(probe))] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert toxicity.train(df.where("toxic = 0")) is None
    assert {r.predicted for r in toxicity.score(df, None).collect()} == {0}


def test_reject_toxic_judges_each_row(spark):
    rng = random.Random(1)
    calm = [" ".join(rng.choices(WORDS, k=30)) for _ in range(40)]
    rude = [c + " " + rng.choice(["blockhead", "dunderpate"]) for c in calm]
    model = toxicity.train(spark.createDataFrame([(i, t, int(i >= 40)) for i, t in enumerate(calm + rude)], "doc_id long, text string, toxic int"))
    rows = [(None, "you blockhead", 1), (None, "alpha beta", 2), (7, "you blockhead", 3), (7, "alpha beta", 4), (7, "alpha beta", 4), (8, None, 5)]
    kept = toxicity.reject_toxic(spark.createDataFrame(rows, "doc_id long, text string, extra int"), model).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted((r for r in rows if r[1] != "you blockhead"), key=repr)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(0, x) for x in range(300, 340)] + [(None, 1)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = {(a, b) for a, b in pairs if a is not None and a != b}
    ids = sorted({x for p in links for x in p})
    assert got == brute_components(ids, lambda a, b: (a, b) in links or (b, a) in links)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, before, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_levels_against_brute_force(spark):
    """Chains, forks, joins, unknown names, repeats and cycles, against a walk in plain Python."""
    rng = random.Random(5)
    waits = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(70)}
    for i in range(60):
        waits[f"d{i}"] = [f"d{rng.randrange(i)}" for _ in range(rng.randrange(4))] if i else []
    waits |= {"x": ["y", "c3"], "y": ["z"], "z": ["x"], "behind": ["z"], "both": ["behind", "c5"], "self": ["self"], "lost": ["nowhere"], "late": ["c69", "d59", "c69"], "later": ["late"], "last": ["later", "d3"]}

    def walk(c, above=()):
        if c in above:
            return None
        below = [walk(w, (*above, c)) for w in waits[c] if w in waits]
        return None if None in below else max(below, default=-1) + 1

    rows = [(conv, c, w) for conv in (1, 2) for c, w in waits.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, waits_for array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.topological_levels(calls).collect()}
    assert got == {(conv, c): walk(c) for conv, c, _ in rows if walk(c) is not None}
    assert toolcalls.topological_levels(calls.limit(0)).count() == 0
