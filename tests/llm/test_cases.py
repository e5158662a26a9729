"""Clashing names, nulls, repeats, ties and empty tables of every operator and stage; laws against recomputation."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest

import numpy as np
from pyspark.sql import functions as F
from strandwork.llm import common, embeddings, lines, media, queries, sharding, simhash, toolcalls, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
CLASH = ["row", "k", "t", "h", "site", "cut", "at", "n", "o", "top", "hits", "_k", "_h", "_cut", "n_lines", "n_removed", "fp", "component", "_top", "_n", "part", "place"]


def with_clashes(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def text_rows(n=40, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=40)) for _ in range(n)]


def test_extra_columns_of_any_name_pass(spark):
    texts = text_rows()
    rows = [(i, t + "\nshared line", f"s{i % 12}") for i, t in enumerate(texts)] + [(None, texts[0], None), (3, texts[3] + "\nshared line", "s3"), (50, None, "s1"), (51, "", "s1")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = with_clashes(plain)
    model = toxicity.train(spark.createDataFrame([(i, t + (" blockhead" if i % 2 else ""), i % 2) for i, t in enumerate(texts)], "doc_id long, text string, toxic int"))
    for step in (lambda d: lines.remove_boilerplate(d, 10, counts=("removed_lines", "all_lines")), simhash.keep_one, lambda d: toxicity.reject_toxic(d, model)):
        want, got = step(plain), step(df)
        assert sorted(map(repr, want.collect())) == sorted(map(repr, got.select(want.columns).collect()))
        for r in got.collect():
            assert all(r[c] == f"own {c}" for c in CLASH)
        assert step(df.limit(0)).count() == 0
    both = lines.remove_boilerplate(df, 10)
    assert both.columns.count("n_lines") == 1 and {r.n_removed for r in both.collect()} == {0, 1}
    for op in (lambda d: media.media_features(media.store_as_png(d)), lambda d: toxicity.score(d, model), lambda d: sharding.assign_shards(d, sharding.even_tree(4)), simhash.near_duplicates):
        assert sorted(map(repr, op(plain).collect())) == sorted(map(repr, op(df).collect()))


def test_long_texts_and_repeated_rows_in_line_spread(spark):
    long = "\n".join(f"line {i}" for i in range(20000))
    rows = [(i, f"own {i}\nshared", f"s{i}") for i in range(12)] + [(20, long + "\nshared", "s0")] * 2 + [(5, "own 5\nshared", "s5")]
    got = [tuple(r) for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert Counter(got)[(20, long, "s0", 20001, 1)] == 2 and Counter(got)[(5, "own 5", "s5", 2, 1)] == 2 and (0, "own 0\nshared", "s0", 2, 0) in got


def test_stages(spark, tmp_path):
    """Each stage of the pipeline with nulls, empties, repeats, extra columns and no rows, against what its rule says."""
    import corpus_pipeline

    texts = text_rows(60, 4)
    toxic = [t + " blockhead" for t in texts[:30]]
    docs = [(i, t) for i, t in enumerate(texts + toxic)] + [(200, texts[1]), (201, None), (202, ""), (None, text_rows(1, 9)[0]), (40, texts[40])]
    common_line = "the same line stands here"
    rows = [(i, t if t is None or i is None or i % 5 else t + "\n" + common_line, "en", f"s{(i or 0) // 5 % 15}", len(t or "")) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df, stages = with_clashes(df), dict(corpus_pipeline.STAGES)
    sf = str(tmp_path)
    kept = stages["toxicity"](spark, df, sf)
    assert kept.columns == df.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, [r for r in df.collect() if "blockhead" not in (r.text or "")]))
    cut = stages["line_dedup"](spark, kept, sf)
    assert cut.columns == df.columns
    first = min(r.doc_id for r in kept.collect() if r.text and common_line in r.text)
    for r in cut.collect():
        assert (common_line in (r.text or "")) == (r.doc_id == first) and (r.text is None or r.doc_id == first or r.n_chars == len(r.text)) and r.n_lines == "own n_lines"
    assert cut.count() == kept.count()
    one = stages["simhash_dedup"](spark, cut, sf)
    left = Counter(r.doc_id for r in one.collect())
    assert one.columns == df.columns and left[40] == 1 and left[200] == 0 and left[None] == 1 and left[201] + left[202] == 1
    packed = stages["best_fit_packing"](spark, one, sf)
    assert Counter(r.doc_id for r in packed.collect()) == left
    for stage in stages.values():
        assert stage(spark, df.limit(0), sf).count() == 0


def test_embeddings_repeats_and_clashes(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64))
    vectors = [[float(x) for x in base[i // 5] + 0.25 * rng.standard_normal(64)] for i in range(200)]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(7, vectors[100], 2), (None, vectors[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"rep": F.lit(1), "unit": F.lit(2), "bucket": F.lit(3), "n": F.lit(4)})
    got = Counter(map(tuple, embeddings.near_duplicate_vectors(df).collect()))
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = x @ x.T >= 0.93
    links = {r[0]: r[1] for r in got}
    assert [links[i] for i in range(200)] == (near.sum(axis=1) - 1).tolist() and near.sum() > 400
    assert sum(n for r, n in got.items() if r[0] == 7) == 2 and links[None] == 0
    assert got == Counter(map(tuple, embeddings.near_duplicate_vectors(df.repartition(3)).collect()))


def test_recall_of_the_hash_tables_at_the_threshold(spark):
    """Pairs planted just over a cosine of 0.93 are all found."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    u = rng.standard_normal((400, 64))
    u -= (u * a).sum(axis=1)[:, None] * a
    u /= np.linalg.norm(u, axis=1)[:, None]
    b = 0.9302 * a + math.sqrt(1 - 0.9302**2) * u
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, b]))]
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[i + 400] == i for i in range(400)) == 400


def test_toxicity_repeats_and_empty(spark):
    texts = text_rows(60, 3)
    rows = [(i, t + (" blockhead" if i % 2 else ""), i % 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, "another text"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    a, b = toxicity.train_from_tables(docs, labels, 50), toxicity.train_from_tables(docs.repartition(5), labels.repartition(3), 50)
    assert a.bias == b.bias and (a.v == b.v).all() and (a.coef == b.coef).all()
    assert toxicity.train_from_tables(docs.limit(0), labels, 50) is None and toxicity.score(docs.limit(0), a).count() == 0
    assert {r.h for r in docs.where("doc_id is null").select(toxicity.held_out("doc_id").alias("h")).collect()} == {True}


def plain_errors(value, schema, within=""):
    """What is wrong with an object, field by field."""
    kinds = {"string": lambda x: isinstance(x, str), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool), "boolean": lambda x: isinstance(x, bool), "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list)}
    out = [f"missing {within}{f}" for f in schema.get("required", []) if f not in value]
    deeper = []
    for f, rule in schema.get("properties", {}).items():
        if f not in value:
            continue
        x = value[f]
        if not kinds[rule["type"]](x):
            out.append(f"{within}{f} is not {rule['type']}")
            continue
        if "minLength" in rule and len(x) < rule["minLength"]:
            out.append(f"{within}{f} breaks minLength")
        if "minimum" in rule and x < rule["minimum"]:
            out.append(f"{within}{f} breaks minimum")
        if "items" in rule and not all(kinds[rule["items"]["type"]](y) for y in x):
            out.append(f"{within}{f} holds what is not {rule['items']['type']}")
        if rule["type"] == "object":
            deeper += plain_errors(x, rule, f"{within}{f}.")
    return out + [f"unknown field {within}{k}" for k in sorted(value) if k not in schema.get("properties", {})] + deeper


def test_arguments_against_a_plain_validator(spark):
    """Names with dots, brackets, quotes and question marks; links by identifier within the conversation."""
    rng = random.Random(6)
    names = ["a.b", "x[0]", 'q"t', "o'k?", "plain", "$", "é"]
    inner = {"properties": {n: {"type": "integer", "minimum": 1} for n in names[:4]}, "required": names[1:3]}
    schema = {"properties": {"a.b": {"type": "string", "minLength": 2}, "x[0]": {"type": "array", "items": {"type": "string"}}, 'q"t': {"type": "object", **inner}, "o'k?": {"type": "boolean"}, "$": {"type": "integer", "minimum": 0}}, "required": ["a.b", 'q"t']}
    value = lambda deep: rng.choice(["", "ab", 0, 5, -1, True, ["a"], ["a", 1], {n: rng.choice([0, 2, "x"]) for n in rng.sample(names, 3)} if deep else {}])
    bodies = [{n: value(True) for n in rng.sample(names, rng.randrange(0, 7))} for _ in range(150)]
    calls = [(i % 7, f"c{i}", "go", json.dumps(b), [], i) for i, b in enumerate(bodies)]
    results = [(rng.randrange(7), f"c{rng.randrange(150)}", f"r{j}", 1000 + j) for j in range(200)]
    frame = spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, waits_for array<string>, position long")
    got = toolcalls.link_tool_calls(frame, spark.createDataFrame(results, "conv_id long, call_id string, content string, position long"), {"go": schema}).collect()
    assert len(got) == 150
    for r in got:
        want = plain_errors(bodies[int(r.call_id[1:])], schema)
        assert sorted(filter(None, r.errors.split("; "))) == sorted(want) and r.valid == (not want), (r.call_id, r.errors)
        mine = [x for x in results if x[:2] == (r.conv_id, r.call_id)]
        assert r.n_results == len(mine) and r.result_position == min((x[3] for x in mine), default=None)


def test_tool_call_cases(spark):
    schema = {"go": {"properties": {"to": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 1}}, "required": ["x"]}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["to"]}}
    bodies = ['{"to": {"x": 2}, "tags": ["a"]}', '{"to": {"x": 0, "y": 1}}', '{"to": {}, "tags": [1]}', '{"to": 3}', '{"to": {"x": 1}, "to": {"x": 1}}']
    calls = spark.createDataFrame([(1, f"c{i}", "go", b, [f"c{i + 1}"] if i < 4 else [], 9 - i) for i, b in enumerate(bodies)] + [(1, "loop", "go", bodies[0], ["loop"], 0), (2, "a", None, "{}", None, None)], "conv_id long, call_id string, name string, arguments string, waits_for array<string>, position long").withColumns({"level": F.lit(9), "part": F.lit(8), "nth": F.lit(7)})
    results = spark.createDataFrame([], "conv_id long, call_id string, content string, position long")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_tool_calls(calls, results, schema).collect()}
    assert [got[1, f"c{i}"].errors for i in range(5)] == ["", "to.x breaks minimum; unknown field to.y", "tags holds what is not string; missing to.x", "to is not object", "not an object"]
    assert [got[1, c].place for c in ("c4", "c3", "c2", "c1", "c0", "loop")] == [0, 1, 2, 3, 4, 5] and got[1, "loop"].level is None and got[2, "a"].place == 0
    assert json.loads(got[1, "c0"].canonical) == {"id": "c0", "name": "go", "arguments": json.loads(bodies[0]), "result": None}
    assert toolcalls.link_tool_calls(calls.limit(0), results, schema).count() == 0


def test_roles_that_share_a_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 1, "assistant", "c"), (2, 0, "user", "u"), (2, 0, "system", "s"), (2, 1, "assistant", "yes"), (2, 2, "user", "z"), (2, 2, "user", "y"), (3, 0, "tool", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"user": F.lit(1), "position": F.lit(2)})
    calls, results = toolcalls.calls_from_conversations(df)
    got = {r.call_id: r for r in toolcalls.link_tool_calls(calls, results, toolcalls.SCHEMAS).collect()}
    assert {k: (r.level, r.n_results) for k, r in got.items()} == {"1:0": (0, 1), "2:0": (0, 1), "2:0:system": (0, 1), "2:2": (1, 0)}
    assert json.loads(got["2:2"].canonical)["arguments"] == {"prompt": "y", "turn": 2}


def test_hash_tree_against_recomputation(spark):
    tree = sharding.even_tree(24)

    def walk(key, tree):
        def pick(node, weights):
            draws = [(-math.log((int(hashlib.md5(f"{key}/{node}{i}".encode()).hexdigest()[:12], 16) + 1.0) / (2**48 + 1)) / w, i) for i, w in enumerate(weights)]
            return min(draws)[1]

        r = pick("r", [sum(map(sum, x)) for x in tree.regions])
        k = pick(f"r{r}.", [sum(x) for x in tree.regions[r]])
        s = pick(f"r{r}.{k}.", tree.regions[r][k])
        return sum(len(x) for y in tree.regions[:r] for x in y) + sum(map(len, tree.regions[r][:k])) + s

    for r in sharding.assign_shards(spark.range(300).selectExpr("id as doc_id", "'x' as text"), tree).collect():
        assert (r.shard, r.grown_shard) == (walk(r.doc_id, tree), walk(r.doc_id, tree.grown()))


def test_warc_clashes_and_ranges(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/", f"p{i % 7}") for i in range(60)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("n", "digest", "body", "first", "revisit", "value")})
    runs = common.stored(warc.archive_and_index(pages), "runs").drop("range_no", "place")
    got = sorted(warc.merge_index(runs, 10).collect(), key=lambda r: (r.range_no, r.place))
    assert len({r.range_no for r in got}) > 2 and [(r.url_key, r.ts, r.page_id) for r in got] == sorted((r.url_key, r.ts, r.page_id) for r in got) and len(got) == 60


def test_cosine_hash_by_definition():
    rng = np.random.default_rng(3)
    for h in (1, 5, 32, 70):
        img = rng.integers(0, 256, (h, 64), dtype=np.uint8)
        cell = lambda n, i: (min(i * n // 32, n - 1), max((i + 1) * n // 32, min(i * n // 32, n - 1) + 1))
        grid = [[img[slice(*cell(h, y)), slice(*cell(64, x))].mean() for x in range(32)] for y in range(32)]
        basis = [[math.cos(math.pi * (2 * n + 1) * k / 64) for n in range(32)] for k in range(8)]
        terms = (np.array(basis) @ np.array(grid) @ np.array(basis).T).round(6).ravel()
        bits = "".join("1" if t > np.median(terms[1:]) else "0" for t in terms)
        assert media.cosine_hash(img) == f"{int(bits, 2):016x}"
    png = media.encode_png(bytes(range(64)) * 200)
    assert media.decode_png(png).tobytes() == bytes(range(64)) * 200


@pytest.mark.parametrize("name", ["op4_line_spread"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert Counter(cur.fetchall()) == Counter(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, sf).collect())
