"""The engine's operators against plain Python on small inputs, and their queries against SQL."""

import gzip
import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwork import store
from strandwork.functions import buckets
from strandwork.functions import packed as P
from strandwork.functions import seq as S
from strandwork.operators import correct, explore, graph, kmers, match, stats
from strandwork.plans import catalogue, workflow
from strandwork.sources import reads as R
from strandwork.sources import stages

K = 9


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canon(s):
    return min(s, rc(s))


def as_reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def test_sequence_functions(spark):
    row = spark.range(1).select(S.revcomp(F.lit("AGCTTGCT")).alias("a"), S.iupac_revcomp(F.lit("ACGTRYKMBVDHSW-")).alias("b"), S.push_right(F.lit("ACG"), F.lit("T")).alias("c"), S.push_left(F.lit("ACG"), F.lit("T")).alias("d")).first()
    assert tuple(row) == ("AGCAAGCT", "nwsdhbvkmryacgt", "CGT", "TAC")
    for k, mu, want in ((10, 10, 0.12511003572113349), (100, 10, 4.8646491820674864e-63), (1000, 10, 0.0)):
        got = spark.range(1).select(S.poisson_pdf(F.lit(float(k)), F.lit(float(mu)))).first()[0]
        assert got == pytest.approx(want, rel=1e-8, abs=1e-300)


def test_windows_of_long_sequences(spark):
    rng = random.Random(1)
    s = "".join(rng.choices("ACGTN", k=1500))
    got = {(r.pos, r.w) for r in S.windows(as_reads(spark, [s, "ACG"]), "seq", K, ["read_id"]).collect()}
    assert got == {(i + 1, s[i : i + K]) for i in range(len(s) - K + 1)}


def test_sums_of_windows_without_a_row_each(spark):
    """as seq.windows gives them, a row a text."""
    rows = spark.createDataFrame([(1, "ACGTN" * 20), (1, "ACGTACG"), (2, "ACGTAC"), (3, None), (4, ""), (5, "TTTTTTT")], "read_id long, seq string")
    sums = P.placed_sums(rows, "seq", 7, ["read_id"])
    assert sums.count() == 3
    got = sums.groupBy("read_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    plain = S.windows(rows, "seq", 7, ["read_id"]).groupBy("read_id").agg(F.sum(F.ascii("w") * F.col("pos")).cast("long").alias("s"), F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert P.placed_sums(rows.where("read_id > 9"), "seq", 7, ["read_id"]).count() == 0


def test_packed_kmers(spark, monkeypatch):
    """Codes of windows on both strands, stretches of long texts, and the column forms, against plain text."""
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n)) for n in (0, 5, 40, 700, 90)] + [None]
    number = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    for k in (1, 2, 9, 16, 31):
        monkeypatch.setattr(P, "CHUNK", 64)
        df = as_reads(spark, seqs)
        got = {(r.read_id, r.pos, r.code, r.same) for r in P.windows(df, "seq", k, ["read_id"]).collect()}
        wins = [(i, j + 1, s[j : j + k]) for i, s in enumerate(seqs) for j in range(len(s or "") - k + 1) if "N" not in s[j : j + k]]
        assert got == {(i, j, number(canon(w)), w == canon(w)) for i, j, w in wins}
        count = Counter(number(canon(w)) for _, _, w in wins)
        assert {r.code: r.n for r in P.counts(df, "seq", k).groupBy("code").agg(F.sum("n").alias("n")).collect()} == count
        one = [w for _, _, w in wins][:40]
        rows = spark.createDataFrame([(w,) for w in one], "w string").withColumn("c", P.code_of(F.col("w")))
        for r in rows.select("w", "c", P.letters(F.col("c"), k).alias("t"), P.letters(P.revcomp(F.col("c"), k), k).alias("r")).collect():
            assert (r.c, r.t, r.r) == (number(r.w), r.w, rc(r.w))
    with pytest.raises(ValueError):
        P.windows(as_reads(spark, seqs), "seq", 32, [])


def brute_graph(seqs, k):
    count = Counter(canon(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT"))
    solid = {x for x, n in count.items() if n > 1}
    arcs = set()
    for s in seqs:
        for i in range(len(s) - k):
            a, b = s[i : i + k], s[i + 1 : i + 1 + k]
            if canon(a) in solid and canon(b) in solid and set(a + b) <= set("ACGT"):
                arcs |= {(a, b), (rc(b), rc(a))}
    out, into = Counter(a for a, _ in arcs), Counter(b for _, b in arcs)
    nxt = {a: b for a, b in arcs if out[a] == 1 and into[b] == 1 and a != b and b != rc(a)}
    prev = {b: a for a, b in nxt.items()}
    seen, nodes = set(), []
    for v in sorted(solid | {rc(x) for x in solid}):
        if v in seen:
            continue
        start = v
        while start in prev and prev[start] != v:
            start = prev[start]
        path = [start]
        while path[-1] in nxt and nxt[path[-1]] != start:
            path.append(nxt[path[-1]])
        seen |= set(path) | {rc(x) for x in path}
        nodes.append(path)
    return solid, arcs, nodes


@pytest.mark.parametrize("case", ["random", "fork", "circle", "hairpin"])
def test_graph(spark, case):
    rng = random.Random(7)
    g = "".join(rng.choices("ACGT", k=300))
    if case == "random":
        seqs = [g[i : i + 60] for i in range(0, 240, 10)]
        seqs += [rc(x) for x in seqs[::2]]
    elif case == "fork":
        seqs = [g[:120]] * 3 + [g[:60] + rc(g[200:260])] * 2 + [g[:60] + ("A" if g[60] != "A" else "C") + g[61:120]] * 2
    elif case == "circle":
        seqs = [g[:40] + g[:50]] * 2
    else:
        seqs = [g[:40] + rc(g[:40])] * 2
    solid, arcs, nodes = brute_graph(seqs, K)
    built = graph.build(spark, as_reads(spark, seqs), K)
    assert {r.kmer for r in kmers.spelt(built["solid"], K).collect()} == solid
    text = lambda c: P.letters(F.col(c), K).alias(c)
    assert {(r.src, r.dst) for r in kmers.kmer_neighbors(built["masks"], K).select(text("src"), text("dst")).collect()} == arcs
    got = [r.seq for r in built["nodes"].collect()]
    assert Counter(frozenset(canon(s[i : i + K]) for i in range(len(s) - K + 1)) for s in got) == Counter(frozenset(canon(x) for x in p) for p in nodes)
    assert sum(len(s) - K + 1 for s in got) == len(solid)
    assert set(graph.sanity(built["nodes"], built["arcs"], K).first()) == {0}
    total = sum(len(s) - K + 1 for s in seqs if True) - sum(canon(s[i : i + K]) not in solid for s in seqs for i in range(len(s) - K + 1))
    assert built["nodes"].agg(F.sum("kmer_cov")).first()[0] == total


@pytest.mark.parametrize("together", [1, 1 << 18])
def test_graph_from_pieces(spark, monkeypatch, together):
    """Nodes, arcs and coverage from buckets, each alone and all in one, against those of single k-mers and of reads' positions; no read is placed for them."""
    monkeypatch.setattr(buckets, "TOGETHER", together)
    rng = random.Random(5)
    g, tangle = "".join(rng.choices("ACGT", k=400)), "".join(rng.choices("AC", k=300))
    seqs = [g[i : i + 60] for i in range(0, 200, 9)] + [rc(g[i : i + 50]) for i in range(0, 200, 21)] + [tangle[i : i + 70] for i in range(0, 230, 20)] * 2
    seqs += [g[200:240] + g[200:255]] * 2 + [g[260:290] + rc(g[260:290])] * 3 + ["A" * 30, "AT" * 20, "ACG" * 12 + "N" + "TTTTTTTTTTTT", "", "ACG"]
    reads = as_reads(spark, seqs)
    built = graph.build(spark, reads, K)
    assert {"masks", "index", "positions", "solid"} & set(built) == set()
    solid = kmers.solid(kmers.kmer_count(reads, K)).localCheckpoint()
    count = Counter(canon(s[i : i + K]) for s in seqs for i in range(len(s) - K + 1) if "N" not in s[i : i + K])
    assert {(r.kmer, r.cov) for r in kmers.spelt(solid, K).collect()} == {(x, n) for x, n in count.items() if n > 1}
    assert Counter(kmers.own_solid_kmers(reads, K).collect()) == Counter(kmers.read_solid_kmers(reads, solid, K).collect())
    assert {r.code for r in kmers.weak(kmers.kmer_count(reads, K)).collect()} == {r.code for r in kmers.weak_kmers(reads, solid, K).collect()}
    masks = kmers.overlap_masks(reads, solid, K).localCheckpoint()
    assert Counter(masks.collect()) == Counter(built["masks"].collect())
    nodes = graph.saved(graph.unitigs(masks, K), "nodes")
    positions = graph.saved(graph.read_node_positions(reads, graph.kmer_index(nodes, K), K), "positions")
    arcs = graph.arc_coverage(positions, graph.unitig_arcs(nodes, masks, K))
    nodes = graph.node_coverage(positions, nodes)
    rows = lambda df, *c: Counter(tuple(r) for r in df.select(*c).collect())
    assert rows(built["nodes"], *nodes.columns) == rows(nodes, *nodes.columns)
    assert rows(built["arcs"], "src", "dst", "cov") == rows(arcs, "src", "dst", "cov")
    assert any(a == b for a, b, _ in rows(arcs, "src", "dst", "cov")) and any(a == -b for a, b, _ in rows(arcs, "src", "dst", "cov"))


def test_tips_bubbles_and_merge(spark):
    rng = random.Random(11)
    g = "".join(rng.choices("ACGT", k=200))
    wrong = g[:100] + ("A" if g[100] != "A" else "C") + g[101:]
    built = graph.build(spark, as_reads(spark, [g] * 12 + [wrong] * 2), 15)
    assert built["nodes"].count() == 4
    found = graph.bubbles(built["nodes"], built["arcs"], 45)
    gone = graph.bubble_removals(found, built["nodes"], 5.0, 400)
    assert graph.bubble_removals(found, built["nodes"], 5.0, 10).count() == 0  # too long to go
    assert gone.count() == 1
    nodes, arcs = graph.remove_nodes(built["nodes"], built["arcs"], gone)
    merged, left = graph.merge_linear(graph.saved(nodes, "n"), graph.saved(arcs, "a"), 15)
    assert [r.seq for r in merged.collect()] == [canon(g)] and left.count() == 0
    tip = graph.build(spark, as_reads(spark, [g] * 12 + [g[:100] + "".join(rng.choices("ACGT", k=20))] * 2), 15)
    assert graph.clip_tips(tip["nodes"], tip["arcs"], 3.0, 5.0, 400).count() == 1
    clean, _ = graph.purify(tip["nodes"], tip["arcs"], 15, 4.0, 100)
    assert [r.seq for r in clean.collect()] == [canon(g)]


def test_merge_walks_linked_nodes_alone(spark, monkeypatch):
    """nodes on no link are no rows of a path and no text of theirs is joined; each comes on its lesser strand."""
    nodes = spark.createDataFrame([(1, "TTTTACGGC", 5, 1), (2, "GGCAATG", 3, 0), (3, "TTTTTGAGA", 2, 0)], "node_id long, seq string, kmer_cov long, read_start_cov long")
    arcs = spark.createDataFrame([(1, -2, 4), (2, -1, 4)], "src long, dst long, cov long")
    nodes = nodes.withColumn("seq", F.when(F.col("node_id") == 2, S.revcomp(F.lit("GGCAATG"))).otherwise(F.col("seq")))
    plain, seen = graph.chains, []
    monkeypatch.setattr(graph, "chains", lambda links, *rest: seen.append(links.count()) or plain(links, *rest))
    merged, left = graph.merge_linear(nodes, arcs, 4)
    assert seen == [4]
    assert sorted(map(tuple, merged.collect())) == [(1, "CATTGCCGTAAAA", 8, 1, 10), (2, "TCTCAAAAA", 2, 0, 6)]
    assert left.count() == 0


@pytest.mark.parametrize("k", [15, 31])
def test_substitution_bubble_at_depth_k(spark, k):
    rng = random.Random(11)
    g = "".join(rng.choices("ACGT", k=200))
    wrong = g[:100] + ("A" if g[100] != "A" else "C") + g[101:]
    b = graph.build(spark, as_reads(spark, [g] * 12 + [wrong] * 2), k)
    branch = b["nodes"].where((F.col("marginal") == k) & (F.col("kmer_cov") == 2 * k)).first().node_id
    found = graph.saved(graph.bubbles(b["nodes"], b["arcs"], k), "found")
    assert {abs(r.path_a[0]) for r in found.collect()} == {branch} and found.count() == 2  # from both sides
    assert [r.node_id for r in graph.bubble_removals(found, b["nodes"], 3.0, 400).collect()] == [branch]
    clean, _ = graph.purify(b["nodes"], b["arcs"], k, 4.0, 100)
    assert [r.seq for r in clean.collect()] == [canon(g)]


def test_multiplicity_without_read_starts(spark):
    """No read starts in the longest nodes: nothing is known of any, and none is reliable."""
    n = spark.createDataFrame([(1, 900, 9000, 0, 2, 2), (2, 30, 300, 0, 2, 2), (3, 30, 300, 4, 2, 2)], "node_id long, marginal long, kmer_cov long, read_start_cov long, n_right long, n_left long")
    rows = stats.node_multiplicity(n)
    assert {(r.multiplicity, r.confidence, r.incorrectness) for r in rows.collect()} == {(0.0, 0.0, math.inf)}
    assert stats.reliable_nodes(rows, 15).count() == 0 and stats.node_multiplicity(n.limit(0)).count() == 0


def test_purify_reaches_long_branches(spark):
    """Two substitutions ten letters apart make a branch of k + 10, which a search of depth k does not cross."""
    k, nodes = 15, [(1, 86, 1032), (2, 25, 300), (3, 25, 50), (4, 74, 888)]
    rng = random.Random(11)
    g = "".join(rng.choices("ACGT", k=199))
    swap = lambda s, i: s[:i] + ("A" if s[i] != "A" else "C") + s[i + 1 :]
    wrong = swap(swap(g, 100), 110)
    seqs = {1: g[:100], 2: g[86:124 + 1], 3: wrong[86:124 + 1], 4: g[111:]}
    n = spark.createDataFrame([(i, seqs[i], c, 0, len(seqs[i]) - k + 1) for i, _, c in nodes], "node_id long, seq string, kmer_cov long, read_start_cov long, marginal long")
    a = [(1, 2), (1, 3), (2, 4), (3, 4)]
    arcs = spark.createDataFrame([(x, y, 5) for x, y in a] + [(-y, -x, 5) for x, y in a], "src long, dst long, cov long")
    assert set(graph.sanity(n, arcs, k).first()) == {0} and graph.bubbles(n, arcs, k).count() == 0
    clean, _ = graph.purify(n, arcs, k, 4.0, 100)
    assert [r.seq for r in clean.collect()] == [canon(g)]
    with pytest.raises(RuntimeError, match="settle"):
        graph.purify(n, arcs, k, 4.0, 100, max_rounds=1)
    chain = spark.createDataFrame([(1, 4, [2, 3, 4], [5, 4], 2.0, 9.0)], "root long, meet long, path_a array<long>, path_b array<long>, cov_a double, cov_b double")
    low = spark.createDataFrame([(2, 10, 20), (3, 10, 20), (4, 10, 90)], "node_id long, marginal long, kmer_cov long")
    assert {r.node_id for r in graph.bubble_removals(chain, low, 3.0, 400).collect()} == {2, 3}


def test_correction(spark):
    rng = random.Random(3)
    g = "".join(rng.choices("ACGT", k=200))
    bad = g[20:100][:50] + ("A" if g[70] != "A" else "C") + g[20:100][51:]
    rows = as_reads(spark, [g] * 5 + [bad, "ACGTACGTACG"])
    b = graph.build(spark, rows, K)
    got = {r.read_id: r for r in correct.correct(rows, b["positions"], b["nodes"], b["arcs"], K, retry=False).collect()}
    assert got[5].corrected == g[20:100] and got[5].substitutions == 1 and got[0].corrected == g
    assert got[6].corrected == "ACGTACGTACG"


def walk_score(a, b, gap=-3):
    """Banded alignment, band 2, cell by cell."""
    d = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(max(0, i - 2), min(len(b), i + 2) + 1):
            if i or j:
                hit = 1 if i and j and (a[i - 1] == b[j - 1] or "N" in (a[i - 1], b[j - 1])) else -1
                d[i, j] = max(d.get((i - 1, j - 1), -999) + hit, d.get((i - 1, j), -999) + gap, d.get((i, j - 1), -999) + gap)
    return d[len(a), len(b)]


def test_band_scores():
    rng = random.Random(5)
    pairs = [("", ""), ("A", "A"), ("", "AC")]
    for n in (5, 20, 60):
        for _ in range(30):
            a = "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n))
            b = list(a)
            for _ in range(rng.randrange(6)):
                b[rng.randrange(len(b))] = rng.choice("ACGT")
            if rng.random() < 0.5:
                del b[rng.randrange(len(b))]
                b.insert(rng.randrange(len(b) + 1), rng.choice("ACGT"))
            pairs.append((a, "".join(b)[: n - rng.randrange(3)]))
    assert list(correct.band_scores(*map(list, zip(*pairs, strict=True)))) == [walk_score(a, b) for a, b in pairs]


def best_extension(seq, node, pos, out, k, score=0, best=None, trail=""):
    """The search in plain form: depth first, best child first, a path counts if it beats all before it."""
    m = len(seq) - k + 1
    best = best if best is not None else [pos - m, pos, ""]
    kids = []
    for d, text in out.get(node, []):
        marginal = len(text) - k + 1
        n = min(marginal, m - pos)
        add = walk_score(seq[pos + k - 1 : pos + k - 1 + n], text[k - 1 : k - 1 + n])
        kids.append((-add / marginal, -(score + add), d, pos + n, text[k - 1 : k - 1 + n]))
    for _, s, d, p, letters in sorted(kids):
        if -s > best[0]:
            best[:] = [-s, p, trail + letters]
        if -s + m - p > best[0]:
            best_extension(seq, d, p, out, k, -s, best, trail + letters)
    return best


def test_search_over_arcs(spark):
    """Growth to the right over a graph of many branches against the depth-first search, and reads mended over branches."""
    rng = random.Random(8)
    g = "".join(rng.choices("ACGT", k=400))
    swaps = {60: "A", 75: "C", 140: "G", 150: "T", 230: "A", 300: "C"}
    h = "".join(swaps[i] if i in swaps and swaps[i] != c else c for i, c in enumerate(g))
    mix = g[:180] + h[180:]
    clean = [g] * 3 + [h] * 3 + [mix] * 2
    noisy = []
    for n in range(12):
        a = rng.randrange(0, 300)
        r = list((g, h, mix)[n % 3][a : a + 90])
        for _ in range(1 + n % 4):
            i = rng.randrange(90)
            r[i] = rng.choice([c for c in "ACGT" if c != r[i]])
        noisy.append(("".join(r), a))
    rows = as_reads(spark, clean + [r for r, _ in noisy])
    b = graph.build(spark, rows, K)
    texts = {}
    for r in b["nodes"].collect():
        texts[r.node_id], texts[-r.node_id] = r.seq, rc(r.seq)
    out = {}
    for r in b["arcs"].collect():
        out.setdefault(r.src, []).append((r.dst, texts[r.dst]))
    seeds = correct._spread(correct.merged_chains(correct.chained_seeds(b["positions"], b["nodes"], b["arcs"])), b["reads"], b["nodes"], K)
    before = {(r.read_id, r.seed): r for r in seeds.collect()}
    after = {(r.read_id, r.seed): r for r in correct._extended(seeds, correct.patches(b["nodes"], b["arcs"], 90, doublings=1), K).collect()}
    assert before.keys() == after.keys() and len(before) > 20
    for key, s in before.items():
        cut = max(s.lo + 1, s.hi - K)
        tail = [x for x in s.path if x.at < cut][-1]
        hi = min(len(s.seq) - K + 1, tail.at + tail.marginal)
        want = best_extension(s.seq, tail.node, hi, out, K)
        got = after[key]
        grown = "".join(x.text[K - 1 : K - 1 + x.marginal] for x in got.path if x.at >= hi)
        assert (got.hi, grown[: got.hi - hi]) == (want[1], want[2]), key
    done = {r.read_id: r for r in correct.correct(b["reads"], b["positions"], b["nodes"], b["arcs"], K, retry=False).collect()}
    walks = {t[a : a + 90] for t in (g, h, mix) for a in range(311)}
    assert all(done[i].corrected == clean[i] for i in range(8))
    mended = sum(done[8 + n].corrected in walks for n in range(12))
    assert mended >= 10 and all(len(done[8 + n].corrected) == 90 for n in range(12))


@pytest.mark.parametrize("doublings", [0, 1, 4])
def test_search_in_a_tangle(spark, doublings):
    """Two letters and short k-mers: nearly every node branches, and far more paths than 16 are open at a time."""
    k, rng = 7, random.Random(21)
    g = "".join(rng.choices("AC", k=260)) + "".join(rng.choices("ACGT", k=60))
    reads = [g] * 2
    for _ in range(10):
        a = rng.randrange(0, 280)
        r = list(g[a : a + 40])
        for _ in range(5):
            i = rng.randrange(len(r))
            r[i] = rng.choice([c for c in "ACGT" if c != r[i]])
        reads.append("".join(r))
    b = graph.build(spark, as_reads(spark, reads), k)
    texts = {}
    for r in b["nodes"].collect():
        texts[r.node_id], texts[-r.node_id] = r.seq, rc(r.seq)
    out = {}
    for r in b["arcs"].collect():
        out.setdefault(r.src, []).append((r.dst, texts[r.dst]))
    seeds = correct._spread(correct.merged_chains(correct.chained_seeds(b["positions"], b["nodes"], b["arcs"])), b["reads"].where("read_id > 1"), b["nodes"], k)
    near = correct.patches(b["nodes"], b["arcs"], 40, doublings, most=12)
    before = {(r.read_id, r.seed): r for r in seeds.collect()}
    after = {(r.read_id, r.seed): r for r in correct._extended(seeds, near, k).collect()}
    assert before.keys() == after.keys() and len(before) > 10
    for key, s in before.items():
        cut = max(s.lo + 1, s.hi - k)
        tail = [x for x in s.path if x.at < cut][-1]
        hi = min(len(s.seq) - k + 1, tail.at + tail.marginal)
        want = best_extension(s.seq, tail.node, hi, out, k)
        grown = "".join(x.text[k - 1 : k - 1 + x.marginal] for x in after[key].path if x.at >= hi)
        assert (after[key].hi, grown[: after[key].hi - hi]) == (want[1], want[2]), key
    few = {(r.read_id, r.seed): r for r in correct._extended(seeds, near, k, limit=3).collect()}
    assert few.keys() == after.keys() and any(few[x].hi < after[x].hi for x in few)


def test_match_counts_and_sizes(spark):
    """Counts of matches by length, and each read's length, against listed matches."""
    rng = random.Random(12)
    refs = ["".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n)) for n in (300, 40, 5)]
    reads = [refs[0][10:70], "".join(rng.choices("ACGT", k=50)), "ACGTNN" + refs[1][:30], "A" * 40, "ACG"]
    q = spark.createDataFrame(list(enumerate(reads)), "query_id long, seq string")
    r = spark.createDataFrame(list(enumerate(refs)), "ref_id long, seq string")
    found = Counter((x.query_id, x["len"]) for x in match.mems(q, r, 3).collect())
    n = {(i, size): sum(c for (a, x), c in found.items() if a == i and x >= size) for i in range(len(reads)) for size in range(3, 20)}
    got = {(x.query_id, x["size"]): x.n for x in correct.match_counts(q, r, list(range(3, 20))).collect()}
    assert {key: v for key, v in n.items() if v} == {key: v for key, v in got.items() if v}
    for enough in (2, 8, 30):
        sizes = {x.query_id: x["size"] for x in correct.match_sizes(q, r, 20, enough, 3).collect()}
        assert sizes == {i: max((x for x in range(3, 20) if n[i, x] >= enough), default=3) for i in range(len(reads))}


def test_mem_seeds(spark):
    """A read with an error in each k-mer has no seed of k-mers and is mended by matches shorter than k."""
    rng = random.Random(10)
    g = "".join(rng.choices("ACGT", k=300))
    r = list(g[100:190])
    for i in range(7, 90, 8):
        r[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[r[i]]
    rows = as_reads(spark, [g] * 3 + ["".join(r)])
    b = graph.build(spark, rows, K)
    assert b["positions"].where("read_id = 3").count() == 0
    fixed = correct.correct(rows, b["positions"], b["nodes"], b["arcs"], K).cache()
    got = {x.read_id: x for x in fixed.collect()}
    assert got[3].corrected == g[100:190] and got[3].by_mem and got[3].substitutions == 11
    assert correct.report(fixed).first()[:6] == (4, 4, 3, 1, 0, 11)


def test_alignment():
    unit = lambda a, b: max([0] if not a or not b else [unit(a[1:], b), unit(a, b[1:]), (a[0] == b[0]) + unit(a[1:], b[1:])])
    for a, b in (("", "A"), ("ACGT", "AGT"), ("AACCG", "CAGAC")):
        assert correct.align_unit(a, b) == unit(a, b)
    for b, want in (("ACGTACGTAC", 10), ("ACGTACGCAC", 8), ("ACGTACCGTAC", 7), ("ACGTAGTAC", 6)):
        assert correct.align_banded("ACGTACGTAC", b, 3) == want
    assert correct.align_unit("AGCTTGTAGCTTGCTAGCTTGCTAGCTTGCT", "AGCAAGCTAGCTTGCTAGCCTAGCTTGCT") == 26
    with pytest.raises(ValueError):
        correct.align_banded("A", "ACGTACGT")


def test_matches(spark):
    rng = random.Random(2)
    ref = ["".join(rng.choices("ACGT", k=200)) for _ in range(3)]
    ref[2] = ref[2][:50] + ref[0][40:90] + ref[2][50:]
    qs = [ref[0][30:80] + "N" + ref[1][5:40], "ACGT", ref[1][10:35]]
    want = set()
    for qi, q in enumerate(qs):
        for ri, r in enumerate(ref):
            for i in range(len(q)):
                for j in range(len(r)):
                    if i and j and q[i - 1] == r[j - 1] and q[i - 1] != "N":
                        continue
                    n = 0
                    while i + n < len(q) and j + n < len(r) and q[i + n] == r[j + n] and q[i + n] != "N":
                        n += 1
                    if n >= 12:
                        want.add((qi, ri, i + 1, j + 1, n))
    queries = spark.createDataFrame(list(enumerate(qs)), "query_id long, seq string")
    refs = spark.createDataFrame(list(enumerate(ref)), "ref_id long, seq string")
    mems = match.mems(queries, refs, 12)
    assert {(r.query_id, r.ref_id, r.q_start, r.r_start, r["len"]) for r in mems.collect()} == want
    assert {r.ok for r in match.verify(mems, queries, refs).collect()} == {True}
    text = lambda m: qs[m[0]][m[2] - 1 : m[2] - 1 + m[4]]
    occurs = lambda t: sum(r[j : j + len(t)] == t for r in ref for j in range(len(r)))
    mams = {(r.query_id, r.ref_id, r.q_start, r.r_start, r["len"]) for r in match.unique_matches(mems).collect()}
    assert mams == {m for m in want if occurs(text(m)) == 1}
    inside = lambda t: sum(q[j : j + len(t)] == t for q in qs for j in range(len(q)))
    mums = {(r.query_id, r.ref_id, r.q_start, r.r_start, r["len"]) for r in match.unique_matches(mems, both=True).collect()}
    assert mums == {m for m in mams if inside(text(m)) == 1} and len(mums) < len(mams)


def plain_mems(qs, ref, least):
    out = set()
    for qi, q in enumerate(qs):
        for ri, r in enumerate(ref):
            for i in range(len(q)):
                for j in range(len(r)):
                    if q[i] != r[j] or (i and j and q[i - 1] == r[j - 1] != "N"):
                        continue
                    n = 0
                    while i + n < len(q) and j + n < len(r) and q[i + n] == r[j + n] != "N":
                        n += 1
                    if n >= least:
                        out.add((qi, ri, i + 1, j + 1, n))
    return out


def found_mems(df):
    return sorted((r.query_id, r.ref_id, r.q_start, r.r_start, r["len"]) for r in df.collect())


@pytest.fixture(scope="module")
def long_texts(spark):
    rng = random.Random(13)
    ref = ["".join(rng.choices("ACGTN", weights=[30, 30, 30, 30, 1], k=n)) for n in (400, 150, 30, 3)]
    ref.append("".join(rng.choices("ACGT", k=130)))
    qs = [ref[4], ref[4][5:110] + "C" + ref[0][100:170], ref[0][:70] + ref[1][60:], "N" + ref[4][:31] + "N" + ref[4][32:72], "ACGT", "A" * 70]
    ref.append("A" * 90)
    return qs, ref, spark.createDataFrame(list(enumerate(qs)), "query_id long, seq string"), spark.createDataFrame(list(enumerate(ref)), "ref_id long, seq string")


@pytest.mark.parametrize("least", [20, 31, 40, 64, 100])
def test_matches_of_any_length(long_texts, least):
    qs, ref, queries, refs = long_texts
    want = sorted(plain_mems(qs, ref, least))
    assert len(want) > 1
    assert found_mems(match.mems(queries, refs, least)) == want
    for step in (1, 4, 10):
        assert found_mems(match.indexed_mems(queries, match.match_index(refs, least, step), least, step)) == want


def test_contexts_over_parts(long_texts, monkeypatch):
    qs, ref, queries, refs = long_texts
    want = sorted(plain_mems(qs, ref, 24))
    texts = [r.encode() for r in ref]
    monkeypatch.setattr(P, "CHUNK", 16)
    parts = [(row, start, begin) for _, rows, starts, begins, _ in P._parts(texts, 15, 9) for row, start, begin in zip(rows, starts, begins, strict=True)]
    assert {(r, s) for r, s, _ in parts} == {(i, s) for i, t in enumerate(texts) for s in range(0, len(t) - 14, 16)}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ref))), pa.array(ref)], names=["ref_id", "seq"])
    small = [tuple(x.values()) for b in P._in_context([batch], 15, 3, 9) for x in b.to_pylist()]
    monkeypatch.undo()
    assert sorted(small) == sorted(tuple(x.values()) for b in P._in_context([batch], 15, 3, 9) for x in b.to_pylist())
    assert found_mems(match.indexed_mems(queries, match.match_index(refs, 20, 4), 20, 4, shortest=24)) == want


def test_stored_index(spark, long_texts, tmp_path):
    qs, ref, queries, refs = long_texts
    for step in (1, 4, 10):
        match.save_index(refs, 24, step, f"file://{tmp_path}/{step}", buckets=4)
        index, least, kept = match.load_index(spark, f"file://{tmp_path}/{step}")
        assert (least, kept) == (24, step)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = match.indexed_mems(queries, index, least, kept)
        plan = found._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert found_mems(found) == sorted(plain_mems(qs, ref, 24))
        assert plan.count("hashpartitioning(code") == 1  # the queries alone are shuffled
    n = [spark.read.parquet(f"file://{tmp_path}/{step}/windows").count() for step in (1, 4, 10)]
    assert n[0] > 3.5 * n[1] > 8 * n[2] / 3
    with pytest.raises(ValueError):
        match.index_shape(20, 12)


def test_occurrences_of_any_length(spark):
    rng = random.Random(14)
    refs = ["".join(rng.choices("ACGTN", weights=[20, 20, 20, 20, 1], k=n)) for n in (300, 80, 10)]
    patterns = ["", None, "A", "N", "AC", "GTN", "ACGT", refs[0][:20], refs[0][:21], refs[0][5:27], rc(refs[0][30:90]), refs[1], refs[1] + "A", "T" * 30, refs[2]]
    refs.append(refs[0][50:120] + "ACGTACGT" + refs[0][5:27])
    both = lambda p: {p, rc(p)}
    count = lambda p: sum(t[i : i + len(p)] == p for t in refs for i in range(len(t)))
    got = match.occurrences(spark.createDataFrame(list(enumerate(patterns)), "id long, seq string"), spark.createDataFrame(list(enumerate(refs)), "ref_id long, seq string"))
    assert {r.id: r.n for r in got.collect()} == {i: sum(count(x) for x in both(p)) if p else 0 for i, p in enumerate(patterns)}


@pytest.mark.parametrize("few", [0, match.FEW])
def test_occurrences_in_one_pass(spark, monkeypatch, few):
    """Lengths about that of a window, texts side by side and cut pieces; few patterns take one pass over the references."""
    rng = random.Random(31)
    refs = ["".join(rng.choices("ACGTN", weights=[6, 3, 3, 6, 1], k=n)) for n in (500, 1, 0, 20, 21, 22, 300)]
    patterns = [refs[0][i : i + n] for i in (0, 90, 477) for n in range(1, 24)] + ["A", "A", "N" * 21, refs[4], refs[5], refs[3] + refs[4], None, ""]
    rows = spark.createDataFrame([*enumerate(refs), (None, refs[0]), (9, None)], "ref_id long, seq string")
    monkeypatch.setattr(match, "FEW", few)
    got = match.occurrences(spark.createDataFrame(list(enumerate(patterns)), "id long, seq string"), rows)
    count = lambda p: sum(t[i : i + len(p)] == p for t in [*refs, refs[0]] for i in range(len(t)))
    assert {r.id: r.n for r in got.collect()} == {i: sum(count(x) for x in {p, rc(p)}) if p else 0 for i, p in enumerate(patterns)}
    monkeypatch.setattr(P, "CHUNK", 37)
    known = {n: [int(s.translate(str.maketrans("ACGTN", "01234")), 8) for s in {t[i : i + n] for t in refs for i in range(len(t) - n + 1)}] for n in (1, 2, 20, 21)}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(refs))), pa.array(refs)], names=["ref_id", "seq"])
    made = [r for b in P._known([batch], {n: np.array(sorted(x)) for n, x in known.items()}) for r in b.to_pylist()]
    assert Counter({n: sum(r["n"] for r in made if r["size"] == n) for n in known}) == Counter({n: sum(max(0, len(t) - n + 1) for t in refs) for n in known})
    code = lambda s: int(s.translate(str.maketrans("ACGTN", "01234")), 8)
    assert all(code(refs[r["ref_id"]][r["pos"] - 1 : r["pos"] + 20]) == r["code"] for r in made if r["size"] == 21)


def test_range_lookup(spark):
    """Points and starts in many ranges, ranges without starts among them, against a scan."""
    rng = random.Random(15)
    starts = sorted(rng.sample(range(1000), 30)) + [5000]
    points = [(i, rng.randrange(6000)) for i in range(400)] + [(400, 5000), (401, starts[0] - 1), (402, None)]
    p = spark.createDataFrame(points, "i int, at long")
    s = spark.createDataFrame([(x, j if j % 3 else None, f"n{j}") for j, x in enumerate(starts)], "at long, node int, name string")
    got = {r.i: r.name for r in match.asof(p, s, "at").collect()}
    assert got == {i: next((f"n{j}" for j, x in reversed(list(enumerate(starts))) if at is not None and x <= at), None) for i, at in points}
    assert match.asof(p.limit(0), s, "at").count() == 0 and {r.name for r in match.asof(p, s.limit(0), "at").collect()} == {None}


def test_read_files(spark, tmp_path):
    seqs = ["ACGT" * 25, "acgtn" * 24, "TTTT"]
    texts = {
        "fasta": "".join(f">r{i} x>y A>G\n" + "\n".join(s[j : j + 60] for j in range(0, len(s), 60)) + "\n" for i, s in enumerate(seqs)),
        "fastq": "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)),
        "sam": "@HD\tVN:1\n" + "".join(f"r{i}\t0\tc\t1\t60\t*\t*\t0\t0\t{s}\t{'I' * len(s)}\tX:1\n" for i, s in enumerate(seqs)),
        "raw": "\n".join(seqs[:2]) + "\n\n" + seqs[2],
    }
    for kind, text in texts.items():
        plain, packed = tmp_path / f"a.{kind}", tmp_path / f"a.{kind.upper()}.gz"
        plain.write_text(text)
        packed.write_bytes(gzip.compress(text.encode()))
        for p in (plain, packed):
            got = R.read_reads(spark, str(p)).orderBy("read_id").collect()
            assert [r.seq for r in got] == [s.upper() for s in seqs], kind
        out = str(tmp_path / f"out.{kind}")
        R.write_reads(R.read_reads(spark, str(plain)), out, kind)
        body = "\n".join(r.value for r in spark.read.text(out).collect())
        if kind == "fasta":
            assert max(map(len, body.split("\n"))) == 70 and body.count("\n>") == 2 and body.count(" x>y A>G\n") == 3
        else:
            assert body.upper() == "\n".join(x for x in text.upper().split("\n") if x and not x.startswith("@HD"))
    with pytest.raises(ValueError):
        R.file_format("a.fa")
    assert R.default_output("x/y.fastq.gz") == "x/y.corr.fastq"
    (tmp_path / "bad.fastq").write_text("r0\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="FASTQ"):
        R.read_reads(spark, str(tmp_path / "bad.fastq")).collect()


def test_libraries_and_stage_files(spark, tmp_path):
    (tmp_path / "a.raw").write_text("ACGTACGTA\nACGTACGTA\n")
    (tmp_path / "b.fasta").write_text("lost\n>x\nAC\nGT\n>none\n>y\nTTTTTTTTT")
    got = R.read_libraries(spark, [str(tmp_path / "a.raw"), str(tmp_path / "b.fasta")]).orderBy("lib_id", "read_id").collect()
    assert [(r.lib_id, r.seq) for r in got] == [(0, "ACGTACGTA"), (0, "ACGTACGTA"), (1, "ACGT"), (1, "TTTTTTTTT")]
    with pytest.raises(ValueError):
        R.read_libraries(spark, [])
    b = graph.build(spark, as_reads(spark, [r.seq for r in got]), K)
    rows = lambda df: sorted(map(tuple, df.collect()))
    counts = kmers.kmer_count(b["reads"], K)
    for solid in (True, False):
        stages.write_kmers(counts, str(tmp_path / "kmers"), K, solid)
        assert rows(stages.read_kmers(spark, str(tmp_path / "kmers"), K)) == rows(counts.where("cov > 1") if solid else counts)
    with pytest.raises(ValueError):
        stages.read_kmers(spark, str(tmp_path / "kmers"), 11)
    stages.write_graph(b["nodes"], b["arcs"], str(tmp_path / "graph"))
    nodes, arcs = stages.read_graph(spark, str(tmp_path / "graph"))
    assert rows(nodes) == rows(b["nodes"].select(nodes.columns)) and rows(arcs) == rows(b["arcs"])
    stats_ = stats.library_stats(b["reads"].withColumn("source", F.lit("a")))
    stages.write_library_metadata(stats_, str(tmp_path / "met"))
    assert rows(stages.read_library_metadata(spark, str(tmp_path / "met"))) == rows(stats_)
    assert [stages.read_length(x, 31) for x in (None, 31.0, 100.0, 501.0)] == [150.0, 150.0, 100.0, 150.0]


def test_unreliable_neighbours(spark):
    """A sure node 1 with right neighbours 2 (twin, sure), 3 (low), 4 (a tip of middling coverage); 5 also leads into 2."""
    nodes = spark.createDataFrame([(i, "A" * (m + K - 1), c, 0, m) for i, m, c in ((1, 50, 500), (2, 60, 600), (3, 20, 20), (4, 20, 100), (5, 20, 40), (6, 30, 30))], "node_id long, seq string, kmer_cov long, read_start_cov long, marginal long")
    one = [(1, 2), (1, 3), (1, 4), (5, 2), (3, 6), (2, 6)]
    arcs = spark.createDataFrame([(x, y, 1) for x, y in one] + [(-y, -x, 1) for x, y in one], "src long, dst long, cov long")
    ids = lambda df: {x for r in df.collect() for x in r.gone}
    sure = spark.createDataFrame([(1, 3.0), (2, 3.0)], "node_id long, multiplicity double")
    assert ids(graph.delete_extra_neighbors(nodes, arcs, sure, 2.0, 10.0, 1.0, 400)) == {3, 6}
    assert ids(graph.delete_extra_neighbors(nodes, arcs, sure.where("node_id = 1"), 0.5, 10.0, 1.0, 400)) == {4}  # a tip under mean - 2 std
    assert ids(graph.delete_extra_neighbors(nodes, arcs, sure.where("node_id = 1"), 0.5, 6.0, 1.0, 400, nodes.where("node_id = 3").select("node_id"))) == {3}
    assert ids(graph.delete_extra_neighbors(nodes, arcs, sure, 2.0, 10.0, 1.0, 10)) == set()
    assert ids(graph.delete_extra_neighbors(nodes, arcs, sure.withColumn("multiplicity", F.lit(0.0)), 2.0, 10.0, 1.0, 400)) == set()
    assert ids(graph.connect_same_mult(nodes, arcs, sure, 3.0, 400)) == {3, 5}
    assert ids(graph.connect_same_mult(nodes, arcs, sure.withColumn("multiplicity", F.col("node_id") + 1.0), 3.0, 400)) == set()
    assert {(r.node_id, r.component) for r in explore.components(nodes.union(nodes.where("node_id = 1").withColumn("node_id", F.lit(9).cast("long"))), arcs).collect()} == {*((i, 1) for i in range(1, 7)), (9, 9)}
    near = {(r.root, r.node): r.depth for r in explore.neighborhood(nodes, arcs, spark.createDataFrame([(1,)], "root long"), 60).collect()}
    assert near == {(1, 1): 0, (1, 2): 50, (1, 3): 50, (1, 4): 50, (1, 6): 70, (1, 5): 110}


def plain_bubbles(nodes, arcs, depth, cutoff, limit=None):
    """Shortest paths of each colour from each root, one after another."""
    cov, length, out = {n: c / m for n, m, c in nodes}, {n: m for n, m, _ in nodes}, {}
    for a, b in arcs:
        out.setdefault(a, []).append(b)
    found = set()
    for root, kids in out.items():
        if len(kids) < 2 or min(cov[abs(x)] for x in kids) >= cutoff:
            continue
        done, heap = {}, [(length[abs(x)], (x,)) for x in kids]
        while heap:
            heap.sort()
            dist, path = heap.pop(0)
            if (path[-1], path[0]) in done:
                continue
            done[path[-1], path[0]] = path
            if dist <= depth and (limit is None or len(done) <= limit):
                heap += [(dist + length[abs(x)], (*path, x)) for x in out.get(path[-1], []) if x not in path and x != root]
        for (at, a), x in done.items():
            for (to, b), y in done.items():
                if at == to and (cov[abs(a)], a) < (cov[abs(b)], b):
                    found.add((root, at, x, y))
    return found


def test_bubbles_by_shortest_paths(spark):
    rng = random.Random(16)
    nodes = [(i, rng.randrange(1, 20), rng.randrange(1, 200)) for i in range(1, 31)]
    one = {(rng.choice([1, -1]) * rng.randrange(1, 31), rng.choice([1, -1]) * rng.randrange(1, 31)) for _ in range(55)}
    arcs = sorted({*one, *((-b, -a) for a, b in one)})
    n = spark.createDataFrame(nodes, "node_id long, marginal long, kmer_cov long")
    a = spark.createDataFrame(arcs, "src long, dst long")
    for limit in (None, 5):
        got = {(r.root, r.meet, tuple(r.path_a), tuple(r.path_b)) for r in graph.bubbles(n, a, 30, 8.0, limit).collect()}
        want = plain_bubbles(nodes, arcs, 30, 8.0, limit)
        assert got == want and len(want) > 10


@pytest.mark.parametrize("k,depth", [(7, 7), (7, 4), (5, 5)])
def test_bubbles_of_branches_walked_side_by_side(spark, k, depth):
    """Substitutions, insertions, repeats and runs of one letter: no bubble is lost and none is added."""
    rng = random.Random(18)
    g = "".join(rng.choices("ACGT", k=900 if k == 7 else 260))
    texts = [g]
    for i in range(20, len(g) - 20, 25):
        texts.append(g[:i] + rng.choice(["A", "CA", g[i - 3 : i], g[i - 2 : i] * 2, "AAAAAA", g[i - 1] * 4, ""]) + g[i + rng.choice([0, 1, 3]) :])
    built = graph.build(spark, as_reads(spark, [t for t in texts for _ in range(2)]), k)
    nodes, arcs = built["nodes"], built["arcs"]
    rows = lambda df: {(r.root, r.meet, tuple(r.path_a), tuple(r.path_b), r.cov_a, r.cov_b) for r in df.collect()}
    want = rows(graph.bubbles(nodes, arcs, depth))
    assert rows(graph.bubbles(nodes, arcs, depth, k=k)) == want and len(want) > 10
    assert any(len(a) > 1 and len(b) > 1 for _, _, a, b, _, _ in want)


def test_independent_deletions(spark):
    """Proposals taken one by one by priority; chains of clashes take several rounds."""
    rng = random.Random(17)
    rows = [((rng.random(), i), sorted(rng.sample(range(40), rng.randrange(1, 3)))) for i in range(60)]
    rows = [(p, gone, sorted(set(rng.sample(range(40), 4)) - set(gone))) for p, gone in rows] + [((2.0 + i, 99), [100 + i], [101 + i]) for i in range(12)]
    held, gone = set(), set()
    for _, g, k in sorted(rows):
        if not set(g) & held and not set(k) & gone:
            gone |= set(g)
            held |= set(k)
    frame = spark.createDataFrame(rows, "priority struct<c: double, i: long>, gone array<long>, kept array<long>")
    assert {r.node_id for r in graph.independent(frame).collect()} == gone and len(gone) > 10
    assert graph.independent(frame.limit(0)).count() == 0


def test_branches_do_not_both_go(spark):
    """Two branches of two nodes: seen from the left the upper one is lower, from the right the lower one. Only one loses."""
    nodes = spark.createDataFrame([(1, 50, 500), (2, 5, 10), (3, 5, 25), (4, 5, 20), (5, 5, 12), (6, 50, 500)], "node_id long, marginal long, kmer_cov long")
    one = [(1, 2), (2, 3), (3, 6), (1, 4), (4, 5), (5, 6)]
    arcs = spark.createDataFrame(one + [(-b, -a) for a, b in one], "src long, dst long")
    gone = {r.node_id for r in graph.bubble_removals(graph.bubbles(nodes, arcs, 30), nodes, 6.0, 400).collect()}
    assert gone == {2, 3}


def simulated(rng, size, coverage, errors, length=100):
    g = "".join(rng.choices("ACGT", k=size))
    g = g[: size // 2] + g[100:300] + g[size // 2 :]  # a repeat
    reads = []
    for _ in range(len(g) * coverage // length):
        a = rng.randrange(0, len(g) - length + 1)
        r = list(g[a : a + length])
        for i in range(length):
            if rng.random() < errors:
                r[i] = rng.choice("ACGT")
        reads.append("".join(r) if rng.random() < 0.5 else rc("".join(r)))
    return g, reads


def test_purify_a_simulated_genome(spark):
    g, reads = simulated(random.Random(18), 3000, 60, 0.008)
    b = graph.build(spark, as_reads(spark, reads), 21)
    before = {r.seq for r in b["nodes"].collect()}
    # every deletion of the rounds is judged: what goes is wrong, and what each step leaves is what the next one meets
    nodes, arcs, steps = explore.purification_report(b["nodes"], b["arcs"], spark.createDataFrame([(0, g)], "ref_id long, seq string"), 21, 8.0, 100)
    steps = steps.orderBy("step").collect()
    inside = lambda s: s in g + g or rc(s) in g + g
    assert [r.step for r in steps] == list(range(1, len(steps) + 1)) and {r.rule for r in steps} >= {"tips", "bubbles"}
    assert all(r.n_removed == r.tp + r.fp > 0 for r in steps) and [r.round for r in steps] == sorted(r.round for r in steps)
    assert (steps[0].tp + steps[0].fn, steps[0].tn + steps[0].fp) == (sum(not inside(s) for s in before), sum(inside(s) for s in before))
    clipped = {r.node_id for r in graph.clip_tips(b["nodes"], b["arcs"], 8.0 * 0.8, 8.0 * 1.1, 400).collect()}
    assert steps[0].tp == sum(r.node_id in clipped and not inside(r.seq) for r in b["nodes"].collect()) and steps[0].n_removed == len(clipped)
    assert steps[0].sensitivity == steps[0].tp / (steps[0].tp + steps[0].fn)
    after = [r.seq for r in nodes.collect()]
    right = lambda s: s in g or rc(s) in g
    assert sum(not right(s) for s in before) > 50 and all(right(s) for s in after)
    # but for its ends the genome is whole: all that is left are the repeat and what lies between
    assert sum(len(s) - 20 for s in after) > len(g) - 200 - 21 - 150 and len(after) <= 5
    assert set(graph.sanity(nodes, arcs, 21).first()) == {0}


def test_jobs_over_stage_files(spark, tmp_path):
    """Reads with errors in two libraries: graph, cleaned graph and corrected reads, stages used again while nothing changes."""
    rng = random.Random(23)
    g = "".join(rng.choices("ACGT", k=700))
    clean, noisy = [], []
    for n in range(260):
        a = rng.randrange(0, 601)
        r = list(g[a : a + 100])
        if n % 4 == 0:
            i = rng.randrange(25, 75)
            r[i] = rng.choice([c for c in "ACGT" if c != r[i]])
        clean.append(g[a : a + 100])
        noisy.append("".join(r))
    paths = [str(tmp_path / "one.fastq"), str(tmp_path / "two.fasta")]
    with open(paths[0], "w") as f:
        f.writelines(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(noisy[:200]))
    with open(paths[1], "w") as f:
        f.writelines(f">r{i}\n{s}\n" for i, s in enumerate([*noisy[200:], "ACGT"]))
    work, settings = f"file://{tmp_path}/work", workflow.Settings(k=21)
    first = workflow.run(spark, "graph_construction", paths, work, settings)
    assert first["made"] == ["reads", "kmers", "graph", "contigs"] and spark.read.text(first["fasta"]).where("value like '>NODE%'").count() > 1
    second = workflow.run(spark, "read_correction", paths, work, settings)
    assert second["made"] == ["clean", "corrected"] and second["graph"] == first["graph"]
    told = spark.read.json(f"{second['clean']}/parameters").first()
    assert told.read_length == pytest.approx(99.6, abs=1) and 1 < told.cutoff < told["mean"]
    assert [r.seq for r in stages.read_graph(spark, second["clean"])[0].collect()] in ([canon(s)] for s in (g[i:j] for i in range(9) for j in range(691, 701)))
    out = [r.value for r in spark.read.text(second["outputs"][0]).collect()]
    assert second["outputs"][0].endswith("one.corr.fastq") and out[0::4] == [f"@r{i}" for i in range(200)]
    wrong = sum(a != b for a, b in zip(noisy, clean))
    left = sum(a != b for a, b in zip(out[1::4], clean[:200]))
    assert wrong > 60 and left <= 2
    assert spark.read.text(second["outputs"][1]).collect()[-1].value == "ACGT"
    again = workflow.run(spark, "graph_correction", paths, work, settings)
    assert again["made"] == ["contigs"] and again["clean"] == second["clean"]
    other = workflow.run(spark, "graph_construction", paths[:1], work, workflow.Settings(k=15))
    assert other["made"] == ["reads", "kmers", "graph", "contigs"] and other["graph"] != first["graph"]
    with pytest.raises(ValueError, match="none of"):
        workflow.run(spark, "assembly", paths, work, settings)


def test_unreliable_nodes_of_a_graph(spark):
    """A long node that branches into its true neighbour and a low one of another length: the low one goes by its statistics."""
    k = 9
    rng = random.Random(19)
    rows = [(1, 400, 20000, 400), (2, 300, 15000, 300), (3, 30, 60, 1), (4, 500, 25000, 500)]
    nodes = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=m + k - 1)), c, s, m) for i, m, c, s in rows], "node_id long, seq string, kmer_cov long, read_start_cov long, marginal long")
    one = [(1, 2), (1, 3), (4, 1)]
    arcs = spark.createDataFrame([(x, y, 5) for x, y in one] + [(-y, -x, 5) for x, y in one], "src long, dst long, cov long")
    sure = {r.node_id for r in stats.reliable_nodes(stats.node_multiplicity(graph.degrees(nodes, arcs)), k).collect()}
    assert sure == {1}
    doubled = nodes.withColumn("read_start_cov", F.when(F.col("node_id") == 1, 800).otherwise(F.col("read_start_cov")))
    assert {r.node_id for r in graph.unreliable_nodes(doubled, arcs, k, 8.0, 10.0, 400, k).collect()} == {3}
    assert graph.unreliable_nodes(nodes, arcs, k, 8.0, 10.0, 400, k).count() == 0  # multiplicity 1 and two neighbours: nothing is known
    assert graph.unreliable_nodes(doubled, arcs, k, 8.0, 10.0, 20, k).count() == 0


def test_gapped_alignments(spark):
    rng = random.Random(20)
    pairs = [("", ""), ("A", "A"), ("ACGT", "ACT"), ("ACGTACGTAC", "ACGTACCGTAC"), ("N", "A"), (None, "A")]
    for n in (5, 30, 80):
        for _ in range(15):
            a = "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n))
            b = list(a)
            for _ in range(rng.randrange(5)):
                b[rng.randrange(len(b))] = rng.choice("ACGT")
            del b[rng.randrange(len(b))]
            b.insert(rng.randrange(len(b) + 1), rng.choice("ACGT"))
            pairs.append((a, "".join(b)[: n - rng.randrange(3)]))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    alike = lambda x, y: x == y or "N" in (x, y)
    for r in df.select("i", correct.banded_alignment("a", "b").alias("x"), correct.unit_alignment("a", "b").alias("u")).collect():
        a, b = pairs[r.i]
        if a is None:
            assert r.x.score is None and r.u.a is None
            continue
        assert r.x.score == walk_score(a, b) and r.u.score == correct.align_unit(a, b)
        for x in (r.x, r.u):
            assert (x.a.replace("-", ""), x.b.replace("-", "")) == (a, b) and len(x.a) == len(x.b) and ("-", "-") not in zip(x.a, x.b)
        assert sum(-3 if "-" in p else 1 if alike(*p) else -1 for p in zip(r.x.a, r.x.b)) == r.x.score
        assert sum(p[0] == p[1] for p in zip(r.u.a, r.u.b)) == r.u.score
    assert correct.band_alignments(["ACGTACGTAC"], ["ACGTACCGTAC"])[1] == [("ACGTA-CGTAC", "ACGTACCGTAC")]


def test_true_walks_and_distances(spark):
    """Contigs over a branching graph: walks break where a contig leaves the graph and at letters that are no bases."""
    rng = random.Random(22)
    k = 11
    g = "".join(rng.choices("ACGT", k=300))
    other = g[:120] + ("A" if g[120] != "A" else "C") + g[121:200]
    b = graph.build(spark, as_reads(spark, [g] * 3 + [other] * 2), k)
    seqs = {r.node_id: r.seq for r in b["nodes"].collect()}
    seqs |= {-i: rc(s) for i, s in seqs.items()}
    arcs = {(r.src, r.dst) for r in b["arcs"].collect()}
    contigs = [g, other[50:180], g[:60] + "N" + g[61:250], g[:150] + "".join(rng.choices("ACGT", k=40)) + g[150:], "ACGT"]
    frame = spark.createDataFrame(list(enumerate(contigs)), "ref_id long, seq string")
    want = []
    for i, c in enumerate(contigs):
        at = {}
        for p in range(len(c) - k + 1):
            for n, s in seqs.items():
                o = s.find(c[p : p + k])
                if o >= 0:
                    at[p + 1] = (n, o)
        walk = step = lo = None
        for p, (n, o) in sorted(at.items()):
            before = at.get(p - 1)
            if before == (n, o - 1):
                want[-1][5] = p
                continue
            on = before and o == 0 and before[1] == len(seqs[before[0]]) - k and (before[0], n) in arcs
            walk, step, zero = (walk, step + 1, zero) if on else (p, 0, p - o)
            want.append([i, walk, step, n, p, p, p - o - zero])
    walks = graph.saved(explore.true_walks(frame, b["nodes"], b["arcs"], b["index"], k), "walks")
    got = sorted([r.ref_id, r.walk, r.step, r.node, r.lo, r.hi, r.distance] for r in walks.collect())
    assert got == sorted(want) and len(want) > 8
    first = [r for r in got if r[0] == 0]
    a, z = first[0], first[-1]
    pairs = [(a[3], z[3]), (z[3], a[3]), (-z[3], -a[3]), (a[3], -z[3]), (a[3], a[3])]
    dist = {(r.src, r.dst): r.distance for r in explore.walk_distances(walks, b["nodes"], spark.createDataFrame(pairs, "src long, dst long"), 1000).collect()}
    length = {r.node_id: r.marginal for r in b["nodes"].collect()}
    d = z[6] - a[6]
    assert dist == {pairs[0]: d, pairs[1]: -d, pairs[2]: d - length[abs(a[3])] + length[abs(z[3])], pairs[3]: None, pairs[4]: 0}


def test_walk_distances_make_pairs_once(spark):
    """the pairs, which grow with the graph, are in the plan once; only walks meet walks."""
    nodes = spark.createDataFrame([(1, 5), (2, 30), (3, 4)], "node_id long, marginal long")
    walks = spark.createDataFrame([(0, 1, 1, 0), (0, 1, 2, 5), (0, 1, 3, 35), (0, 50, 1, 0), (0, 50, 2, -5)], "ref_id long, walk long, node long, distance long")
    ids = spark.range(9)
    pairs = ids.select((F.col("id") % 3 + 1).alias("src"), (F.floor(F.col("id") / 3) + 1).alias("dst")).union(spark.createDataFrame([(-3, -2), (-2, -1)], "src long, dst long"))
    got = explore.walk_distances(walks, nodes, pairs, 32)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {(r.src, r.dst): r.distance for r in got.collect()} == {(1, 1): 0, (1, 2): 5, (1, 3): None, (2, 1): 5, (2, 2): 0, (2, 3): 30, (3, 1): None, (3, 2): -30, (3, 3): 0, (-3, -2): 4, (-2, -1): 20}


def test_prelude(spark):
    rng = random.Random(11)
    g = "".join(rng.choices("ACGT", k=200))
    b = graph.build(spark, as_reads(spark, [g] * 12 + [g[:100] + "".join(rng.choices("ACGT", k=20))] * 2), 15)
    nodes, arcs = graph.prelude(b["nodes"], b["arcs"], 15)
    assert [r.seq for r in nodes.collect()] == [canon(g)] and arcs.count() == 0


def test_multiplicity_climb(spark):
    rows = [(i, 1000 - i, 5 * (1000 - i), (1000 - i) * (1 + i % 3) // 50) for i in range(30)]
    nodes = spark.createDataFrame(rows, "node_id long, marginal long, kmer_cov long, read_start_cov long")
    got = {r.node_id: r.multiplicity for r in stats.node_multiplicity(nodes).collect()}
    top = sorted(rows, key=lambda r: -r[1])[:2]
    rate = sum(r[3] for r in top) / sum(r[1] for r in top)
    for i, marginal, _, starts in rows:
        p = lambda m: math.exp(starts * math.log(rate * m * marginal) - rate * m * marginal - math.lgamma(starts + 1))
        m = 1
        while p(m + 1) > p(m):
            m += 1
        assert got[i] == m


def test_reliable_nodes(spark):
    """Confidence term by term; a node alone in its density is reliable, a repeat is not, on the strand that branches."""
    rows = [(i, 1000, 50000, n, 2) for i, n in enumerate([50] * 2 + [100, 150, 400, 5000, 1, 0])] + [(8, 1000, 50000, 50, 1), (9, 20, 1000, 1, 2), (10, 20, 1000, 300, 2), (11, 100000, 5000000, 5000, 2)]
    nodes = spark.createDataFrame(rows, "node_id long, marginal long, kmer_cov long, read_start_cov long, n_right long").withColumn("n_left", F.when(F.col("node_id") == 0, 3).when(F.col("node_id") == 8, 2).otherwise(0))
    got = {r.node_id: r for r in stats.node_multiplicity(nodes).collect()}
    for i, marginal, _, starts, _ in rows:
        mu, m = 0.05 * marginal, got[i].multiplicity
        p = lambda x: math.exp(starts * math.log(mu * x) - mu * x - math.lgamma(starts + 1))
        terms = [(m + side * d, d + (side > 0)) for d in range(1, 400) for side in (-1, 1) if side > 0 or m - d >= 1]  # where, and the next distance
        last, total = p(m + 1), 0.0
        for where, following in terms:
            total += p(where)
            if abs(p(where) - last) <= 1e-6 and following >= 5:
                break
            last = p(where)
        assert got[i].confidence == pytest.approx(0.0 if not m else p(m) / total if total else math.inf, rel=1e-6), i
    sure = {r.node_id for r in stats.reliable_nodes(stats.node_multiplicity(nodes), 31).collect()}
    assert {0, 1, 11, -0, -8} <= sure and not {abs(x) for x in sure} & {4, 5, 9, 10} and 8 not in sure and -1 not in sure


SMALL = ["dna_projection", "solid_kmers", "unitigs", "arc_cov", "graph_fasta", "merged_seeds", "components", "neighborhood", "graph_quality", "validate_overlaps", "mum_matches", "mem_both_strands", "pair_span", "clip_tips", "kmer_overlap_mask", "kmer_neighbors", "n50", "coverage_std_top5", "poisson_pdf", "mem_matches", "asof_offset", "concat_offsets", "confusion_metrics", "match_score", "true_multiplicity", "long_matches", "indexed_matches", "banded_alignment", "unit_alignment", "reliable_nodes", "node_multiplicity", "node_lookup", "graph_statistics", "graph_sanity", "merge_linear", "threshold_schedule"]


@pytest.mark.parametrize("name", SMALL)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "events", "lineitem", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, d)
    cur = con.execute(catalogue.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else v
    assert sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(map(clean, r)) for r in cur.fetchall()), key=repr)


def test_documents_as_reads_in_tasks(spark, tmp_path, monkeypatch):
    """Odd texts, null ids and texts over several pieces, against a plain loop; no row goes through a pattern."""
    monkeypatch.setattr(R, "LETTERS", 333)
    texts = [(0, "a", "Hello, wörld\n 1 \t日本 😀x"), (-3, "b", None), (2, None, ""), (5, "c", " \n"), (None, "d", "ab😀 " * 500), (6, "e", "é" * 50), (9, "f", "z" * 151)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for doc, source, text in texts:
        s = "".join("ACGT"[(ord(c.upper()) - 65) % 4] if c.isascii() and c.isalpha() else "N" for c in text or "" if c not in " \n")
        want.update((None if doc is None else doc * R.READS_A_DOC + i // 50, source, s[i : i + 100]) for i in range(0, len(s), 50))
    rows = R.documents_as_reads(spark, str(tmp_path))
    assert Counter(map(tuple, rows.collect())) == want
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "source", "text"), t, strict=True)) for t in texts])
    assert Counter(tuple(r.values()) for made in R._cut_reads([batch], 100, 50) for r in made.to_pylist()) == want
    assert "regexp" not in rows._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("k", [1, 3, 4, 5, 15, 30, 31])
def test_codes_cut_from_packed_letters(monkeypatch, k):
    """Windows read from packed letters and hashes of valid letters alone, against windows of the text."""
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGT" * 9 + "N") for _ in range(n)) for n in (0, k - 1, k, 40, 333, 5000)] + [None, "N" * 50]
    monkeypatch.setattr(P, "CHUNK", 512)
    monkeypatch.setattr(buckets, "WINDOWS", 100)
    valid = [w for t in texts if t for w in (t[i : i + k] for i in range(len(t) - k + 1)) if "N" not in w]
    sent = pa.Table.from_batches(buckets._sending([pa.RecordBatch.from_arrays([pa.array(texts)], names=["seq"])], k, False)).to_pylist()
    met, home = Counter(), {}
    for row in sent:
        group = buckets.Group([[row[c] for c in ("sizes", "beside", "letters", "ids", "places")]], row["home"])
        for _, _, codes in group.codes(k):
            for code in codes.tolist():
                w = "".join("ACGT"[code >> 2 * (k - 1 - i) & 3] for i in range(k))
                met[w] += 1
                assert home.setdefault(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))), row["home"]) == row["home"]
    assert met == Counter(valid)


def test_spelling(spark):
    for k in (1, 4, 15, 31):
        codes = [0, 1, (1 << 2 * k) - 1, 0x1234567890ABCDEF & (1 << 2 * k) - 1]
        rows = spark.createDataFrame([(c,) for c in codes], "code long").select(P.letters(F.col("code"), k).alias("w"))
        assert [r.w for r in rows.collect()] == ["".join("ACGT"[c >> 2 * (k - 1 - i) & 3] for i in range(k)) for c in codes]
        assert "conv(" not in rows._jdf.queryExecution().toString()


def test_few_texts_at_a_time(monkeypatch):
    """What _placed() makes of a batch is handed on by a bounded number of texts and letters, whatever the batch."""
    monkeypatch.setattr(P, "TEXTS", 10)
    rng = random.Random(43)
    texts = ["".join(rng.choices("ACGTN", k=60)) for _ in range(95)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(95)), pa.array(texts)], names=["id", "seq"])
    made = list(P._placed([batch], 20, False))
    assert len(made) == 10 and max(b.num_rows for b in made) <= 10 * 41
    assert Counter((r["id"], r["pos"]) for b in made for r in b.to_pylist()) == Counter((i, j + 1) for i, t in enumerate(texts) for j in range(41) if "N" not in t[j : j + 20])


def test_a_graph_leaves_nodes_and_arcs_alone(spark):
    """tables and shuffles on the way to a graph, and of its cleaning, are gone once it is made; a stage asked for later stays, whoever asks."""
    where = store.shared_dir(spark).removeprefix("file://")
    there = set(os.listdir(where))
    named = lambda: sorted(x.split("-")[0] for x in set(os.listdir(where)) - there)
    rng = random.Random(3)
    g = "".join(rng.choices("ACGT", k=300))
    b = graph.build(spark, as_reads(spark, [g[i : i + 60] for i in range(0, 240, 20)] + ["ACG" * 20] * 2), K)
    assert named() == ["arcs", "nodes"]
    left = graph.prelude(b["nodes"], b["arcs"], K)
    assert named() == ["arcs", "merged", "merged", "nodes"] and left[0].count() > 0
    with store.passing() as keep:
        inner = keep(store.saved(spark.range(3), "inner"))
        store.saved(spark.range(3), "lost")
        b["index"]
    assert named() == ["arcs", "index", "inner", "merged", "merged", "nodes"] and inner.count() == 3
    assert spark.conf.get(store._CLEANUP) == "false"


@pytest.mark.parametrize("together", [1, 1 << 18])
def test_runs_on_nodes(spark, monkeypatch, together):
    """runs of k-mers hold the places of single ones, and the seeds of both are the same; no window is a row."""
    monkeypatch.setattr(buckets, "TOGETHER", together)
    rng = random.Random(8)
    g, tangle = "".join(rng.choices("ACGT", k=400)), "".join(rng.choices("AC", k=200))
    seqs = [g[i : i + 60] for i in range(0, 340, 13)] + [rc(g[i : i + 50]) for i in range(0, 300, 31)] + [tangle[i : i + 70] for i in range(0, 130, 20)] * 2
    seqs += [g[200:230] + "N" + g[231:260] + "".join(rng.choices("ACGT", k=20)) + g[10:40], "A" * 30, "ACG" * 12, "", "ACG", None, "NNN"]
    reads = as_reads(spark, seqs).withColumn("read_id", F.col("read_id") - 5)
    b = graph.build(spark, reads, K)
    runs = b["runs"].collect()
    want = b["positions"].collect()
    assert Counter((r.read_id, r.pos + i, r.node, r.off + i) for r in runs for i in range(r.n)) == Counter((r.read_id, r.pos, r.node, r.off) for r in want)
    assert len(runs) < len(want) / 2
    rows = lambda df: Counter(map(str, df.collect()))
    assert rows(correct.read_seeds(b["runs"])) == rows(correct.read_seeds(b["positions"]))
    assert rows(correct.merged_seeds(correct.read_seeds(b["runs"]))) == rows(correct.merged_seeds(correct.read_seeds(b["positions"])))
    assert rows(correct.chained_seeds(b["runs"], b["nodes"], b["arcs"])) == rows(correct.chained_seeds(b["positions"], b["nodes"], b["arcs"]))
    even = graph.build(spark, reads, 8)
    assert rows(even["runs"].drop("n")) == rows(even["positions"])


def test_seeds_and_walks_write_no_row_a_window(spark):
    """The queries ask for neither the reads' positions nor the index of all nodes."""
    graph._graphs.clear()
    for name in ("read_seeds", "merged_seeds", "top10_seeds", "true_walks"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(graph._graphs) == 2 and not any({"positions", "index"} & set(g) for g in graph._graphs.values())


def test_pairs_within_two_arcs(spark):
    """each pair once, also where two ways lead to it; pairs are made after the last shuffle, only arcs are moved."""
    rng = random.Random(2)
    arcs = {(rng.choice((-1, 1)) * rng.randint(1, 12), rng.choice((-1, 1)) * rng.randint(1, 12)) for _ in range(60)}
    got = explore.within_two(spark.createDataFrame([(*x, 1) for x in arcs], "src long, dst long, cov long"))
    assert Counter((r.src, r.dst) for r in got.collect()) == Counter(arcs | {(a, d) for a, b in arcs for c, d in arcs if b == c})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")


def test_neighbourhood_rounds_stay_inside(spark, monkeypatch):
    """depths as a plain search finds them; rounds read short steps and keep nodes that are left alone."""
    rng = random.Random(4)
    size = {i: rng.choice((1, 2, 3, 5, 30, 90)) for i in range(1, 60)}
    arcs = {(rng.choice((-1, 1)) * rng.randint(1, 59), rng.choice((-1, 1)) * rng.randint(1, 59)) for _ in range(200)}
    nodes = spark.createDataFrame([(i, n) for i, n in size.items()], "node_id long, marginal long")
    most, want, made = 12, {}, []
    for root in (1, 7, -9, 20):
        depth, open_ = {root: 0}, [root]
        while open_:
            u = open_.pop()
            for v in [b for a, b in arcs if a == u] + [a for a, b in arcs if b == u] if depth[u] <= most else []:
                if depth[u] + size[abs(u)] < depth.get(v, 10**9):
                    depth[v] = depth[u] + size[abs(u)]
                    open_.append(v)
        want |= {(root, v): d for v, d in depth.items()}
    real = explore.saved
    monkeypatch.setattr(explore, "saved", lambda df, name: made.append((name, {c: r for c, r in df.agg(*[F.max(c).alias(c) for c in df.columns if c in ("far", "depth")]).first().asDict().items()})) or real(df, name))
    for front in (0, 200_000):
        monkeypatch.setattr(explore, "FRONT", front)
        made.clear()
        got = explore.neighborhood(nodes, spark.createDataFrame(list(arcs), "src long, dst long"), spark.createDataFrame([(x,) for x in (1, 7, -9, 20)], "root long"), most)
        assert {(r.root, r.node): r.depth for r in got.collect()} == want and max(want.values()) > most
        assert all(x["far"] <= most for name, x in made if name == "short") and all(x["depth"] <= most for name, x in made[:-1] if name == "reach") and len(made) > 5


def test_match_counts_without_rows_of_windows(spark, monkeypatch):
    """many reads' matches are counted in tables and buckets, as the joins of few reads' windows count them."""
    rng = random.Random(1)
    refs = ["".join(rng.choices("ACGT", k=rng.randint(1, 300))) for _ in range(20)] + ["A" * 50, "", "ACGNNACGTTACGTTACGTACGTAC" * 3]
    reads = [r[5:90] for r in refs] + ["".join(rng.choices("ACGT", k=60)) for _ in range(10)] + ["A" * 40, None, "ACGTN" * 9 + refs[0][:30]]
    q, r = spark.createDataFrame(list(enumerate(reads)), "query_id long, seq string"), spark.createDataFrame([(-i, s) for i, s in enumerate(refs)], "ref_id long, seq string")
    rows = lambda sizes: sorted(map(tuple, correct.match_counts(q, r, sizes).collect()))
    sizes = [[6, 7, 8], [9, 10, 11, 12], [14, 15, 16, 17, 18], [29, 30]]
    want = [rows(x) for x in sizes]
    monkeypatch.setattr(match, "FEW", 0)
    monkeypatch.setattr(P, "windows", None)
    assert [rows(x) for x in sizes] == want and all(want)
    monkeypatch.setattr(buckets, "TOGETHER", 1)
    assert rows(sizes[1]) == want[1]


def test_merged_arcs_are_not_grouped(spark):
    """arcs of merged nodes are renamed by joins alone, and none is there twice."""
    rng = random.Random(6)
    g = "".join(rng.choices("AC", k=150))
    b = graph.build(spark, as_reads(spark, [g] * 2 + [g[:70] + rc(g[:70])] * 2 + ["ACG" * 12] * 2), K)
    nodes, arcs = graph.merge_linear(*graph.remove_nodes(b["nodes"], b["arcs"], b["nodes"].where("node_id % 5 = 0")), K)
    assert "Aggregate" not in arcs._jdf.queryExecution().optimizedPlan().toString()
    for some in (b["arcs"], arcs):
        assert some.count() == some.select("src", "dst").distinct().count() > 0
