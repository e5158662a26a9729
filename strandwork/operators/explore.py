"""Looking at a graph: components, neighbourhoods, exports, and its comparison with a known genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions import seq as S
from ..store import drop, passing, saved
from . import graph as G
from . import kmers as K
from . import match as M
from . import stats as T
from .components import connected_components

#: Rows (root, node, depth) of a round of neighborhood() that are sent to every task: 5 MB.
FRONT = 200_000


def components(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node reachable over arcs in any direction and strand; lone nodes are their own."""
    found = connected_components(arcs.select(F.abs("src").alias("a"), F.abs("dst").alias("b")))
    return nodes.select("node_id").join(found.withColumnRenamed("id", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def neighborhood(nodes: DataFrame, arcs: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, depth): signed nodes within reach of each root, over arcs of both directions.

    A node's depth is the least sum of the marginal lengths of the nodes left on the way; nodes of a depth over max_depth
    are met and not left. Depths are lowered round by round until none changes. Rounds stay among nodes that are left, so they read
    only steps of up to max_depth letters; the others are met once, from depths that are settled.
    """
    length = nodes.select(F.col("node_id").alias("_id"), F.col("marginal").cast("long").alias("far"))
    step = arcs.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(arcs.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    with passing() as keep:
        step = saved(step.join(length, F.abs("node") == F.col("_id")).select("node", "next", "far"), "steps")
        short = saved(step.where(F.col("far") <= max_depth), "short")
        start = roots.select(F.col("root").cast("long").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth"))
        reach = front = saved(start, "reach")
        while n := front.count():
            few = F.broadcast(front) if n <= FRONT else front
            met = short.join(few, "node").groupBy("root", F.col("next").alias("node")).agg(F.min(F.col("depth") + F.col("far")).alias("new")).where(F.col("new") <= max_depth)
            both = saved(reach.join(met, ["root", "node"], "full").select("root", "node", F.least("depth", "new").alias("depth"), F.coalesce(F.col("new") < F.col("depth"), F.col("depth").isNull()).alias("lower")), "reach")
            drop(reach)
            reach, front = both, both.where("lower").drop("lower")
        inner = reach.select("root", "node", "depth")
        met = inner.join(step, "node").select("root", F.col("next").alias("node"), (F.col("depth") + F.col("far")).alias("depth"))
        return keep(saved(inner.union(met).groupBy("root", "node").agg(F.min("depth").alias("depth")), "reach"))


def node_start_offsets(nodes: DataFrame) -> DataFrame:
    """(node_id, start): where each node begins in the text of all nodes, each followed by a sign, its other strand and a sign."""
    return M.concat_offsets(nodes.select("node_id", (2 * F.length("seq") + 2).alias("n")), "node_id", "n", gap=0)


def cytoscape(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (value) of the arcs' and the nodes' tab-separated tables."""
    line = lambda *c: F.concat_ws("\t", *[F.col(x).cast("string") for x in c]).alias("value")
    return arcs.select(line("src", "dst", "cov")), nodes.select(line("node_id", "marginal", "kmer_cov", "read_start_cov"))


def write_cytoscape(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    for rows, name in zip(cytoscape(nodes, arcs), ("arcs", "nodes"), strict=True):
        rows.write.text(f"{path}/{name}")


def genome(contigs: DataFrame) -> DataFrame:
    """Contigs taken for circles: each is doubled, so that hits over its end are found."""
    return contigs.withColumn("seq", F.concat("seq", "seq"))


def validate_kmers(contigs: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """One row: windows of the contigs, those in the table, and those of coverage over 1, with their percentages."""
    j = P.counts(contigs, "seq", k).groupBy("code").agg(F.sum("n").alias("n")).join(counts, "code", "left")
    found, twice = F.sum(F.when(F.col("cov").isNotNull(), F.col("n")).otherwise(0)), F.sum(F.when(F.col("cov") > 1, F.col("n")).otherwise(0))
    rows = j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kmers"), F.coalesce(found, F.lit(0)).alias("n_found"), F.coalesce(twice, F.lit(0)).alias("n_solid"))
    share = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col("n_kmers")), 6)
    return rows.select("*", share("n_found").alias("pct_found"), share("n_solid").alias("pct_solid"))


def validate_overlaps(contigs: DataFrame, masks: DataFrame, k: int) -> DataFrame:
    """One row: steps of the contigs between solid k-mers, and those whose arc the reads have shown."""
    known = masks.select("code")
    pairs = P.counts(contigs, "seq", k + 1).groupBy("code").agg(F.sum("n").alias("n"))
    there = pairs.select("n", F.shiftrightunsigned("code", 2).alias("src"), F.col("code").bitwiseAND(F.lit((1 << 2 * k) - 1)).alias("dst"))
    own = lambda c: F.least(F.col(c), P.revcomp(F.col(c), k))
    solid = there.withColumns({"a": own("src"), "b": own("dst")}).join(known.withColumnRenamed("code", "a"), "a", "left_semi").join(known.withColumnRenamed("code", "b"), "b", "left_semi")
    seen = solid.join(K.kmer_neighbors(masks, k).withColumn("seen", F.lit(True)), ["src", "dst"], "left")
    return seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_steps"), F.coalesce(F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)), F.lit(0)).alias("n_seen"))


def with_truth(nodes: DataFrame, contigs: DataFrame) -> DataFrame:
    """nodes + correct: whether the circular contigs hold the node on some strand."""
    hits = M.occurrences(nodes.select(F.col("node_id").alias("id"), "seq"), genome(contigs))
    return nodes.join(hits.select(F.col("id").alias("node_id"), (F.col("n") > 0).alias("correct")), "node_id")


def removal_confusion(nodes: DataFrame, contigs: DataFrame, gone: DataFrame) -> DataFrame:
    """stats.confusion of a cleaning rule: what it removes (node_id) against the nodes that no contig holds."""
    marked = with_truth(nodes, contigs).join(gone.select("node_id", F.lit(1).alias("found")), "node_id", "left")
    return T.confusion(marked.select((~F.col("correct")).cast("int").alias("truth"), F.coalesce("found", F.lit(0)).alias("found")))


PURIFICATION = "step int, round int, rule string, n_removed long, tp long, tn long, fp long, fn long, sensitivity double, specificity double, gain double"


def purification_report(nodes: DataFrame, arcs: DataFrame, contigs: DataFrame, k: int, cutoff: float, read_length: int, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, arcs, steps): graph.purify, and each of its deletions judged by removal_confusion on the nodes that it met.

    steps: a row a deletion, numbered from 1; a cleaning that removes nothing has no steps.
    """
    steps = nodes.sparkSession.createDataFrame([], PURIFICATION)
    done = 0

    def watch(number: int, rule: str, met: DataFrame, gone: DataFrame) -> None:
        nonlocal steps, done
        done += 1
        judged = removal_confusion(met, contigs, gone)
        of = [F.lit(done).alias("step"), F.lit(number).alias("round"), F.lit(rule).alias("rule"), (F.col("tp") + F.col("fp")).alias("n_removed")]
        steps = steps.union(saved(judged.select(*of, *judged.columns), "judged"))

    left = G.purify(nodes, arcs, k, cutoff, read_length, limit=limit, watch=watch)
    return *left, steps


def graph_quality(nodes: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """One row: nodes that the circular contigs hold on some strand, those that they do not, and their marginal lengths."""
    j = with_truth(nodes, contigs)
    right = F.col("correct")
    size = contigs.agg(F.sum(F.length("seq") + 1 - k).alias("genome_size"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("marginal"))), F.lit(0))
    return j.agg(F.count_if(right).alias("n_correct"), F.count_if(~right).alias("n_incorrect"), total(right).cast("long").alias("size_correct"), total(~right).cast("long").alias("size_incorrect")).crossJoin(size)  # one row each


def pair_span(starts: DataFrame, stops: DataFrame, most: int) -> DataFrame:
    """(id, ref_id, p1, p2): hits (id, ref_id, p, len) of a start and a later one of a stop of one id within `most` letters in all.

    A range join by cells `most` wide: a stop meets starts of its own cell and of the one before.
    """
    cell = F.floor(F.col("p") / most)
    a = starts.select("id", "ref_id", F.col("p").alias("p1"), cell.alias("cell"))
    b = stops.select("id", "ref_id", F.col("p").alias("p2"), "len", F.explode(F.array(cell, cell - 1)).alias("cell"))
    return a.join(b, ["id", "ref_id", "cell"]).where((F.col("p2") > F.col("p1")) & (F.col("p2") - F.col("p1") + F.col("len") <= most)).select("id", "ref_id", "p1", "p2")


def hits(patterns: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(id, ref_id, p, len) of patterns (id, seq) of k letters on the strand as given."""
    w = P.windows(refs, "seq", k, ["ref_id"], both=False).select("ref_id", F.col("pos").alias("p"), "code")
    heads = patterns.where(~F.col("seq").rlike("[^ACGT]")).select("id", P.code_of(F.col("seq")).alias("code"))
    return w.join(heads, "code").select("id", "ref_id", "p", F.lit(k).cast("long").alias("len"))


def mems_on_strands(queries: DataFrame, refs: DataFrame, least: int) -> DataFrame:
    """mems + reverse, q_forward: matches of the queries and of their reverse complements.

    q_start counts on the strand that matches, q_forward is where the match begins on the query as given.
    """
    there = M.mems(queries, refs, least).select("*", F.lit(False).alias("reverse"), F.col("q_start").alias("q_forward"))
    back = M.mems(queries.withColumn("seq", S.revcomp(F.col("seq"))), refs, least).join(queries.select("query_id", F.length("seq").alias("_n")), "query_id")
    return there.unionByName(back.select("*", F.lit(True).alias("reverse"), (F.col("_n") - F.col("q_start") - F.col("len") + 2).alias("q_forward")).drop("_n"))


def true_walks(contigs: DataFrame, nodes: DataFrame, arcs: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(ref_id, walk, step, node, lo, hi, distance): the nodes that each contig passes, cut into walks that follow the graph's arcs.

    contigs: (ref_id, seq). A visit is a stretch lo to hi of k-mers (from 1) on one signed node. A walk goes on if the next
    visit begins right after the last one, that one ended with its node, the next begins its own and an arc joins them;
    else it breaks and the walk is named by where it begins. distance: from the start of the walk's first node to the
    start of this one, in k-mers. Visits are found by their node and diagonal, walks by pointer doubling, so a contig of
    any length is no single task's.
    """
    on = G.read_node_positions(contigs.select(F.col("ref_id").alias("read_id"), "seq"), index, k)
    on = on.select(F.col("read_id").alias("ref_id"), F.col("pos").cast("long").alias("pos"), "node", F.col("off").cast("long").alias("off"))
    near = Window.partitionBy("ref_id", "node", (F.col("pos") - F.col("off"))).orderBy("pos")
    runs = on.withColumn("_run", F.col("pos") - F.row_number().over(near))
    visits = runs.groupBy("ref_id", "node", (F.col("pos") - F.col("off")).alias("_d"), "_run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("off").alias("first"), F.max("off").alias("last"))
    visits = visits.join(nodes.select(F.col("node_id").alias("_id"), "marginal"), F.abs("node") == F.col("_id"))
    visits = saved(visits.select("ref_id", "node", "lo", "hi", "first", "last", "marginal", F.monotonically_increasing_id().alias("v")), "visits")
    ended = visits.where(F.col("last") == F.col("marginal") - 1).select("ref_id", (F.col("hi") + 1).alias("lo"), F.col("node").alias("src"), F.col("v").alias("p"))
    met = visits.where("first = 0").join(ended, ["ref_id", "lo"]).join(arcs.select("src", F.col("dst").alias("node")), ["src", "node"], "left_semi").select("v", "p")
    paths = G.chains(visits.select("v").join(met, "v", "left"), lambda v: v)
    heads = visits.select(F.col("v").alias("head"), F.col("lo").alias("walk"), F.col("first").alias("_in"))
    rows = visits.join(paths, "v").join(heads, "head")
    return rows.select("ref_id", "walk", F.col("rank").alias("step"), "node", "lo", "hi", (F.col("lo") - F.col("first") - F.col("walk") + F.col("_in")).alias("distance"))


def contig_index(contigs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """graph.kmer_index() of the k-mers that the contigs hold. Those of contigs of few letters are broadcast, so no window of a node is shuffled."""
    codes = P.counts(contigs, "seq", k).select("code").distinct()
    return G.kmer_index(nodes, k).join(F.broadcast(codes) if M.letters(contigs) <= M.FEW else codes, "code", "left_semi")


def within_two(arcs: DataFrame) -> DataFrame:
    """(src, dst), each once: signed nodes that one or two arcs join. A row an arc brings what follows it; pairs are made in their source's row."""
    after = arcs.groupBy(F.col("src").alias("m")).agg(F.collect_set("dst").alias("next"))
    met = arcs.select("src", F.col("dst").alias("m")).join(after, "m", "left")
    far = F.concat(F.array("m"), F.coalesce("next", F.expr("cast(array() as array<bigint>)")))
    return met.groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list(far))).alias("far")).select("src", F.explode("far").alias("dst"))


def walk_distances(walks: DataFrame, nodes: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(src, dst, distance): of pairs (src, dst) of signed nodes, each given once, how far dst begins after src on a true walk, negative if before; null if on none within `most`.

    Both strands of the walks count. Of several distances the nearest one, then the positive. A range join by cells of the
    walks alone, whose steps meet those within `most` letters; the pairs, which grow with the graph, are made once.
    """
    there = walks.join(nodes.select(F.col("node_id").alias("_id"), "marginal"), F.abs("node") == F.col("_id")).select("ref_id", "walk", "node", "distance", "marginal")
    back = there.select("ref_id", (-F.col("walk")).alias("walk"), (-F.col("node")).alias("node"), (-F.col("distance") - F.col("marginal")).alias("distance"), "marginal")
    cell = F.floor(F.col("distance") / most)
    at = saved(there.unionByName(back).select("ref_id", "walk", "node", "distance", cell.alias("cell")), "strands")
    a, b = (at.withColumnsRenamed({"node": x, "distance": f"_{x}"}) for x in ("src", "dst"))
    near = a.withColumn("cell", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)))
    found = near.join(b, ["ref_id", "walk", "cell"]).withColumn("distance", F.col("_dst") - F.col("_src")).where(F.abs("distance") <= most)
    best = found.groupBy("src", "dst").agg(F.min_by("distance", F.struct(F.abs("distance"), -F.col("distance"))).alias("distance"))
    return pairs.select("src", "dst").join(saved(best, "distances"), ["src", "dst"], "left")


def lookup_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points (at) + node, offset: the signed node and the letter on it (from 0) at a place of the text of all nodes.

    In that text each node is followed by a sign, its other strand and a sign (node_start_offsets). Places of signs get
    the strand before them and its length as offset.
    """
    starts = node_start_offsets(nodes).join(nodes.select("node_id", F.length("seq").cast("long").alias("_n")), "node_id").withColumnRenamed("start", "at").withColumn("_at", F.col("at"))
    found = M.asof(points, starts, "at")
    into = F.col("at") - F.col("_at")
    own = into <= F.col("_n")
    return found.select(*points.columns, F.when(own, F.col("node_id")).otherwise(-F.col("node_id")).alias("node"), F.when(own, into).otherwise(into - F.col("_n") - 1).alias("offset"))
