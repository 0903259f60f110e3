"""op9: exact Jaccard self-join of word shingles, with relations between sets.

Sets are shingle hashes in hash order; equal sets become one class first.
Index: the prefix of every class is posted, tokens with the same list of
classes become one list with a weight.  Relations: classes of a list are first
compared with the list's most central class only, the one that has most tokens
in common with others; what links forms clusters, named by their most central
class, and later steps skip whole clusters: a cluster is a candidate of another one by their
roots, distances of members to the root bound all other distances (triangle
inequality), and clusters that other links join already are left.  Members of
pairs still open are compared with the other cluster's root where common lists
allow a link; what both distances of both members leave open is compared.  Lists
that join many clusters (passages of otherwise different documents) are not
paired at all: their documents are joined again with tokens ordered by their
exact frequency, which takes such tokens out of the prefixes.  Lists are met by
position: ordered by frequency, rare ones first, a pair meets in a list only if the tokens from there on, on
both sides, can still make a link.  The posted prefix is a
little longer than the threshold needs; so a pair must share more tokens than
one, and only documents with many tokens in long lists can have missed a link.
Pairs that share a usual list too are bounded as if the tokens of the smaller
number in long lists were all common.

The links found connect exactly the components of all links; every pair is
compared exactly, on the shingles of the whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from cohortlens.llm.common import cut, pin_splits, small_batches
from cohortlens.llm.components import components
from cohortlens.llm.hashing import mix, steps, text_bytes, word_hashes, word_table

SHINGLE = 5
#: Similarity threshold as a fraction.
NUM, DEN = 75, 100
#: Clusters of a list that are paired; longer lists go to the join by frequency.
LIST_CLUSTERS = 64
#: Share of a class's prefix that it must have in common with a list's central class to be compared with it early.
STAR_SHARE = 0.3
#: Tokens posted beyond the prefix, as a share of the set.
EXTRA = 0.06
#: Rows whose sets a Python task holds at once, and bytes of text that it is handed at once.
SLICE, HANDED = 1_000, 1 << 22
#: Row numbers or pairs of them that are broadcast at most (8 or 16 bytes each); more are joined by shuffle.
MOST_BROADCAST = 2_000_000
EPS = 1e-9
_WORDS = word_table(blank_words=True)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle, none an empty set."""
    data, offsets = text_bytes(texts)
    out: list[np.ndarray] = []
    for a, b in steps(offsets):
        h, rows = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], _WORDS)
        n = len(h)
        full = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            full += mix(h[j:n - k + 1 + j] + np.uint64(j + 1)) * np.uint64(2 * j + 3)
        full = mix(full).view(np.int64)
        for s, e in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if e - s >= k:
                out.append(np.unique(full[s:e - k + 1]))
            elif e > s:
                short = hashlib.blake2b(h[s:e].tobytes(), digest_size=8).digest()
                out.append(np.frombuffer(short, np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out


def prefix_size(n: int) -> int:
    """Tokens of which two sets at the threshold must share one, the sets being in one order."""
    return n - -(-n * NUM // DEN) + 1


def posted_size(n: int) -> int:
    return prefix_size(n) + int(EXTRA * n)


def _prefix_size_col(n: Column, extra: float = 0.0) -> Column:
    return n - F.ceil(n * NUM / F.lit(float(DEN))).cast("int") + 1 + F.floor(n * F.lit(extra)).cast("int")


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _emit_sets(batches):
    for batch in _slices(batches):
        sets = shingle_sets(batch.column("text"))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        prefixes = [s[:posted_size(len(s))] if len(s) else s for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array([len(s) for s in sets], pa.int32()),
                                          pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                                         ["rid", "id", "n", "digest", "prefix"])


def _emit_tokens(batches):
    for batch in _slices(batches):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(sets, pa.list_(pa.int64()))], ["rid", "tokens"])


def _compare(batches):
    names, types = ["x", "y", "inter", "n_x", "n_y"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in _slices(batches):
        cols = []
        for c in ("text_x", "text_y"):
            # a root's text comes once for each of its pairs
            coded = batch.column(c).dictionary_encode()
            sets = shingle_sets(coded.dictionary)
            cols.append([sets[i] for i in coded.indices.to_pylist()])
        inter = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*cols)]
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(inter, types[2]),
                                          *[pa.array([len(s) for s in c], pa.int64()) for c in cols]], names)


def rows_of(rows: DataFrame, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """The rows whose rid is in ``wanted`` (distinct, ``most`` at most), without moving the others where ``wanted`` is small."""
    wanted = cut(wanted, "wanted")
    few = most is not None and most <= MOST_BROADCAST or wanted.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(wanted) if few else wanted, "rid", "left_semi")


def compare(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """x, y, distance, linked of the pairs (x, y); ``rows``: rid, text."""
    pairs = cut(pairs.select("x", "y"), "pairs")
    count = pairs.count()
    if not count:
        return pairs.select("x", "y", F.lit(1.0).alias("distance"), F.lit(False).alias("linked"))
    texts = rows_of(rows, pairs.select(F.explode(F.array("x", "y")).alias("rid")).distinct(), 2 * count)
    x = texts.select(F.col("rid").alias("x"), F.col("text").alias("text_x"))
    y = texts.select(F.col("rid").alias("y"), F.col("text").alias("text_y"))
    few = count <= MOST_BROADCAST
    both = x.join(F.broadcast(pairs) if few else pairs, "x").join(y, "y").select("x", "y", "text_x", "text_y")
    got = both.mapInArrow(_compare, "x long, y long, inter long, n_x long, n_y long")
    union = F.col("n_x") + F.col("n_y") - F.col("inter")
    return cut(got.select("x", "y", (1 - F.col("inter") / union).alias("distance"),
                          (F.col("inter") * DEN >= union * NUM).alias("linked")), "compared")


def token_lists(postings: DataFrame) -> DataFrame:
    """sig, rid, w, k from (token, rid): lists of k classes, two or more; w tokens have this list."""
    by = Window.partitionBy("token")
    shared = postings.select("rid", F.count("*").over(by).alias("k"), F.min("rid").over(by).alias("least"),
                             F.bit_xor(F.xxhash64("rid")).over(by).alias("mark")).where("k > 1")
    return cut(shared.groupBy(F.xxhash64("mark", "k", "least").alias("sig"), "rid").agg(F.count("*").alias("w"), F.first("k").alias("k")), "lists")


def centrality(lists: DataFrame) -> DataFrame:
    """rid, weight: common posted tokens of a class with all others; of a group of copies, the text they stem from has most."""
    return cut(lists.groupBy("rid").agg(F.sum(F.col("w") * F.col("k")).alias("weight")), "weights")


def rooted(clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """The clusters (node, comp), each named by its most central node, which keeps distances to the root short."""
    ranked = clusters.join(weights.withColumnRenamed("rid", "node"), "node", "left")
    best = ranked.groupBy("comp").agg(F.max_by("node", F.struct(F.coalesce("weight", F.lit(0)), -F.col("node"))).alias("root"))
    return cut(clusters.join(best, "comp").select("node", F.col("root").alias("comp")), "clusters")


def stars(lists: DataFrame, weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """x, y: classes (y) against the most central class (x) of their lists, where they have a good part of y's prefix in common."""
    few = weights.count() <= MOST_BROADCAST
    ranked = lists.join(F.broadcast(weights) if few else weights, "rid")
    pivots = ranked.groupBy("sig").agg(F.max_by("rid", F.struct("weight", -F.col("rid"))).alias("x"))
    pairs = lists.join(pivots, "sig").where("rid <> x").groupBy("x", F.col("rid").alias("y")).agg(F.sum("w").alias("c"))
    return pairs.join(_nodes_as(nodes, "y"), "y").where(F.col("c") >= STAR_SHARE * F.col("p_y"))


def _may_link(c: Column, nx, px, hx, ny, py, hy) -> Column:
    """Whether two sets with c common prefix tokens (or fewer) can reach the threshold.

    Common tokens up to the lower of both prefix ends are all counted, so
    what is left of the set with the lower end bounds the rest.
    """
    rest = F.when(hx <= hy, nx - px).otherwise(ny - py)
    need = (nx + ny) * NUM
    fits = (F.least(nx, ny) * DEN >= F.greatest(nx, ny) * NUM)
    return fits & ((c + rest) * (NUM + DEN) >= need)


def _nodes_as(nodes: DataFrame, end: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{c}_{end}") for c in ("n", "p", "h")], F.col("rid").alias(end))


def still_apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (x, y) that no chain of links (u, v) joins."""
    groups = components(links.toDF("u", "v"))
    cols = pairs.columns
    for end in ("x", "y"):
        pairs = pairs.join(groups.select(F.col("node").alias(end), F.col("comp").alias(f"group_{end}")), end, "left")
    return pairs.where(F.coalesce("group_x", "x") != F.coalesce("group_y", "y")).select(*cols)


def positions(lists: DataFrame, by: list[str], often: str) -> DataFrame:
    """``lists`` (sig, w, ``often``) with s, the position of a list from the end: tokens in it and the more frequent ones of its row (``by``).

    Lists are ordered by frequency, then by sig, alike in all rows.  What two
    rows share begins with their rarest common list, so s of that list, on both
    sides, is at least the number of tokens that they share.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(often), F.desc("sig")).rowsBetween(Window.unboundedPreceding, 0)
    return lists.withColumn("s", F.sum("w").over(order))


def _reaches(c: Column, rest: Column, n_x: Column, n_y: Column) -> Column:
    """Whether c common posted tokens and ``rest`` others can link sets of n_x and n_y tokens, or larger ones."""
    # a partner has at least three quarters of a set's tokens
    both = F.greatest(n_x * DEN, n_y * NUM) + F.greatest(n_y * DEN, n_x * NUM)
    return (c + rest) * (NUM + DEN) * DEN >= both * NUM


def resolve(lists: DataFrame, nodes: DataFrame, clusters: DataFrame, texts: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Links between clusters that share lists; and rid, h: tokens of a class in lists of more than ``most`` clusters.

    ``nodes``: rid, n, p, h (prefix size and last prefix token); ``clusters``: node, comp.
    """
    nodes = nodes.select("rid", F.col("n").cast("long"), F.col("p").cast("long"), "h")
    rows = lists.join(clusters.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    rows = cut(rows.select("sig", "rid", "w", "comp"), "clustered")
    parts = rows.groupBy("sig", "comp").agg(F.max("w").alias("w"))
    width = parts.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1")
    usual = width.where(F.col("k") <= most) if most else width
    long_lists = width.where(F.col("k") > most) if most else width.where(F.lit(False))
    left_over = cut(rows.join(long_lists.select("sig"), "sig").groupBy("rid").agg(F.sum("w").alias("in_long")), "left-over")
    spans = (nodes.join(clusters.withColumnRenamed("node", "rid"), "rid", "left").join(left_over, "rid", "left")
             .groupBy(F.coalesce("comp", "rid").alias("comp"))
             .agg(F.max(F.col("comp").isNull()).alias("alone"), F.min("n").alias("least"), F.max("n").alias("n"), F.max("p").alias("p"),
                  F.max(F.col("n") - F.col("p")).alias("rest"), F.max("h").alias("h"), F.max(F.coalesce("in_long", F.lit(0))).alias("in_long")))
    spans = cut(spans, "spans")
    # lists by position: those of a cluster's end, frequent ones, are skipped where they are too few tokens for a link
    parts = cut(positions(parts.join(usual, "sig"), ["comp"], "k").join(spans.select("comp", "least", "n", "rest", "in_long"), "comp"), "parts")
    sides = [parts.select("sig", *[F.col(c).alias(f"{c}_{e}") for c in ("w", "s", "least", "n", "rest", "in_long")], F.col("comp").alias(e)) for e in ("x", "y")]
    near = ((F.col("x") < F.col("y")) & (F.col("n_x") * DEN >= F.col("least_y") * NUM) & (F.col("n_y") * DEN >= F.col("least_x") * NUM)
            & _reaches(F.least("s_x", "s_y") + F.least("in_long_x", "in_long_y"), F.greatest("rest_x", "rest_y"), F.col("least_x"), F.col("least_y")))
    # skipped lists come after the last one kept
    pairs = (sides[0].join(sides[1].withColumnRenamed("sig", "sig_y"), (F.col("sig") == F.col("sig_y")) & near).groupBy("x", "y")
             .agg((F.sum("w_x") + F.min(F.least(F.col("s_x") - F.col("w_x"), F.col("s_y") - F.col("w_y")))).alias("c")))
    for end in ("x", "y"):
        pairs = pairs.join(spans.select(F.col("comp").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in spans.columns if c != "comp"]), end)
    alone = F.col("alone_x") & F.col("alone_y")
    args = [F.col(f"{c}_{e}") for e in ("x", "y") for c in ("n", "p", "h")]
    # c leaves out common tokens in long lists, of which there are at most as many as either side has
    most_c = F.col("c") + F.least("in_long_x", "in_long_y")
    # c of two clusters is at least that of any two members, so the same bound holds in a wider form
    some = _reaches(most_c, F.greatest("rest_x", "rest_y"), F.col("least_x"), F.col("least_y"))
    pairs = pairs.where(F.when(alone, _may_link(most_c, *args)).otherwise(some))
    pairs = cut(pairs.select("x", "y", alone.alias("alone")), "cluster-pairs")
    judged = compare(pairs, texts)
    links = judged.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    # clusters whose roots are not linked, nor joined through others: distances to the roots bound what their members can reach
    open_ = judged.where("not linked").join(pairs.where("not alone").select("x", "y"), ["x", "y"]).select("x", "y", "distance")
    open_ = cut(still_apart(open_, links), "open")
    if open_.isEmpty():
        return links, left_over
    asked = open_.select(F.explode(F.array("x", "y")).alias("comp")).distinct()
    members = rows.select("comp", "rid").distinct().join(asked, "comp").where("rid <> comp").select(F.col("comp").alias("x"), F.col("rid").alias("y"))
    radius = compare(members, texts).select(F.col("x").alias("comp"), F.col("y").alias("rid"), F.col("distance").alias("r"))
    radius = radius.join(nodes.select("rid", F.col("n").alias("n_rid"), F.col("p").alias("p_rid")), "rid")
    reach = radius.groupBy("comp").agg(F.max("r").alias("reach"))
    limit = 1 - NUM / DEN + EPS
    ranges = spans.select("comp", "least", "n", "rest", "in_long").join(reach, "comp", "left").fillna(0.0, ["reach"])
    for end in ("x", "y"):
        open_ = open_.join(ranges.select(F.col("comp").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ranges.columns if c != "comp"]), end)
    open_ = cut(open_.where(F.col("distance") <= limit + F.col("reach_x") + F.col("reach_y")), "reachable")
    if open_.isEmpty():
        return links, left_over
    # members against the root of the other cluster, where their lists and the bounds allow a link to any of its members;
    # common lists of two clusters come from the one with fewer lists
    count = parts.groupBy("comp").agg(F.count("*").alias("lists"))
    ends = open_.select("x", "y")
    for end in ("x", "y"):
        ends = ends.join(count.select(F.col("comp").alias(end), F.col("lists").alias(f"lists_{end}")), end)
    first = F.col("lists_x") <= F.col("lists_y")
    ends = ends.select("x", "y", F.when(first, F.col("x")).otherwise(F.col("y")).alias("comp"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("other"))
    tied = ends.join(parts.select("comp", "sig", "w"), "comp").join(parts.select("sig", F.col("comp").alias("other")), ["sig", "other"])
    tied = cut(tied.select("x", "y", "sig", "w"), "tied")
    held = cut(rows.join(asked, "comp").groupBy("sig", "comp").agg(F.count("*").alias("m")), "held")
    of_rid = radius.join(left_over, "rid", "left").fillna(0, ["in_long"])
    asks = []
    for here, there in (("x", "y"), ("y", "x")):
        # common lists by position too: rarest in the cluster first
        order = positions(tied.join(held.withColumnRenamed("comp", here), ["sig", here]), ["x", "y"], "m").join(open_, ["x", "y"])
        mine = rows.select("sig", "w", F.col("rid"), "comp").join(of_rid, ["comp", "rid"]).select(
            F.col("sig").alias("sig_rid"), "rid", "r", "n_rid", "p_rid", "in_long", F.col("comp").alias("comp_rid"))
        others = [F.least("in_long", f"in_long_{there}"), F.greatest(F.col("n_rid") - F.col("p_rid"), f"rest_{there}")]
        near = ((F.col("distance") - F.col("r") - F.col(f"reach_{there}") <= limit)
                & (F.col("n_rid") * DEN >= F.col(f"least_{there}") * NUM) & (F.col(f"n_{there}") * DEN >= F.col("n_rid") * NUM)
                & _reaches(F.col("s") + others[0], others[1], F.col("n_rid"), F.col(f"least_{there}")))
        met = order.join(mine, (F.col("sig") == F.col("sig_rid")) & (F.col(here) == F.col("comp_rid")) & near)
        met = met.groupBy("x", "y", "rid").agg((F.sum("w") + F.min(F.col("s") - F.col("w")) + F.first(others[0])).alias("c"), F.first(others[1]).alias("others"),
                                               *[F.first(c).alias(c) for c in ("r", "n_rid", f"least_{there}")])
        asks.append(cut(met.where(_reaches(F.col("c"), F.col("others"), F.col("n_rid"), F.col(f"least_{there}")))
                        .select("x", "y", F.lit(here).alias("side"), F.col(there).alias("root"), "rid", "r"), "asks"))
    asks = asks[0].union(asks[1])
    told = compare(asks.select(F.col("root").alias("x"), F.col("rid").alias("y")), texts)
    links = links.union(told.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")))
    told = cut(asks.join(told.select(F.col("x").alias("root"), F.col("y").alias("rid"), F.col("distance").alias("d"), "linked"), ["root", "rid"]), "told")
    found = told.where("linked").select("x", "y")
    if not found.isEmpty():
        open_ = cut(still_apart(open_, judged.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")).union(found)), "open")
    # what can still link: member pairs that share a list and whose distances to both roots allow it
    ends = []
    for side, other in (("x", "y"), ("y", "x")):
        mine = told.where(F.col("side") == side).select("x", "y", "rid", "r", "d")
        roots = open_.select("x", "y", F.col(side).alias("rid"), F.lit(0.0).alias("r"), F.col("distance").alias("d"))
        mine = mine.union(roots).join(open_.select("x", "y", F.col(f"reach_{other}").alias("most_r")), ["x", "y"]).where(F.col("d") <= limit + F.col("most_r"))
        ends.append(mine.join(lists.select("rid", "sig", "w"), "rid"))
    one = ends[0].select("x", "y", "sig", "w", F.col("rid").alias("u"), F.col("r").alias("r_u"), F.col("d").alias("d_u"))
    two = ends[1].select("x", "y", "sig", F.col("rid").alias("v"), F.col("r").alias("r_v"), F.col("d").alias("d_v"))
    # here c counts all lists, the long ones too
    deep = one.join(two, ["x", "y", "sig"]).where((F.col("d_u") - F.col("r_v") <= limit) & (F.col("d_v") - F.col("r_u") <= limit))
    deep = deep.groupBy(F.col("u").alias("x"), F.col("v").alias("y")).agg(F.sum("w").alias("c"))
    deep = deep.join(_nodes_as(nodes, "x"), "x").join(_nodes_as(nodes, "y"), "y").where(_may_link(F.col("c"), *args)).select("x", "y")
    more = compare(deep, texts).where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return links.union(more), left_over


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LIST_CLUSTERS) -> DataFrame:
    """Per row of ``docs``: rid (its number), id, n_shingles, comp and component_id.

    Rows link at a Jaccard similarity of 0.75 or more of their 5-word
    shingles; comp is the least rid of the component's classes, null without
    shingles, and component_id the least id in the component, which is null
    where all ids are and need not be its own.  ``docs`` must be
    a table read from storage, as its rows are numbered in several scans.
    Null, empty and blank texts have no shingles and stand alone; equal texts
    and repeated rows are one class; null ids rank last in a component; other
    columns are not read; an empty table gives no rows.
    """
    pin_splits(docs.sparkSession)
    with small_batches(docs.sparkSession, SLICE, HANDED):
        return _similar_sets(docs, id_col, text_col, most)


def _similar_sets(docs: DataFrame, id_col: str, text_col: str, most: int | None) -> DataFrame:
    # every Python step is cut here, so it has run when this returns
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = cut(numbered.mapInArrow(_emit_sets, "rid long, id long, n int, digest binary, prefix array<long>"), "sets")
    classes = cut(rows.where("n > 0").groupBy("n", "digest").agg(F.min("rid").alias("rep")), "classes")
    reps = rows_of(rows, classes.select(F.col("rep").alias("rid")))
    postings = reps.select(F.explode("prefix").alias("token"), "rid")
    lists = token_lists(postings)
    texts = numbered.select("rid", "text")
    no_df = F.struct(F.lit(0).cast("long").alias("df"), F.element_at("prefix", -1).alias("token"))
    nodes = cut(reps.select("rid", "n", F.size("prefix").alias("p"), no_df.alias("h")), "nodes")
    # classes against the most central class of their lists
    weights = centrality(lists)
    links = compare(stars(lists, weights, nodes), texts).where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    clusters = rooted(components(links), weights)
    more, long_rows = resolve(lists, nodes, clusters, texts, most)
    links = links.union(more)
    # a pair whose common posted tokens are all in long lists has more of them than the extra ones of the smaller set
    laden = cut(long_rows.join(nodes, "rid").where(F.col("in_long") > F.floor(F.col("n") * (NUM / DEN * EXTRA))).select("rid"), "laden")
    if not laden.isEmpty():
        # by exact frequency among these documents: rare tokens first
        tokens = rows_of(texts, laden).mapInArrow(_emit_tokens, "rid long, tokens array<long>").select("rid", F.explode("tokens").alias("token"))
        # the frequency comes with the rows, in one shuffle instead of a join's three
        ranked = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).groupBy("rid").agg(
            F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))
        ranked = cut(ranked.select("rid", F.slice("all", 1, _prefix_size_col(F.size("all"))).alias("head"), F.size("all").alias("n")), "ranked")
        again = token_lists(ranked.select("rid", F.explode("head").alias("x")).where("x.df > 1").select("rid", "x.token"))
        nodes = ranked.select("rid", "n", F.size("head").alias("p"), F.element_at("head", -1).alias("h"))
        clusters = rooted(components(links), centrality(again))
        more, _ = resolve(again, cut(nodes, "nodes"), clusters, texts, None)
        links = links.union(more)
    final = components(links)
    named = classes.join(final.select(F.col("node").alias("rep"), "comp"), "rep", "left").select(
        "n", "digest", F.coalesce("comp", "rep").alias("comp"))
    placed = cut(rows.select("rid", "id", "n", "digest").join(named, ["n", "digest"], "left"), "placed")
    least = placed.where("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    out = placed.join(least, "comp", "left")
    return out.select("rid", "id", F.col("n").cast("long").alias("n_shingles"), "comp",
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id (then the first) of every component, its columns as they were.

    Rows without words or text all stay; rows with a null id come last in their
    component; of repeated rows one stays; names may clash with inner ones; an
    empty table gives no rows.
    """
    groups = similar_sets(docs, id_col, text_col)
    solo = F.col("comp").isNull()
    keep = groups.where(~solo).groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("best")).select("best.rid")
    keep = keep.union(groups.where(solo).select("rid"))
    names = docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("rid"))
    return plain.join(keep, "rid", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
