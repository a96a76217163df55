"""MinHash near-dedup (operator 6) with bottom-k sketches.

1. One pass gives every text its set of word shingles as hashes of one function
   and the ``K`` smallest of them (its sketch). Texts with equal sets form a class;
   its smallest id stands for it.
2. Inverted lists of the retained values. Two linked texts share at least ``t`` of
   their retained values, so of each sketch only the rarest values are listed, all
   but ``t - 1``; values that many texts share stay out of most lists. The pairs in
   the lists, with their overlaps, go through the union-sketch estimate, and texts
   connected by pairs that pass form a cluster. Lists above ``LIST`` texts don't give
   all their pairs: every text meets ``LIST_PIVOTS`` of the list, and then, in blocks,
   the texts of the list that it is not connected with.
3. Inside a cluster estimates choose pairs and Jaccard on the whole sets confirms
   them. Clusters up to ``CHUNK`` texts are compared in one task. In larger ones,
   which are groups of near copies, all texts first meet a few pivots, in chunks;
   then only texts that are not yet in one component are compared, in blocks.

Only links between components found so far leave a task, so a group of copies
gives about a row per text, not all its pairs. Values, lists, hubs and clusters that
hold many rows meet their one row of counts by broadcast (``join_counted``).

Sets hold 63-bit hashes. Equal sets are told by their size and two sums of hashes
that are independent from the bytes of the words on, 127 bits together.

For a similarity of 0.75 the chance that two linked texts with more than ``K``
shingles each share fewer than 27 of 64 retained values is below 1e-8; smaller sets
are compared without any such chance. Other similarities have other counts, see
``shared_at_least``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Tables, as_bytes, join_counted, number_rows, text_chunks
from pagelake.llm.recompression import U, Words, mix

#: Retained values, and the chance that two linked texts share fewer than they should.
K, MISS = 64, 1e-8
#: Texts that are compared in one task, pivots of larger clusters, texts in a block.
CHUNK, PIVOTS, BLOCK = 256, 8, 256
#: Texts of a list that give all their pairs; pivots of larger lists, and sketches in a block of them.
LIST, LIST_PIVOTS, LIST_BLOCK = 128, 2, 2048
#: Edges that one task joins into components.
TASK_EDGES = 1 << 18
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 6.0


def shared_at_least(percent: int) -> int:
    """How many of ``K`` retained values two linked texts share, but for a chance of MISS.

    Under 26 percent they may share none, which no list finds: an error.
    """
    p, below = percent / 100, 0.0
    for n in range(K + 1):
        below += math.comb(K, n) * p**n * (1 - p) ** (K - n)
        if below > MISS:
            break
    if n < 1 or percent > 100:
        raise ValueError(f"percent is {percent}; sketches of {K} values need 26 to 100")
    return n


def shingle_sets(words: Words, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes (63 bits) of each text, and independent ones of the same shingles.

    Texts with fewer words than a shingle give one.
    """
    counts = np.diff(words.first)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), per)
    start = np.repeat(words.first[:-1], per) + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(size, counts[owner])
    one, two = mix(length.astype(U)), length.astype(U)
    short = (per == 1) & (counts < size)
    for j in range(size):
        at = slice(None) if not short.any() or not j else np.flatnonzero(length > j)
        one[at] = mix(one[at] ^ words.names[start[at] + j])
        two[at] = mix((two[at] + words.others[start[at] + j]) * U(0xFF51AFD7ED558CCD))
    one >>= U(1)
    out, cuts = [], np.cumsum(per).tolist()
    for e, p in zip(cuts, per.tolist()):
        order = np.argsort(one[e - p : e])
        sorted_ = one[e - p : e][order]
        new = np.concatenate([np.ones(min(p, 1), bool), sorted_[1:] != sorted_[:-1]])
        out.append((sorted_[new], two[e - p : e][order[new]]))
    return out


def _lower(column: pa.Array) -> list[bytes]:
    return [t.lower() for t in as_bytes(column)]  # of bytes: A to Z only


def document_sketches(docs: DataFrame, size: int, *, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, c1, c2, sketch`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            sets = shingle_sets(Words(_lower(b.column("text"))), size)
            sums = np.array([[mix(s * U(0x9E3779B97F4A7C15)).sum(), mix(t).sum()] for s, t in sets], U).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([s[:K].view(np.int64) for s, _ in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "c1", "c2", "sketch"],
            )

    return rows.mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, sketch array<long>")


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``node, label``: the smallest node of the component, for nodes of ``edges`` (a, b).

    Each task first joins up to ``TASK_EDGES`` edges and sends on one edge per node
    that isn't its component's smallest. If that took several tasks, large-star and
    small-star steps alternate on written tables until the edges stay the same.
    Edges never meet on the driver; the smallest neighbour of a hub reaches the
    hub's edges by broadcast.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, nodes = _Union(), set()
        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                union.join(x, y)
                nodes.update((x, y))
        pairs = [(x, union.root(x)) for x in sorted(nodes) if union.root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    def lowest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))

    edges = edges.where("a != b").select("a", "b")
    tasks = math.ceil(max(1, edges.count()) / TASK_EDGES)
    now, seen, step = tables.write(edges.repartition(tasks).mapInArrow(joined, "u long, v long"), f"{name}-0"), None, 0
    while tasks > 1:
        state = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.col("v").cast("decimal(38,0)"))).first())  # a fingerprint
        if state == seen:
            break
        seen, step = state, step + 1
        both = now.union(now.select("v", "u"))
        large = join_counted(both, lowest(both), "u", "n", 2 * state[0])
        large = large.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = lowest(large)
        small = join_counted(large, low, "u", "n", 2 * state[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = tables.write(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-{step}")
        tables.drop(f"{name}-{step - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())


class _Union:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            self.up[x] = x = self.up.get(self.up[x], self.up[x])
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the values."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    common = np.intersect1d(*flat)
    at = [np.searchsorted(common, f) for f in flat]
    hit = [(a < len(common)) & (common[np.minimum(a, len(common) - 1)] == f) if len(common) else np.zeros(len(f), bool) for a, f in zip(at, flat)]
    order = []
    for k in (0, 1):
        a, r = at[k][hit[k]], rows[k][hit[k]]
        o = np.argsort(a, kind="stable")
        order.append((a[o], r[o]))
    step = 2048
    for low in range(0, len(common), step):
        mats = []
        for k, n in ((0, len(left)), (1, len(right))):
            a, r = order[k]
            s, e = np.searchsorted(a, [low, low + step])
            m = np.zeros((n, min(step, len(common) - low)), np.float32)
            m[r[s:e], a[s:e] - low] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out.astype(np.int64)


def _estimated(left: list[np.ndarray], right: list[np.ndarray], n: np.ndarray, m: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
    """Of the ``wanted`` pairs those whose sketches may belong to linked sets of sizes n and m.

    Sizes first, then the estimate from the union of both sketches below the
    smaller of their largest values.
    """
    wanted = wanted & (100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :]))
    if not wanted.any():
        return wanted
    top = [np.array([s[K - 1] if size > K else ~U(0) for s, size in zip(x, sizes.tolist())]) for x, sizes in ((left, n), (right, m))]
    shared = _shared(left, right)
    below_l = np.stack([np.searchsorted(s, top[1], side="right") for s in left])
    below_r = np.stack([np.searchsorted(s, top[0], side="right") for s in right]).T
    union = np.maximum(1, below_l + below_r - shared)
    p = percent / 100
    return wanted & (shared >= p * union - SLACK * np.sqrt(p * (1 - p) * union))


def _links(left: list[np.ndarray], right: list[np.ndarray], percent: int, wanted: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of ``wanted`` with 100 * intersection >= percent * union, of whole sets; estimates come first."""
    n, m = (np.array([len(s) for s in x]) for x in (left, right))
    i, j = np.nonzero(_estimated([s[:K] for s in left], [s[:K] for s in right], n, m, percent, wanted))
    if not len(i):
        return np.empty((0, 2), np.int64)
    some_l, some_r = np.unique(i), np.unique(j)
    whole = np.zeros((len(left), len(right)), np.int64)
    whole[np.ix_(some_l, some_r)] = _shared([left[k] for k in some_l], [right[k] for k in some_r])
    both = whole[i, j]
    ok = 100 * both >= percent * (n[i] + m[j] - both)
    return np.stack([i[ok], j[ok]], axis=1)


def _spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """Links that join two components of this task."""
    union = _Union()
    kept = [(a, b) for a, b in zip(left[links[:, 0]].tolist(), right[links[:, 1]].tolist()) if union.join(a, b)]
    return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([x for _, x in kept], pa.int64())})


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in table.column("hashes").to_pylist()]


def _between_labels(rows: DataFrame, group: str, size: int, find, tables: Tables, name: str) -> DataFrame:
    """Edges (a, b) that ``find(left, right, wanted)`` sees between texts of one group and different labels.

    ``rows``: the group, ``node, label, n, hashes``. A group's texts lie in blocks of
    ``size`` by label; every two blocks meet but for those of one and the same label.
    """
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    placed = number_rows(rows, ["label", "node"], by=[group], sums={"place": "one"}, name=name, tables=tables)
    placed = tables.write(placed.withColumn("block", F.floor(F.col("place") / size)).select(group, "block", "label", "n", "hashes"), f"{name}-placed")
    tables.drop(name)
    blocks = placed.groupBy(group, "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    sides = [blocks.select(group, *[F.col(c).alias(f"{s}_{c}") for c in ("block", "low", "high")]) for s in "ij"]
    tasks = sides[0].join(sides[1], group).where("i_block <= j_block AND NOT (i_low = i_high AND j_low = j_high AND i_low = j_low)")
    tasks = tasks.select(group, "i_block", "j_block", F.explode(F.array_distinct(F.array("i_block", "j_block"))).alias("block"))
    dealt = placed.join(tasks, [group, "block"])

    def compare(table: pa.Table) -> pa.Table:
        label, block, n = (table.column(c).to_numpy() for c in ("label", "block", "n"))
        found = _sets(table)
        i, j = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("i_block", "j_block"))
        links = find([found[k] for k in i], [found[k] for k in j], n[i], n[j], label[i][:, None] != label[j][None, :])
        return _spanning(links, label[i], label[j])

    return dealt.groupBy(group, "i_block", "j_block").applyInArrow(compare, "a long, b long")


def _clusters(lists: DataFrame, classes: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """``node, cluster, size``: nodes connected by pairs of the lists (node, n, value) that pass the estimate."""
    total = lists.count()
    pivots = F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(j)), "node", "n")) for j in range(LIST_PIVOTS)])
    pivots = F.array_distinct(F.transform(pivots, lambda p: F.struct(p["node"].alias("node"), p["n"].alias("n"))))
    per = lists.groupBy("value").agg(F.count("*").alias("texts"), pivots.alias("pivots")).where("texts > 1")
    listed = tables.write(join_counted(lists, per, "value", "texts", total), "listed")
    few, many = listed.where(f"texts <= {LIST}"), listed.where(f"texts > {LIST}")
    alike = f"100 * least(n, b_n) >= {percent} * greatest(n, b_n) AND node != b"
    small = few.join(few.select("value", F.col("node").alias("b"), F.col("n").alias("b_n")), "value").where(f"node < b AND {alike}").select(F.col("node").alias("a"), "b")
    stars = many.withColumn("p", F.explode("pivots")).select("node", "n", F.col("p.node").alias("b"), F.col("p.n").alias("b_n")).where(alike).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    pairs = tables.write(small.unionByName(stars).groupBy("a", "b").agg(F.count("*").alias("overlap")), "pairs")
    n_pairs, met = pairs.count(), pairs
    for side in "ab":
        degree = pairs.groupBy(side).agg(F.count("*").alias(f"{side}_deg"))
        sketches = classes.select(F.col("node").alias(side), F.col("sketch").alias(f"{side}_sketch"), F.col("n_shingles").alias(f"{side}_n")).join(degree, side)
        met = join_counted(met, sketches, side, f"{side}_deg", n_pairs)
    maybe = tables.write(met.where(_may_link(percent)).select("a", "b"), "maybe")
    labels = tables.write(components(maybe, tables, "maybe-linked"), "maybe-labels")
    # lists whose texts are not all connected yet: texts of different components meet in blocks
    of = many.select("value", "node", "n", "texts").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = tables.write(of, "labelled")
    open_ = of.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high")
    rows = join_counted(of, open_, "value", "size", total).join(classes.select("node", "sketch"), "node")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("value", "node", "label", "n")], pa.array([np.array(x, np.int64).tobytes() for x in b.column("sketch").to_pylist()], pa.binary())], names=["value", "node", "label", "n", "hashes"])

    rows = rows.select("value", "node", "label", "n", "sketch").mapInArrow(packed, "value long, node long, label long, n long, hashes binary")
    more = _between_labels(rows, "value", LIST_BLOCK, lambda x, y, n, m, wanted: np.argwhere(_estimated(x, y, n, m, percent, wanted)), tables, "list-blocks")
    both = tables.write(maybe.union(more), "maybe-all")
    found = components(both, tables, "clustered").withColumnRenamed("label", "cluster")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size"))
    found = tables.write(join_counted(found, sizes, "cluster", "size", found.count()), "clusters")
    tables.drop("lists", "listed", "pairs", "maybe", "maybe-all", "maybe-linked-0", "labelled", "list-blocks-placed", "clustered-0")
    return found


def _may_link(percent: int):
    """The test of ``_estimated`` for a pair's columns ``a_sketch, a_n, b_sketch, b_n``."""
    top = {s: F.when(F.col(f"{s}_n") > K, F.element_at(f"{s}_sketch", -1)).otherwise(F.lit((1 << 63) - 1)) for s in "ab"}
    shared = F.size(F.array_intersect("a_sketch", "b_sketch"))
    below = F.size(F.filter("a_sketch", lambda x: x <= top["b"])) + F.size(F.filter("b_sketch", lambda x: x <= top["a"]))
    union, p = F.greatest(F.lit(1), below - shared), percent / 100
    return shared >= p * union - SLACK * F.sqrt(p * (1 - p) * union)


def near_duplicate_groups(docs: DataFrame, *, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Letters A to Z are lowered. Links are pairs with 100 * intersection >= percent
    * union of their sets of ``shingle``-word shingles (fewer words: the whole
    sequence); ``component_id`` is the smallest id reachable. Texts without words
    are linked with nothing. Rows with one id share a component, repeated rows
    too. Rows with a null id are linked with nothing: null component, kept. Without
    rows there are none; a very long text is one sketch, and its set is held in one task.

    Candidates come from sketches of random hashes, so a link between two different texts of
    more than 64 shingles is missed with a chance below 1e-8 (none of fewer shingles is, and
    no copy); 1e10 such links lose 100 on average, if nothing else connects their texts.
    """
    shared = shared_at_least(percent)
    tables = Tables(docs.sparkSession, "near-dedup")
    rows = tables.write(document_sketches(docs, shingle, id_col=id_col, text_col=text_col), "sketches")
    classed = ["n_shingles", "c1", "c2"]
    real = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = tables.write(real.groupBy(*classed).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")), "classes")

    # lists: per text its rarest retained values that another text has; a text of two classes counts once
    values = classes.select("node", "c1", F.col("n_shingles").alias("n"), F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = join_counted(values, counts, "value", "df", K * classes.count()).groupBy("node", "c1", "n", "kept").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("x"))
    enough = F.greatest(F.lit(1), F.floor(F.col("kept") * shared / K))
    listed = F.greatest(F.lit(0), F.col("kept") - enough + 1 - (F.col("kept") - F.size("x")))
    lists = held.select("node", "n", F.explode(F.slice("x", F.lit(1), listed.cast("int"))).alias("x")).select("node", "n", "x.value")
    clusters = _clusters(tables.write(lists, "lists"), classes, percent, tables)

    # whole sets of the clustered texts only
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            sets = [s for s, _ in shingle_sets(Words(_lower(b.column("text"))), shingle)]
            cols = [*[b.column(c) for c in ("node", "cluster", "size")], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "cluster", "size", "n", "hashes"])

    sets = texts.join(clusters, "node").select("node", "text", "cluster", "size").mapInArrow(whole, "node long, cluster long, size long, n long, hashes binary")
    sets = sets.withColumn("one", F.lit(1).cast("long")).withColumn("mixed", F.xxhash64("node"))
    ranked = number_rows(sets, ["mixed", "node"], by=["cluster"], sums={"place": "one"}, name="sets", tables=tables).withColumn("chunk", F.floor(F.col("place") / CHUNK))
    pivots = ranked.where(f"place < {PIVOTS} AND size > {CHUNK}")
    pivots = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("size") - 1) / CHUNK))))
    met = ranked.withColumn("role", F.lit(0)).unionByName(pivots.withColumn("role", F.lit(1)))

    def meet(table: pa.Table) -> pa.Table:
        node, role, place = (table.column(c).to_numpy() for c in ("node", "role", "place"))
        found = _sets(table)
        if table.column("size")[0].as_py() <= CHUNK:
            other = np.arange(len(node))
            wanted = np.triu(np.ones((len(node), len(node)), bool), 1)
        else:
            other = np.flatnonzero((role == 1) | (place < PIVOTS))
            wanted = node[:, None] != node[other][None, :]
        links = _links(found, [found[i] for i in other], percent, wanted)
        return _spanning(links, node, node[other])

    edges = tables.write(met.select("cluster", "chunk", "node", "role", "place", "size", "hashes").groupBy("cluster", "chunk").applyInArrow(meet, "a long, b long"), "links")
    large = ranked.where(f"size > {CHUNK}").select("cluster", "node", "n", "hashes")
    if large.limit(1).count():
        labels = components(edges, tables, "first").withColumnRenamed("node", "of")
        large = large.join(labels, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("label", "node")).drop("of")
        more = _between_labels(large, "cluster", BLOCK, lambda x, y, n, m, wanted: _links(x, y, percent, wanted), tables, "blocks")
        edges = tables.write(edges.union(more), "all-links")
    final = components(edges, tables, "groups").withColumnRenamed("node", "of")
    known = classes.select(*[F.col(c).alias(f"k_{c}") for c in classed], "node")
    known = tables.write(known.join(final, F.col("node") == F.col("of"), "left").select(*[f"k_{c}" for c in classed], F.coalesce("label", "node").alias("label")), "labels")
    tables.drop("classes", "clusters", "sets", "links", "blocks-placed", "all-links", "maybe-labels")
    out = _labelled(rows, known, classed)
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _labelled(rows: DataFrame, known: DataFrame, classed: list[str]) -> DataFrame:
    """Each row with its class's label; classes with many rows, such as large groups of copies, are broadcast."""
    total = rows.count()
    keyed = rows.withColumn("class", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.struct(*classed)))
    plain = keyed.where("class IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("label"))
    real = keyed.where("class IS NOT NULL").select("doc_id", "class")
    sizes = real.groupBy("class").agg(F.count("*").alias("texts"))
    labels = known.select(F.struct(*[F.col(f"k_{c}").alias(c) for c in classed]).alias("class"), "label").join(sizes, "class")
    return join_counted(real, labels, "class", "texts", total).select("doc_id", F.col("class.n_shingles").alias("n_shingles"), "label").unionByName(plain)


def drop_near_duplicates(docs: DataFrame, *, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``near_duplicate_groups``, all columns as they are.

    The row with the smallest id stays; of rows with that id one stays. Rows with
    a null id stay.
    """
    groups = near_duplicate_groups(docs, percent=percent, shingle=shingle, id_col=id_col, text_col=text_col)
    groups = Tables(docs.sparkSession, "kept").write(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("_nd_id"))
    left = docs.join(gone, docs[id_col].cast("long") == F.col("_nd_id"), "left_anti")
    if groups.where("kept AND n > 1").limit(1).count():
        left = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.where(F.col(id_col).isNull()))
    return left
