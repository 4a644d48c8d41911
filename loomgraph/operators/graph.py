"""Graph shaping: edge tables to degrees, weights, layouts, subgraphs and summaries.

``edges`` has src and dst (and w where weighted), one row an edge; parallel edges count each.  ``nodes`` has id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..functions import vectors as V
from ..functions.dealing import dealt
from ..functions.positions import global_positions, running_sum
from ..functions.scratch import written


def add_self_loops(edges: DataFrame, nodes: DataFrame, w: float = 1.0) -> DataFrame:
    """One more edge (i, i) for each node, whether or not it has one."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), *([F.lit(w).alias("w")] if "w" in edges.columns else []))
    return edges.select(loops.columns).unionByName(loops)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def coalesce(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Parallel edges become one with the sum of their weights."""
    return edges.groupBy("src", "dst").agg(F.sum(weight).alias(weight))


def symmetrize(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Both directions of every edge, once each; weights of parallel edges are summed."""
    both = edges.select("src", "dst", *([weight] if weight else []))
    both = both.unionByName(transpose(both))
    return coalesce(both, weight) if weight else both.distinct()


def degrees(edges: DataFrame, nodes: DataFrame, direction: str = "in") -> DataFrame:
    """(id, deg) for every node; direction in, out or both."""
    if direction not in ("in", "out", "both"):
        raise ValueError(f"unknown direction {direction}")
    ends = {"in": [edges.select(F.col("dst").alias("id"))], "out": [edges.select(F.col("src").alias("id"))]}
    ends["both"] = ends["in"] + ends["out"]
    found = ends[direction][0]
    for more in ends[direction][1:]:
        found = found.unionByName(more)
    counted = found.groupBy("id").agg(F.count("*").alias("deg"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def max_degree(deg: DataFrame) -> DataFrame:
    return deg.agg(F.coalesce(F.max("deg"), F.lit(0)).alias("max_degree"))


def degree_bucket(deg: DataFrame, quantile: float) -> DataFrame:
    """(id, deg, bucket): heavy from the interpolated quantile of all degrees on; quantile -1 makes all light."""
    if quantile < 0:
        return deg.withColumn("bucket", F.lit("light"))
    limit = deg.agg(F.percentile("deg", F.lit(quantile)).alias("_t"))
    return deg.join(F.broadcast(limit)).withColumn("bucket", F.when(F.col("deg") < F.col("_t"), "light").otherwise("heavy")).drop("_t")  # one row


def degree_bucket_fixed(deg: DataFrame, threshold: float) -> DataFrame:
    return deg.withColumn("bucket", F.when(F.col("deg") < threshold, "light").otherwise("heavy"))


def undirectedness(edges: DataFrame) -> DataFrame:
    """One row (directed): whether the multiset of edges differs from its transpose."""
    way = F.when(F.col("src") < F.col("dst"), 1).when(F.col("src") > F.col("dst"), -1).otherwise(0)
    pairs = written(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), way.alias("way")))
    balance = dealt(pairs, "a", "b").groupBy("a", "b").agg(F.sum("way").alias("d"))
    return balance.agg(F.coalesce(F.max(F.col("d") != 0), F.lit(False)).alias("directed"))


def is_directed(edges: DataFrame) -> bool:
    return bool(undirectedness(edges).first()[0])


def to_csr(edges: DataFrame, nodes: DataFrame, row: str = "dst", col: str = "src") -> DataFrame:
    """(id, neighbors, weights, row_start): one row a node, sorted by neighbour and weight, row_start in global edge order.

    Rows are destinations by default.  The lists of one node are one row's arrays, as the layout asks for; to_csr_parts splits them.
    """
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    lists = edges.select(F.col(row).alias("id"), F.col(col).alias("n"), w.alias("w")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("e"))
    full = nodes.select("id").join(lists, "id", "left").select("id", F.coalesce(F.transform("e", lambda x: x["n"]), F.array().cast("array<bigint>")).alias("neighbors"), F.coalesce(F.transform("e", lambda x: x["w"]), F.array().cast("array<double>")).alias("weights"))
    # places are summed over narrow rows and joined to the lists where they are
    starts = running_sum(degrees(transpose(edges) if row == "src" else edges, nodes, "in").withColumnRenamed("deg", "_deg"), ["id"], F.col("_deg"), "row_start")
    return full.join(starts.select("id", "row_start"), "id")


def to_csr_parts(edges: DataFrame, size: int = 65_536, row: str = "dst", col: str = "src") -> DataFrame:
    """(id, part, neighbors, weights): to_csr's order in rows of at most ``size`` neighbours, so that a hub isn't one row.

    Places in a row come from sorted ranges, not from a window over the row.
    """
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    placed = running_sum(edges.select(F.col(row).alias("id"), F.col(col).alias("n"), w.alias("w")), ["n", "w"], F.lit(1).cast("long"), "k", ["id"])
    lists = placed.groupBy("id", F.floor(F.col("k") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("k", "n", "w"))).alias("e"))
    return lists.select("id", "part", F.transform("e", lambda x: x["n"]).alias("neighbors"), F.transform("e", lambda x: x["w"]).alias("weights"))


def to_csc(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """As to_csr with sources as rows."""
    return to_csr(edges, nodes, "src", "dst")


def from_csr(adjacency: DataFrame) -> DataFrame:
    """(src, dst, w) of a layout whose rows are destinations."""
    z = F.arrays_zip("neighbors", "weights")
    return adjacency.select(F.col("id").alias("dst"), F.explode(z).alias("e")).select(F.col("e.neighbors").alias("src"), "dst", F.col("e.weights").alias("w"))


def csr_to_csc_positions(edges: DataFrame) -> DataFrame:
    """(src, dst, pos, val_idx): each edge's place in source order and its place in destination order.

    Edges need to be distinct pairs.
    """
    by_src = global_positions(edges.select("src", "dst"), ["src", "dst"], "pos")
    return global_positions(by_src, ["dst", "src"], "val_idx")


def edge_weights(edges: DataFrame, nodes: DataFrame, norm: str = "both", degree: str = "both", weight: str | None = None) -> DataFrame:
    """(src, dst, w) with w divided by degrees counted in edges and at least 1.

    none; right: in-degree of dst; left: out-degree of src; both: root of their product.  degree='in' takes
    the in-degree at both ends.
    """
    if norm not in ("none", "right", "left", "both"):
        raise ValueError(f"unknown norm {norm}")
    base = F.col(weight) if weight else F.lit(1.0)
    out = edges.select("src", "dst", base.cast("double").alias("w"))
    one = lambda d: F.greatest(d, F.lit(1)).cast("double")
    if norm in ("left", "both"):
        d = edges.groupBy(F.col("dst" if degree == "in" else "src").alias("src")).agg(F.count("*").alias("_s"))
        out = out.join(d, "src", "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    if norm in ("right", "both"):
        d = edges.groupBy("dst").agg(F.count("*").alias("_d"))
        out = out.join(d, "dst")
    by = {"none": lambda: F.lit(1.0), "right": lambda: one(F.col("_d")), "left": lambda: one(F.col("_s")), "both": lambda: F.sqrt(one(F.col("_s")) * one(F.col("_d")))}[norm]()
    return out.select("src", "dst", (F.col("w") / by).alias("w"))


def normalized_adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The symmetric normalisation as a matrix: one entry a pair."""
    edges = written(edges.select("src", "dst"))
    return coalesce(dealt(edge_weights(edges, nodes, "both"), "src", "dst", like=edges))


def row_windows(edges: DataFrame, size: int) -> DataFrame:
    """(window, n_edges, n_cols): edges and distinct columns of each block of rows."""
    return edges.groupBy(F.floor(F.col("src") / size).cast("long").alias("window")).agg(F.count("*").alias("n_edges"), F.count_distinct("dst").alias("n_cols"))


def to_block_sparse(matrix: DataFrame, rows: int = 16, cols: int = 8) -> DataFrame:
    """(window, block, cols, bm_lo, bm_hi, weights, block_start) of a matrix (src, dst, w) without repeated entries.

    In each window of rows the distinct columns are ranked and cut into blocks; entry (r, c) of a block is bit and weight
    r * cols + c.  rows * cols is at most 128.
    """
    if rows * cols > 128:
        raise ValueError("a block holds 128 entries at most")
    entry = matrix.select(F.floor(F.col("src") / rows).cast("long").alias("window"), (F.col("src") % rows).cast("int").alias("r"), "dst", "w")
    columns = entry.select("window", "dst").distinct()
    ranked = columns.withColumn("k", F.row_number().over(Window.partitionBy("window").orderBy("dst")) - 1)
    placed = entry.join(ranked, ["window", "dst"]).withColumn("block", F.floor(F.col("k") / cols).cast("long")).withColumn("bit", (F.col("r") * cols + F.col("k") % cols).cast("int"))
    bit = lambda low: F.coalesce(F.bit_or(F.when((F.col("bit") >= low) & (F.col("bit") < low + 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") - low))), F.lit(0).cast("long"))
    bits = placed.groupBy("window", "block").agg(bit(0).alias("bm_lo"), bit(64).alias("bm_hi"), F.map_from_entries(F.collect_list(F.struct("bit", "w"))).alias("m"))
    named = ranked.groupBy("window", F.floor(F.col("k") / cols).cast("long").alias("block")).agg(F.array_sort(F.collect_list("dst")).alias("c"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    padded = F.concat("c", F.array_repeat(F.lit(0).cast("long"), F.lit(cols) - F.size("c")))
    blocks = bits.join(named, ["window", "block"]).select("window", "block", padded.alias("cols"), "bm_lo", "bm_hi", weights.alias("weights"))
    starts = global_positions(named.select("window", "block"), ["window", "block"], "block_start")
    return blocks.join(starts, ["window", "block"])


def from_block_sparse(blocks: DataFrame, rows: int = 16, cols: int = 8) -> DataFrame:
    """(src, dst, w) of the entries whose bit is set."""
    one = blocks.select("window", "cols", "weights", "bm_lo", "bm_hi", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("i"))
    word, place = F.when(F.col("i") < 64, F.col("bm_lo")).otherwise(F.col("bm_hi")), F.col("i") % 64
    there = one.where(F.call_function("getbit", word, place.cast("int")) == 1)
    return there.select((F.col("window") * rows + F.floor(F.col("i") / cols)).cast("long").alias("src"), F.col("cols")[F.col("i") % cols].alias("dst"), F.col("weights")[F.col("i")].alias("w"))


#: Blocks whose columns are multiplied at once.
GROUP_BLOCKS = 2048


def block_product(blocks: DataFrame, nodes: DataFrame, width: int, x: str = "x", rows: int = 16, cols: int = 8) -> DataFrame:
    """(id, out): the matrix in blocks (window, block, cols, bm_lo, bm_hi, weights) times the rows x of ``nodes``, zeros where a row has no entry.

    The columns of blocks are dealt into the cells of a grid of columns and windows, where each meets the one copy of its dense row: columns
    are shuffled with their weights alone, and a cell hands over one sum for each row of its windows.
    """
    one = lambda r, c: F.call_function("getbit", F.col("bm_lo" if r * cols + c < 64 else "bm_hi"), F.lit((r * cols + c) % 64))
    bits = lambda c, low: sum((one(r, c).cast("long") * (1 << (r - low)) for r in range(low, min(rows, low + 32))), F.lit(0).cast("long"))
    column = lambda c: F.struct(F.col("cols")[c].alias("src"), F.array(*[F.col("weights")[r * cols + c].cast("double") for r in range(rows)]).alias("w"), F.array(*[bits(c, low) for low in range(0, rows, 32)]).alias("held"))
    words = -(-rows // 32)
    each = blocks.select(F.col("window").alias("dst"), F.inline(F.array(*[column(c) for c in range(cols)]))).where(F.exists("held", lambda h: h != 0))  # padded columns hold nothing
    each = written(each.select("src", "dst", "w", F.col("held").cast("array<double>").alias("held")))

    def begin(left: grid.Cell, right: grid.Cell):
        total, met = np.zeros((len(right.ids) * rows, width)), np.zeros(len(right.ids) * rows, bool)

        def step(l: np.ndarray, r: np.ndarray, e: np.ndarray) -> None:
            held = e[:, rows : rows + words].astype(np.int64)
            for i in range(0, len(l), GROUP_BLOCKS * cols):
                part = slice(i, i + GROUP_BLOCKS * cols)
                at, row = np.nonzero(held[part][:, np.arange(rows) // 32] >> (np.arange(rows) % 32) & 1)
                places = r[part][at] * rows + row
                grid.added(total, places, e[part][at, row][:, None] * left.rows[l[part][at]])
                met[places] = True

        def end() -> pa.RecordBatch:
            ids = (right.ids[:, None] * rows + np.arange(rows)).ravel()
            return pa.RecordBatch.from_arrays([pa.array(ids[met]), V.lists_of(total[met])], names=["id", "v"])

        return step, end

    windows = each.select(F.col("dst").alias("id")).distinct()
    dense = nodes.select("id", F.col(x).cast("array<double>").alias("x"))
    sums = grid.on_grid(each, dense, {"x": width}, {}, begin, "id long, v array<double>", dst_nodes=windows, values={"w": rows, "held": words})
    found = sums.groupBy("id").agg(V.aggregated(F.sum, "v", width).alias("out"))
    return nodes.select("id").join(found, "id", "left").withColumn("out", F.coalesce("out", V.zeros(width)))


def block_stats(blocks: DataFrame, rows: int = 16, cols: int = 8) -> DataFrame:
    """Windows, blocks, stored entries and bytes (4 a column and weight, 16 a bitmap, 4 an offset) of the layout."""
    n = blocks.agg(F.count_distinct("window").alias("n_windows"), F.count("*").alias("n_blocks"), F.sum(F.bit_count("bm_lo") + F.bit_count("bm_hi")).cast("long").alias("n_entries"))
    return n.withColumn("bytes", (F.col("n_blocks") * (4 * cols + 16 + 4 * rows * cols) + 4 * (F.col("n_windows") + 1)).cast("long"))


def window_column_hist(edges: DataFrame, n: int, rows: int = 16) -> DataFrame:
    """(k, mean_cols, share): how many of n columns hold k of a window's rows, mean over windows with an edge; k = 0..rows."""
    distinct = edges.select(F.floor(F.col("src") / rows).alias("win"), "src", "dst").distinct()
    held = distinct.groupBy("win", "dst").agg(F.count("*").alias("k"))
    windows = held.agg(F.count_distinct("win").alias("nw"), F.count("*").alias("nc"))
    counted = held.groupBy("k").agg(F.count("*").alias("c"))
    every = edges.sparkSession.range(1, rows + 1).select(F.col("id").alias("k"))
    full = every.join(counted, "k", "left").join(F.broadcast(windows)).select("k", F.coalesce("c", F.lit(0)).alias("c"), "nw")
    none = windows.select(F.lit(0).cast("long").alias("k"), (F.col("nw") * n - F.col("nc")).alias("c"), "nw")
    return none.unionByName(full).where("nw > 0").select("k", (F.col("c") / F.col("nw")).alias("mean_cols"), (F.col("c") / (F.col("nw") * n)).alias("share"))


def block_density(edges: DataFrame, b: int) -> DataFrame:
    """(bi, bj, density): edges in each block of b by b cells, over b squared; empty blocks left out."""
    return edges.groupBy(F.floor(F.col("src") / b).cast("long").alias("bi"), F.floor(F.col("dst") / b).cast("long").alias("bj")).agg((F.count("*") / (b * b)).alias("density"))


def diagonal_density(edges: DataFrame, n: int, b: int) -> DataFrame:
    """(diag, density): mean block density for each offset bj - bi, empty blocks and diagonals included."""
    nb = -(-n // b)
    found = block_density(edges, b).groupBy((F.col("bj") - F.col("bi")).alias("diag")).agg(F.sum("density").alias("s"))
    every = edges.sparkSession.range(-(nb - 1), nb).select(F.col("id").alias("diag"))
    return every.join(found, "diag", "left").select("diag", (F.coalesce("s", F.lit(0.0)) / (nb - F.abs("diag"))).alias("density"))


def block_count_hist(edges: DataFrame, n: int, b: int) -> DataFrame:
    """(k, share): share of all blocks whose edge count div b is k."""
    nb = -(-n // b)
    cells = block_density(edges, b).select((F.floor(F.col("density") * b * b + 0.5) / b).alias("x")).select(F.floor("x").cast("long").alias("k"))
    some = cells.groupBy("k").agg(F.count("*").alias("c"))
    zero = some.agg((F.lit(nb * nb) - F.coalesce(F.sum("c"), F.lit(0))).alias("c")).select(F.lit(0).cast("long").alias("k"), "c")
    return some.unionByName(zero).groupBy("k").agg((F.sum("c") / (nb * nb)).alias("share"))


def density(num_edges: Column, num_nodes: Column) -> Column:
    return F.try_divide(num_edges, num_nodes * (num_nodes - 1))


def graph_summary(stats: DataFrame) -> DataFrame:
    """Per dataset: nodes, edges, density, average degree; densest first."""
    largest = stats.groupBy("dataset").agg(F.max("num_nodes").alias("num_nodes"), F.max("num_edges").alias("num_edges"))
    out = largest.withColumn("density", density(F.col("num_edges").cast("double"), F.col("num_nodes").cast("double"))).withColumn("average_degree", F.try_divide(F.col("num_edges").cast("double"), F.col("num_nodes")))
    return out.orderBy(F.desc("density"), "dataset")


def num_classes(nodes: DataFrame, y: str = "y") -> DataFrame:
    return nodes.agg((F.max(y) + 1).cast("long").alias("num_classes"))


def induced_subgraph(nodes: DataFrame, edges: DataFrame, keep: Column, relabel: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept nodes, edges between them, and (id, node_id): new dense ids beside the old ones (equal without relabelling)."""
    kept = nodes.where(keep)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if not relabel:
        return kept, inside, ids.withColumn("node_id", F.col("id"))
    mapping = global_positions(ids.withColumnRenamed("id", "node_id"), ["node_id"], "id").select("id", "node_id")
    new_nodes = kept.withColumnRenamed("id", "node_id").join(mapping, "node_id").drop("node_id").select("id", *[c for c in nodes.columns if c != "id"])
    return new_nodes, relabelled(inside, mapping, "node_id", "id"), mapping


def relabelled(edges: DataFrame, mapping: DataFrame, old: str = "id", new: str = "new_id") -> DataFrame:
    """Edges with both ends replaced through (old, new); ends that aren't mapped drop their edge."""
    s, d = (mapping.select(F.col(old).alias(c), F.col(new).alias(f"_{c}")) for c in ("src", "dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(s, "src").join(d, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)


def reorder(edges: DataFrame, nodes: DataFrame, by: str = "degree", rounds: int = 5, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges under new ids and (id, new_id): by falling in-degree, by label propagation, in parts of at most ``size`` nodes ("parts"), or by
    a column of nodes."""
    if by == "degree":
        order = degrees(edges, nodes, "in").withColumn("_k", -F.col("deg"))
    elif by == "label_propagation":
        order = label_propagation(edges, nodes, rounds).withColumnRenamed("label", "_k")
    elif by == "parts":
        order = bounded_parts(edges, nodes, size, rounds).withColumnRenamed("part", "_k")
    else:
        order = nodes.select("id", F.col(by).alias("_k"))
    mapping = global_positions(order.select("id", "_k"), ["_k", "id"], "new_id").select("id", "new_id")
    return relabelled(edges, mapping), mapping


def bounded_parts(edges: DataFrame, nodes: DataFrame, size: int, rounds: int = 5, fill: float = 0.8) -> DataFrame:
    """(id, part): parts of at most ``size`` nodes with few edges between them, by label propagation with capacities.

    Nodes start in even parts by id, filled to ``fill`` so that there is room to move.  In a round, the nodes of one parity of id + round
    propose the part with most of their neighbours (either direction, the smallest of equals) if it has more of them than their own; a part takes
    the proposals of largest gain, then smallest id, while it has room.  Ranks come from sorted ranges, so a part that all want to
    join is no single task's.
    """
    if not size or size < 1 or not 0 < fill <= 1:
        raise ValueError("the size of a part must be at least 1 and its fill in (0, 1]")
    n = nodes.count()
    parts = max(1, -(-n // max(1, int(size * fill))))
    even = -(-n // parts) if n else 1
    edges = written(edges.select("src", "dst").where("src <> dst"))
    both = edges.unionByName(transpose(edges))
    now = written(global_positions(nodes.select("id"), ["id"], "_pos").select("id", F.floor(F.col("_pos") / even).cast("long").alias("part")))
    for t in range(1, rounds + 1):
        movers = now.where(F.pmod(F.col("id") + t, F.lit(2)) == 0).select(F.col("id").alias("dst"), F.col("part").alias("own"))
        votes = both.join(now.withColumnRenamed("id", "src"), "src").join(movers, "dst").groupBy("dst", "own", "part").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst", "own").agg(F.max(F.struct("n", (-F.col("part")).alias("m"))).alias("b"), F.coalesce(F.max(F.when(F.col("part") == F.col("own"), F.col("n"))), F.lit(0)).alias("stay"))
        wish = best.select(F.col("dst").alias("id"), (-F.col("b.m")).alias("to"), (F.col("stay") - F.col("b.n")).alias("loss")).where("loss < 0")
        ranked = running_sum(wish, ["loss", "id"], F.lit(1).cast("long"), "rank", ["to"])
        room = now.groupBy(F.col("part").alias("to")).agg((F.lit(size) - F.count("*")).alias("room"))
        moved = ranked.join(room, "to").where("rank < room").select("id", "to")
        now = written(now.join(moved, "id", "left").select("id", F.coalesce("to", "part").alias("part")))
    return now


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row (n_edges, n_cut): edges, and those between different parts of (id, part)."""
    ends = [parts.select(F.col("id").alias(c), F.col("part").alias(f"_{c}")) for c in ("src", "dst")]
    both = edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst")
    return both.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum((F.col("_src") != F.col("_dst")).cast("long")), F.lit(0)).alias("n_cut"))


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): each round a node takes the commonest label of its neighbours (either direction), the smallest of equals."""
    edges = written(edges.select("src", "dst"))
    both = edges.unionByName(transpose(edges))
    labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        heard = both.join(labels.withColumnRenamed("id", "src"), "src").select("dst", "label")
        votes = dealt(heard, "dst", "label", like=both).groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b"))
        labels = written(labels.join(best.select(F.col("dst").alias("id"), (-F.col("b.m")).alias("new")), "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return labels
