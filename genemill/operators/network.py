"""Gene graphs as edge tables (src, dst, weight): restriction, normalisation, smoothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genemill.operators.distributed import reuse


def undirected(edges: DataFrame, confidence: float | None = None) -> DataFrame:
    """One row per unordered pair: its largest weight; self edges are dropped."""
    e = edges if confidence is None else edges.filter(F.col("weight") >= confidence)
    return (
        e.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.max("weight").alias("weight"))
    )


def restrict_edges(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges with both ends in the given genes."""
    keep = genes.select("gene").distinct()
    return edges.join(keep.withColumnRenamed("gene", "src"), "src", "left_semi").join(
        keep.withColumnRenamed("gene", "dst"), "dst", "left_semi"
    )


def adjacency(edges: DataFrame, genes: DataFrame, self_loop: float = 1.0) -> DataFrame:
    """Symmetric adjacency over the genes: largest weight per pair, both directions, self loops."""
    one = undirected(restrict_edges(edges, genes))
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    loops = genes.select("gene").distinct().select(
        F.col("gene").alias("src"), F.col("gene").alias("dst"), F.lit(float(self_loop)).alias("weight")
    )
    return one.unionByName(back).unionByName(loops)


def normalized_adjacency(adj: DataFrame, eps: float = 1e-8) -> DataFrame:
    """w / sqrt(degree(src) * degree(dst))."""
    deg = adj.groupBy("src").agg((F.sum("weight") + eps).alias("_d"))
    return (
        adj.join(deg, "src")
        .join(deg.select(F.col("src").alias("dst"), F.col("_d").alias("_e")), "dst")
        .select("src", "dst", (F.col("weight") / F.sqrt(F.col("_d") * F.col("_e"))).alias("weight"))
    )


DENSE_GENES = 1024


def _dense_sums(expr: DataFrame, normalized: DataFrame) -> DataFrame:
    """Neighbour sums by one matrix product per block of samples; the weights are at most DENSE_GENES squared."""
    edges = normalized.select("src", "dst", "weight").collect()
    src, i = np.unique(np.array([e[0] for e in edges], dtype=object), return_inverse=True)
    dst, j = np.unique(np.array([e[1] for e in edges], dtype=object), return_inverse=True)
    weight, near = np.zeros((len(dst), len(src))), np.zeros((len(dst), len(src)))
    np.add.at(weight, (j, i), [e[2] for e in edges])
    near[j, i] = 1.0
    names = pa.array(src.tolist(), pa.string())
    index = expr.sparkSession.createDataFrame(list(enumerate(dst.tolist())), "i int, gene_id string")
    # of a cell, its value and whether it is null; the row is there if a neighbour has a cell
    rows = (
        expr.join(index, "gene_id")
        .groupBy("sample_id")
        .agg(F.collect_list(F.struct("i", "value")).alias("c"))
        .select("sample_id", F.col("c.i").alias("i"), F.col("c.value").alias("v"))
    )

    def multiply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cells, value = part.column("i"), part.column("v").flatten()
                row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
                place = (row, cells.flatten().to_numpy())
                full = ~value.is_null().to_numpy(zero_copy_only=False)
                x, known, there = (np.zeros((len(cells), len(weight))) for _ in range(3))
                np.add.at(x, place, value.fill_null(0.0).to_numpy())
                np.add.at(known, place, full.astype(float))
                np.add.at(there, place, 1.0)
                s, g = np.nonzero(there @ near)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(g)), part.column("sample_id").take(pa.array(s)),
                     pa.array((x @ weight)[s, g], mask=(known @ near)[s, g] == 0)], ["src", "sample_id", "value"]
                )

    return rows.mapInArrow(multiply, "src string, sample_id string, value double")


def smooth_expression(expr: DataFrame, normalized: DataFrame, mode: str = "concat") -> DataFrame:
    """Neighbour sums of each gene per sample, appended (_nbr) or in place of it (_sm)."""
    if mode not in ("concat", "smooth_only"):
        raise ValueError("mode must be concat or smooth_only")
    tail = "_nbr" if mode == "concat" else "_sm"
    expr = reuse(expr)
    ends = reuse(normalized)
    genes = ends.select("dst").distinct().count()
    if genes <= DENSE_GENES and ends.select("src").distinct().count() <= DENSE_GENES:
        sums = _dense_sums(expr, ends)
    else:
        sums = (
            ends.join(expr.withColumnRenamed("gene_id", "dst"), "dst")
            .groupBy("src", "sample_id")
            .agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
        )
    sm = sums.select(F.concat(F.col("src"), F.lit(tail)).alias("gene_id"), "sample_id", "value")
    return expr.select("gene_id", "sample_id", "value").unionByName(sm) if mode == "concat" else sm


def nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct nodes of a graph with a mark for the seeds."""
    ends = edges.select(F.col("src").alias("gene")).union(edges.select("dst")).distinct()
    s = seeds.select("gene").distinct().withColumn("_s", F.lit(True))
    return ends.join(s, "gene", "full").select("gene", F.coalesce("_s", F.lit(False)).alias("is_seed"))
