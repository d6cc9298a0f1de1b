"""Over-representation and rank-based enrichment of gene sets (gene_set, gene)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genemill.functions.special import hypergeom_sf
from genemill.operators.distributed import GROUP_LIMIT, ordered_scan, ordinal_ranks, reuse
from genemill.operators.padjust import adjust_p

# Short names of gene-set libraries.
LIBRARIES = {
    "KEGG": "KEGG_2021_Human",
    "REACTOME": "Reactome_2022",
    "GO_BP": "GO_Biological_Process_2021",
    "GO_MF": "GO_Molecular_Function_2021",
    "GO_CC": "GO_Cellular_Component_2021",
    "HALLMARK": "MSigDB_Hallmark_2020",
    "CURATED": "MSigDB_Curated_2020",
}


def library_name(name: str) -> str:
    return LIBRARIES.get(name, name)


def over_representation(genes: DataFrame, gene_sets: DataFrame, universe: DataFrame) -> DataFrame:
    """Hypergeometric tail per set within a universe of genes; combined = -ln(p) * odds ratio."""
    uni = reuse(universe.select("gene").distinct())
    sets = gene_sets.select("gene_set", "gene").distinct().join(uni, "gene", "left_semi")
    mine = reuse(genes.select("gene").distinct().join(uni, "gene", "left_semi").withColumn("_in", F.lit(1)))
    n_all = uni.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_mine = mine.agg(F.count(F.lit(1)).alias("n")).scalar()
    g = (
        sets.join(mine, "gene", "left")
        .groupBy("gene_set")
        .agg(
            F.count(F.lit(1)).alias("set_size"),
            F.count("_in").alias("overlap"),
            F.concat_ws(";", F.array_sort(F.collect_list(F.when(F.col("_in") == 1, F.col("gene"))))).alias("genes"),
        )
        .filter(F.col("overlap") > 0)
        .withColumn("_n", n_all)
        .withColumn("_d", n_mine)
    )
    k, m, n, d = F.col("overlap"), F.col("set_size"), F.col("_n"), F.col("_d")
    below = (m - k) * (d - k)
    g = g.withColumn("p_value", hypergeom_sf(k, n, m, d)).withColumn(
        "odds_ratio", F.when(below > 0, k * (n - m - d + k) / below).otherwise(F.lit(float("inf")))
    )
    g = g.withColumn("combined_score", -F.log("p_value") * F.col("odds_ratio"))
    return adjust_p(g, "p_value", "fdr_bh", "p_adj").drop("_n", "_d")


def ranked_list(scores: DataFrame) -> DataFrame:
    """Genes by falling score: gene, score, pos (1 = highest)."""
    return ordinal_ranks(
        scores.filter(F.col("score").isNotNull()).select("gene", "score"), [], "score", "gene", "pos", descending=True
    )


def _enrichment(hits: DataFrame, keys, n_genes, weight: float) -> DataFrame:
    """Enrichment score per key from hit positions alone: rows (keys, pos, score)."""
    w = Window.partitionBy(*keys)
    run = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hits.withColumn("_a", F.pow(F.abs("score"), F.lit(weight)))
    h = (
        h.withColumn("_i", F.row_number().over(w.orderBy("pos")))
        .withColumn("_cum", F.sum("_a").over(run))
        .withColumn("_tot", F.sum("_a").over(w))
        .withColumn("_k", F.count(F.lit(1)).over(w))
    )
    miss = (F.col("pos") - F.col("_i")) / F.greatest(n_genes - F.col("_k"), F.lit(1))
    total = F.when(F.col("_tot") > 0, F.col("_tot")).otherwise(F.lit(1.0))
    after = F.col("_cum") / total - miss
    before = (F.col("_cum") - F.col("_a")) / total - miss
    g = h.groupBy(*keys).agg(
        F.max(after).alias("_hi"), F.min(before).alias("_lo"), F.max("_k").alias("set_size"),
        F.max_by("pos", after).alias("_hi_pos"), F.min_by("pos", before).alias("_lo_pos"),
    )
    up = F.col("_hi") >= -F.col("_lo")
    return g.select(
        *keys, "set_size", F.when(up, F.col("_hi")).otherwise(F.col("_lo")).alias("es"),
        F.when(up, F.col("_hi_pos")).otherwise(F.col("_lo_pos")).alias("peak"),
    )


def _sized_hits(ranked: DataFrame, gene_sets: DataFrame, min_size: int, max_size: int) -> DataFrame:
    hits = gene_sets.select("gene_set", "gene").distinct().join(ranked, "gene")
    sizes = hits.groupBy("gene_set").agg(F.count(F.lit(1)).alias("_c"))
    ok = sizes.filter(F.col("_c").between(min_size, max_size))
    return hits.join(ok, "gene_set", "left_semi")


def enrichment_scores(
    scores: DataFrame, gene_sets: DataFrame, min_size: int = 15, max_size: int = 500, weight: float = 1.0
) -> DataFrame:
    """Enrichment score and leading edge of each set of admissible size."""
    ranked = ranked_list(scores)
    n = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    return _scored_sets(_sized_hits(ranked, gene_sets, min_size, max_size), n, weight)


def _scored_sets(hits: DataFrame, n, weight: float) -> DataFrame:
    es = _enrichment(hits, ["gene_set"], n, weight)
    j = hits.join(es, "gene_set")
    edge = F.when(F.col("es") >= 0, F.col("pos") <= F.col("peak")).otherwise(F.col("pos") >= F.col("peak"))
    lead = j.filter(edge).groupBy("gene_set").agg(
        F.concat_ws(";", F.array_sort(F.collect_list("gene"))).alias("leading_edge")
    )
    return es.join(lead, "gene_set", "left")


REPS_AT_ONCE = 25  # permutations of a task
GENES_AT_ONCE = 1_000_000  # genes broadcast, at 24 bytes each
_MEMBERS_AT_ONCE = 1_000_000


def null_scores(
    ranked: DataFrame, hits: DataFrame, n_genes: int, max_size: int, n_perm: int, weight: float, seed: int,
    by_joins: bool | None = None,
) -> DataFrame:
    """(rep, gene_set, es) of every set under `n_perm` permutations of the ranked genes.

    A permutation is the order of a hash of gene, replicate and seed (ties: gene). One Arrow pass takes blocks of
    replicates: a task orders the genes anew for each and scores all sets from prefix sums over their sorted positions, so
    no rows of genes x permutations arise. A set brings at most `max_size` positions. With more than `GENES_AT_ONCE` genes
    the same permutations come from distributed ranks and joins.
    """
    if n_genes > GENES_AT_ONCE if by_joins is None else by_joins:
        return _null_by_joins(ranked, hits, n_genes, n_perm, weight, seed)
    genes = ranked.orderBy("gene").select(
        F.xxhash64("gene").alias("hash"), F.pow(F.abs("score"), F.lit(weight)).alias("size"), "pos"
    ).toArrow()
    place = genes["pos"].to_numpy().astype(np.int64) - 1
    gene_at, size_at = np.empty(n_genes, np.int64), np.empty(n_genes)
    gene_at[place] = np.arange(n_genes)
    size_at[place] = genes["size"].to_numpy()
    shared = ranked.sparkSession.sparkContext.broadcast((genes["hash"].to_numpy(), gene_at, size_at))
    last_block = (n_perm - 1) // REPS_AT_ONCE
    sets = hits.groupBy("gene_set").agg(F.collect_list(F.col("pos").cast("long") - 1).alias("places"))
    work = sets.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last_block)))).repartition(last_block + 1, "block")
    rows = max(1, _MEMBERS_AT_ONCE // max_size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, gene_of, sizes = shared.value
        for batch in batches:
            blocks = batch["block"].to_numpy()
            for block in np.unique(blocks):
                part = batch.filter(pa.array(blocks == block))
                reps = range(block * REPS_AT_ONCE, min(n_perm, (block + 1) * REPS_AT_ONCE))
                for start in range(0, part.num_rows, rows):
                    some = part.slice(start, rows)
                    places = some["places"]
                    member = gene_of[places.flatten().to_numpy()]
                    count = np.diff(places.offsets.to_numpy())
                    for rep in reps:
                        es = _permuted_scores(_new_places(hashes, rep, seed), member, count, sizes)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(es), rep, np.int32)), some["gene_set"], pa.array(es)], ["rep", "gene_set", "es"]
                        )

    kind = hits.schema["gene_set"].dataType.simpleString()
    return work.mapInArrow(score, f"rep int, gene_set {kind}, es double")


def _new_places(hashes: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """Place (from 0) of every gene in the order of Spark's xxhash64(gene, rep, seed) / 2**20."""
    h = hashes.view(np.uint64)
    for number in (rep, seed):
        h = _hash_int(number, h)
    out = np.empty(len(h), np.int64)
    out[np.argsort(h.view(np.int64) / 2.0**20, kind="stable")] = np.arange(len(h))
    return out


# The primes of XXH64.
_P1, _P2, _P3, _P5 = (
    np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
)


def _hash_int(number: int, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of a 32-bit integer for an array of seeds."""
    word = np.full(1, number & 0xFFFFFFFF, np.uint64) * _P1
    h = (seeds + _P5 + np.uint64(4)) ^ word
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    for shift, factor in ((33, _P2), (29, _P3)):
        h = (h ^ (h >> np.uint64(shift))) * factor
    return h ^ (h >> np.uint64(32))


def _permuted_scores(places: np.ndarray, member: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Enrichment score of sets given one after the other (`count` genes each) with genes at `places`."""
    n = len(places)
    start = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    at = np.sort(owner * n + places[member]) - owner * n
    size = sizes[at]
    run = np.cumsum(size)
    run -= np.repeat(run[start] - size[start], count)
    total = np.add.reduceat(size, start)
    total = np.repeat(np.where(total > 0, total, 1.0), count)
    miss = (at - (np.arange(len(at)) - np.repeat(start, count))) / np.repeat(np.maximum(n - count, 1), count)
    high = np.maximum.reduceat(run / total - miss, start)
    low = np.minimum.reduceat((run - size) / total - miss, start)
    return np.where(high >= -low, high, low)


def _null_by_joins(ranked: DataFrame, hits: DataFrame, n_genes: int, n_perm: int, weight: float, seed: int) -> DataFrame:
    reps = ranked.select("gene").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    reps = reps.withColumn("_h", F.xxhash64("gene", "rep", F.lit(seed)) / 2.0**20)
    placed = ordinal_ranks(reps, ["rep"], "_h", "gene", "pos", small=n_genes <= GROUP_LIMIT).select("rep", "gene", "pos")
    moved = hits.select("gene_set", "gene").join(placed, "gene").join(ranked.select("pos", "score"), "pos")
    return _enrichment(moved, ["rep", "gene_set"], F.lit(n_genes), weight).select("rep", "gene_set", "es")


def gsea(
    scores: DataFrame,
    gene_sets: DataFrame,
    min_size: int = 15,
    max_size: int = 500,
    n_perm: int = 1000,
    weight: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """ES, NES, p, FDR and FWER against `n_perm` gene permutations (see `null_scores`)."""
    ranked = reuse(ranked_list(reuse(scores)))
    n_genes = ranked.count()
    hits = reuse(_sized_hits(ranked, gene_sets, min_size, max_size))
    es = _scored_sets(hits, F.lit(n_genes), weight)
    side = lambda c: F.when(F.col(c) >= 0, 1).otherwise(-1)
    null = null_scores(ranked, hits, n_genes, max_size, n_perm, weight, seed)
    null = reuse(null.select("rep", "gene_set", F.col("es").alias("null_es"), side("es").alias("side")))
    scale = null.groupBy("gene_set", "side").agg(
        F.avg(F.abs("null_es")).alias("_mean"), F.count(F.lit(1)).alias("_nn")
    )
    obs = es.withColumn("side", side("es")).join(scale, ["gene_set", "side"], "left")
    obs = obs.withColumn("nes", F.when(F.col("_mean") > 0, F.col("es") / F.col("_mean")))
    beyond = null.join(obs.select("gene_set", "side", "es"), ["gene_set", "side"]).groupBy("gene_set").agg(
        F.count_if(F.abs("null_es") >= F.abs("es")).alias("_b")
    )
    obs = reuse(
        obs.join(beyond, "gene_set", "left").withColumn(
            "p_value", F.coalesce(F.col("_b") / F.col("_nn"), F.lit(1.0))
        )
    )
    null_nes = null.join(scale, ["gene_set", "side"]).select(
        "rep", "side", (F.abs("null_es") / F.col("_mean")).alias("mag")
    )
    top = null_nes.groupBy("rep", "side").agg(F.max("mag").alias("mag"))
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    pool = (
        null_nes.select("side", "mag", one.alias("a"), zero.alias("o"), zero.alias("f"))
        .unionByName(top.select("side", "mag", zero.alias("a"), zero.alias("o"), one.alias("f")))
        .unionByName(
            obs.filter(F.col("nes").isNotNull()).select(
                "side", F.abs("nes").alias("mag"), zero.alias("a"), one.alias("o"), zero.alias("f")
            )
        )
    )
    table = pool.groupBy("side", "mag").agg(F.sum("a").alias("a"), F.sum("o").alias("o"), F.sum("f").alias("f"))
    table = ordered_scan(
        table, ["side"], "mag",
        {"na": ("sum", "a", "desc"), "no": ("sum", "o", "desc"), "nf": ("sum", "f", "desc")},
    )
    totals = table.groupBy("side").agg(F.sum("a").alias("ta"), F.sum("o").alias("to"))
    table = table.filter(F.col("o") > 0).join(totals, "side").select(
        "side", "mag",
        F.least(F.lit(1.0), (F.col("na") / F.col("ta")) / (F.col("no") / F.col("to"))).alias("fdr"),
        (F.col("nf") / n_perm).alias("fwer"),
    )
    out = obs.withColumn("mag", F.abs("nes")).join(table, ["side", "mag"], "left")
    return out.select("gene_set", "set_size", "es", "nes", "p_value", "fdr", "fwer", "leading_edge")


def significant_pathways(gsea_rows: DataFrame, ora_rows: DataFrame, p_max: float = 0.05) -> DataFrame:
    """Union of both analyses below the limit, sorted."""
    a = gsea_rows.select("gene_set", F.lit("gsea").alias("method"), F.col("fdr").alias("q"))
    b = ora_rows.select("gene_set", F.lit("ora").alias("method"), F.col("p_adj").alias("q"))
    return a.unionByName(b).filter(F.col("q") < p_max).orderBy("q", "gene_set", "method")


def pathway_summary(rows: DataFrame, library: str, q: str, p_max: float = 0.05) -> DataFrame:
    """Pathways and significant pathways per library."""
    return rows.groupBy(F.col(library).alias("library")).agg(
        F.count(F.lit(1)).alias("n_pathways"), F.count_if(F.col(q) < p_max).alias("n_significant")
    )


def pathway_run(genes: DataFrame, scores: DataFrame, gene_sets: DataFrame, method: str = "both", **o) -> DataFrame:
    """ORA, GSEA or both, stacked with the method name."""
    parts = []
    if method in ("ora", "both"):
        ora = over_representation(genes, gene_sets, scores.select("gene"))
        parts.append(ora.select("gene_set", F.lit("ora").alias("method"), F.col("odds_ratio").alias("score"), "p_value", F.col("p_adj").alias("q")))
    if method in ("gsea", "both"):
        g = gsea(scores, gene_sets, **o)
        parts.append(g.select("gene_set", F.lit("gsea").alias("method"), F.col("nes").alias("score"), "p_value", F.col("fdr").alias("q")))
    if not parts:
        raise ValueError("method must be ora, gsea or both")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
