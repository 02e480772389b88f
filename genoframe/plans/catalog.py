"""Every registered query. Thresholds are those of the driver's tables, where a genome's would drop all or nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions import scalar
from genoframe.operators import agreement, arcs, cluster, correct, duplicates, genome, hmm, intervals, lift, normalise, ploidy, qc, segment
from genoframe.params import Params
from genoframe.plans import pipeline
from genoframe.plans.oracles import BINS, ORACLES  # noqa: F401
from genoframe.session import Scratch
from genoframe.sources import tables

P = replace(Params(), bin_size=tables.BIN, mapq=0, min_mean=0.5, gini=0.16, gc_low=45.0, gc_high=55.0, min_mappability=0.955, ward_first=3.0, ward_second=2.0)
six = lambda c: F.round(c, 6).alias(c)


def once(make: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    """A step that several others read: it is written once, so no plan computes it again."""

    def saved(self: Data) -> DataFrame:
        if make.__name__ not in self.made:
            self.made[make.__name__] = self.scratch.save(make(self))
        return self.made[make.__name__]

    return saved


class Data:
    """The tables of a folder, seen by the pipeline."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.scratch, self.made = spark, sf_dir, Scratch(spark), {}
        self.reads, self.bins, self.mask = tables.reads(spark, sf_dir), tables.bins(spark, sf_dir), tables.mask(spark, sf_dir)

    @once
    def counts(self) -> DataFrame:
        return intervals.dense_counts(intervals.overlap_counts(self.reads, self.bins, tables.BIN), self.reads, self.bins)

    @once
    def norm(self) -> DataFrame:
        return correct.plus_one(self.counts())

    def labels(self) -> DataFrame:
        """A fixed clustering that SQL knows too."""
        return self.reads.select("cell").distinct().withColumn("cluster", (F.col("cell") % 4).cast("int"))

    @once
    def profile(self) -> DataFrame:
        return segment.mean_profile(self.norm(), self.labels()).withColumn("pos", F.col("bin_id"))

    @once
    def diffs(self) -> DataFrame:
        return segment.neighbour_difference(self.profile())

    def islands(self) -> DataFrame:
        d = self.diffs()
        return segment.islands(d, segment.cutoffs(d))

    def bounds(self) -> DataFrame:
        return segment.boundaries(self.islands(), self.profile())

    @once
    def segments(self) -> DataFrame:
        return segment.segments(self.bounds())

    @once
    def values(self) -> DataFrame:
        places = segment.placed(self.profile(), self.segments())
        norm = self.norm().withColumn("pos", F.col("bin_id")).join(self.labels(), "cell")
        return norm.join(places, ["cluster", "pos"]).select("cluster", "cell", "bin_id", "pos", "seg_id", scalar.ninth(F.col("y")).alias("y"))

    def residuals(self) -> DataFrame:
        return ploidy.residuals(self.profile())

    def by_cell(self) -> DataFrame:
        return self.labels().join(ploidy.estimate(self.residuals()), "cluster").select("cell", "ploidy")

    def calls(self) -> DataFrame:
        values = self.values()
        return ploidy.call_matrix(ploidy.calls(values, self.by_cell()), values.select("cluster", "seg_id", "pos").distinct())

    def sizes(self) -> DataFrame:
        """A chromosome for each line number, as long as its last day."""
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long") + F.col("l_quantity").cast("long")
        return tables.read(self.spark, self.dir, "lineitem").groupBy(F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chrom")).agg(F.max(day).alias("length"))

    def intervals(self) -> DataFrame:
        """Spans of all orders as intervals, each customer being a sequence of its own."""
        day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
        return tables.read(self.spark, self.dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("chrom"), day.alias("start"), (day + F.col("o_orderkey") % 7 + 1).alias("end"))


def named(df: DataFrame) -> DataFrame:
    """start and end under names that SQL does not reserve."""
    return df.withColumnsRenamed({"start": "bin_start", "end": "bin_end"})


def _q(make: Callable[[Data], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Data(spark, sf_dir))


def _labels(d: Data) -> DataFrame:
    b = genome.bins(d.sizes(), tables.BIN).select("bin_id", scalar.bin_label(F.col("chrom"), F.col("start"), F.col("end")).alias("label"))
    chrom, start, end = scalar.parse_label(F.col("label"))
    return b.select("bin_id", "label", chrom.alias("chrom"), start.alias("bin_start"), end.alias("bin_end"))


def _pseudo(d: Data, arithmetic: bool) -> DataFrame:
    counts = d.counts()
    used = counts if arithmetic else counts.join(F.broadcast(qc.full_bins(counts)), "bin_id", "left_semi")
    return qc.pseudo_sample(used, arithmetic).select("bin_id", six("pseudo"))


def _fingerprints(d: Data) -> DataFrame:
    norm = d.norm()
    return cluster.fingerprints(norm, cluster.fingerprint_bins(norm))


def _normal(d: Data) -> DataFrame:
    return correct.normal_cells(d.counts(), d.bins, P.gini)


def _paste(d: Data) -> DataFrame:
    """Counts of returned and of other lines side by side, on the keys of bins."""
    one, two = (intervals.overlap_counts(d.reads.where(w), d.bins, tables.BIN).groupBy("bin_id").agg(F.sum("n").alias(n)) for w, n in (("flag >= 1024", "n_returned"), ("flag < 1024", "n_other")))
    return one.join(two, "bin_id", "full")


def _histogram(d: Data) -> DataFrame:
    std = correct.spread_split(d.norm())
    return std.groupBy(F.floor(F.round(F.col("std") / 0.01, 6)).cast("int").alias("bucket")).agg(F.count("*").alias("cells"))


def _genotypes(d: Data) -> DataFrame:
    """Phased heterozygous sites: orders as sites, their status and priority as a genotype."""
    o = tables.read(d.spark, d.dir, "orders").select(F.concat(F.lit("chr"), (F.col("o_custkey") % 25).cast("string")).alias("chrom"), F.col("o_orderkey").alias("pos"), F.concat(F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"), F.lit("|"), F.when(F.col("o_orderpriority") < "3", "1").otherwise("0")).alias("gt"))
    return o.where(F.col("chrom").isin([f"chr{i}" for i in range(1, 23)]) & F.col("gt").isin("1|0", "0|1"))


def _pivot(d: Data) -> DataFrame:
    wide = d.calls().groupBy("cell").pivot("pos", list(range(BINS))).agg(F.first("cn"))
    return wide.select("cell", *[F.col(str(i)).alias(f"b{i}") for i in range(BINS)])


def _transposed(d: Data) -> DataFrame:
    by_cluster = d.calls().join(d.labels(), "cell").groupBy("pos").pivot("cluster", [0, 1, 2, 3]).agg(F.sum("cn"))
    return by_cluster.select("pos", *[F.col(str(i)).alias(f"c{i}") for i in range(4)])


def _pca(d: Data) -> DataFrame:
    return correct.informative_bins(correct.first_loadings(d.counts()))


def _ward(d: Data) -> DataFrame:
    return cluster.ward_labels(_fingerprints(d), P.ward_first, P.ward_second, max_cells=P.max_cells)


def _profiles(d: Data) -> DataFrame:
    """Normalised values with their chromosomes, as sequences for segmentation."""
    return d.norm().join(d.bins.select("bin_id", "chrom"), "bin_id").select("cell", "chrom", "bin_id", F.col("y").alias("value"))


def _hmm(d: Data) -> DataFrame:
    rows = d.scratch.save(hmm.sequences(_profiles(d)))
    return hmm.segments(hmm.decode(rows, hmm.fit(rows, hmm.Start((0.6, 1.0, 1.4), 0.3, 0.95), d.scratch)))


def _arcs(d: Data) -> DataFrame:
    profiles = _profiles(d)
    return arcs.segment_means(profiles, d.scratch.save(arcs.shared_segments(profiles)))


def _agreement(d: Data) -> DataFrame:
    nodes = d.labels().join(tables.cell_nodes(d.spark, d.dir), "cell", "left")
    return agreement.adjusted_rand(nodes, "cluster", "node").select("cells", six("rand"), six("adjusted_rand"))


def _by_depth(d: Data) -> DataFrame:
    return normalise.depth_corrected(d.counts(), d.bins, d.scratch).select("cell", "bin_id", six("by_gc"), six("by_mapp"), six("copy"))


def _poisson(d: Data) -> DataFrame:
    counts = d.counts()
    cells, effects, _ = normalise.poisson_fit(counts, d.bins, d.scratch, d.scratch.save(_normal(d)))
    return normalise.poisson_normalised(counts, cells, effects).select("cell", "bin_id", six("mean"), six("ratio"))


def _lifted(d: Data) -> DataFrame:
    """All lines in an axis without the days of most orders; a chain is eight runs of the days left, odd ones turned."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    lines = tables.read(d.spark, d.dir, "lineitem").select(line.cast("long").alias("id"), F.lit("chr1").alias("chrom"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))
    out = lift.lifted(lines, tables.calm_blocks(d.spark, d.dir), 0.75)
    none = {"to_chrom": F.lit(""), "to_start": F.lit(-1).cast("long"), "to_end": F.lit(-1).cast("long"), "flip": F.lit(False)}
    return out.select("id", "status", *[F.coalesce(c, v).alias(c) for c, v in none.items()], six("share"))


def _copies(d: Data) -> DataFrame:
    marks = duplicates.marked(tables.fragments(d.spark, d.dir))
    return marks.select("cell", "name", "mate", "duplicate")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bin_genome": _q(lambda d: named(genome.bins(d.sizes(), tables.BIN).select("chrom", "start", "end"))),
    "bin_running_id": _q(lambda d: genome.bins(d.sizes(), tables.BIN).select("bin_id", "chrom", scalar.bin_label(F.col("chrom"), F.col("start"), F.col("end")).alias("label"))),
    "bin_label_parse": _q(_labels),
    "chromosome_whitelist": _q(lambda d: genome.autosomes(d.sizes(), "hg38")),
    "read_filter": _q(lambda d: named(intervals.keep_reads(d.reads, 10, 65, 1540))),
    "mask_anti_join": _q(lambda d: named(intervals.drop_masked(d.reads, d.mask).select("cell", "start", "end", "mapq"))),
    "overlap_count": _q(lambda d: intervals.overlap_counts(d.reads, d.bins, tables.BIN)),
    "dense_counts": _q(lambda d: d.counts()),
    "sample_qc_metrics": _q(lambda d: qc.sample_metrics(d.reads).select("cell", six("readlength"), "total", "mapped", "non_dup", "mapq20", six("mapped_prop"), six("non_dup_prop"), six("mapq20_prop"))),
    "sample_filter": _q(lambda d: qc.kept_cells(d.counts(), qc.sample_metrics(d.reads), 0, 12, 0.3)),
    "bin_gc_filter": _q(lambda d: qc.kept_bins(d.bins, P.gc_low, P.gc_high, 0.0).select("bin_id", "gc")),
    "bin_mapp_filter": _q(lambda d: qc.kept_bins(d.bins, 0.0, 100.0, P.min_mappability).select("bin_id", "mapp")),
    "all_nonzero_bins": _q(lambda d: qc.full_bins(d.counts())),
    "geometric_pseudo_sample": _q(lambda d: _pseudo(d, False)),
    "arithmetic_pseudo_sample": _q(lambda d: _pseudo(d, True)),
    "size_factor": _q(lambda d: qc.size_factors(d.counts()).select("cell", six("factor"))),
    "bin_sum_mad_filter": _q(lambda d: qc.mad_bins(d.counts(), d.scratch.save(qc.size_factors(d.counts()))).select("bin_id", six("total"))),
    "lorenz_curve": _q(lambda d: correct.lorenz(d.counts(), "cell", "n").select("cell", "rank", six("share"))),
    "gini_by_cell": _q(lambda d: correct.gini(d.counts()).select("cell", six("gini"))),
    "normal_cells": _q(_normal),
    "bias_vector": _q(lambda d: correct.bias(d.counts(), _normal(d)).select("bin_id", six("bias"))),
    "bias_corrected": _q(lambda d: correct.corrected(d.counts(), correct.bias(d.counts(), _normal(d))).select("cell", "bin_id", six("value"))),
    "plus_one_norm": _q(lambda d: d.norm().select("cell", "bin_id", six("y"))),
    "cell_std_split": _q(lambda d: correct.spread_split(d.norm()).select("cell", six("std"), "is_normal")),
    "fingerprint_bins": _q(lambda d: cluster.fingerprint_bins(d.norm()).select("bin_id", six("spread"))),
    "fingerprint_norm": _q(lambda d: _fingerprints(d).withColumn("f", scalar.ninth(F.col("f"))).select("cell", "bin_id", six("f"))),
    "label_frequency": _q(lambda d: cluster.label_counts(d.labels())),
    "cluster_mean_profile": _q(lambda d: d.profile().select("cluster", "bin_id", six("v"))),
    "global_median_profile": _q(lambda d: segment.median_profile(d.norm()).select("bin_id", six("v"))),
    "nbdiff": _q(lambda d: d.diffs().select("cluster", "pos", six("diff"))),
    "lag_difference": _q(lambda d: segment.lag_difference(d.profile()).select("cluster", "pos", six("d"))),
    "change_cutoff_q": _q(lambda d: segment.cutoffs(d.diffs())),
    "change_cutoff_h": _q(lambda d: d.diffs().join(segment.cutoffs(d.diffs(), "h", fixed=0.05), "cluster").where("diff >= cutoff").select("cluster", "pos", "cutoff")),
    "islands": _q(lambda d: d.islands()),
    "boundaries": _q(lambda d: d.bounds()),
    "segments": _q(lambda d: d.segments()),
    "segment_median": _q(lambda d: ploidy.cell_medians(d.values()).select("cluster", "cell", "seg_id", six("middle"))),
    "block_median": _q(lambda d: ploidy.block_medians(d.values()).select("cluster", "seg_id", six("block"))),
    "block_smooth": _q(lambda d: ploidy.smoothed(d.values()).select("cell", "bin_id", six("y"))),
    "ploidy_residuals": _q(lambda d: d.residuals().select("cluster", "p", six("rs"))),
    "ploidy_local_minima": _q(lambda d: ploidy.local_minima(d.residuals()).select("cluster", "p", six("rs"))),
    "ploidy_estimate": _q(lambda d: ploidy.estimate(d.residuals())),
    "integer_cnv": _q(lambda d: d.calls()),
    "breakpoints": _q(lambda d: segment.breakpoints(d.calls(), "cell", "cn")),
    "cell_node_names": _q(lambda d: d.reads.select("cell").distinct().join(tables.cell_nodes(d.spark, d.dir), "cell", "left").select("cell", scalar.node_name(F.col("node"), F.col("cell").cast("string")).alias("name"))),
    "pivot_cnv": _q(_pivot),
    "transpose_cnv": _q(_transposed),
    "quantile_blacklist": _q(lambda d: intervals.extreme_bins(d.counts().groupBy("bin_id").agg(F.sum("n").alias("n")))),
    "interval_merge": _q(lambda d: named(intervals.merged(d.intervals()))),
    "snap_coordinates": _q(lambda d: d.intervals().select("chrom", (scalar.snapped(F.col("start"), 30) + 1).alias("bin_start"), scalar.snapped(F.col("end"), 30).alias("bin_end"))),
    "paste_join": _q(_paste),
    "std_histogram": _q(_histogram),
    "phased_genotype_filter": _q(_genotypes),
    "pca_loading": _q(_pca),
    "ward_clusters": _q(_ward),
    "hmm_segments": _q(_hmm),
    "shared_arc_segments": _q(_arcs),
    "label_agreement": _q(_agreement),
    "depth_corrected": _q(_by_depth),
    "poisson_normalised": _q(_poisson),
    "lifted_intervals": _q(_lifted),
    "duplicate_reads": _q(_copies),
    "fallback_split": _q(lambda d: pipeline.split_by_ploidy(d.norm(), P)),
    "pipeline_end_to_end": _q(lambda d: pipeline.call_copy_numbers(d.reads, d.bins, P, d.mask)),
}
