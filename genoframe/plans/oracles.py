"""DuckDB equivalents: one chain of common table expressions, of which each query selects what it needs."""

from __future__ import annotations

BINS = 84
DAY = "date_diff('day', DATE '1995-01-01', {}::DATE)"
L, O = DAY.format("l_shipdate"), DAY.format("o_orderdate")

CHAIN = f"""WITH
reads AS (SELECT l_suppkey AS cell, 'chr1' AS chrom, {L} AS s, {L} + l_quantity::BIGINT AS e, l_quantity::INT AS mapq,
  (CASE WHEN l_linenumber % 2 = 1 THEN 65 ELSE 129 END + CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END)::INT AS flag, l_quantity::INT AS query_length FROM lineitem),
sizes AS (SELECT 'chr' || l_linenumber AS chrom, l_linenumber AS k, max({L} + l_quantity::BIGINT) AS length FROM lineitem GROUP BY ALL),
gbins AS (SELECT (row_number() OVER (ORDER BY k, i) - 1)::INT AS bin_id, chrom, i * 30 + 1 AS s, least((i + 1) * 30, length) AS e
  FROM (SELECT *, unnest(range(0, (length + 29) // 30)) AS i FROM sizes)),
facts AS (SELECT (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // 30)::INT AS bin_id, round(avg(l_discount) * 1000, 6) AS gc, round(1 - avg(l_tax), 6) AS mapp FROM lineitem GROUP BY ALL),
bins AS (SELECT i::INT AS bin_id, i * 30 + 1 AS s, (i + 1) * 30 AS e, gc, mapp FROM range({BINS}) AS r(i) LEFT JOIN facts ON facts.bin_id = i),
days AS (SELECT {O} AS s, count(*) AS n FROM orders GROUP BY ALL),
mask AS (SELECT s, s + 3 AS e FROM days WHERE n >= (SELECT round(quantile_cont(n, 0.98), 9) FROM days)),
oc AS MATERIALIZED (SELECT cell, bin_id, count(*) AS n FROM reads JOIN bins ON reads.s < bins.e AND reads.e > bins.s GROUP BY ALL),
cells AS (SELECT DISTINCT cell FROM reads),
counts AS MATERIALIZED (SELECT cell, bin_id, coalesce(n, 0)::BIGINT AS n FROM cells CROSS JOIN bins LEFT JOIN oc USING (cell, bin_id)),
qc AS (SELECT cell, avg(query_length) AS readlength, count(*)::DOUBLE AS total, count(chrom)::DOUBLE AS mapped, count(*) FILTER (WHERE flag & 1024 = 0)::DOUBLE AS non_dup,
  count(*) FILTER (WHERE mapq >= 20)::DOUBLE AS mapq20 FROM reads GROUP BY cell),
fullb AS (SELECT bin_id FROM counts GROUP BY bin_id HAVING min(n) > 0),
geo AS (SELECT bin_id, exp(avg(ln(n))) AS pseudo FROM counts JOIN fullb USING (bin_id) GROUP BY bin_id),
ari AS (SELECT bin_id, avg(n) AS pseudo FROM counts GROUP BY bin_id),
pseudo AS (SELECT * FROM geo WHERE (SELECT count(*) FROM fullb) > 10 UNION ALL SELECT * FROM ari WHERE (SELECT count(*) FROM fullb) <= 10),
factors AS (SELECT cell, median(n / nullif(pseudo, 0)) AS factor FROM counts JOIN pseudo USING (bin_id) GROUP BY cell),
sums AS (SELECT bin_id, round(sum(n / factor), 9) AS total FROM counts JOIN factors USING (cell) WHERE factor > 0 GROUP BY bin_id),
mids AS (SELECT *, abs(total - (SELECT median(total) FROM sums)) AS d FROM sums),
ranked AS (SELECT cell, n::DOUBLE AS y, row_number() OVER (PARTITION BY cell ORDER BY n, bin_id) AS i FROM counts),
gini AS (SELECT cell, 2 * round_even(round((2 * sum(i * y) - (count(*) + 1) * sum(y)) / nullif(2 * count(*) * sum(y), 0), 9), 4) AS gini FROM ranked GROUP BY cell),
normal AS (SELECT cell FROM gini WHERE gini < 0.16),
nmed AS (SELECT cell, median(n) AS m FROM counts JOIN normal USING (cell) GROUP BY cell),
bias0 AS (SELECT bin_id, round(avg(n / nullif(m, 0)), 9) AS b FROM counts JOIN nmed USING (cell) GROUP BY bin_id),
bias AS (SELECT bin_id, CASE WHEN coalesce(b, 0) = 0 THEN 1 ELSE b END AS bias FROM bias0),
y AS MATERIALIZED (SELECT cell, bin_id, (n + 1) / avg(n + 1) OVER (PARTITION BY cell) AS y FROM counts),
std AS (SELECT cell, round(stddev_pop(y), 9) AS std FROM y GROUP BY cell),
spread AS (SELECT bin_id, round(max(y) - min(y), 9) AS spread FROM y GROUP BY bin_id),
fp AS (SELECT * FROM spread WHERE spread >= (SELECT round(quantile_cont(spread, 0.9), 9) FROM spread)),
prof AS MATERIALIZED (SELECT (cell % 4)::INT AS cluster, bin_id, bin_id AS pos, round(avg(y), 9) AS v FROM y GROUP BY ALL),
nb AS MATERIALIZED (SELECT cluster, pos, v, CASE WHEN wat < 6 OR wat >= n - 6 THEN 0 ELSE round(abs(a - b), 9) END AS diff FROM (
  SELECT *, row_number() OVER w - 1 AS wat, count(*) OVER (PARTITION BY cluster) AS n,
    median(v) OVER (PARTITION BY cluster ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS a,
    median(v) OVER (PARTITION BY cluster ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS b FROM prof WINDOW w AS (PARTITION BY cluster ORDER BY pos))),
cq AS (SELECT cluster, round_even(round(quantile_cont(diff, 0.84), 9), 2) AS cutoff FROM nb GROUP BY cluster),
isl AS (SELECT cluster, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM (
  SELECT cluster, pos, pos - row_number() OVER (PARTITION BY cluster ORDER BY pos) AS run FROM nb JOIN cq USING (cluster) WHERE diff >= cutoff) GROUP BY cluster, run HAVING count(*) >= 4),
bnd AS (SELECT cluster, round_even((lo + hi) / 2, 0)::INT AS boundary FROM isl UNION SELECT cluster, count(*)::INT FROM prof GROUP BY cluster),
seg0 AS (SELECT cluster, (row_number() OVER w - 1)::INT AS seg_id, coalesce(lag(boundary) OVER w, 0) AS from_bin, boundary AS to_bin FROM bnd WINDOW w AS (PARTITION BY cluster ORDER BY boundary)),
seg AS (SELECT * FROM seg0 WHERE to_bin > from_bin),
vals AS MATERIALIZED (SELECT cluster, cell, bin_id, bin_id AS pos, seg_id, round(y, 9) AS y FROM y JOIN seg ON cluster = cell % 4 AND bin_id >= from_bin AND bin_id < to_bin),
blk AS (SELECT cluster, seg_id, median(y) AS block FROM vals GROUP BY ALL),
cm AS (SELECT cluster, cell, seg_id, median(y) AS middle FROM vals GROUP BY ALL),
grid AS (SELECT round(1.15::DOUBLE + 0.05::DOUBLE * k, 2) AS p FROM range(87) AS g(k)),
rs AS (SELECT cluster, p, round(sum(abs(v * p - round_even(round(v * p, 9), 0))), 9) AS rs FROM prof CROSS JOIN grid GROUP BY ALL),
lm AS (SELECT cluster, p, rs FROM (SELECT *, lag(rs) OVER w AS l, lead(rs) OVER w AS r FROM rs WINDOW w AS (PARTITION BY cluster ORDER BY p)) WHERE rs < l AND rs < r),
pl AS (SELECT cluster, coalesce(b.p, a.p) AS ploidy FROM (SELECT cluster, arg_min(p, (rs, p)) AS p FROM rs GROUP BY cluster) a LEFT JOIN (SELECT cluster, arg_min(p, (rs, p)) AS p FROM lm GROUP BY cluster) b USING (cluster)),
call AS (SELECT cluster, cell, seg_id, round_even(round(ploidy * ((middle + block) / 2), 9), 0)::INT AS cn FROM cm JOIN blk USING (cluster, seg_id) JOIN pl USING (cluster)),
cnv AS (SELECT vals.cell, pos, cn FROM vals JOIN call ON call.cell = vals.cell AND call.seg_id = vals.seg_id),
ivs AS (SELECT 'c' || o_custkey AS chrom, {O} AS s, {O} + o_orderkey % 7 + 1 AS e FROM orders),
fresh AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)::INT AS f FROM ivs),
marked AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM fresh),
bsum AS (SELECT bin_id, sum(n)::BIGINT AS n FROM counts GROUP BY bin_id),
frag_reads AS (SELECT (l_orderkey % 100)::INT AS cell, l_orderkey || ':' || (l_linenumber - 1) // 2 AS name, ((l_linenumber - 1) % 2)::INT AS mate, floor({L} / 90)::BIGINT * 90 || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS e, l_quantity::INT AS score FROM lineitem),
frags AS (SELECT cell, name, list_sort(list(e)) AS ends, count(*) AS n, sum(score) AS score FROM frag_reads GROUP BY cell, name),
frag_ends AS (SELECT DISTINCT cell, n, unnest(ends) AS e FROM frags),
geno AS (SELECT 'chr' || (o_custkey % 25) AS chrom, o_orderkey AS pos, (CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END) || '|' || (CASE WHEN o_orderpriority < '3' THEN '1' ELSE '0' END) AS gt FROM orders)
"""

#: Counts over their bias with nothing shared: bins by arithmetic, the bias as a window over all cells of a bin.
CORRECTED = f"""WITH spans AS (SELECT l_suppkey AS cell, {L} AS s, {L} + l_quantity::BIGINT AS e FROM lineitem),
hits AS (SELECT cell, unnest(range(greatest(0, s // 30), least({BINS - 1}, (e - 2) // 30) + 1))::INT AS bin_id FROM spans WHERE e >= 2),
sums AS (SELECT cell, bin_id, count(*) AS n FROM hits GROUP BY ALL),
grid AS (SELECT cell, bin_id::INT AS bin_id FROM (SELECT DISTINCT cell FROM spans), range({BINS}) AS r(bin_id)),
dense AS (SELECT cell, bin_id, coalesce(n, 0) AS n FROM grid LEFT JOIN sums USING (cell, bin_id)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n, bin_id) AS i, median(n) OVER (PARTITION BY cell) AS m FROM dense),
even AS (SELECT *, 2 * round_even(round((2 * sum(i * n::DOUBLE) OVER w - (count(*) OVER w + 1) * sum(n) OVER w) / nullif(2 * count(*) OVER w * sum(n) OVER w, 0), 9), 4) < 0.16 AS normal FROM ranks WINDOW w AS (PARTITION BY cell)),
level AS (SELECT cell, bin_id, n, round(avg(CASE WHEN normal THEN n / nullif(m, 0) END) OVER (PARTITION BY bin_id), 9) AS b, count(*) FILTER (normal) OVER (PARTITION BY bin_id) AS cells FROM even)
SELECT cell, bin_id, round(n / CASE WHEN coalesce(b, 0) = 0 THEN 1 ELSE b END, 6) AS value FROM level WHERE cells > 0"""

#: Cells with both labels: their number's remainder and their nation.
NODES = "(SELECT cell % 4 AS a, n_name AS b FROM cells JOIN supplier ON s_suppkey = cell JOIN nation ON n_nationkey = s_nationkey)"

SELECTS = {
    "bin_genome": "SELECT chrom, s AS bin_start, e AS bin_end FROM gbins",
    "bin_running_id": "SELECT bin_id, chrom, chrom || ':' || s || '-' || e AS label FROM gbins",
    "bin_label_parse": "SELECT bin_id, chrom || ':' || s || '-' || e AS label, chrom, s AS bin_start, e AS bin_end FROM gbins",
    "chromosome_whitelist": "SELECT chrom, length FROM sizes WHERE k BETWEEN 1 AND 22",
    "read_filter": "SELECT cell, chrom, s AS bin_start, e AS bin_end, mapq, flag, query_length FROM reads WHERE mapq >= 10 AND flag & 65 = 65 AND flag & 1540 = 0",
    "mask_anti_join": "SELECT cell, s AS bin_start, e AS bin_end, mapq FROM reads WHERE NOT EXISTS (SELECT 1 FROM mask WHERE reads.s < mask.e AND reads.e > mask.s)",
    "overlap_count": "SELECT * FROM oc",
    "dense_counts": "SELECT * FROM counts",
    "sample_qc_metrics": "SELECT cell, round(readlength, 6) AS readlength, total, mapped, non_dup, mapq20, round(mapped / total, 6) AS mapped_prop, round(non_dup / total, 6) AS non_dup_prop, round(mapq20 / total, 6) AS mapq20_prop FROM qc",
    "sample_filter": "SELECT cell FROM counts JOIN qc USING (cell) GROUP BY cell, mapped, total HAVING sum(n) > 0 AND round(avg(n), 9) > 12 AND mapped / total >= 0.3",
    "bin_gc_filter": "SELECT bin_id, gc FROM bins WHERE gc BETWEEN 45 AND 55 AND mapp >= 0",
    "bin_mapp_filter": "SELECT bin_id, mapp FROM bins WHERE gc BETWEEN 0 AND 100 AND mapp >= 0.955",
    "all_nonzero_bins": "SELECT * FROM fullb",
    "geometric_pseudo_sample": "SELECT bin_id, round(pseudo, 6) AS pseudo FROM geo",
    "arithmetic_pseudo_sample": "SELECT bin_id, round(pseudo, 6) AS pseudo FROM ari",
    "size_factor": "SELECT cell, round(factor, 6) AS factor FROM factors",
    "bin_sum_mad_filter": "SELECT bin_id, round(total, 6) AS total FROM mids WHERE round(d, 9) <= (SELECT round(median(d) * 1.4826 * 3, 9) FROM mids)",
    "lorenz_curve": "SELECT cell, count(*) OVER w AS rank, round(sum(n) OVER w::DOUBLE / nullif(sum(n) OVER (PARTITION BY cell), 0), 6) AS share FROM counts WINDOW w AS (PARTITION BY cell ORDER BY n, bin_id ROWS UNBOUNDED PRECEDING)",
    "gini_by_cell": "SELECT cell, round(gini, 6) AS gini FROM gini",
    "normal_cells": "SELECT cell FROM normal",
    "bias_vector": "SELECT bin_id, round(bias, 6) AS bias FROM bias",
    "plus_one_norm": "SELECT cell, bin_id, round(y, 6) AS y FROM y",
    "cell_std_split": "SELECT cell, round(std, 6) AS std, std <= 0.25 AS is_normal FROM std",
    "fingerprint_bins": "SELECT bin_id, round(spread, 6) AS spread FROM fp",
    "fingerprint_norm": "SELECT cell, bin_id, round(round(y / avg(y) OVER (PARTITION BY cell), 9), 6) AS f FROM y JOIN fp USING (bin_id)",
    "label_frequency": "SELECT (cell % 4)::INT AS cluster, count(*) AS cells FROM cells GROUP BY ALL",
    "cluster_mean_profile": "SELECT cluster, bin_id, round(v, 6) AS v FROM prof",
    "global_median_profile": "SELECT bin_id, round(median(y), 6) AS v FROM y GROUP BY bin_id",
    "nbdiff": "SELECT cluster, pos, round(diff, 6)::DOUBLE AS diff FROM nb",
    "lag_difference": "SELECT * FROM (SELECT cluster, pos, round(round(v - lag(v, 6) OVER (PARTITION BY cluster ORDER BY pos), 9), 6) AS d FROM prof) WHERE d IS NOT NULL",
    "change_cutoff_q": "SELECT * FROM cq",
    "change_cutoff_h": "SELECT cluster, pos, 0.05::DOUBLE AS cutoff FROM nb WHERE diff >= 0.05",
    "islands": "SELECT * FROM isl",
    "boundaries": "SELECT * FROM bnd",
    "segments": "SELECT * FROM seg",
    "segment_median": "SELECT cluster, cell, seg_id, round(middle, 6) AS middle FROM cm",
    "block_median": "SELECT cluster, seg_id, round(block, 6) AS block FROM blk",
    "block_smooth": "SELECT cell, bin_id, round(block + (y - block) / 2, 6) AS y FROM vals JOIN blk USING (cluster, seg_id)",
    "ploidy_residuals": "SELECT cluster, p, round(rs, 6) AS rs FROM rs",
    "ploidy_local_minima": "SELECT cluster, p, round(rs, 6) AS rs FROM lm",
    "ploidy_estimate": "SELECT * FROM pl",
    "integer_cnv": "SELECT * FROM cnv",
    "breakpoints": "SELECT cell, pos + 0.5::DOUBLE AS breakpoint FROM (SELECT *, lead(cn) OVER (PARTITION BY cell ORDER BY pos) AS nxt FROM cnv) WHERE nxt <> cn",
    "cell_node_names": "SELECT cell, coalesce(n_name || '_' || cell, cell::VARCHAR) AS name FROM cells LEFT JOIN supplier ON s_suppkey = cell LEFT JOIN nation ON n_nationkey = s_nationkey",
    "pivot_cnv": "SELECT cell, " + ", ".join(f"max(cn) FILTER (WHERE pos = {i}) AS b{i}" for i in range(BINS)) + " FROM cnv GROUP BY cell",
    "transpose_cnv": "SELECT pos, " + ", ".join(f"(sum(cn) FILTER (WHERE cell % 4 = {i}))::BIGINT AS c{i}" for i in range(4)) + " FROM cnv GROUP BY pos",
    "quantile_blacklist": "SELECT * FROM bsum WHERE n <= (SELECT round(quantile_cont(n, 0.05), 9) FROM bsum) OR n >= (SELECT round(quantile_cont(n, 0.999), 9) FROM bsum)",
    "interval_merge": "SELECT chrom, min(s) AS bin_start, max(e) AS bin_end FROM marked GROUP BY chrom, island",
    "snap_coordinates": "SELECT chrom, (round_even(s / 30, 0) * 30)::BIGINT + 1 AS bin_start, (round_even(e / 30, 0) * 30)::BIGINT AS bin_end FROM ivs",
    "paste_join": "SELECT bin_id, count(*) FILTER (WHERE flag >= 1024) AS n_returned, count(*) FILTER (WHERE flag < 1024) AS n_other FROM reads JOIN bins ON reads.s < bins.e AND reads.e > bins.s GROUP BY bin_id",
    "std_histogram": "SELECT floor(round(std / 0.01, 6))::INT AS bucket, count(*) AS cells FROM std GROUP BY ALL",
    "label_agreement": "SELECT cells, round(coalesce((total + 2 * same - ones - twos) / nullif(total, 0), 1), 6) AS rand, "
    "round(coalesce((same - coalesce(ones * twos / nullif(total, 0), 0)) / nullif((ones + twos) / 2 - coalesce(ones * twos / nullif(total, 0), 0), 0), 1), 6) AS adjusted_rand FROM ("
    "SELECT sum(n)::BIGINT AS cells, sum(n * (n - 1) / 2)::DOUBLE AS same, (sum(n) * (sum(n) - 1) / 2)::DOUBLE AS total, "
    f"(SELECT sum(n * (n - 1) / 2)::DOUBLE FROM (SELECT count(*) AS n FROM {NODES} GROUP BY a)) AS ones, "
    f"(SELECT sum(n * (n - 1) / 2)::DOUBLE FROM (SELECT count(*) AS n FROM {NODES} GROUP BY b)) AS twos "
    f"FROM (SELECT count(*) AS n FROM {NODES} GROUP BY a, b))",
    "lifted_intervals": f"""SELECT id, CASE WHEN coalesce(top >= 0.75 * length, false) THEN 'lifted' WHEN bases IS NULL THEN 'deleted' WHEN bases >= 0.75 * length THEN 'split' ELSE 'partly deleted' END AS status,
  CASE WHEN top >= 0.75 * length THEN 'part' || chain ELSE '' END AS to_chrom, CASE WHEN top >= 0.75 * length THEN a ELSE -1 END AS to_start, CASE WHEN top >= 0.75 * length THEN b ELSE -1 END AS to_end,
  CASE WHEN top >= 0.75 * length THEN chain % 2 = 1 ELSE false END AS flip, round(coalesce(bases / length, 0), 6) AS share FROM (
  SELECT l_orderkey * 10 + l_linenumber AS id, {L} AS s, {L} + l_quantity::BIGINT AS e, e - s AS length FROM lineitem) l LEFT JOIN (
  SELECT s, e, sum(n)::BIGINT AS bases, max(n) AS top, arg_min(chain, (-n, chain)) AS chain, arg_min(a, (-n, chain)) AS a, arg_min(b, (-n, chain)) AS b FROM (
    SELECT s, e, chain, count(*) AS n, min(place) AS a, max(place) + 1 AS b FROM (
      SELECT s, e, chain, CASE WHEN chain % 2 = 1 THEN whole - 1 - spot ELSE spot END AS place FROM (SELECT DISTINCT s, e FROM reads) JOIN (
        SELECT day, chain, row_number() OVER (PARTITION BY chain ORDER BY day) - 1 AS spot, count(*) OVER (PARTITION BY chain) AS whole FROM (
          SELECT day, ((dense_rank() OVER (ORDER BY run) - 1) // 8)::BIGINT AS chain FROM (
            SELECT s AS day, s - row_number() OVER (ORDER BY s) AS run FROM days WHERE n < (SELECT round(quantile_cont(n, 0.97), 9) FROM days)))) ON day >= s AND day < e)
    GROUP BY s, e, chain) GROUP BY s, e) USING (s, e)""",
    "duplicate_reads": f"""SELECT cell, name, mate, duplicate FROM (
  SELECT cell, name, mate, NOT (r = 1 AND (n > 1 OR NOT EXISTS (SELECT 1 FROM frag_ends p WHERE p.n > 1 AND p.cell = f.cell AND p.e = f.ends[1]))) AS duplicate FROM (
    SELECT *, row_number() OVER (PARTITION BY cell, ends ORDER BY score DESC, name) AS r FROM frags) f JOIN frag_reads USING (cell, name))""",
    "phased_genotype_filter": "SELECT * FROM geno WHERE substr(chrom, 4)::INT BETWEEN 1 AND 22 AND gt IN ('1|0', '0|1')",
}

ORACLES = {name: CHAIN + select for name, select in SELECTS.items()} | {"bias_corrected": CORRECTED}
