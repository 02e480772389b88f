"""Operator 9: quality rules with risk-controlled thresholds. DataFrame functions only.

Base features are counted for every whole text. Each rule rejects a document if its feature exceeds a cutoff, and
the cutoff is not a guess: over the labelled documents of a stratum, a cutoff is certified if the exact binomial
bound says that it rejects at most ``risk`` of the good documents, at a confidence shared out over all strata and
rules (Bonferroni). The cutoffs of a rule are tested from the mildest on and testing stops at the first failure
(fixed sequence), so they need no further correction. Of the certified cutoffs, the one that rejects most bad
documents net of good ones is taken, the mildest at ties. A stratum with too few labels certifies nothing and keeps
all that the base rules keep.

Defined cases: a null text counts as empty (all features 0; fails the base rule of 20 words); a null stratum is a
stratum of its own, apart from the empty name; null or repeated labels: null ones are ignored, a document is good if
any of its labels is 1; rows that repeat a doc_id are one draw in the bounds and get a verdict each; a value equal to
a cutoff is kept; ties between cutoffs go to the milder; a very long text is one task's work, in time n log n of its
words; an empty table gives none; other columns are ignored, whatever their names, and passed through by
``keep_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.llm.common import WORD, Scratch, join_small, table

#: Cutoffs tested for each rule, mildest first.
CUTOFFS = {
    "symbols": [0.5, 0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02],
    "dup_lines": [0.7, 0.5, 0.4, 0.3, 0.2],
    "repeats": [0.25, 0.2, 0.15, 0.1, 0.05],
}
SYMBOLS = "#*$%&|<>"
#: Good documents that a rule may reject in a stratum, at most, and the chance that any certificate is wrong. With twelve
#: tests it takes 180 good labels of which none is rejected to certify a cutoff.
RISK, DELTA = 0.03, 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def stratum_key(stratum: str) -> Column:
    """The stratum's name after a mark, so that null is a stratum apart from the empty name."""
    return F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit(""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas that look at a whole array must not compute it per element,
    as they would where the optimizer puts the array's expression in place of its name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_words = df.withColumn("_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    window = F.transform(F.sequence(F.lit(1), F.size("_words") - 7), lambda i: F.xxhash64(F.slice("_words", i, 8)))
    with_windows = with_words.withColumn("_w", F.when(F.size("_words") >= 8, window).otherwise(F.array().cast("array<bigint>")))
    # Positions of windows that occur again, from a sort by (hash, position); a word counts once, in the last one before it.
    pairs = F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])))
        start = F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last"))
        add = lambda c, p: F.struct((c["n"] + F.least(F.lit(8), p - c["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.array_sort(F.transform(again, lambda x: x["p"])), start, add, lambda c: c["n"])

    repeats = F.when(F.size(F.array_distinct("_w")) < F.size("_w"), bound(pairs, covered))
    return (
        with_windows.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("_words", "_lines", "_w")
    )


def rule_values() -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words")}


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of n draws at p, summed in logarithms; 1 where k >= n p, which no confidence can exclude."""
    step = F.log(F.lit(p)) - F.log(F.lit(1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1).cast("double") / i) + step
        high, low = F.greatest(acc["s"], term), F.least(acc["s"], term)
        return F.struct(term.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))
    total = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add, lambda acc: F.exp(acc["s"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def certified_cutoffs(features: DataFrame, labels: DataFrame, stratum: str, risk: float, delta: float) -> DataFrame:
    """stratum and one column a rule: its certified cutoff, null if there is none worth taking."""
    good = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    # The bound is one of independent draws: rows that repeat a doc_id are one draw, the least of them.
    whole = F.struct(stratum_key(stratum).alias("stratum"), *COUNTS, "good")
    drawn = features.where("NOT base_failed").join(good, "doc_id").groupBy("doc_id").agg(F.min(whole).alias("row")).select("row.*")
    tested = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (value > c).alias("rejects")) for rule, value in rule_values().items() for i, c in enumerate(CUTOFFS[rule])])
    counts = (
        drawn.select("stratum", "good", F.explode(tested).alias("x"))
        .groupBy("stratum", "x.rule", "x.step", "x.cutoff")
        .agg(
            F.sum("good").cast("long").alias("n"),
            F.sum(F.when(F.col("x.rejects"), F.col("good")).otherwise(0)).cast("long").alias("k"),
            F.sum(F.when(F.col("x.rejects"), 1 - F.col("good")).otherwise(0)).cast("long").alias("bad"),
        )
    )
    tests = counts.select("stratum", "rule").distinct().agg(F.count("*").alias("tests"))
    passes = counts.join(F.broadcast(tests)).withColumn("ok", (F.col("n") > 0) & (binomial_tail(F.col("n"), F.col("k"), risk) <= F.lit(delta) / F.col("tests")))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.struct((F.col("bad") - F.col("k")).alias("gain"), (-F.col("step")).alias("mild"), "cutoff")
    best = passes.withColumn("ok", F.min("ok").over(so_far)).where("ok AND bad > k").groupBy("stratum", "rule").agg(F.max(gain)["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in CUTOFFS])


def judge(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``features`` with ``kept``. ``cutoffs`` has a row a stratum and should have been saved."""
    joined = join_small(features.withColumn("stratum", stratum_key(stratum)), cutoffs, "stratum", "left")
    over = F.lit(False)
    for rule, value in rule_values().items():
        over = over | F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False))
    # One condition that needs the cutoffs: it is not split and pushed into the texts' scan, which would count twice.
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~over)).drop("stratum", *[f"cut_{r}" for r in CUTOFFS])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row a document: its base features, base_failed and kept."""
    scratch = Scratch(docs.sparkSession)
    features = scratch.save(base_features(docs.select("doc_id", "text", stratum)).drop("text"))
    cutoffs = scratch.save(certified_cutoffs(features, labels, stratum, risk, delta))
    return judge(features, cutoffs, stratum)


def keep_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever their names.

    Rows are saved with their features, so that these are counted once and texts are not shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    whole = docs.select("doc_id", "text", stratum, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    features = scratch.save(base_features(whole).drop("text"))
    cutoffs = scratch.save(certified_cutoffs(features, labels, stratum, risk, delta))
    return judge(features, cutoffs, stratum).where("kept").select("_row.*")


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op9(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*OUT)


def features_sql(docs: str) -> str:
    return rf"""
d AS (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {docs}),
i AS (SELECT row_number() OVER () AS rid, * FROM d),
x AS (SELECT rid, unnest(range(1, len(words) - 6)) AS p, unnest(list_transform(range(1, len(words) - 6), lambda j: array_to_string(words[j:j + 7], ' '))) AS w FROM i WHERE len(words) >= 8),
y AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w) AS c FROM x),
z AS (SELECT rid, sum(least(8, p - prev))::BIGINT AS n FROM (SELECT rid, p, coalesce(lag(p) OVER (PARTITION BY rid ORDER BY p), -8) AS prev FROM y WHERE c > 1) GROUP BY rid),
f AS (SELECT i.* EXCLUDE (words, lines, t), coalesce('=' || lang, '') AS stratum, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(z.n, 0)::BIGINT AS n_repeat_words, len(words) < 20 OR 100 * coalesce(z.n, 0) > 30 * len(words) AS base_failed FROM i LEFT JOIN z USING (rid)),
v AS (SELECT *, unnest([
  {{'rule': 'symbols', 'value': coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0)}},
  {{'rule': 'dup_lines', 'value': coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0)}},
  {{'rule': 'repeats', 'value': coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0)}}]) AS r FROM f),
cuts AS (SELECT rule, unnest(range(0, len(cs))) AS step, unnest(cs) AS cutoff FROM (VALUES
  {", ".join(f"('{r}', {[float(c) for c in cs]}::DOUBLE[])" for r, cs in CUTOFFS.items())}) AS c(rule, cs)),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
u AS (SELECT rid, good FROM (SELECT rid, good, row_number() OVER (PARTITION BY doc_id ORDER BY stratum, {", ".join(COUNTS)}) AS pick
  FROM f JOIN good USING (doc_id) WHERE NOT base_failed) WHERE pick = 1),
n AS (SELECT stratum, cuts.rule, step, cutoff, sum(good)::BIGINT AS n, coalesce(sum(good) FILTER (WHERE r.value > cutoff), 0)::BIGINT AS k,
  coalesce(sum(1 - good) FILTER (WHERE r.value > cutoff), 0)::BIGINT AS bad
  FROM v JOIN u USING (rid) JOIN cuts ON cuts.rule = r.rule GROUP BY ALL),
b AS (SELECT *, n > 0 AND (CASE WHEN k >= n * {RISK} THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
  lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) END)
  <= {DELTA} / (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM n)) AS ok FROM n),
o AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS fine FROM b),
best AS (SELECT stratum, rule, arg_max(cutoff, (bad - k, -step)) AS cutoff FROM o WHERE fine AND bad > k GROUP BY ALL),
kept AS (SELECT v.* EXCLUDE (r), bool_and(coalesce(r.value <= cutoff, TRUE)) AS ok FROM v LEFT JOIN best ON best.stratum = v.stratum AND best.rule = r.rule GROUP BY ALL)"""


SQL = f"""WITH {features_sql("(SELECT doc_id, text, lang FROM documents)")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM kept
"""
