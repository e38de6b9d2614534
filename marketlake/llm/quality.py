"""Document quality by hierarchical empirical Bayes.

A document has evidence of its own: a naive Bayes sum over whole-text features in fixed bins, whose tables are counted
from the labelled documents. It also has a place: a host, and a path on the host. The rate of good documents is
estimated for each path, shrunk toward that of its host, which is shrunk toward the global rate; how strongly is
estimated from how much the rates differ beyond chance. Documents without a label enter the rates with the probability
their evidence gives, at a lower weight. A document's prior is the rate of its path without itself, and its
score combines prior and evidence.

Texts are read once for a row of small numbers; everything after is grouped aggregation, summed before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import whole
from marketlake.session import stored

FEATURES = ["words", "distinct", "signs", "capitals", "digits", "length", "lines"]
SMOOTH = 1.0  # added to each cell of the evidence tables, of BINS cells
BINS = 24
TEMPER = 0.5  # of the summed evidence, as features are not independent
UNLABELLED = 0.25  # weight of a document without a label in the rates


def measured(text: Column) -> dict[str, Column]:
    """Whole numbers from 0 to 23 that describe a whole text."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    lines = F.split(text, "\n")
    n, n_words = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))

    def bins(part: Column, per: int, of: Column, most: int) -> Column:
        return F.least(F.floor(part * per / of), F.lit(most)).cast("int")

    return {
        "words": F.least(F.length(F.bin(F.size(words))), F.lit(23)).cast("int"),
        "distinct": bins(F.size(F.array_distinct(words)), 20, n_words, 20),
        "signs": bins(F.regexp_count(text, F.lit(r"[#$%&*|!+=<>{}~^_@]")), 200, n, 23),
        "capitals": bins(F.regexp_count(text, F.lit("[A-Z]")), 40, n, 23),
        "digits": bins(F.regexp_count(text, F.lit("[0-9]")), 200, n, 23),
        "length": bins(F.length(text), 1, n_words, 23),
        "lines": bins(F.size(F.array_distinct(lines)), 20, F.size(lines), 20),
    }


def _shrinkage(groups: DataFrame, rate: float, n_col: str, s_col: str) -> float:
    """Pseudo-documents of the prior, by moments: small where groups differ beyond chance."""
    r = groups.agg(F.count("*"), F.sum(n_col), F.sum(F.col(n_col) * (F.col(s_col) / F.col(n_col) - rate) ** 2)).first()
    if not r[1]:
        return 1.0
    chance = rate * (1 - rate)
    between = max(r[2] / r[1] - chance * r[0] / r[1], 1e-6)
    return min(1_000.0, max(1.0, chance / between))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, places: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "host", path_col: str = "path", label_col: str = "quality") -> DataFrame:
    """``doc_id, host, path, evidence, prior, score`` for every row of ``docs``; score is the chance to be good.

    ``places(doc_id, host, path)``, a row for a document at most, goes before the host and path columns of ``docs``.

    Labels (0 or 1; null ids and labels are left out; a document labelled twice is good only if all labels say so) train the
    tables and the rates; no document's own label is in its score. Null texts are empty, null hosts and paths are places
    of their own. Without labels of both kinds evidence is 0 and every prior 0.5.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"),
                        F.coalesce(F.col(path_col), F.lit("")).alias("path"), whole(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good"))
    known = known.filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    narrow = texts.select("doc_id", "host", "path", *[c.alias(k) for k, c in measured(F.col("text")).items()])
    narrow = narrow.join(known, "doc_id", "left")
    if places is not None:
        own = places.select("doc_id", F.col("host").alias("own_host"), F.col("path").alias("own_path"))
        narrow = narrow.join(own, "doc_id", "left").withColumns(
            {"host": F.coalesce("own_host", "host"), "path": F.coalesce("own_path", "path")}).drop("own_host", "own_path")
    rows = stored(narrow, "measured")
    # At most BINS rows for each feature.
    cells = rows.filter("good is not null").select("good", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES])).alias("c"))
    counts = cells.groupBy("c.feature", "c.bin").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")).collect()
    n_good = sum(r.g for r in counts if r.feature == FEATURES[0])
    n_bad = sum(r.b for r in counts if r.feature == FEATURES[0])
    both = n_good > 0 and n_bad > 0
    rate = n_good / (n_good + n_bad) if both else 0.5
    evidence = F.lit(0.0)
    if both:
        of_bin = {(r.feature, r.bin): (r.g, r.b) for r in counts}
        for f in FEATURES:
            g, b = (F.array(*[F.lit(float(of_bin.get((f, i), (0, 0))[k])) for i in range(BINS)]) for k in (0, 1))
            evidence = evidence + F.log((g[F.col(f)] + SMOOTH) / (n_good + SMOOTH * BINS)) - F.log((b[F.col(f)] + SMOOTH) / (n_bad + SMOOTH * BINS))
        evidence = evidence * TEMPER
    rows = rows.withColumn("evidence", evidence)
    chance = 1 / (1 + F.exp(-(_logit(F.lit(rate)) + F.col("evidence"))))
    rows = rows.withColumn("w", F.when(F.col("good").isNull(), UNLABELLED).otherwise(1.0))
    rows = rows.withColumn("y", F.col("w") * F.coalesce(F.col("good").cast("double"), chance))
    paths = stored(rows.groupBy("host", "path").agg(F.sum("w").alias("path_n"), F.sum("y").alias("path_s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    both_levels = stored(paths.join(hosts, "host"), "rates")
    if both:
        to_global = _shrinkage(both_levels.select("host", "host_n", "host_s").distinct(), rate, "host_n", "host_s")
        to_host = _shrinkage(both_levels, rate, "path_n", "path_s")
    else:
        to_global = to_host = 1_000.0
    placed = rows.join(both_levels, ["host", "path"])
    host_rate = (F.col("host_s") - F.col("y") + to_global * rate) / (F.col("host_n") - F.col("w") + to_global)
    prior = (F.col("path_s") - F.col("y") + to_host * F.col("host_rate")) / (F.col("path_n") - F.col("w") + to_host)
    if not both:
        prior = F.lit(0.5)
    placed = placed.withColumn("host_rate", host_rate).withColumn("prior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior)))
    return placed.select("doc_id", "host", "path", "evidence", "prior",
                         (1 / (1 + F.exp(-(_logit(F.col("prior")) + F.col("evidence"))))).alias("score"))
