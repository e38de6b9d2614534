"""Quality: held-out accuracy, shrinkage, a brute-force version, and odd tables."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketlake.llm import quality
from marketlake.llm.queries import QUERIES


def bins(t):
    t = t or ""
    words, lines = re.findall("[^\x20\x09-\x0d]+", t), t.split("\n")
    n, w = max(1, len(t)), max(1, len(words))
    return [min(23, len(bin(len(words))) - 2), min(20, len(set(words)) * 20 // w), min(23, len(re.findall(r"[#$%&*|!+=<>{}~^_@]", t)) * 200 // n),
            min(23, len(re.findall("[A-Z]", t)) * 40 // n), min(23, len(re.findall("[0-9]", t)) * 200 // n), min(23, len(t) // w),
            min(20, len(set(lines)) * 20 // len(lines))]


def brute(docs, labels):
    known = {}
    for i, g in labels:
        if i is not None and g is not None:
            known[i] = min(known.get(i, 1), g)
    rows = [(i, h or "", p or "", bins(t), known.get(i)) for i, h, p, t in docs]
    good, bad = (sum(r[4] == k for r in rows) for k in (1, 0))
    if not good or not bad:
        return sorted(((r[0], r[1], r[2], 0.0, 0.5, 0.5) for r in rows), key=str)
    rate, cells = good / (good + bad), defaultdict(lambda: [0, 0])
    for r in rows:
        if r[4] is not None:
            for f, b in enumerate(r[3]):
                cells[f, b][r[4]] += 1
    weigh = lambda f, b: math.log((cells[f, b][1] + 1) / (good + 24)) - math.log((cells[f, b][0] + 1) / (bad + 24))
    out, hosts, paths = [], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for i, h, p, b, g in rows:
        e = 0.5 * sum(weigh(f, x) for f, x in enumerate(b))
        w, y = (0.25, 0.25 / (1 + math.exp(-(math.log(rate / (1 - rate)) + e)))) if g is None else (1.0, float(g))
        for level in (hosts[h], paths[h, p]):
            level[0] += w
            level[1] += y
        out.append((i, h, p, e, w, y))

    def pseudo(groups):
        n = sum(a for a, _ in groups.values())
        v, chance = sum(a * (s / a - rate) ** 2 for a, s in groups.values()) / n, rate * (1 - rate)
        return min(1000, max(1, chance / max(v - chance * len(groups) / n, 1e-6)))

    k1, k2 = pseudo(hosts), pseudo(paths)
    final = []
    for i, h, p, e, w, y in out:
        above = (hosts[h][1] - y + k1 * rate) / (hosts[h][0] - w + k1)
        prior = min(1 - 1e-6, max(1e-6, (paths[h, p][1] - y + k2 * above) / (paths[h, p][0] - w + k2)))
        final.append((i, h, p, e, prior, 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + e)))))
    return sorted(final, key=str)


def got(spark, docs, labels):
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, host string, path string, text string, score int, w string").repartition(3)
    return [tuple(r) for r in quality.score(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()]


r = random.Random(1)
TEXTS = [" ".join(r.choice(["Word", "the", "of", "$$$", "SPAM!!", "12", "it\n"]) for _ in range(r.randint(0, 30))) for _ in range(150)]
DOCS = [(i, f"h{min(i % 9, 3)}", f"/{i % 2}", t) for i, t in enumerate(TEXTS)]
LABELS = [(i, int("SPAM" not in t)) for i, t in enumerate(TEXTS) if i % 3]


@pytest.mark.parametrize("docs, labels", [
    (DOCS, LABELS), (DOCS, []), ([], []), (DOCS + DOCS[:20], LABELS + [(1, 0), (None, 1), (2, None), (10**7, 1)]),
    ([(None, None, None, None), (1, "h", None, ""), (1, "h", None, ""), (2, None, "/", "x " * 50_000)], [(1, 1), (2, 0)])])
def test_against_brute_force(spark, docs, labels):
    have, want = sorted(got(spark, docs, labels), key=lambda t: str(t[:3])), sorted(brute(docs, labels), key=lambda t: str(t[:3]))
    assert [t[:3] for t in have] == [t[:3] for t in want]
    key = lambda t: (str(t[:3]), round(t[3], 6), round(t[5], 6))
    for a, b in zip(sorted(have, key=key), sorted(want, key=key)):
        assert a[3:] == pytest.approx(b[3:], abs=1e-9)


def test_sparse_sites_shrink_toward_the_prior(spark):
    docs = [(i, "large bad", "/", "same text") for i in range(300)] + [(1_000 + i, "large good", "/", "same text") for i in range(300)] + [
        (5_000, "small bad", "/", "same text"), (5_001, "small bad", "/", "same text"), (6_000, "alone", "/", "same text")]
    labels = [(i, 0) for i in range(200)] + [(1_000 + i, 1) for i in range(200)] + [(5_000, 0)]
    prior = {x[0]: x[4] for x in got(spark, docs, labels)}
    assert prior[299] < 0.1 < prior[5_001] < prior[6_000] < 0.9 < prior[1_299]
    assert prior[6_000] == pytest.approx(200 / 401, abs=0.02)


def test_held_out_accuracy(spark, sf):
    bigger = sf.replace("sf0.001", "sf0.01")
    found = QUERIES["op7_quality_classifier"](spark, bigger)
    labels = spark.read.parquet(f"{bigger}/labels.parquet")
    assert found.count() == spark.read.parquet(f"{bigger}/documents.parquet").count()
    right = found.filter("held_out").join(labels, "doc_id").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert right[0] >= 0.85 and right[1] >= 0.9
