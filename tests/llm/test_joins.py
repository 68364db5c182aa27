"""Hard negatives, URL rules and spelling variants against plain versions, in many small blocks, parts and units."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stationcast.llm import negatives, spelling, urls

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_url_rules", "op13_spelling_variants"])
def test_like_sql(spark, name):
    problem, rows = compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and rows > 0


def plain_negatives(rows, is_anchor, scale=256, low=80, k=5):
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        value = (label, [math.floor(scale * x) for x in v])
        known[i] = min(known.get(i, value), value)
    score = lambda a, b: sum(x * y for x, y in zip(known[a][1], known[b][1], strict=False))
    out = []
    for a in known:
        if not is_anchor(a):
            continue
        others = sorted((-score(a, b), b) for b in known if b != a)
        for p, positive in [x for x in others if known[x[1]][0] == known[a][0]][:k]:
            fits = [x for x in others if known[x[1]][0] != known[a][0] and low * -p <= 100 * -x[0] <= 100 * -p]
            out += [(a, positive, rank, b, -p, -s) for rank, (s, b) in enumerate(fits[:k], 1)]
    return sorted(out)


def test_negatives_by_hand(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0, 0, 0, 1, 2]), [r.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(-30, 400)]
    rows += [(i, 1, [1.0] * 4) for i in range(400, 460)]  # copies, so ties everywhere
    rows += [(500, None, [1.0] * 4), (None, 1, [1.0] * 4), (510, 1, None), (520, 1, [1.0, None, 0.0, 0.0]), (530, 1, [float("nan")] * 4)]
    rows += [(540, 1, [float("inf")] * 4), (550, 0, []), (560, 0, [0.5]), (0, 1, [1.0] * 4), (0, 1, [1.0] * 4), (570, 9, [1.0] * 4)]
    df = spark.createDataFrame([(*x, 1, "r") for x in rows], "vec_id long, label int, embedding array<float>, rank int, q string")
    expected = plain_negatives(rows, lambda i: i % 10 == 0)
    for values in (1 << 24, 200):
        found = negatives.mine(df, F.col("label"), F.col("vec_id") % 10 == 0, block_values=values).collect()
        assert sorted(map(tuple, found)) == expected
    assert len(expected) > 300


def test_negatives_of_large_numbers(spark):
    rows = [(i, i % 2, [float(i % 7) * 2.0**e, 1.0]) for i, e in zip(range(60), [3, 20, 10] * 20, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = negatives.mine(df, F.col("label"), F.col("vec_id") % 6 == 0).collect()
    assert sorted(map(tuple, found)) == plain_negatives(rows, lambda i: i % 6 == 0)


def test_negatives_without_rows(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (3, 2, None)], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(df, F.col("label"), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df.limit(0), F.col("label"), F.lit(True)).count() == 0
    alone = spark.createDataFrame([(100, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(alone, F.col("label"), F.lit(True)).count() == 0


def test_first_rows_with_ties():
    r = np.random.default_rng(0)
    for _ in range(200):
        scores = r.integers(0, 4, 30)
        at = np.flatnonzero(r.random(30) < 0.7)
        k = int(r.integers(1, 8))
        assert negatives.first_rows(scores, at, k).tolist() == sorted(at.tolist(), key=lambda i: (-scores[i], i))[:k]


def plain_verdict(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group().translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()) :]).group()
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_url_rules_by_hand(spark):
    r = random.Random(6)
    hosts = [".".join(r.choices(["a", "b", "www", "com", "net"], k=r.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/x", "/x/", "/x/y/", "/xy", "/é/", "/x/y/z"]
    rules = sorted({(r.choice(hosts), r.choice(paths), r.choice(["allow", "block"])) for _ in range(80)})
    tails = ["", "?q=1", "#top", "?a#b", "/more", "\nx"]
    given = [f"http://{r.choice(['', 'M.', 'x.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(tails)}" for _ in range(500)]
    given += [None, "", "no url", "://", "a://B.com", "HTTP://WWW.A.COM/X/", "x://a.b/x://c", "http://" + "a." * 5000 + "com/", "http://a.com/" + "x" * 50_000]
    pages = spark.createDataFrame([(i % 300, u, "w", 1) for i, u in enumerate(given)], "page_id long, url string, host string, best int")
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, None)], "host string, path string, verdict string")
    expected = sorted((i % 300, *plain_verdict(u, rules)) for i, u in enumerate(given))
    key = lambda x: tuple((v is None, v or "") if not isinstance(v, int) else v for v in x)
    for options in ({}, {"max_bits": 256, "most_shapes": 5}):
        found = [tuple(x) for x in urls.judge(pages, listed, **options).collect()]
        assert sorted(found, key=key) == sorted(expected, key=key)
    assert {x[4] for x in expected} == {"allow", "block"}
    assert urls.judge(pages.limit(0), listed).count() == 0
    assert {x.verdict for x in urls.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    listed = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("key"))
    universe = spark.range(60_000).select(F.col("id").cast("string").alias("key"))
    cascade = urls.build(listed, universe)
    assert len(cascade.levels) >= 3
    judged = universe.withColumn("listed", cascade.lists(F.col("key")))
    assert judged.filter("listed <> (cast(key as int) < 4000 and cast(key as int) % 2 = 0)").count() == 0


def test_url_plan_is_native(spark, sf):
    plan = entry.queries()["op12_url_rules"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Join", "Cartesian", "ExistingRDD", "Exchange"))


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def plain_variants(docs):
    words = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            crc = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if crc % 199 == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("most", [spelling.UNIT_WORDS, 20, 1])
def test_variants_by_hand(spark, most):
    r = random.Random(7)
    stems = ["".join(r.choices("abéÿ×pq", k=r.randint(6, 8))) for _ in range(40)]
    pool = stems + ["".join(r.choices(s + "ab", k=len(s))) for s in stems] + [s[:3] + s[4:] for s in stems] + [s + r.choice("abÀ") for s in stems]
    weights = [r.choice([1, 6, 40, 250]) for _ in pool]
    docs = [(i, r.choice([" ", "1", "-\n"]).join(r.choices(pool, weights, k=r.randint(0, 400)))) for i in range(60)]
    docs += [(None, "NULLED nulled " * 6), (70, None), (71, ""), (72, "repeat rows " * 3), (72, "repeat rows " * 3), (73, ("z" * 3000 + " ") * 6), (74, ("z" * 3001 + " ") * 31)]
    docs += [(75, "日本語 🙂 short abcde " * 9)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n long, word string")
    assert sorted(map(tuple, spelling.spelling_variants(df, most_in_unit=most).collect())) == plain_variants(docs)


def test_variants_without_words(spark, odd):
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    assert spelling.spelling_variants(odd.filter("text is null")).count() == 0
    assert spelling.spelling_variants(odd).count() >= 0


def test_units_are_bounded(spark):
    """No task holds more words of one unit than allowed, even if a third of the words share a vector."""
    from itertools import islice, permutations

    some = ["".join(p) for p in islice(permutations("abcdefg"), 300)] + [f"{a}{b}qqqqqq" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    words = spark.createDataFrame([(w, 5) for w in some], "word string, n long").withColumn("vector", spelling.letter_counts(F.col("word")))
    heavy = spelling.heavy_nodes(words, 50)
    deepest = heavy.agg(F.max(F.size("path"))).first()[0]
    routed = spelling.routed(words, heavy, heavy.count(), deepest, 50)
    homes = routed.filter("kind = 0")
    assert homes.count() == len(some)
    assert homes.groupBy("path", "chunk").count().agg(F.max("count")).first()[0] < 50 * 1.6
    visits = routed.groupBy("path", "chunk").agg(F.count_if(F.col("kind") == 1).alias("n")).agg(F.max("n")).first()[0]
    assert visits < 50 * 1.6 * 14
