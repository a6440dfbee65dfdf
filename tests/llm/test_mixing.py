import hashlib
import re
from collections import Counter, defaultdict

from corpusloom.llm import mixing as M


def water(sizes, weights, budget, passes):
    """Targets by bisection on the level of words per unit of weight."""
    low, high = 0.0, float(budget) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(passes * sizes[s], weights[s] * mid) for s in sizes) < budget:
            low = mid
        else:
            high = mid
    return {s: min(passes * sizes[s], weights[s] * high) for s in sizes}


def brute(rows, passes=3, seed=7):
    """rows: (id, text, source). Copies taken by (id, text, source)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget = sum(size)
    digest = [hashlib.md5((t or "").encode()).hexdigest() for _, t, _ in rows]
    turn = [hashlib.md5("|".join([str(seed), "" if i is None else str(i), d, s or ""]).encode()).hexdigest() for (i, _, s), d in zip(rows, digest)]
    offers = []
    for s in order:
        queue = sorted((turn[k], rows[k][0] is not None, rows[k][0] or 0, digest[k], k) for k in range(len(rows)) if rows[k][2] == s)
        for p in range(passes):
            end = p * sizes[s]
            for *_, k in queue:
                end += size[k]
                if size[k]:
                    offers.append((end / weights[s], s is None, s or "", rows[k][0] is not None, rows[k][0] or 0, digest[k], p, k))
    copies, total = Counter(), 0
    for o in sorted(offers):
        k = o[-1]
        if total + size[k] > budget:
            break
        total += size[k]
        copies[k] += 1
    return size, sizes, weights, budget, copies


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, sizes, weights, budget, copies = brute(rows)
    got = M.mix(df).collect()
    want = Counter((r[0], s, size[k], sizes[s], copies[k] * size[k]) for k, r in enumerate(rows) for s in [r[2]])
    assert Counter((r.id, r.source, r.size, r.source_size, r.taken) for r in got) == want
    targets = water(sizes, weights, budget, 3)
    for r in got:
        assert abs(r.target - targets[r.source]) < 1e-3 * max(1, targets[r.source]) and r.taken <= 3 * r.size
    assert sum(r.taken for r in got) <= budget
    out = M.repeat_taken(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == Counter({k: n for k, n in sum(
        (Counter({rows[k]: n}) for k, n in copies.items()), Counter()).items()})


def test_random_sources_equal_brute_force(spark):
    import random
    draw = random.Random(5)
    rows = [(i, " ".join(["w"] * draw.choice([1, 3, 10, 40])) + f" {i}", draw.choice(["a", "b", "b", "b", "c", "d", None, "é"])) for i in range(400)]
    check(spark, rows)


def test_small_sources_stop_at_three_passes(spark):
    rows = [(i, "w " * 20 + str(i), "big") for i in range(60)] + [(100, "x y z", "a"), (101, "x", "a")]
    check(spark, rows)  # "a" comes first and weighs 5, but has 4 words
    got = {r.id: r for r in M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[100].target == 12 and got[100].taken == 9 and got[101].taken == 3


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c", "s"), (1, "other words", "s"), (2, None, "s"), (3, "", None), (None, "x y", None),
            (None, "x y", None), (4, "q", "t"), (5, "  ", "t"), (6, "long " * 200, "u")]
    check(spark, rows)


def test_order_of_rows_does_not_matter_and_empty_tables_work(spark, edge_docs, no_docs):
    a = sorted(map(str, M.mix(edge_docs).collect()))
    assert a == sorted(map(str, M.mix(edge_docs.repartition(7)).collect())) and len(a) == edge_docs.count()
    assert M.mix(no_docs).count() == 0 and M.repeat_taken(no_docs).count() == 0
    blank = edge_docs.where("trim(coalesce(text, '')) in ('', '\t\n')")
    assert {r.taken for r in M.mix(blank).collect()} <= {0}


def test_taken_comes_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = M.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"], r
