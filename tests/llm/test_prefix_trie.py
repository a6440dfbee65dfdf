import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import prefix_trie as T
from corpusloom.llm import queries
from corpusloom.llm.tree_contraction import subtree_totals

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Node rows from (conv_id, turn, role, text), by a dictionary of prefixes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [r[3:] for r in sorted(t)] for c, t in convs.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    ends = {p: ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def run(spark, rows, n=3):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(n)
    return sorted(tuple(r[c] for c in COLUMNS) for r in T.trie(*T.rebuilt(df)).collect())


def test_equals_brute_force_on_random_conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 130), 500, 999, 1000]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["hi there", "hello", "", None, "a b c"])))
    rows += [(0, None, "user", "first"), (41, 2, "user", "tie a"), (41, 2, "user", "tie b"), (41, 2, "user", "tie b"), (None, 1, "user", "nobody"), (7, None, None, None)]
    assert run(spark, rows) == brute(rows)


def test_long_chain_and_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 20)
    rows = [(20, i, "user", f"turn {i % 7}") for i in range(700)]  # one conversation over many partitions
    rows += [(c, i, "user", f"turn {i}") for c in range(2001, 2300) for i in range(3)]
    rows += [(5, 0, "user", "gone")]  # shorter than its head, whose source is missing
    assert run(spark, rows, 5) == brute(rows)


def test_table_edges_and_extra_columns(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "conversations")
    got = queries.op12_prefix_trie(spark, "/root/testdata/sf0.01")
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert T.trie(*T.rebuilt(df.limit(0))).count() == 0
    odd = df.limit(60).withColumn("depth", F.lit(5)).withColumn("node", F.lit("x")).withColumn("h", F.lit(1)).withColumn("k1", F.lit(2))
    assert T.trie(*T.rebuilt(odd)).count() == len(brute([(r.conv_id, r.turn, r.role, r.text) for r in odd.collect()]))


def test_contraction_equals_plain_sums(spark):
    rng, n = random.Random(6), 200
    shapes = [lambda i: rng.randrange(i), lambda i: i - 1, lambda i: 0, lambda i: i - 1 if i < 100 else 99,
              lambda i: rng.randrange(i) if i % 50 else None, lambda i: max(0, i - rng.randint(1, 3))]
    parent = {}
    for tree, up in enumerate(shapes):  # one forest
        for i in range(n):
            above = up(i) if i else None
            parent[1000 * tree + i] = None if above is None else 1000 * tree + above
    value = {i: rng.randrange(100) for i in parent}
    total, size = dict(value), dict.fromkeys(parent, 1)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
            size[parent[i]] += size[i]
    df = spark.createDataFrame([(i, parent[i], value[i], 1) for i in parent], "node long, parent long, v long, one long")
    got = {r.node: (r.v, r.one) for r in subtree_totals(df, ["v", "one"]).collect()}
    assert got == {i: (total[i], size[i]) for i in parent}
    assert subtree_totals(df.limit(0), ["v"]).count() == 0
