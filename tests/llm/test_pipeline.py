import os
import random
import shutil
import subprocess
import sys
from collections import Counter

import corpus_pipeline as P
import pytest

from corpusloom.llm import bpe, mixing, queries, simhash
from corpusloom.llm.oracles import ORACLE
from corpusloom.plans.compare import compare
from corpusloom.session import materialize

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, key):
    result = compare(queries.QUERIES[key](spark, SF), ORACLE[key], SF)
    assert result["values_match"], result


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, then what each stage made of them."""
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "mixing", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_filters_keep_clean_documents(spark, stages):
    docs, known, clean = (s.count() for s in stages[:3])
    assert known >= 0.999 * docs  # the table's own languages stay
    labels = queries.table(spark, SF, "labels")
    gone = stages[1].join(stages[2], "doc_id", "left_anti").join(labels, "doc_id")
    n = {r.toxic: r["count"] for r in gone.groupBy("toxic").count().collect()}
    assert n.get(1, 0) > 20 and n.get(0, 0) <= 4 and clean > 0.85 * docs


def test_foreign_and_garbled_documents_go(spark):
    docs = queries.table(spark, SF, "documents")
    rng = random.Random(1)
    salad = lambda: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=rng.randint(3, 9))) for _ in range(60))
    planted = ["Он открыл окно и посмотрел на улицу, где дети играли в мяч. " * 3, "春天来了，花园里的花都开了，孩子们在草地上玩耍。" * 4,
               "오늘은 날씨가 좋아서 공원에 산책을 갔습니다. " * 4, "Þe ŵyġħť ŵąş ňöť ťħé şàṁę ąġąịň " * 5, salad(), salad()]
    clean = [r.text for r in docs.where("length(text) > 200 and lang is not null").orderBy("doc_id").limit(40).collect()]
    switched = [" ".join(a.split()[:40] + b.split()[:40]) for a, b in zip(clean, clean[1:])]
    texts = planted + clean + switched
    extra = spark.createDataFrame([(10 ** 9 + 4 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in P.identify_language(spark, docs.unionByName(extra, allowMissingColumns=True), SF).where("doc_id >= 1000000000").collect()}
    gone = [t for i, t in enumerate(texts) if 10 ** 9 + 4 * i not in kept]
    assert gone == planted


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect()]
    codes = {i: simhash.fingerprint(t) for i, t in rows}
    first, parent = {}, {c: c for c in codes.values()}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    for i, c in codes.items():
        first[find(c)] = min(i, first.get(find(c), i))
    kept = Counter(r.doc_id for r in stages[3].collect())
    assert kept == Counter(first.values())


def test_mix_takes_rows_as_often_as_the_operator_says(stages):
    want = {r.id: r.copies for r in mixing.mix(stages[3]).collect() if r.copies}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter(want)


def test_last_stage_encodes_every_row_of_the_mix(stages):
    with open(queries.vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        v = bpe.vocabulary(f.read())
    lengths = {r.doc_id: len(v.encode(r.text)) for r in stages[4].collect()}
    got = [(r.doc_id, r.n_tokens) for r in stages[5].collect()]
    assert len(got) == stages[4].count() and all(lengths[i] == n for i, n in got)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


def test_stages_bear_odd_documents(spark, edge_docs, no_docs):
    for start in (edge_docs, no_docs):
        docs = start
        for name, stage in P.STAGES:
            docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), f"test-odd-{name}")
            assert docs.columns == (start.columns if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        assert docs.count() <= 3 * start.count()


def test_extra_columns_keep_their_values(spark, edge_docs):
    out = P.filter_toxicity(spark, edge_docs, "/root/testdata/sf0.001")
    assert {(r.score, r.Lang_Pred, r.rank) for r in out.collect()} == {(0.5, "x", "k")}


def test_the_rest_works_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == 92 and 'pipeline' not in q, len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120,
                   env={**os.environ, "PYTHONPATH": str(copy)})
