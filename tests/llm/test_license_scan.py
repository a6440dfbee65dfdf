import random
import re

from corpusloom.llm import license_scan as S


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in S.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(rows):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.text), r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in S.scan(df).join(df, "doc_id").collect()}


def test_base_places_equal_brute_force(spark):
    texts = ["MIT license mit LICENSE, Mit-License", "the GNU general public license", "gnu general public", "cc by", "CC-BY cc\nby",
             "apache license é apache license", "émit license", "mit 2 license", "license mit", "cc cc by by cc by"]
    rows = scan(spark, texts)
    assert len(rows) == len(texts)
    check(rows.values())


def test_documents_table_and_edges(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = S.scan(docs).join(docs, "doc_id").collect()
    assert len(out) == docs.count()
    check(out)
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.labels) for r in S.scan(edge_docs).collect())
    want = sorted((r.doc_id is None, r.doc_id, brute(r.text)[0], "") for r in edge_docs.collect())
    assert got == want
    assert S.scan(no_docs).count() == 0


def test_neighbouring_diagonals_merge_into_a_verified_span(spark):
    notice = "this work is licensed under the gnu general public license version 3"
    rows = scan(spark, [
        notice,
        notice.replace("under the", "under the terms of the"),   # words inserted: diagonals 0 and 3
        notice.replace("work is ", ""),                           # words left out
        "under the general public",                               # too little of it
        notice.replace("under the", "under " + "x " * 40 + "the"),  # too far apart
    ])
    assert rows[0].labels == "gpl,gpl-3.0" and rows[0].score == 1.0
    assert "gpl-3.0" in rows[1].labels and "gpl-3.0" in rows[2].labels
    assert rows[3].labels == "" and rows[3].score == 0.0
    assert rows[4].labels == "gpl"


def test_relatives_of_a_notice_do_not_get_its_label(spark):
    want = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa-4.0",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by",
        "Licensed under CC BY-NC 3.0.": "cc-by",
        "This work is licensed under the GNU General Public License, version 2.": "gpl",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl",
        "Mozilla Public License, version 1.1": "",
        "Mozilla Public License, version 2.0": "mpl-2.0",
        "Licensed under the Apache License, version 1.1": "apache",
        "Licensed under the Apache License, version 2.0": "apache,apache-2.0",
        "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
        "Licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software": "",
        "Released under the MIT/X11 License": "mit",
    }
    rows = scan(spark, list(want))
    assert {t: rows[i].labels for i, t in enumerate(want)} == want


def test_votes_nearby_do_not_spoil_a_complete_notice(spark):
    notice = S.NOTICES[0][0]
    texts = ["All rights reserved. " * n for n in (1, 2, 3, 50)] + [
        "licensed under the under the " + notice + " under the under the licensed under",
        ("Released under the MIT license.\n" * 30),
        "rights reserved all all rights",
        "mozilla public license version 2 0 " * 400,
    ]
    rows = scan(spark, texts)
    assert [rows[i].labels for i in range(8)] == ["all-rights-reserved"] * 4 + ["gpl,gpl-3.0", "mit", "", "mpl-2.0"]
    assert all(rows[i].score == 1.0 for i in (0, 1, 2, 3, 4, 5, 7))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = {}
    for r in S.spans(df).where("not is_base").collect():
        places.setdefault(r.id, []).append((r.first_word, r.n_span))
    assert sorted(places[3]) == [(3 * i, 3) for i in range(50)]
    assert sorted(places[5]) == [(5 * i, 5) for i in range(30)]
    assert places[4] == [(5, 12)]


def test_every_notice_verifies_itself(spark):
    rows = scan(spark, [phrase for phrase, _ in S.NOTICES])
    for i, (phrase, label) in enumerate(S.NOTICES):
        assert label in rows[i].labels.split(",") and rows[i].score == 1.0, phrase
        assert all(S._deciding_masks(phrase)), phrase


def test_plan_has_no_python(spark, edge_docs):
    plan = S.scan(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def brute_spans(words, phrase):
    """Coverages of all verified placements of a notice: every vote may open one."""
    t = phrase.split()
    grams = [tuple(t[i:i + 2]) for i in range(len(t) - 1)]
    votes = [(p, q) for p in range(len(words) - 1) for q, g in enumerate(grams) if g == tuple(words[p:p + 2])]
    for p, q in votes:
        near = [(x, y) for x, y in votes if p <= x <= p + int(S.STRETCH * len(t)) - 2]
        chain, grown = {p - q}, True
        while grown:
            more = {x - y for x, y in near if any(abs(x - y - d) <= S.SHIFT for d in chain)}
            grown, chain = not more <= chain, chain | more
        seen = {y for x, y in near if x - y in chain}
        asked = [{y for y, g in enumerate(grams) if " ".join(g) in entry.split("|")} for entry in S.DECIDING.get(phrase, [])]
        if len(seen) / len(grams) >= S.COVER and all(a & seen for a in asked):
            yield len(seen) / len(grams)


def test_labels_equal_brute_force_on_random_placements(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 3)):
            part = rng.choice(S.NOTICES)[0].split()
            for _ in range(rng.randint(0, 3)):  # words left out, put in, or exchanged
                at = rng.randrange(len(part))
                part[at:at + rng.randint(0, 2)] = rng.choices(["the", "of", "license", "version", "2", "0", "x"], k=rng.randint(0, 2))
                part = part or ["x"]
            words += part + rng.choices(["a", "under", "the", "mit", "license"], k=rng.randint(0, 4))
        texts.append(" ".join(words))
    rows = scan(spark, texts)
    for i, text in enumerate(texts):
        words = text.split()
        by_label = {}
        for phrase, label in S.NOTICES:
            by_label.setdefault(label, []).extend(brute_spans(words, phrase))
        want = {label for label, covers in by_label.items() if covers} | set(filter(None, brute(text)[4].split(",")))
        best = max([c for covers in by_label.values() for c in covers] + [1.0] * bool(brute(text)[1]), default=0.0)
        assert set(filter(None, rows[i].labels.split(","))) == want and abs(rows[i].score - best) < 1e-9, text
