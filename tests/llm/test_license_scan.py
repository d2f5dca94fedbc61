import re
from collections import Counter

import duckdb
from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401

from lastmile.llm import license_scan as L
from lastmile.llm import twins

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows):
    """(id, words, places, labels, score) by looking at every word of every notice."""
    texts = [words_of(t) for _, t in rows]
    held = Counter(w for t in texts for w in set(t))
    rare = []
    for notice in L.NOTICES:
        words = notice.text.split(" ")
        wanted = set(sorted(set(words), key=lambda w: (held[w], w))[: L.INDEX_WORDS])
        rare.append([(w, j) for j, w in enumerate(words) if w in wanted])
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        def at(phrase, t=t):
            p = phrase.split(" ")
            return [i for i in range(len(t)) if t[i : i + len(p)] == p]

        places = {label: at(phrase) for phrase, label in L.PHRASES.items()}
        base, labels, score = {x for x, p in places.items() if p}, set(), 0.0
        for notice, index in zip(L.NOTICES, rare, strict=True):
            begins = Counter(i - j for i, x in enumerate(t) for w, j in index if w == x)
            share = max(begins.values(), default=0) / len(index)
            if share >= L.LEAST_SHARE and all(map(at, notice.phrases)):
                labels.add(notice.label)
                score = max(score, share)
        every = sorted(i for p in places.values() for i in p)
        first, last = (every[0], every[-1]) if every else (None, None)
        out.append((doc_id, len(t), len(every), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
    return Counter(out)


CASES = [
    "Released under the MIT License.",
    "# Licensed under the Apache\n# License, Version 2.0 (the \"License\")",
    "This work is licensed under the GNU General Public License, version 3. CC BY",
    "cc by cc by cc-by, all rights reserved",
    "general public general public license",
    "the mit license was released",  # its words, but not at one place
    "ﬁle CC BY İ All Rights Reserved K",
    "THIS IS free and unencumbered software released into the public domain",
    "software " * 20_000,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: x",
]


def test_query_is_brute_force(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    rows = [(r[0], r[1]) for r in edge_rows] + [(100 + k, t) for k, t in enumerate(CASES)] * 2
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, licenses string, words string")
    monkeypatch.setattr(L, "table", lambda *_: docs)
    got = Counter(map(tuple, L.op12_license_scan(spark, "").collect()))
    want = expected(rows)
    assert got == want
    labels = {r[0]: r[6] for r in want}
    assert [labels[100 + k] for k in range(6)] == ["mit", "apache-2.0", "cc-by,gpl,gpl-3.0", "cc-by,reserved", "gpl", ""]
    monkeypatch.setattr(L, "table", lambda *_: no_docs)
    assert L.op12_license_scan(spark, "").count() == 0


def test_scan_keeps_columns_and_says_where(spark):
    docs = spark.createDataFrame([(1, "x y released under the mit license", "a", "b")], "doc_id long, text string, words string, number string")
    row = L.scan(docs).first()
    assert row.asDict().keys() == {"doc_id", "words", "number", "licenses"} and (row["words"], row["number"]) == ("a", "b")
    mit = next(k for k, n in enumerate(L.NOTICES) if n.text == "released under the mit license")
    assert [tuple(x) for x in row["licenses"]["notices"]] == [(mit, 2, 1.0)]


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "all rights reserved")], "doc_id long, text string")
    plan = L.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_twin_on_cases(spark, monkeypatch):
    rows = list(enumerate([None, "", *CASES, *CASES[:3]]))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert Counter(con.execute(twins.license_scan()).fetchall()) == expected(rows)
