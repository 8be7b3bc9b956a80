"""op3: base places against brute force; merged diagonals on edited license texts."""

import random
import re

import duckdb

from pairwell.llm import license_scan, queries, runtime

SF = "/root/testdata/sf0.01"


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def loose(text, drift=3, least=0.7):
    """Labels and the best score, by all matches of a template's grams, diagonal by diagonal."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low), []
    for template, label in license_scan.TEMPLATES:
        t = template.split()
        k = min(3, len(t))
        votes = sorted((i - j, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k])
        spans, last = [], None
        for d, j in votes:
            if last is None or d - last > min(drift, len(t) - 1):
                spans.append(set())
            spans[-1].update(range(j, j + k))
            last = d
        found += [(label, len(x) / len(t)) for x in spans if len(x) / len(t) >= least]
    base = brute(text)[4]
    labels = sorted({x for x, _ in found} | set(filter(None, base.split(","))))
    return ",".join(labels), max([x for _, x in found] + [1.0] * bool(base), default=0.0)


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_made_texts(spark):
    rng = random.Random(3)
    pool = ["MIT", "license", "License,", "apache", "General", "Public", "x", "é", "public\n", "of the", "K", "İ", "mit-license", "gnu"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "--", "mit", "MIT LICENSE", "licenKe", "mit license " * 3000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, w string, row int")
    found = license_scan.scan(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.labels, r.score) == loose(texts[r.doc_id])
        assert base(r) == brute(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_edited_templates(spark):
    rng, texts = random.Random(8), []
    for _ in range(150):
        w = rng.choice(license_scan.TEMPLATES)[0].split()
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(3)] = rng.choice([[], ["foreign"], w[max(0, i - 3) : i], w[:3], ["x"] * rng.randrange(6)])
        texts.append(" ".join(["a"] * rng.randrange(4) + w * rng.randrange(1, 3)))
    gpl = license_scan.TEMPLATES[3][0].split()
    texts.append(" ".join(gpl[:9] + gpl[6:9] + gpl[9:]))  # its own words again, a shift within the drift
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    assert found == {i: loose(t) for i, t in enumerate(texts)}
    assert found[len(texts) - 1] == ("gpl,gpl-text", 1.0)


def test_templates(spark):
    text = license_scan.TEMPLATES[3][0].split()
    edited = " ".join(["intro"] * 50 + text[:9] + ["really"] + text[9:15] + text[17:] + ["outro"] * 30)
    half = " ".join(text[:8] + ["and"] * 9)
    docs = spark.createDataFrame([(1, " ".join(text).upper()), (2, edited), (2, edited), (3, half), (None, "All rights reserved.")], "doc_id long, text string")
    rows = license_scan.scan(docs).collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == 5 and score[1] == 1.0 and 0.7 < score[2] <= 1.0 and score[3] == 0.0 and score[None] == 1.0
    assert {r.doc_id: r.labels for r in rows} == {1: "gpl,gpl-text", 2: "gpl,gpl-text", 3: "", None: "all-rights-reserved"}
    (span,) = [s for r in rows if r.doc_id == 1 for s in r.spans if s.label == "gpl-text"]
    assert (span.start, span.end) == (0, len(text))
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_long_templates_go_in_pieces(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = spark.createDataFrame([(1, "a b " + long), (2, long[:300])], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(docs, templates=[(long, "long")]).collect()}
    assert rows[1].labels == "long" and len(rows[1].spans) == 3


def test_query(spark):
    texts = {r.doc_id: r.text for r in runtime.table(spark, SF, "documents").collect()}
    rows = queries.op3_license_scan(spark, SF).collect()
    assert len(rows) == len(texts) and all(base(r) == brute(texts[r.doc_id]) for r in rows) and any(r.n_base for r in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLE["op3_license_scan"])
    names = [c[0] for c in cursor.description]
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == sorted(map(tuple, cursor.fetchall()), key=str)
    assert sorted(names) == sorted(rows[0].__fields__)
