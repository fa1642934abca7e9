"""The trained operators: toxicity, quality rules, licences."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.llm import licences, quality, toxicity
from lorebase.llm.registry import QUERIES

SF_DIR = "/root/testdata/sf0.1"


def brute_statistics(text):
    text = text or ""
    w = text.encode().split()
    n, seen, dup = len(w), set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    inside = np.zeros(n, bool)
    for k in range(n - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            inside[k : k + 8] = True
    return n, sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, int(inside.sum())


def test_statistics(odd):
    texts = [r["text"] for r in odd.collect()] + ["a " * 9, "a b c d e f g h " * 2, "x\n\n \nx\nx", "<|#*$%&>", "é|é\né|é"]
    counts, inputs = quality.statistics(pa.array(texts))
    assert [tuple(map(int, c)) for c in counts] == [brute_statistics(t) for t in texts]
    assert np.isfinite(inputs).all()


def test_forest_isolates():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (1000, 4)), rng.normal(8, 1, (20, 4))])
    score = quality.Forest.grow(rows).score(rows)
    assert score[1000:].min() > np.quantile(score[:1000], 0.99)
    assert quality.calibrate(score, np.arange(1020) < 1000, 0.01) < score[1000:].min()
    assert np.isfinite(quality.Forest.grow(np.zeros((3, 4))).score(np.zeros((3, 4)))).all()


def test_quality_of_odd_rows(spark, odd, frame):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1)], "doc_id long, quality int")
    for model in (quality.fit(odd, labels), quality.fit(odd, labels.unionByName(spark.createDataFrame([(9, 0), (8, 1)], labels.schema)))):
        got = quality.judge(odd, model).collect()
        assert len(got) == odd.count()
        assert all(not r["kept"] for r in got if r["base_failed"])
        assert quality.judge(frame([]), model).count() == 0
    assert quality.fit(frame([]), labels.limit(0)).forest is None


def test_quality_query(spark):
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op4_quality_rules"](spark, SF_DIR).collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    good = [kept[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [kept[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.94 and np.mean(bad) < 0.35


def test_toxicity_query_on_rows_held_out(spark):
    got = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, SF_DIR).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    rows = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    toxic = [r["predicted"] for r, y in rows if y == 1]
    clean = [r["predicted"] for r, y in rows if y == 0]
    assert np.mean(toxic) > 0.65 and np.mean(clean) < 0.01
    order = sorted(rows, key=lambda x: x[0]["score"])
    rank = np.array([k for k, (_, y) in enumerate(order) if y == 1])
    auc = (rank.sum() - len(rank) * (len(rank) - 1) / 2) / (len(rank) * (len(rows) - len(rank)))
    assert auc > 0.95


def test_toxicity_of_odd_rows(spark, odd, frame):
    some = spark.createDataFrame([(6, 1), (7, 0), (4, 0), (4, 1), (9, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for labels in (some, some.limit(0), some.filter("toxic = 1")):
        model = toxicity.fit(odd, labels)
        got = odd.withColumn("out", toxicity.score_column(model, F.col("text"))).collect()
        assert len(got) == odd.count() and all(0 <= r["out"] <= 1 for r in got)
        if labels is not some:
            assert {r["out"] for r in got} == {0.5}
    assert toxicity.fit(frame([]), some).bias == 0.0


def test_weights_are_sparse_and_learnt_from_text():
    learner = toxicity.Learner(10, toxicity.FTRL(alpha=1.0, l1=1.0, epochs=1))
    rng = np.random.default_rng(0)
    for _ in range(400):
        y = int(rng.integers(0, 2))
        learner.learn(np.unique(np.append(rng.integers(10, 1024, 5), 3 if y else 4)), y, 1.0)
    w = learner.weights(np.arange(1025))
    assert w[3] > 1 and w[4] < -1 and (w == 0).mean() > 0.5


@pytest.fixture(scope="module")
def scanner(spark):
    return licences.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_licences(frame, odd, scanner):
    rows = [(k, f"some text\n{t}\nmore text") for k, ts in enumerate(licences.TEMPLATES.values()) for t in ts]
    rows += [(90, "released UNDER the mit   license"), (91, "the license under which it was released"), (92, "Licensed under nothing at all. Version 2.0 of the text.")]
    got = Counter((r["doc_id"], r["family"]) for r in licences.notices(frame(rows), scanner).collect())
    want = Counter((k, f) for k, (f, ts) in enumerate(licences.TEMPLATES.items()) for _ in ts) + Counter([(90, "mit")])
    assert got == want
    assert licences.notices(odd, scanner).count() == 0
    assert licences.notices(frame([]), scanner).count() == 0


def test_licence_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = Counter(r["doc_id"] for r in docs for line in r["text"].split("\n") if any(s in line for s in ("icensed under", "eleased under the MIT")))
    got = Counter(r["doc_id"] for r in QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.01").collect())
    assert got == want


WRAPPED = {
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation.",
    "mit": "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files (the Software)",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License);\nyou may not use this file except in compliance\nwith the License.",
}


def test_wrapped_notices(frame, scanner):
    rows = [(k, f"A title\n\n{t}\n\nmore text") for k, t in enumerate(WRAPPED.values())]
    rows += [(10 + k, "A title\n#\n# " + t.replace("\n", "\n# ") + "\nmore text follows here") for k, t in enumerate(WRAPPED.values())]
    got = {(r["doc_id"], r["line"], r["family"]) for r in licences.notices(frame(rows), scanner).collect()}
    want = {(k + d, 2, f) for d in (0, 10) for k, f in enumerate(WRAPPED)}
    assert got == want


def test_neighbouring_licences_are_not_confirmed(frame, scanner):
    other = [t.replace("GNU", f"GNU {k}") for k in ("Lesser", "Affero") for t in licences.TEMPLATES["gpl-3.0"]]
    other += ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
              "1. Redistributions of source code must retain the notice.\n2. Redistributions in binary form must\nreproduce the notice."]  # fmt: skip
    other += ["Licensed under the BSD 2-Clause License.", "Licensed under CC BY-SA 4.0.", "Licensed under the Apache License, Version 1.1."]
    assert licences.notices(frame(list(enumerate(other))), scanner).collect() == []


def test_hints_change_nothing(spark, frame):
    known = licences.templates(spark)
    said = licences.hints(known)
    runs = [r["run"] for r in known.selectExpr("explode(runs) AS run").collect()]
    assert all(r in said or set(r.split(" ")) & set(said) for r in runs) and len(said) < len(set(runs))
    rows = [(k, t) for k, t in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)]
    rows += [(100 + k, t.upper().replace(" ", "\n\n" if k % 2 else "\n", 3)) for k, t in rows]
    rows += [(200 + k, " ".join(t.split()[1:5])) for k, t in rows[:16]] + [(300, "the and of with or"), (301, None), (302, "LICENSE\nthe\nsoftware")]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for docs in (frame(rows), given):
        both = [sorted(map(str, licences.candidates(docs, known, "doc_id", "text", hinted=h).collect())) for h in (True, False)]
        assert both[0] == both[1] and both[0]


def test_learning_rows_are_bounded_whatever_ids_repeat(spark, frame):
    """One labelled id in most rows: the bound is on rows, not on ids."""
    docs = frame([(1, f"bad word {k} " * 9) for k in range(300)] + [(k, f"good text {k} " * 9) for k in range(2, 40)])
    labels = spark.createDataFrame([(k, int(k == 1), int(k != 1)) for k in range(1, 40)], "doc_id long, toxic int, quality int")
    seen = []
    learn, grow = toxicity.materialize, quality.Forest.grow
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "materialize", lambda df, *a: seen.append(learn(df, *a)) or seen[-1])
        m.setattr(quality.Forest, "grow", lambda rows, *a: seen.append(rows) or grow(rows, *a))
        toxicity.fit(docs, labels, max_rows=60)
        quality.fit(docs, labels, max_rows=60)
    assert seen[-2].count() == 60 and len(seen[-1]) == 60


def test_licences_learn_from_every_line_of_every_text(spark, frame):
    texts = [(k, f"the words of a line that is given in the text {k}\nlicensed under the sky {k % 3}") for k in range(900)]
    known = licences.templates(spark)
    vocabulary = sorted({t for r in known.select(licences.features(F.col("words")).alias("t")).collect() for t in r["t"]})
    lines = licences.corpus_lines(frame(texts).select("text"), known, vocabulary, 1e9).groupBy("near").agg(F.sum("weight").alias("n")).collect()
    assert {r["near"]: r["n"] for r in lines} == {False: 900.0, True: 900.0}
    lines = licences.corpus_lines(frame(texts).select("text"), known, vocabulary, 90).agg(F.sum("weight")).first()[0]
    assert abs(lines - 180) < 1e-6


def test_notices_read_the_texts_once(spark, frame, scanner, tmp_path):
    frame([(1, "Released under the MIT License."), (2, "other")]).write.parquet(f"{tmp_path}/read-me")
    found = licences.notices(spark.read.parquet(f"{tmp_path}/read-me"), scanner)
    assert str(found._jdf.queryExecution().executedPlan()).count("read-me") <= 1
    assert [(r["doc_id"], r["family"]) for r in found.collect()] == [(1, "mit")]
