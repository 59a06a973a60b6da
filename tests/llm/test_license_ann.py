import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, license_scan, queries


def test_licences_and_inheritance(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        ("a/LICENSE", mit),
        ("a/b/LICENSE", "Released under the MIT License\nLicensed under the Apache License, Version 2.0"),
        ("a/b/c/x.py", "code\n" * 50),
        ("a/y.py", "more code"),
        ("a/z.py", "// Licensed under the Apache License, Version 2.0 //\n" + "lots of other words in this file " * 90),
        ("q/x.py", "nothing here"),
        ("ab/x.py", "nothing here"),
        ("a/b/c/x.py", "code\n" * 50),
        (None, "All rights reserved."),
        (None, None),
        ("n", ""),
        ("top", "word " * 40_000),
    ]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 AS row", "2 AS license")
    got = license_scan.scan(df).collect()
    assert len(got) == len(rows)
    by = {r["path"]: (r["license"], r["method"], r["declared_in"]) for r in got}
    assert by["a/LICENSE"] == ("MIT", "file", None) and by["a/y.py"] == ("MIT", "inherited", "a/LICENSE")
    assert by["a/b/LICENSE"][1] == "file" and by["a/b/c/x.py"] == (by["a/b/LICENSE"][0], "inherited", "a/b/LICENSE")
    assert by["a/z.py"] == ("Apache-2.0", "header", None) and by["q/x.py"] == by["ab/x.py"] == by["n"] == by["top"] == (None, "none", None)
    assert ("Proprietary", "file") in {(r["license"], r["method"]) for r in got if r["path"] is None}
    assert license_scan.scan(df.limit(0)).count() == 0


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""
BSD = """Redistribution and use in source and binary forms, with or
without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice
"""


def test_wrapped_notices_identifiers_and_titles(spark):
    code = "int main() { return value; }\n" * 40
    rows = [
        ("p/a.c", f"/* {GPL} */\n{code}"), ("p/b.py", f"{APACHE}{code}"), ("p/c.py", f"// SPDX-License-Identifier: MPL-2.0\n{code}"), ("p/d", f"Copyright 2020 Some Body Inc. All rights reserved.\n{code}"), ("p/e.c", f"{BSD}{code}"),
        ("p/f.c", f"// SPDX-License-Identifier: GPL-2.0\n{code}"), ("q/LICENSE", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\n" + "Everyone is permitted to copy and distribute verbatim copies.\n" * 300), ("q/src/deep/x.c", code), ("r/x.c", code),
        ("q/y.c", "the public version of a general foundation, either software or work"),
    ]
    got = {r["path"]: (r["license"], r["method"]) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    want = {"p/a.c": "GPL-3.0", "p/b.py": "Apache-2.0", "p/c.py": "MPL-2.0", "p/d": "Proprietary", "p/e.c": "BSD-3-Clause", "p/f.c": "GPL-2.0"}
    assert {p: got[p] for p in want} == {p: (x, "header") for p, x in want.items()}
    assert got["q/LICENSE"] == ("GPL-3.0", "file") and got["q/src/deep/x.c"] == got["q/y.c"] == ("GPL-3.0", "inherited") and got["r/x.c"] == (None, "none")


def test_root_declaration_and_deep_paths(spark):
    rows = [("LICENSE", "Released under the MIT License"), ("a/b/LICENSE", "Released under the MIT License"), ("a/" * 3000 + "x", "nothing"), ("a/b/" + "c/" * 3000 + "x", "nothing"), ("y", None), (None, "nothing")]
    got = {r["path"]: r["declared_in"] for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/" * 3000 + "x"] == got["y"] == "LICENSE" and got["a/b/" + "c/" * 3000 + "x"] == "a/b/LICENSE" and got[None] is None


def test_runs_against_sql(spark):
    r = np.random.default_rng(7)
    parts = [x for t in (APACHE, GPL, BSD, "The MIT License (MIT)\n", "All rights reserved. ", "Other words stand here\n", "\n", "of the public license. ") for x in t.splitlines(keepends=True)]
    filler = lambda i: " ".join(f"word{k}" for k in range(400)) * (i % 3 > 0)
    rows = [(f"{'abc'[i % 3]}/{i % 5}/{i}", "".join(r.choice(parts, r.integers(0, 25) if i % 7 else 0)) + filler(i)) for i in range(150)]
    frame = pd.DataFrame(rows, columns=["path", "text"])
    want = duckdb.connect().sql(license_scan.scan_sql("SELECT * FROM frame")).fetchall()
    got = [tuple(x) for x in license_scan.scan(spark.createDataFrame(frame)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {x[2] for x in got} == {"file", "header", "inherited", "none"}


def test_anchors_bound_the_cosine():
    _, _, vectors = license_scan.weights([t for _, t, _ in license_scan.ALL])
    need = set(license_scan.anchors(vectors, 0.75))
    assert all(sum(w * w for t, w in v.items() if t not in need) < 0.75**2 for v in vectors)


@pytest.mark.parametrize("name", ["op1_license_scan", "op7_ann", "op9_url_filter"])
def test_oracles(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = queries.QUERIES[name](spark, d).toPandas()
    want = c.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    clean = lambda x: sorted(tuple(None if v != v else v for v in r) for r in x.astype(object).itertuples(index=False, name=None))
    assert str(clean(got)) == str(clean(want)) or [tuple(map(str, r)) for r in sorted(map(str, clean(got)))] == [tuple(map(str, r)) for r in sorted(map(str, clean(want)))]


def brute(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            near = sorted(((-float(np.cumsum(ok[q] * v)[-1]), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_search_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=48).round(3).tolist()) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(60)]  # copies: ties go to smaller ids
    rows += [(1000, None), (1020, []), (1040, [0.0] * 48), (1060, [1.0, None] + [0.5] * 46), (1080, [float("nan")] * 48), (1100, [float("inf")] + [1.0] * 47), (1120, [1.0] * 7), (1121, [2.0] * 7), (None, [1.0] * 48)]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {}
    for x in ann.search(df, query=F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    want = brute(exact, 20)
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values())) and got[20] == want[20] and got[1120] == [(1121, 14.0)]
    assert ann.search(df.where("vec_id = 1"), query=F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.0]), (20, [0.0, 3.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query=F.col("vec_id") % 20 == 0, k=20)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    assert got == sorted([(20, 1, 1, 1.0), (20, 2, 2, 0.5), (20, 3, 1, 0.0), (20, 4, 20, 0.0), (20, 1, 1, 3.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 20, 0.0)])


def test_codes_choose_what_is_computed(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(6000, 32)) + 0.7
    got = ann.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), query=F.col("vec_id") % 2000 == 0, k=10).collect()
    want = set()
    for q in (0, 2000, 4000):
        score = np.where(np.arange(len(v)) == q, -np.inf, v @ v[q])
        want |= {(q, k + 1, i) for k, i in enumerate(np.argsort(-score)[:10].tolist())}
    assert {(x["query_id"], x["rank"], x["vec_id"]) for x in got} == want
    assert all(x["n_exact"] < 0.2 * len(v) for x in got)


def test_estimates_lie_within_their_bounds():
    r = np.random.default_rng(5)
    v, q = r.normal(size=(3000, 100)) * r.uniform(0.1, 9, (3000, 1)) + 2, r.normal(size=100)
    turn, centre = ann.rotation(100), v.mean(0)
    value, bound = ann.Codes(*ann.encode(v, centre, turn), ann.WIDEN * 100).estimate(q / np.linalg.norm(q) @ turn)
    assert (np.abs(value - (v - centre) @ q / np.linalg.norm(q)) <= bound).mean() > 0.99
    assert bound.mean() < 0.2 * np.linalg.norm(v - centre, axis=1).mean()
