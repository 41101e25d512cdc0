"""Operators that SQL can express, and the native ones against brute force."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import op1_fingerprint, op2_revisits, op4_url_rules, op5_licenses, op6_pii


def plain(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


def compare(df, sql, **tables):
    con = duckdb.connect()
    for name, source in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert plain(df.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Arrow|Pandas", plan)


DOCS = "doc_id long, text string"


def save(spark, tmp_path, name, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return f"{tmp_path}/{name}.parquet/*.parquet"


# 1


def words_of(text):
    return re.split(r"[\x20\x09-\x0D]+", (text or "").strip("\t\n\x0b\f\r ").lower())


def generalised_jaccard(a, b):
    a, b = words_of(a), words_of(b)
    keys = set(a) | set(b)
    return sum(min(a.count(k), b.count(k)) for k in keys) / sum(max(a.count(k), b.count(k)) for k in keys)


def test_fingerprints_estimate_generalised_jaccard(spark):
    rng = np.random.default_rng(3)
    # Pairs of neighbours have words of their own, so that their errors are independent.
    rows = [(i, " ".join(f"w{i // 2}_{x}" for x in rng.zipf(1.4, 300) % 400)) for i in range(120)]
    df = op1_fingerprint.edited_likeness(spark.createDataFrame(rows, DOCS), parts=3)
    assert native(df)
    got = {r["doc_id"]: r for r in df.collect()}
    texts = [t for _, t in rows]
    errors, next_errors = [], []
    for i, text in rows:
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(got[i]["near_edited"] - generalised_jaccard(text, edited))
        next_errors.append(got[i]["near_next"] - generalised_jaccard(text, after))
    k = op1_fingerprint.K
    for e in (errors, next_errors):
        assert abs(np.mean(e)) < 4 * 0.5 / np.sqrt(k * len(e)) and np.sqrt(np.mean(np.square(e))) < 0.6 / np.sqrt(k)


def test_fingerprints_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Ä é 😀 x"), (4, "Ä é 😀 x"), (None, "a"), (9, "x " * 30000)]
    got = op1_fingerprint.edited_likeness(spark.createDataFrame(rows, DOCS), parts=2).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == by[3][0]["fingerprint"] != by[None][0]["fingerprint"]
    assert by[1][0]["near_next"] == 1.0 and len({r["fingerprint"] for r in by[4]}) == 1
    assert by[9][0]["n_chars"] == 60000 and by[9][0]["edited_sha256"] == hashlib.sha256(("x " * 30000)[:30000].encode() + b"a").hexdigest()
    one = op1_fingerprint.edited_likeness(spark.createDataFrame([(5, "a b c")], DOCS)).first()
    assert one["near_next"] == 1.0
    assert op1_fingerprint.edited_likeness(spark.createDataFrame([], DOCS)).count() == 0


def slow_fingerprint(text, k):
    """The sampler word by word: Spark hashes a string, long or int as xxHash64 of its bytes."""
    words = words_of(text.lower()) or [""]
    out = []
    for j in range(k):
        best = None
        for w in sorted(set(words)):
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            h_bytes = h.to_bytes(8, "little")
            x, z = (xxhash.xxh64_intdigest((op1_fingerprint.SEED + 2 * j + i).to_bytes(4, "little"), xxhash.xxh64_intdigest(h_bytes, 42)) for i in (0, 1))
            unit = lambda bits, n: (bits + 0.5) / (1 << n)
            r = -math.log(unit(x >> 43, 21) * unit(x >> 22 & (1 << 21) - 1, 21))
            beta = unit(x & (1 << 21) - 1, 21)
            log_c = math.log(-math.log(unit(z >> 32, 32) * unit(z & (1 << 32) - 1, 32)))
            t = math.floor(math.log(words.count(w)) / r + beta)
            rank = int((log_c - r * (t - beta) - r + 96.0) * (1 << 24))
            key = rank << 32 | (z ^ t << 11) & (1 << 32) - 1
            best = key if best is None else min(best, key)
        out.append(f"{best & (1 << 32) - 1:08x}")
    return "".join(out)


def test_fingerprints_equal_the_slow_sampler(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(str(x) for x in rng.zipf(1.5, 60) % 50)) for i in range(20)] + [(30, "Ä ä x"), (31, "")]
    got = op1_fingerprint.edited_likeness(spark.createDataFrame(rows, DOCS), parts=3).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: slow_fingerprint(t, op1_fingerprint.K) for i, t in rows}


@pytest.mark.parametrize("odd", [[], [None] * 300, [10**15], [7] * 900, [None, 10**15, -(10**15)] * 50])
def test_buckets_are_about_equal_whatever_the_ids(spark, odd):
    rows = [(k, f"text {i}") for i, k in enumerate([*range(1000), *odd])]
    df = spark.createDataFrame(rows, DOCS).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie")).repartition(5)
    got = op1_fingerprint.ordered_buckets(df, "key", "tie", 8)
    sizes = [r["count"] for r in got.groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) + len(sizes) and max(sizes) <= 4 * len(rows) / 8
    placed = sorted((r["bucket"], r["guest"], r["key"], r["tie"]) for r in got.collect())
    own = [(k, t) for _, guest, k, t in placed if not guest]
    assert own == sorted(own) and sum(guest for _, guest, _, _ in placed) == len(sizes)


def test_each_text_is_followed_by_the_next(spark):
    """Repeated rows, ids and null ids: every row against a plain loop over the sorted rows, however they lie."""
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "other words"), (None, "n one two"), (None, "n three four"), (None, "n one two"), (5, "x y z"), (9, None), (9, "")]
    for n in (1, 4):
        df = spark.createDataFrame(rows, DOCS).repartition(n)
        got = op1_fingerprint.edited_likeness(df, parts=4).collect()
        hashed = spark.createDataFrame(rows, DOCS).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t", F.col("doc_id").isNull())).collect()
        order = sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["h"], r["t"], r["doc_id"]) for r in hashed)
        want = []
        for i, (_, _, t, k) in enumerate(order):
            after = order[(i + 1) % len(order)][2]
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            same = sum(a == b for a, b in zip(*(re.findall("." * 8, slow_fingerprint(x, op1_fingerprint.K)) for x in (t, after)), strict=True))
            want.append((str(k), len(t), hashlib.sha256(edited.encode()).hexdigest(), slow_fingerprint(edited, op1_fingerprint.K), same / op1_fingerprint.K))
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["edited_fingerprint"], r["near_next"]) for r in got) == sorted(want)


# 2


def test_revisits_equal_sql(spark, small):
    compare(op2_revisits.query(spark, small), op2_revisits.ORACLE_SQL, pages=f"{small}/pages.parquet")


def test_revisits_by_validators_and_time(spark):
    shape = "id long, url string, time long, headers map<string,string>"
    full = [(1, "a", 10, {"etag": '"1"', "content-length": "5", "x": "old"}), (2, "a", 20, {"etag": '"2"', "last-modified": "d"}), (3, "b", 5, {"last-modified": "d1"}), (4, None, 1, {}), (5, "a", 20, {"etag": '"3"'}), (6, "c", None, {"etag": '"1"'})]
    asked = [
        (11, "a", 15, {"etag": 'W/"1"', "content-length": "0", "x": "new", "age": "3"}),
        (12, "a", 20, {"etag": '"1"'}),  # the response of the same moment isn't earlier
        (13, "a", 25, {"etag": '"2"'}),  # the greater id counts
        (14, "b", 9, {"last-modified": "d1"}),
        (15, "b", 9, {}),
        (16, "b", 1, {"last-modified": "d1"}),
        (17, None, 9, {"etag": '"1"'}),
        (18, "c", 9, {"etag": '"1"'}),
        (18, "c", 9, {"etag": '"1"'}),
    ]
    for chunks in (1, 3, 64):
        df = op2_revisits.resolve(spark.createDataFrame(full, shape), spark.createDataFrame(asked, shape), chunks)
        got = sorted((r["id"], r["status"], r["response_id"]) for r in df.collect())
        assert got == [(11, "resolved", 1), (12, "resolved", 1), (13, "changed", None), (14, "resolved", 3), (15, "unchecked", None), (16, "orphan", None), (17, "orphan", None), (18, "orphan", None), (18, "orphan", None)]
    head = next(r for r in df.collect() if r["id"] == 11)["headers"]
    assert head == {"etag": 'W/"1"', "content-length": "5", "x": "new", "age": "3"}
    assert op2_revisits.resolve(spark.createDataFrame([(1, "a", 10, None), (9, "a", 10**15, {})], shape), spark.createDataFrame([(2, "a", 11, None), (3, "a", 12, {"etag": "x"})], shape)).select("status").collect() == [("unchecked",), ("changed",)]
    none = spark.createDataFrame([], shape)
    assert op2_revisits.resolve(none, spark.createDataFrame(asked, shape)).where("status = 'orphan'").count() == 9
    assert op2_revisits.resolve(none, none).count() == 0


def test_revisits_of_a_hot_url_are_spread(spark):
    """One URL, half of the captures without one, a date far out, a very long URL and header: what meets in a window stays small."""
    shape = "id long, url string, time long, headers map<string,string>"
    long = "u" * 300_000
    full = [(i, "hot", 1000 + i, {"etag": f"{i}"}) for i in range(3000)] + [(9000, "hot", 10**15, {"etag": "far"}), (9001, long, 5, {"etag": "e", "x": "y" * 300_000})]
    asked = [(10_000 + i, "hot", 1000 + i + 1, {"etag": f"{i}"}) for i in range(3000)] + [(20_000 + i, None, i, None) for i in range(3000)] + [(30_000, long, 6, {"etag": "e"})]
    df = op2_revisits.resolve(spark.createDataFrame(full, shape), spark.createDataFrame(asked, shape), 32)
    got = {r["id"]: (r["status"], r["response_id"]) for r in df.select("id", "status", "response_id").collect()}
    assert got == {**{10_000 + i: ("resolved", i) for i in range(3000)}, **{20_000 + i: ("orphan", None) for i in range(3000)}, 30_000: ("resolved", 9001)}


@pytest.mark.parametrize(
    "url, want",
    [("HTTP://WWW.A.org:80/x/?b=2&utm_source=q&a=1#f", "www.a.org/x?a=1&b=2"), ("https://a.org", "a.org"), ("https://a.org/", "a.org"), ("a.org/P?", "a.org/P"), ("http://a.org:8080/?ref=1", "a.org:8080"), (None, None)],
)
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(op2_revisits.canonical_url(F.col("u"))).first()[0] == want


def test_warc_records(spark):
    def record(ident, kind, date, http, more=""):
        return ident, f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: <http://WWW.a.org/x/#f>\r\nWARC-Date: {date}\r\n{more}\r\n", http

    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n"
    rows = [
        record(1, "response", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "a"\r\nX-Long: one\r\n two\r\nContent-Length: 9\r\nVary: x\r\nVary: y\r\n\r\nbody: no field'),
        record(2, "revisit", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\nETag: W/"a"\nAge: 5\n', profile),
        record(3, "revisit", "2023-12-31T00:00:00Z", "HTTP/1.1 304 Not Modified\r\n\r\n", profile),
        record(4, "response", "2024-01-01T12:00:00Z", "HTTP/1.1 304 Not Modified\r\n\r\n"),
        record(5, "request", "2024-01-01T12:00:00Z", None),
        record(6, "revisit", "no date", "HTTP/1.1 304 Not Modified\r\nETag: \"a\"", profile),
        (7, None, None),
    ]
    responses, revisits = op2_revisits.from_records(spark.createDataFrame(rows, "id long, warc string, http string"))
    assert [r["id"] for r in responses.collect()] == [1]
    got = {r["id"]: r for r in op2_revisits.resolve(responses, revisits).collect()}
    assert {k: r["status"] for k, r in got.items()} == {2: "resolved", 3: "orphan", 6: "orphan"}
    assert got[2]["headers"] == {"etag": 'W/"a"', "x-long": "one two", "content-length": "9", "vary": "y", "age": "5"} and got[2]["url"] == "www.a.org/x"


# 4


def test_url_rules_equal_sql(spark, small):
    compare(op4_url_rules.query(spark, small), op4_url_rules.ORACLE_SQL, pages=f"{small}/pages.parquet")


def test_url_rules_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    hosts = [".".join(x) for x in ((("a", "b", "c")[i], ("org", "x.org", "com")[j]) for i in range(3) for j in range(3))] + ["org", "x.org", "com", "orgx", "axorg"]
    paths = ["/", "/p", "/p/q", "/pq", "", "/p/q/r?x#y"]
    urls = [f"http{'s' * (i % 2)}://{hosts[i % len(hosts)]}{paths[int(rng.integers(len(paths)))]}" for i in range(600)] + [None, "no scheme", "HTTP://A.ORG/P", "x://", "http://org"] + ["http://hot.x.org/p/q"] * 500
    rules = [("allow", "org", "/"), ("block", "x.org", "/p"), ("allow", "x.org", "/p/q"), ("block", "a.x.org", "/p"), ("block", "com", ""), ("allow", "c.com", "/p/q"), ("block", "org", "/p/q/"), ("block", "zz", "/")]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(5)

    def want(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fit = [(len(h), len(p), f"{h}{p}", v) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        return host, path, *(max(fit)[2:] if fit else (None, "allow"))

    for parts in (1, 7):
        got = op4_url_rules.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), parts=parts).collect()
        assert len(got) == len(urls)
        for r in got:
            assert tuple(r)[1:] == want(urls[r["page_id"]]), urls[r["page_id"]]
    assert op4_url_rules.judge(pages.limit(0), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0
    no_rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert op4_url_rules.judge(pages, no_rules).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_odd_columns_and_long_urls(spark):
    """Columns with the names that the operators use, and a URL and path of a megabyte."""
    long = "http://a.example.org/es/" + "x" * 1_000_000
    pages = spark.createDataFrame([(1, long, "x", 2), (2, None, "y", 3)], "page_id long, url string, host string, Key int").withColumn("ident", F.lit(1))
    rules = spark.createDataFrame(list(op4_url_rules.RULES), "verdict string, host string, path string").withColumns({"key": F.lit(1), "kind": F.lit("x")})
    got = {r["page_id"]: (r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in op4_url_rules.judge(pages, rules).collect()}
    assert got == {1: ("a.example.org", 1_000_004, "example.org/es/", "block"), 2: ("", 0, None, "allow")}
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], DOCS).withColumns({c: F.lit("z") for c in ("key", "tie", "bucket", "guest", "at", "kind", "signature", "copies", "n_chars")})
    assert sorted(r["doc_id"] for r in op1_fingerprint.edited_likeness(docs).collect()) == [1, 2]
    shape = "id long, url string, time long, headers map<string,string>"
    full = spark.createDataFrame([(1, "u", 1, {"etag": "x"})], shape).withColumns({"chunk": F.lit("c"), "hit": F.lit(1), "kind": F.lit(2)})
    asked = spark.createDataFrame([(2, "u", 2, {"etag": "x"})], shape).withColumns({"status": F.lit("c"), "near": F.lit(1)})
    assert [(r["id"], r["status"]) for r in op2_revisits.resolve(full, asked).collect()] == [(2, "resolved")]


# 5


def test_licenses_equal_sql(spark, small):
    df = op5_licenses.query(spark, small)
    assert native(df)
    compare(df, op5_licenses.ORACLE_SQL, documents=f"{small}/documents.parquet")


def test_license_rules(spark, tmp_path):
    head = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
    rows = [
        (1, head + "You may obtain a copy of the License at\n\nhttp://x.org/2\n\nSee nothing."),
        (2, "Text. Released under the MIT License. More text."),
        (3, "This program is free software: one, two. three. four. you can redistribute it"),
        (4, None),
        (5, ""),
        (6, "  LICENSED   under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.\nreleased under the mit license"),
        (6, "a license. " * 5000 + "Released under the MIT License."),
        (7, "unreleased under the MIT License"),
    ]
    path = save(spark, tmp_path, "documents", rows, DOCS)
    df = op5_licenses.query(spark, str(tmp_path))
    got = sorted((r["doc_id"], r["n_known"], r["licenses"]) for r in df.collect())
    assert got == [(1, 3, "Apache-2.0"), (2, 1, "MIT"), (3, 1, ""), (4, 0, ""), (5, 0, ""), (6, 1, "MIT"), (6, 3, "CC-BY-NC-4.0,CC-BY-NC-4.0,MIT"), (7, 0, "")]
    one = [r for r in rows if r[0] != 6]
    compare(op5_licenses.scan(spark.createDataFrame(one, DOCS)).drop("text"), op5_licenses.ORACLE_SQL, documents=save(spark, tmp_path / "x", "documents", one, DOCS))
    assert op5_licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    clash = op5_licenses.scan(spark.createDataFrame([(1, "Released under the MIT License.", 5, "x")], f"{DOCS}, Line int, known string")).first()
    assert (clash["Line"], clash["known"], clash["licenses"]) == (5, "mit-released", "MIT")
    assert all(any(c in s for c in op5_licenses.CUES) for _, s in op5_licenses.SENTENCES)
    assert path


WRAPPED = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "BSD-2-Clause": """Copyright (c) 2020, A B
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License
as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2
as published by
the Free Software Foundation.
""",
    "GPL-3.0-only": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License
as published by
the Free Software Foundation, version 3 of
the License.
""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify
it under the terms of the GNU Lesser
General Public License
as published by
the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""",
    "LGPL-2.1-only": """This library is free software; you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License version
2.1 as published by
the Free Software Foundation.
""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License
as published by
the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.
""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License
as published by
the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.
""",
    "AGPL-3.0-only": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License,
as published by
the Free Software Foundation, version 3.
""",
    "Apache-2.0": """Copyright 2020 A B

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
""",
    "BSD-4-Clause": """1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by A.
""",
    "BSL-1.0": """Copyright A 2006.
Distributed under the Boost Software License,
Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS".
""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "Unlicense": """This is free and unencumbered software released into the
public domain.
""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all
copyright and related and neighboring rights to this software to the
public domain worldwide.
""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so.
""",
    "OFL-1.1": """This Font Software is licensed under the SIL Open Font License,
Version 1.1.
""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its
documentation for any purpose, without fee, and without a written agreement
is hereby granted, provided that the above copyright notice and this paragraph
and the following two paragraphs appear in all copies.
""",
    "CDDL-1.0": """The contents of this file are subject to the terms of the
Common Development and Distribution License (the "License").
You may not use this file except in compliance with the License.
""",
    "WTFPL": """This program is free software. It comes without any warranty, to
the extent permitted by applicable law. You can redistribute it
and/or modify it under the terms of the Do What The Fuck You Want
To Public License, Version 2, as published by Sam Hocevar.
""",
    "GPL-3.0-or-later": """a.py is a part of B

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""",
}


def test_wrapped_licenses(spark):
    marks = ("", "# ", " * ", "// ", "\t")
    rows = [(name, "\r\n".join(m + x for x in text.split("\n")) if m == "// " else "\n".join(m + x for x in text.split("\n"))) for name, text in WRAPPED.items() for m in marks]
    rows += [
        ("MIT", "Title\nReleased under the MIT License\nno stop, one more line\nand one"),
        ("Apache-2.0", 'Licensed under the Apache License,\nVersion 2.0 (the "License")\nother words\non three\nlines;\nyou may not use this file except\nin compliance with the License.'),
        ("", "unreleased\nunder the MIT License\nor released under the MIT\nLicense"),
        ("", "Released under the\n\nMIT License"),
        ("MIT", "word\n" * 20_000 + "Released under\nthe MIT License" + "\n" * 20_000 + "\x01\x02"),
    ]
    df = op5_licenses.scan(spark.createDataFrame(rows, "want string, text string"))
    assert native(df)
    got = df.collect()
    assert [r["licenses"] for r in got] == [r["want"] for r in got]
    assert got[-4]["known"] == "apache-notice-the,apache-compliance"
    assert len(WRAPPED) > 25
    for name in ("MIT", "GPL-3.0-or-later"):
        assert {r["n_known"] for r in got[: 5 * len(WRAPPED)] if r["want"] == name} == {2}


def words_and_ends(text):
    """The words of a text, each with whether a sentence may end after it and begin before it, by a plain loop."""
    out, at = [], 0
    text = re.sub(r"(?i)(spdx-license-identifier):[ \t]*", r"\1 ", text)
    for m in re.finditer(r"[^\W_]+", text):
        gap = text[at : m.start()]
        hard = bool(re.search(r"[.!?;:][ \t\r\n]", gap)) or gap.count("\n") > 1
        out.append((m[0].lower(), hard, "\n" in gap or not out))
        at = m.end()
    return out


def test_wrapped_licenses_equal_a_search_over_words(spark):
    """Every known sentence in the stream of words, wherever its words stand between two ends."""
    rng = np.random.default_rng(4)
    texts = []
    for name, text in WRAPPED.items():
        words = text.replace("\n\n", " \x00 ").split()
        for width in (30, 57, 100):
            lines, line = [], ""
            for w in words:
                if w == "\x00" or len(line) + len(w) > width:
                    lines += [line, ""] if w == "\x00" else [line]
                    line = "" if w == "\x00" else w
                else:
                    line = f"{line} {w}".strip()
            texts.append((name, "\n".join(f"{rng.choice(['# ', '// ', ''])}{x}" for x in [*lines, line])))
    texts += [(t, f"x = 1\n// SPDX-License-Identifier: {t}\nint y;") for t in op5_licenses.TAGS] + [("", "SPDX-License-Identifier: MITX\n"), ("", "MIT")]
    got = op5_licenses.scan(spark.createDataFrame(texts, "want string, text string")).collect()
    assert [r["licenses"] for r in got] == [r["want"] for r in got]
    sentences = {tuple(w.split()): i for i, w in op5_licenses.SENTENCES}
    for r in got:
        stream, found, k = words_and_ends(r["text"]), [], 0
        begins = [hard or line for _, hard, line in stream] + [True]
        while k < len(stream):
            fit = [s for s in sentences if tuple(w for w, _, _ in stream[k : k + len(s)]) == s and begins[k] and begins[k + len(s)] and not any(h for _, h, _ in stream[k + 1 : k + len(s)])]
            if fit:
                found.append(sentences[max(fit, key=len)])
                k += max(map(len, fit))
            else:
                k += 1
        assert r["known"] == ",".join(found), r["text"]


def test_license_cues_are_blind_to_signs_and_spaces(spark, tmp_path):
    rows = [(1, "This program is  free software"), (2, "This program is *free* software."), (3, "This program is\tfree software"), (4, "This program is free"), (5, "Software.")]
    path = save(spark, tmp_path, "documents", rows, DOCS)
    df = op5_licenses.query(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["n_known"]) for r in df.collect()) == [(1, 1), (2, 1), (3, 1), (4, 0), (5, 0)]
    compare(df, op5_licenses.ORACLE_SQL, documents=path)


# 6

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


ODD = [
    "a@b.c_d@e.f x+y@z.com.", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111-2 5 4111111111111111", "+1 (212) 555-0100 call +49 30 123456 +1", "é😀 a@b.co 😀 +12345678901", "", None,
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4111111111111111", "11.22.33.44 @a.b a@b..c a@b.c- x@-.-", "12345678901234567890123 4111 1111  1111 1111", "4111111111111111@x.de 1.2.3.4@5.6", "+1+2+34567890123 +(1) +1)))))", "5.1.2.3.4", "a" * 20_000, "1" * 50_000, "a@" + "b." * 20_000 + "c", "1." * 30_000 + "1", "x@y.z " * 500, "+1 " * 5000,
]


def test_base_spans_equal_brute_force(spark, small):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = op6_pii.find(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        got = [f"{op6_pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]]
        assert got == base_spans(texts[r["doc_id"]]), (texts[r["doc_id"]] or "")[:80]


def test_query_counts_each_kind(spark, tmp_path):
    """The query's own columns: the counts say the kinds, wherever in the text their spans stand."""
    texts = [t for t in ODD if len(t or "") < 1000]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op6_pii.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert [got[i][f"n_{kind}"] for kind, _ in BASE] == [sum(s.startswith(kind) for s in want) for kind, _ in BASE], text
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_base_patterns_equal_brute_force_at_random(spark):
    rng = np.random.default_rng(8)
    alphabet = list("0123456789..  --+@()ab") + ["4111111111111111", "1.2.3.4", "@x.y"]
    rows = [(i, "".join(rng.choice(alphabet, 40))) for i in range(3000)]
    for r in op6_pii.find(spark.createDataFrame(rows, DOCS)).collect():
        got = [f"{op6_pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]]
        assert got == base_spans(rows[r["doc_id"]][1]), rows[r["doc_id"]][1]


def test_labelers_add_spans(spark):
    rows = [(i, f"please call me on 212-555-{1000 + i} today") for i in range(40)] + [(100 + i, f"order 4111111111111{i:03d} was sent") for i in range(40)]
    found = {r["doc_id"]: r["spans"] for r in op6_pii.find(spark.createDataFrame(rows, DOCS)).collect()}
    assert all([(s["start"], s["end"], s["base"]) for s in found[i]] == [(18, 30, False)] for i in range(40))
    assert all(s["base"] for i in range(40) for s in found[100 + i])


def test_masked_text_keeps_the_rest(spark):
    rows = [(1, "😀 a@b.co, 1.2.3.4 end", 7), (2, None, 7), (3, "", 7), (4, "+4111111111111111 x", 7)]
    df = op6_pii.masked(spark.createDataFrame(rows, "doc_id long, text string, spans int"))
    assert native(df) and df.columns == ["doc_id", "text", "spans"]
    assert [r["text"] for r in df.orderBy("doc_id").collect()] == ["😀 [EMAIL], [IP] end", None, "", "+[CARD] x"]
    empty = spark.createDataFrame([], DOCS)
    assert op6_pii.masked(empty).count() == 0 and op6_pii.find(empty).count() == 0


def test_dense_texts_take_linear_time(spark):
    dense = "a@b.co +12345678901, 1.2.3.4 x " * 10_000
    df = spark.createDataFrame([(1, dense)], DOCS)
    spans = op6_pii.find(df).first()["spans"]
    assert len(spans) == 30_000 and (spans[-1]["start"], spans[-1]["end"]) == (len(dense) - 10, len(dense) - 3)
    assert op6_pii.masked(df).first()["text"] == "[EMAIL] [PHONE], [IP] x " * 10_000


def test_estimate_trusts_the_labelers_that_agree():
    counts = {(0, "yy-"): 500, (0, "nn-"): 500, (0, "-y-"): 50, (0, "-n-"): 50}
    belief = op6_pii.estimate(counts)
    assert belief[0, "yy-"] > 0.95 > 0.5 > belief[0, "nn-"] and belief[0, "-y-"] > belief[0, "-n-"]


def test_classifier_tells_apart_what_the_votes_do_not(spark):
    """Numbers with the same votes: the classifier learned what stands before those that all labelers agree on."""
    good = [f"please call dialling 212-555-{1000 + i} now" for i in range(300)]
    bad = [f"isbn part 012 555 {1000 + i} now" for i in range(300)]
    open_ = [("dialling 212-555-7777 now", 1), ("dialling 313-666-7777 now", 1), ("part 212 555 7777 now", 0), ("part 313 666 7777 now", 0)]
    rows = list(enumerate([*good, *bad, *(t for t, _ in open_)]))
    df = spark.createDataFrame(rows, DOCS)
    votes = {r["doc_id"]: r["c"][0]["votes"] for r in df.select("doc_id", op6_pii.candidates(F.col("text")).alias("c")).collect()}
    assert len({votes[600 + k] for k in range(4)}) == 1  # EM alone gives all four the same
    spans = {r["doc_id"]: len(r["spans"]) for r in op6_pii.find(df).collect()}
    assert [spans[600 + k] for k in range(4)] == [1, 1, 0, 0]


def test_marks_are_one_of_each_feature(spark):
    rows = [(1, "call (212) 555-1234 or a@b.co; ip 1.2.3.4, ::1 4111 1111 1111 1111 + +12345678901"), (2, ""), (3, None), (4, "x" * 5000 + "@" + "y." * 3000 + "z")]
    found = [s for r in spark.createDataFrame(rows, DOCS).select(op6_pii.candidates(F.col("text")).alias("c")).collect() for s in r["c"]]
    bounds = np.cumsum([0, *op6_pii.MARKS])
    assert len(found) >= 5 and all(len(s["marks"]) == len(op6_pii.MARKS) and all(lo <= m < hi for m, lo, hi in zip(s["marks"], bounds[:-1], bounds[1:], strict=True)) for s in found)
