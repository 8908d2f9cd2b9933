"""The training-data operators against brute force, and on awkward rows."""

import base64
import hashlib
import os
import re
import zlib
from itertools import combinations

import pytest

from palimpsest.llm import decontaminate, fingerprint, language_model, license_scan, mixing, near_dedup, queries, suffix_dedup, token_counts, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, block string, node string, size long, key long, score double"
_LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
_BASE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, _BASE, "a"), (2, _BASE, "a"), (3, _BASE.replace("word60 ", "other "), "b"), (4, None, None), (5, "", "b"), (6, "  \t\n ", "b"), (None, "no id here", "c"), (7, "two words", "a"), (8, "Two WORDS", None),
    (9, _LONG, "a"), (10, "prefix " + _BASE[100:400] + " suffix", "c"), (11, "é" * 70 + " ü", "c"), (12, "x" + "é" * 70, "c"), (12, "x" + "é" * 70, "c"), (13, "Licensed under the MIT License.\nyou idiot", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "en", "b", "n", 1, 2, 0.5) for i, t, s in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 1, 1), (None, 1, 1), (13, None, 1)], "doc_id long, quality int, toxic int")


def run(spark, docs, labels, name):
    bench = spark.createDataFrame([(1, _BASE), (2, None), (3, ""), (None, "nothing at all of note")], "item_id long, text string")
    return {
        "op1": lambda: license_scan.scan(docs), "op2": lambda: suffix_dedup.remove_repeats(docs, columns=["doc_id"]), "op3": lambda: fingerprint.fingerprints(docs), "op4": lambda: mixing.mix(docs, labels),
        "op5": lambda: token_counts.section_tokens(docs), "op6": lambda: toxicity.toxicity(docs, labels), "op7": lambda: language_model.score_documents(docs),
        "op8": lambda: decontaminate.find_leaks(docs, bench, columns=["doc_id"]), "op10": lambda: near_dedup.near_duplicates(docs, k=3, percent=85),
    }[name]()


TAKEN = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "toxicity", "score", "leaked_items", "leak_share", "more_items", "words", "taken", "chosen_id", "gone_", "toxicity_", "component_id", "kept")


def test_clashing_names_give_way(spark, docs, labels):
    """Columns named like those that an operator adds are replaced by them; others stay as they are."""
    from pyspark.sql import functions as F

    wide = docs.select("doc_id", "text", "source", "lang", F.length("text").alias("n_chars"), *(F.lit(7).alias(c) for c in TAKEN))
    bench = spark.createDataFrame([(1, _BASE)], "item_id long, text string")
    made = {
        "op2": suffix_dedup.remove_repeats(wide, replace=True), "op6": toxicity.score_toxicity(wide, toxicity.learn(docs, labels)),
        "op8": decontaminate.find_leaks(wide, bench), "op4": mixing.mixed_documents(wide, labels),
    }
    for name, df in made.items():
        assert len(set(df.columns)) == len(df.columns) and set(wide.columns) <= set(df.columns), name
        assert df.count() == (len(ROWS) if name != "op4" else df.count()) and {r["words"] for r in df.select("words").collect()} == {7}, name
    for name in ("op1", "op3", "op5", "op7", "op10"):
        assert run(spark, wide, labels, name).count() >= len(ROWS), name


def test_empty_benchmark_finds_nothing(spark, docs):
    none = spark.createDataFrame([(1, None), (None, "x y z")], "item_id long, text string")
    for bench in (none, none.limit(0)):
        assert {tuple(r["leaked_items"]) for r in decontaminate.find_leaks(docs, bench, columns=["doc_id"]).collect()} == {()}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_are_brute_force(spark, docs, rule):
    """Each token's characters are placed one by one; a token goes to the line of its first, last or most of them."""
    import tiktoken
    from collections import Counter

    coder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.load(token_counts.VOCABULARY), special_tokens={})
    rows = [(r["doc_id"], (r["text"] or "")[:4000]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [(9001, "é\nü\n\n\n  x\n"), (9002, ""), (9003, "a\n\n\nb"), (9004, "\n"), (9005, "日本\n語 ok\n")]
    got: dict = {}
    for r in token_counts.section_tokens(spark.createDataFrame(rows, "doc_id long, text string"), rule=rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["n_tokens"], r["n_crossing"])
    for i, text in rows:
        line, lines = 0, []
        for c in text:
            lines.append(line)
            line += c == "\n"
        owner = [k for k, c in enumerate(text) for _ in c.encode()]
        want, crossing, at = Counter(), Counter(), 0
        for token in coder.encode_ordinary(text):
            n = len(coder.decode_single_token_bytes(token))
            chars = sorted(set(owner[at : at + n]))
            at += n
            on = Counter(lines[k] for k in chars)
            home = {"start": lines[chars[0]], "end": lines[chars[-1]], "most": min(on, key=lambda x: (-on[x], x))}[rule]
            want[home] += 1
            crossing[home] += len(on) > 1
        assert got[i] == {s: (want[s], crossing[s]) for s in (sorted(set(lines)) or [0])}, (i, text[:40])


def test_warc_is_a_group_by(spark):
    """The query over all pages against plain Python."""
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first: dict[bytes, int] = {}
    for i, raw in sorted(pages.items()):
        first.setdefault(raw, i)
    want = sorted((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first[raw] == i else "revisit", None if first[raw] == i else first[raw]) for i, raw in pages.items())
    got = queries.QUERIES["op9_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op10"])
def test_awkward_rows_give_a_row_each(spark, docs, labels, name):
    got = sorted(run(spark, docs, labels, name).select("doc_id").collect(), key=str)
    assert [r["doc_id"] for r in got] == sorted([i for i, *_ in ROWS], key=lambda i: str((i,)) if False else f"Row(doc_id={i})")
    assert run(spark, docs.limit(0), labels.limit(0), name).count() == 0


def test_licences(spark, docs, labels):
    got = {r["doc_id"]: r["licenses"] for r in run(spark, docs, labels, "op1").collect()}
    assert got[13] == "MIT" and not any(v for k, v in got.items() if k != 13)


HEADERS = {
    "MIT": "MIT License\n\nCopyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Apache-2.0": "Copyright 2019 The Authors\n\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "AGPL-3.0-only": "Some tool. It is licensed under the GNU Affero General Public License, version 3.",
}


def test_licence_headers_wrapped_and_commented(spark):
    import textwrap

    cases = [("MIT", "SPDX-License-Identifier: MIT\n"), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("MIT", "This file is licensed under the MIT License."), ("MIT", "some words\nLicensed under the MIT License.\nmore words"), ("", "A licence of my own making."), ("", "Nothing of note.")]
    for name, text in HEADERS.items():
        wrapped = "\n".join("\n".join(textwrap.wrap(p, 75)) for p in text.split("\n"))
        cases += [(name, text), (name, wrapped), (name, "\n".join(f" * {x}".rstrip() for x in wrapped.split("\n"))), (name, "\r\n".join(f"# {x}" for x in wrapped.split("\n")))]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == [name for name, _ in cases]
    assert [r["n_unknown"] for r in got[:6]] == [0, 0, 0, 0, 1, 0]


def test_suffix_dedup_is_brute_force(spark, docs, labels):
    rows = [(i, t) for i, t, _ in ROWS]
    assert brute_suffixes(rows) == suffixes(run(spark, docs, labels, "op2"))
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert brute_suffixes([tuple(r) for r in table.collect()]) == suffixes(suffix_dedup.remove_repeats(table.repartition(3)))


def suffixes(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def brute_suffixes(rows):
    first: dict[bytes, int] = {}
    texts = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    for i, raw in texts:
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, 1 << 63), i)
    want = []
    for (i, raw), (doc_id, _) in zip(texts, rows):
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want.append((doc_id, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=str)


def test_loser_tree_merges_with_prefix_lengths():
    runs = [[b"aab", b"abc"], [b"aab", b"b"], [b"aa"]]
    known = [[os.path.commonprefix([a, b]).__len__() for a, b in zip([b"", *r], r)] for r in runs]
    out = list(suffix_dedup.merge_runs(list(zip(runs, known))))
    merged = [runs[r][i] for r, i, _ in out]
    assert merged == sorted(x for r in runs for x in r)
    assert [n for *_, n in out][1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(merged, merged[1:])]


def test_fingerprints(spark, docs, labels):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {i: t or "" for i, t, _ in ROWS if i is not None}
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(rows).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == fingerprint.fingerprints_of([edited], fingerprint.WORDS, fingerprint.SCALE)[0]
        assert got[i]["near_next"] == fingerprint.likeness(got[i]["fingerprint"], got[j]["fingerprint"])
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    part = fingerprint.fingerprints_of([_LONG[50_000:150_000]], fingerprint.WORDS, fingerprint.SCALE)[0]
    assert fingerprint.containment(part, got[9]["fingerprint"]) > 0.99 and fingerprint.containment(part, got[1]["fingerprint"]) == 0
    assert fingerprint.likeness(fingerprint.merge(got[1]["fingerprint"], got[9]["fingerprint"]), got[9]["fingerprint"]) > 0.3


def test_mixing_meets_its_targets(spark, docs, labels):
    got = run(spark, docs, labels, "op4").collect()
    sources: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        at = sources.setdefault((r["source_size"], r["target"]), [0])
        at[0] += r["taken"]
    assert all(abs(taken - target) <= 1 for (_, target), (taken,) in sources.items())
    assert abs(sum(t for _, t in sources) - sum(r["size"] for r in got)) < 1e-6


def test_section_tokens_sum_to_documents(spark, docs, labels):
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.load(token_counts.VOCABULARY), special_tokens={})
    texts = {i: t or "" for i, t, _ in ROWS if i != 12}
    got: dict = {}
    for r in token_counts.section_tokens(docs.filter("doc_id is null or doc_id <> 12")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        assert sum(r["n_tokens"] for r in got[i]) == len(coder.encode_ordinary(text)) == got[i][0]["doc_tokens"]
        assert max(r["char_end"] for r in got[i]) == len(text)
    for rule in token_counts.RULES:
        assert token_counts.section_tokens(docs, rule=rule).agg({"n_tokens": "sum"}).first()[0] == token_counts.section_tokens(docs).agg({"n_tokens": "sum"}).first()[0]


def test_toxicity_tells_held_out_rows_apart(spark):
    """On the largest table: the smaller ones hold out six toxic rows at most."""
    got = queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    bad, good = ([r["score"] for r in rows if r["toxic"] == x] for x in (1, 0))
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert right >= 0.93 and auc >= 0.95, (right, auc)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())


def edits(a, b):
    """Edit distance with swapped neighbours, by its definition."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_is_brute_force():
    import random

    draw = random.Random(6)
    words = ["".join(draw.choices("abc", k=draw.randint(0, 6))) for _ in range(300)]
    terms = sorted({w for w in words[:80] if w})
    trie = toxicity.Trie(terms)
    for w in words:
        assert dict(trie.within_one(w)) == {t: edits(w, t) for t in terms if edits(w, t) <= 1}, w


def test_automaton_equals_edit_distance():
    trie = toxicity.Trie(["idiot", "moron"])
    assert dict(trie.within_one("idoit")) == {"idiot": 1} and dict(trie.within_one("mron")) == {"moron": 1} and dict(trie.within_one("moron")) == {"moron": 0} and not trie.within_one("morning")


def test_language_model_base_and_gain(spark):
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    words = {r["doc_id"]: [*re.findall(rb"[^\x20\x09-\x0d]+", (r["text"] or "").encode().lower()), language_model.END] for r in docs.collect()}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(count[w] > 0 for w in ws) and got[i]["train_tokens"] == n
        assert math.isclose(got[i]["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_leaks_are_found_and_clean_texts_left(spark):
    got = queries.QUERIES["op8_decontaminate"](spark, SF).collect()
    items = {r["item_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: [k for k, t in sorted(items.items()) if t in text] for i, text in whole.items()}
    assert {r["doc_id"]: r["leaked_items"] for r in got} == want
    text = list(items.values())[0].split()
    near = " ".join(w for i, w in enumerate(text) if i % 9)  # every ninth word left out
    item = next(k for k, t in items.items() if t.split() == text)
    planted = spark.createDataFrame([(-1, "some other start " + near + " and an end"), (-2, " ".join(reversed(text)))], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(planted)
    got = {r["doc_id"]: r["leaked_items"] for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert item in got[-1] and item not in got[-2]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(3, "u", "same"), (1, "http://a\n", "same"), (2, None, None), (5, "v", ""), (None, "w", "same"), (7, "x", "é" * 5000)], "page_id long, url string, html string").withColumn("size", pages_extra())
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert got[1]["record_type"] == "response" and (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 1) and got[None]["refers_to"] == 1
    assert got[2]["record_type"] == "response" and got[5]["refers_to"] == 2 and got[7]["payload_bytes"] == 10_000
    assert got[7]["payload_digest"] == base64.b32encode(hashlib.sha1("é".encode() * 5000).digest()).decode()
    assert warc.round_trip(pages.limit(0)).count() == 0
    data, places = warc.archive([warc.record(i, "u", b"<html>%d</html>" % i * 50, None, None, False) for i in range(40)])
    assert len(list(warc.read_archive(data))) == len(places) == 40


def pages_extra():
    from pyspark.sql import functions as F

    return F.lit(1)


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i]) for i in texts}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_brute_force(spark, docs, k, percent):
    texts = {i: t for i, t, _ in ROWS if i is not None}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k=k, percent=percent).collect() if r["doc_id"] is not None}
    assert got == brute_components(texts, k, percent)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table, k=k, percent=percent).collect()}
    assert got == brute_components(texts, k, percent)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    flat = lambda columns, values: sorted(repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(range(len(columns)), key=lambda i: columns[i])]) for r in values)
    assert flat(got.columns, got.collect()) == flat(want.columns, want.fetchall())


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "taken"] and 0 < out.count() < docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_language_model_keeps_every_state_that_passes(spark):
    """Against brute force on a table with more states than one machine was given before."""
    import math
    from collections import Counter, defaultdict

    path = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in language_model.score_documents(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), language_model.END] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    trained = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for ws in trained for w in ws)
    total, least = sum(count.values()), max(2, math.ceil(sum(count.values()) * language_model.SHARE))
    own = {w for w, c in count.items() if c >= least} | {language_model.END}
    one, two = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = one / (one + 2 * two)
    root = {w: (count[w] - discount) / total for w in own}
    root[None] = 1 - sum(root.values())
    symbols = lambda ws: [language_model.END, *(w if w in own else None for w in ws)]
    share = Counter(x for ws in trained for x in symbols(ws)[1:])
    states: list[dict] = [{(): {x: c for x, c in share.items()}}]
    for depth in (1, 2, 3):
        seen: dict = defaultdict(Counter)
        for ws in trained:
            s = symbols(ws)
            for j in range(depth, len(s)):
                if tuple(s[j - depth + 1 : j]) in states[-1]:
                    seen[tuple(s[j - depth : j])][s[j]] += 1
        kept = {}
        for context, following in seen.items():
            above, n = states[-1][context[1:]], following.total()
            of = sum(above.values()) if depth == 1 else states[-1].get((context[1:], "n")) or states[-1].setdefault((context[1:], "n"), sum(above.values()))
            of = of if depth > 1 else total
            if sum(c * math.log(c / n / (above[x] / of)) for x, c in following.items()) - len(following) / 2 * math.log(n) >= language_model.MIN_GAIN:
                kept[context] = following
        states.append(kept)
    print("states by depth:", [len([k for k in s if not (k and k[-1] == "n")]) for s in states[1:]])
    assert sum(map(len, states)) > 100_000
    for i in sorted(texts)[::50]:
        s, score = symbols(texts[i]), 0.0
        for j in range(1, len(s)):
            p = root[s[j]]
            for depth in range(1, min(j, 3) + 1):
                following = states[depth].get(tuple(s[j - depth : j]))
                if following is None:
                    break
                p = (following[s[j]] + len(following) * p) / (following.total() + len(following))
            if s[j] is None:
                c = count[texts[i][j - 1]]
                p *= (c - discount if c else discount * len(count)) / total / root[None]
            score += math.log10(p)
        assert math.isclose(got[i]["score"], score, rel_tol=1e-9), i


def test_long_items_are_found(spark):
    """Exact copies and paraphrases of items much longer than a passage, in texts that share their words."""
    import random

    draw = random.Random(8)
    pool = [f"w{i}" for i in range(6000)]
    items, texts = [], []
    for k, n in enumerate((200, 400, 700, 1000)):
        words = draw.sample(pool, n)
        answer = " ".join(words[-6:])
        items.append((k, " ".join(words[:-6]) + ". " + answer + "."))
        for j, share in enumerate((1.0, 0.85, 0.7)):
            changed = [w if draw.random() < share else draw.choice(pool) for w in words[:-6]]
            texts.append((10 * k + j, " ".join([*draw.choices(pool, k=60), *changed, answer, *draw.choices(pool, k=60)])))
    texts += [(1000 + i, " ".join(draw.choices(pool, k=300))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["leaked_items"] for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [i // 10] if i < 1000 else [] for i, _ in texts}


def test_learned_words_are_matched_fuzzily_and_judged():
    lexicon = toxicity.Lexicon({"ordure": 3.0, "abschaum": 3.0, "oaf": 3.0}, {}, frozenset({"ordures"}))
    assert [lexicon.look_up(w) and lexicon.look_up(w)[0] for w in ("ordure", "odrure", "abschuam", "abschum", "oaff", "ordures", "idoit")] == ["learned", "misspelled", "misspelled", "misspelled", None, None, "misspelled"]
    kinds = lambda text: {k for k, x in zip(toxicity.KINDS, toxicity.Reader(lexicon).features(text)[1:], strict=False) if x}
    assert kinds("quelle ordure ici") == {"learned"} and kinds("tu es une ordure") == {"aimed"}
    assert kinds('il a dit "ordure" hier') == {"quoted"} and kinds("du bist abschuam") == {"misspelled"} and kinds("stupid idea") == {"plain"}


def test_wide_groups_are_brute_force(spark, monkeypatch):
    """A large cluster of variants, with sets beside it that only some of its members are near to."""
    import random

    draw = random.Random(10)
    base = [f"t{i}" for i in range(60)]
    texts = {}
    for i in range(160):
        words = list(base)
        for _ in range(draw.choice((0, 1, 2, 4, 6, 8))):
            words[draw.randrange(60)] = f"x{draw.randrange(40)}"
        texts[i] = " ".join(words)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 16)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k=3, percent=85).collect()}
    assert got == brute_components(texts, 3, 85)
    assert 1 < len({c for _, c in got.values()}) < 160


def test_short_texts_have_true_likeness(spark):
    """Sets of few shingles are compared exactly; larger ones come near to the true Jaccard similarity."""
    shingles = lambda t, k=5: {tuple(w[j : j + k]) for w in [t.encode().lower().split()] for j in range(max(len(w) - k + 1, 1))}
    jaccard = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    mark = lambda t: fingerprint.fingerprints_of([t], fingerprint.WORDS, fingerprint.SCALE)[0]
    for a, b in [("one two three four five six", "one two three four five seven"), ("a b", "a c"), (" ".join(map(str, range(60))), " ".join(map(str, range(20, 80))))]:
        assert abs(fingerprint.likeness(mark(a), mark(b)) - jaccard(a, b)) < 1e-12
        union = fingerprint.decode(fingerprint.merge(mark(a), mark(b)))
        assert union[1] == len(shingles(a) | shingles(b)) or union[0] > 1
    short, long_ = " ".join(map(str, range(50))), " ".join(map(str, range(4000)))
    assert abs(fingerprint.decode(fingerprint.merge(mark(short), mark(long_)))[1] - 3996) < 400
    assert fingerprint.containment(mark(short), mark(long_)) > 0.99
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r["near_next"] for r in queries.QUERIES["op3_fingerprints"](spark, SF).collect()}
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        if a.split() and b.split():
            assert abs(got[i] - jaccard(a, b)) < 0.25, i


def test_pipeline_stages_are_brute_force(spark, docs, labels):
    """Each stage on what its predecessor kept: near duplicates and suffixes by their definitions, leaks by containment,
    the mix by its SQL; then awkward rows with columns of any name."""
    import corpus_pipeline
    import duckdb
    from pyspark.sql import functions as F

    stages = dict(corpus_pipeline.STAGES)
    own = spark.read.parquet(f"{SF}/documents.parquet")
    clean = stages["toxicity"](spark, own, SF)
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(own, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(texts) == {i for i, bad in scores.items() if not bad}
    single = stages["near_dedup"](spark, clean, SF)
    kept = {i for i, (_, label) in brute_components(texts, 5, 80).items() if i == label}
    assert {r["doc_id"] for r in single.collect()} == kept
    cut = stages["suffix_dedup"](spark, single, SF)
    want = {r[0]: r[4] for r in brute_suffixes([(i, texts[i]) for i in kept])}
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    exact = [i for i in kept if hashlib.sha256((left[i] or "").encode()).hexdigest() == want[i]]
    assert set(left) == kept and all(i in exact or len(left[i].encode()) < len(texts[i].encode()) for i in kept) and len(exact) > 0.9 * len(kept)
    safe = stages["decontaminate"](spark, cut, SF)
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in safe.collect()} == {i for i, t in left.items() if not any(x in " ".join((t or "").split()) for x in items)}
    con = duckdb.connect()
    con.register("documents", safe.toArrow())
    con.sql(f"create view labels as select * from '{SF}/labels.parquet'")
    taken = {r[0]: r[4] for r in con.sql(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall() if r[4] > 0}
    assert {r["doc_id"]: r["taken"] for r in stages["mixing"](spark, safe, SF).collect()} == taken
    wide = docs.select("doc_id", "text", "source", "lang", F.length("text").alias("n_chars"), *(F.lit(7).alias(c) for c in TAKEN))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SF)
        assert set(out.columns) == set(wide.columns), name
        rows = out.collect()
        assert 0 < len(rows) <= len(ROWS) and all(r[c] == 7 for r in rows for c in TAKEN if not (name == "mixing" and c == "taken")), name


def test_components_with_hubs_in_parts(spark, monkeypatch):
    """Hubs of most nodes, chains of small ones, repeated rows: the least node reachable, however hubs are cut."""
    import random

    from palimpsest.llm import grouping
    from palimpsest.llm.scratch import Phases

    rng = random.Random(5)
    links = [(n, 1000) for n in range(100, 180)] + [(n, 1001 + n // 2) for n in range(40)] + [(n, 2000 + rng.randrange(30)) for n in range(200, 260)] + [(100, 1000)] * 5 + [(n + 1, 1001 + n // 2) for n in range(1, 20, 6)]
    at = {n: n for n, _ in links}
    for _ in at:
        least = {h: min(at[n] for n, g in links if g == h) for _, h in links}
        at = {n: min(least[h] for m, h in links if m == n) for n in at}
    monkeypatch.setattr(grouping, "HUB_ROWS", 3)
    got = grouping.components(spark.createDataFrame(links, "node long, hub long"), Phases(spark, "near")).collect()
    assert {r["node"]: r["component"] for r in got} == at and len(got) == len(at)
    assert grouping.components(spark.createDataFrame([], "node long, hub long"), Phases(spark, "near")).count() == 0


def test_language_model_has_contexts_of_every_word(spark):
    """Against brute force in which each trained word, however seldom, is a symbol; over one block and over several."""
    import math
    from collections import Counter, defaultdict

    larger = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    twice = "zyxa zyxb zyxc zyxd zyxe"  # seldom words in a fixed order, which only their own contexts tell
    planted = spark.createDataFrame([(10_000_000 + i, twice if i < 4 else None) for i in range(6)], "doc_id long, text string")
    larger = larger.select("doc_id", "text").union(planted).repartition(4, "doc_id").cache()
    for docs, result in ((spark.read.parquet(f"{SF}/documents.parquet"), queries.QUERIES["op7_language_model"](spark, SF)), (larger, language_model.score_documents(larger, share=0))):
        texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), language_model.END] for r in docs.collect()}
        got = {r["doc_id"]: r["score"] for r in result.collect()}
        assert got.keys() == texts.keys()
        trained = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10]
        count = Counter(w for ws in trained for w in ws)
        total = sum(count.values())
        one, two = (sum(c == k for c in count.values()) for k in (1, 2))
        discount = one / (one + 2 * two)
        root = {w: (c - discount) / total for w, c in count.items()}
        states: list[dict] = [{(): (count, total)}]
        for depth in (1, 2, 3):
            seen: dict = defaultdict(Counter)
            for ws in trained:
                s = [language_model.END, *ws]
                for j in range(depth, len(s)):
                    if tuple(s[j - depth + 1 : j]) in states[-1]:
                        seen[tuple(s[j - depth : j])][s[j]] += 1
            kept = {}
            for context, following in seen.items():
                (above, of), n = states[-1][context[1:]], following.total()
                if sum(c * math.log(c / n / (above[x] / of)) for x, c in following.items()) - len(following) / 2 * math.log(n) >= language_model.MIN_GAIN:
                    kept[context] = (following, n)
            states.append(kept)
        for i, ws in texts.items():
            s, score = [language_model.END, *ws], 0.0
            for j in range(1, len(s)):
                p = root.get(s[j], discount * len(count) / total)
                for depth in range(1, min(j, 3) + 1):
                    following, n = states[depth].get(tuple(s[j - depth : j]), (None, 0))
                    if following is None:
                        break
                    p = (following[s[j]] + len(following) * p) / (n + len(following))
                score += math.log10(p)
            assert math.isclose(got[i], score, rel_tol=1e-9), i


def test_distinct_pairs_of_any_width():
    import numpy as np

    rng = np.random.default_rng(1)
    for high, low in ((9, 5), (1 << 31, 1 << 32), (1 << 32, 1 << 32)):
        a, b = high - 1 - rng.integers(0, 9, 500), low - 1 - rng.integers(0, 5, 500)
        own_a, own_b, place = language_model._distinct(a, b)
        assert list(zip(own_a.tolist(), own_b.tolist(), strict=True)) == sorted(set(zip(a.tolist(), b.tolist(), strict=True)))
        assert (own_a[place] == a).all() and (own_b[place] == b).all()
    assert all(not len(x) for x in language_model._distinct(a[:0], b[:0]))
