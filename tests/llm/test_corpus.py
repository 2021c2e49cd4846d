"""The corpus operators against brute force, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import bpe, common, embeddings, html_text, jaccard, license_scan, line_dedup, links, media, mixing, quality, url_filter
from quarrylake.llm.queries import ORACLE, QUERIES, vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000
#: Nulls in every column, empty and blank texts, a very long one, repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", None, 4),
    (4, LONG, "en", "b", len(LONG)),
    (5, "one two three four five six", "en", "a", 27),
    (5, "one two three four five six", "en", "a", 27),
    (6, "ONE two\tthree four five six", "de", "a", 27),
    (None, "one two three four five six", "en", "c", 27),
    (7, "x", "en", "", 1),
    (8, "été ñandú 😀 straße \u00a0x", "es", "b", 20),
]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    order = [want.columns.index(c) for c in names]
    assert got == collections.Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


# --- url filters ---------------------------------------------------------------

URLS = [
    ("http://a.com/", "a.com", "/", "com/", "allow"),
    ("https://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
    ("https://m.example.com/EN/", "m.example.com", "/EN/", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.net/es", "a.net", "/es", None, "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://a.com:80/", "a.com:80", "/", None, "allow"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://m.spam-farm.example.org/x", "m.spam-farm.example.org", "/x", None, "block"),
    ("http://casino.x.org/", "casino.x.org", "/", None, "block"),
    ("http://x.org/phishing/y", "x.org", "/phishing/y", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://é.com/\n", "é.com", "/\n", "com/", "allow"),
]


def test_url_verdicts(spark):
    df = spark.createDataFrame([(i, u[0], "host!") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    rows = url_filter.judge(df).orderBy("page_id").collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]][1:], r
    assert url_filter.judge(df.limit(0)).count() == 0


def test_index_runs_only_rules_that_share_a_token():
    rules = url_filter.compile_rules()
    for counts in ({}, {t: 10 for r in rules for t in r.tokens}):
        index = url_filter.index_rules(rules, counts)
        judge = url_filter.Judge(index)
        brute = url_filter.Judge({None: rules})
        for u, *_ in URLS:
            assert judge(u) == brute(u)
    assert url_filter.index_rules(rules, {"example": 5, "en": 9, "com": 99})["example"]


def test_thousands_of_rules_judge_as_all_of_them_run():
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefg01", k=rng.randint(1, 3))) for _ in range(60)]
    host = lambda: ".".join(rng.choices(words, k=rng.randint(1, 3)))
    path = lambda: "/" + "/".join(rng.choices(words, k=rng.randint(0, 3)))
    bit = lambda: rng.choice([*words, "*", "^", "/", ".", "-", "_", "%"])
    action = lambda: rng.choice(["allow", "block"])
    hosts = [(action(), host() + path()) for _ in range(1500)]
    patterns = [(rng.choices(["allow", "block"], [1, 60])[0], rng.choice(["||", "", "", "/"]) + rng.choice(words) + "".join(bit() for _ in range(rng.randint(2, 6)))) for _ in range(2500)]
    urls = [f"http{rng.choice(['', 's'])}://{host()}{path()}{rng.choice(['', '/', '?q=' + rng.choice(words), '#x', '.html', 'a', 'é'])}" for _ in range(150)]
    for rules in (url_filter.compile_rules(hosts, patterns), url_filter.compile_rules((), patterns)):
        counts: dict[str, int] = {}
        for u in urls:
            for t in set(re.findall("[a-z0-9]+", u)):
                counts[t] = counts.get(t, 0) + 1
        judge, brute = (url_filter.Judge(x) for x in (url_filter.index_rules(rules, counts), {None: rules}))
        got = [judge(u) for u in urls]
        assert got == [brute(u) for u in urls]
        assert {g[3] for g in got} == {"allow", "block"}


# --- mixing ----------------------------------------------------------------------


def test_targets_are_water_filled():
    assert mixing.fit_targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.fit_targets([10, 100, 100, 0], [5, 2, 1, 5])
    assert got == pytest.approx([30, 120, 60, 0]) and sum(got) == pytest.approx(210)
    assert mixing.fit_targets([0, 0], [5, 2]) == [0, 0]


def test_knapsack_is_as_near_as_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, 5))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, 120))
        total = int((lengths * counts).sum())
        budget = min(budget, total)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        got = mixing.choose_counts(lengths, counts, budget)
        assert (got <= counts).all() and (got >= 0).all()
        assert abs(int((got * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_large_budgets_are_met_exactly():
    rng = np.random.default_rng(2)
    lengths, counts = np.arange(1, 3000), rng.integers(0, 2000, 2999)
    total = int((lengths * counts).sum())
    for share in (0.1, 0.5, 0.99):
        got = mixing.choose_counts(lengths, counts, int(total * share))
        assert (got <= counts).all() and int((got * lengths).sum()) == int(total * share)


def test_mix(spark, docs, odd, none):
    for df in (docs, odd):
        rows = mixing.mix(df, buckets=8).collect()
        assert len(rows) == df.count()
        size = collections.Counter()
        for r in df.collect():
            size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
        names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
        target = dict(zip(names, mixing.fit_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
        of = {(r["doc_id"], r["text"]): r["source"] for r in df.collect()}
        taken = collections.Counter()
        by_id = collections.defaultdict(set)
        for (i, _), s in of.items():
            by_id[i].add(s)
        for r in rows:
            (s,) = by_id[r["doc_id"]]
            assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
            assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
            taken[s] += r["taken"]
        largest = max(r["size"] for r in rows)
        assert all(abs(taken[s] - target[s]) <= largest for s in names)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0


def test_border_bucket_takes_the_exact_number(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 400, "s1").otherwise("s2").alias("source"))
    rows = mixing.mix(df, buckets=4).collect()
    want = mixing.fit_targets([1200, 300], [5, 2])
    for name, low, high, t in (("s1", 0, 400, want[0]), ("s2", 400, 500, want[1])):
        assert abs(sum(r["taken"] for r in rows if low <= r["doc_id"] < high) - t) <= 3, name


# --- licences -----------------------------------------------------------------------


def test_every_known_sentence_has_an_anchor():
    for variants in license_scan.SENTENCES.values():
        for v in variants:
            assert any(a in v.lower() for a in license_scan.ANCHORS) or len(license_scan.SENTENCES) == 0, v
    assert {s for _, seq in license_scan.RULES for s in seq} <= set(license_scan.SENTENCES)


def test_licences(spark, odd, none):
    asis = "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES."
    texts = [
        ("Some text.\nReleased under the MIT License.", "MIT", 1),
        ("x. This work is licensed under the GNU General Public License, version 3. y", "GPL-3.0-only", 1),
        ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n http://x\n" + asis, "Apache-2.0", 3),
        ("All rights reserved. LICENSED UNDER CC BY-NC 4.0.", "CC-BY-NC-4.0,Proprietary", 2),
        ("All rights are reserved to licensees.", "", 0),
        ("The license.", "", 0),
    ]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in license_scan.scan(df).collect():
        _, want, n = texts[r["doc_id"]]
        assert (r["licences"], r["n_sentences"], r["licence"]) == (want, n, want.split(",")[0] or None), r
    assert all(r["n_sentences"] == 0 and r["licence"] is None for r in license_scan.scan(odd).collect())
    assert license_scan.scan(none).count() == 0
    plan = license_scan.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


GPL2 = GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful.
"""
AGPL = GPL.replace("GNU General", "GNU Affero General")
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
ZERO = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
FREE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute.
"""


def test_whole_wrapped_licence_texts(spark):
    want = [("Apache-2.0", APACHE, "apache2-grant,apache2-use,apache2-copy,apache2-asis"), ("MIT", MIT, "mit-grant,mit-notice"), ("GPL-3.0-or-later", GPL, "gpl-free,gpl-nowarranty,gpl-nowarranty")]
    want += [("GPL-2.0-or-later", GPL2, "gpl-terms,later-2,gpl-nowarranty,gpl-nowarranty"), ("LGPL-2.1-or-later", LGPL, "lgpl-terms,later-2.1"), ("AGPL-3.0-or-later", AGPL, "agpl3-terms,gpl-nowarranty,gpl-nowarranty")]
    want += [("BSD-2-Clause", BSD2, "bsd-grant,bsd-source,bsd-binary"), ("BSD-3-Clause", BSD3, "bsd-grant,bsd-source,bsd-binary,bsd-endorse"), ("ISC", ISC, "isc-grant"), ("0BSD", ZERO, "0bsd-grant")]
    want += [("Zlib", ZLIB, "zlib-grant"), ("MPL-2.0", MPL, "mpl2"), ("EPL-2.0", EPL, "epl2"), ("Unlicense", FREE, "unlicense")]
    marked = lambda t, mark: "\n".join(f"{mark} {x}".rstrip() for x in t.split("\n"))
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: marked(t, "#"), lambda t: marked(t, " *"), lambda t: marked(t, "//").replace("\n", "\r\n")]
    rows = [(i * 10 + j, f(t)) for i, (_, t, _) in enumerate(want) for j, f in enumerate(forms)]
    rows += [(990, "Our work is\nLicensed under CC BY 4.0.\nNot more\nAll rights reserved"), (991, "* some words\n* licensed under CC0 1.0")]
    got = {r["doc_id"]: (r["licence"], r["sentence_ids"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (licence, _, ids) in enumerate(want):
        for j in range(len(forms)):
            assert got[i * 10 + j] == (licence, ids), (licence, j)
    assert got[990] == ("CC-BY-4.0", "cc-by,all-rights") and got[991] == ("CC0-1.0", "cc0")


# --- media ------------------------------------------------------------------------------


def _png() -> bytes:
    chunk = lambda n, d: len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x01D\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xyz\xff\xd9"
PDF = b"%PDF-1.4\nxx startxref\n0\n%%EOF"


def test_sniffer_finds_corrects_and_carves(spark):
    wav = media.to_wav(b"abc" * 64)
    blobs = [
        (0, wav, "image/png"),
        (1, _png(), "image/png"),
        (2, b"junk RIFF BM" + GIF + b"GIF8" + JPEG + b"tail", "text/plain"),
        (3, _png()[:-4] + b"....", "image/png"),
        (4, b"", None),
        (5, None, None),
        (6, PDF + _png(), "application/pdf"),
    ]
    rows = media.sniff(spark.createDataFrame(blobs, "id long, blob binary, said string"), "id", "blob", "said").collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r["id"]].append((r["media_type"], r["offset"], r["corrected"], r["carved"], bytes(r["media"]) if r["media"] is not None else None))
    assert got[0] == [("audio/wav", 0, True, False, wav)]
    assert got[1] == [("image/png", 0, False, False, _png())]
    assert got[2] == [("image/gif", 12, False, True, GIF), ("image/jpeg", 12 + len(GIF) + 4, False, True, JPEG)]
    assert [got[i][0][0] for i in (3, 4, 5)] == [None] * 3
    assert [x[0] for x in got[6]] == ["application/pdf", "image/png"]


def test_updated_documents_and_lossless_pictures_are_whole():
    updated = PDF + b"\n1 0 obj\nstartxref\n9\n%%EOF\r\n"
    webp = {kind: b"RIFF" + (16).to_bytes(4, "little") + b"WEBP" + kind + (4).to_bytes(4, "little") + b"abcd" for kind in (b"VP8 ", b"VP8L", b"VP8X")}
    own = media.automaton()
    spans = lambda blob: [(x.kind, x.start, x.end) for x in media.find_media(blob, own)]
    assert spans(updated) == [("application/pdf", 0, len(updated))]
    assert spans(updated + updated) == [("application/pdf", 0, len(updated)), ("application/pdf", len(updated), 2 * len(updated))]
    for blob in webp.values():
        assert spans(blob) == [("image/webp", 0, len(blob))]


def test_media_round_trip(spark, docs, odd, none):
    for df in (docs, odd):
        want = collections.Counter()
        for r in df.collect():
            raw = (r["text"] or "").encode()
            full = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
            want[(r["doc_id"], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))] += 1
            assert len(full) % 192 == 0 and full
        rows = media.features(df).collect()
        assert want == collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
        assert all(r["media_bytes"] == r["payload_bytes"] + 44 for r in rows)
    assert media.features(none).count() == 0
    stored = media.store(odd)
    assert media.sniff(stored, "doc_id", "blob", "declared").where("corrected").count() == len(ODD)


# --- byte-level BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


TEXTS = ["", " ", "\n", "a", "  'sup", "it's they're I'LL", "x  \n\n y\t\t z   ", "a" * 3000, "ab" * 700, "abcabd" * 200, "\u3000\u3000x \u2028 y", "12 ½ ² ٣", "😀😀 e\u0301 \x1c\x1d \x85\x85b", "\ufdd0 and \ufdd1", "<|endoftext|>", "a" * 97, "日本語" * 50]


def test_codec_equals_the_library(tokenizer):
    path, pattern = vocabulary()
    rng = np.random.default_rng(3)
    texts = TEXTS + ["".join(chr(c) for c in rng.integers(1, 0xD7FF, 40)) for _ in range(200)] + ["".join(rng.choice(list("abc '\n1!"), 60)) for _ in range(200)]
    texts += ["".join(rng.choice(list("lo"), 600)), "".join(rng.choice(list("abcdefgh"), 700))]
    for own in (texts, ["".join(bpe.MARKS) + " x"]):
        ends, ids, byte_ends, data = bpe.Codec(path).encode(pa.array(own, pa.string()), pattern)
        at, byte_at = [0, *ends], [0, *byte_ends]
        for i, t in enumerate(own):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode_ordinary(t), repr(t)
            assert data[byte_at[i] : byte_at[i + 1]] == t.encode()


def test_bpe_query(spark, docs, odd, none, tokenizer):
    path, pattern = vocabulary()
    for df in (docs, odd):
        want = collections.Counter()
        for r in df.collect():
            ids = tokenizer.encode_ordinary(r["text"] or "")
            want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
        assert want == collections.Counter(map(tuple, bpe.digest(df, path, pattern).collect()))
    assert bpe.digest(none, path, pattern).count() == 0
    back = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in bpe.encode(odd, path, pattern).collect()}
    assert back[1] == ([], b"") and back[5][1] == b"one two three four five six"


# --- HTML ---------------------------------------------------------------------------------------


def test_extraction_on_held_out_layouts():
    model = html_text.trained()
    pages = html_text.labelled_pages(150, seed=77)
    good = sum(html_text.main_text(p, model) == "\n".join(x for x in main if x) for p, main in pages)
    assert good >= 0.9 * len(pages)


def test_extraction_of_the_article(spark, data):
    import html

    rows = html_text.extract(spark.read.parquet(f"{data}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_extraction_of_odd_pages(spark):
    cases = [None, "", "plain words without any tag.", "<p", "<article><p>a &amp; b &eacute;&#33; c<br>d</p><script>x</p></script><p>e", "<!-- <p>no</p> --><article><p title='a>b'>yes, this is it.</p></article><footer>no</footer>", "<article>" + "<p>Long words here.</p>" * 20_000 + "</article>", "<nav><ul><li><a href=x>Home</a></ul></nav>"]
    df = spark.createDataFrame([(i, "u", c, "x") for i, c in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[0] == got[1] == "" and got[4] == "a & b é! c d\ne" and got[5] == "yes, this is it."
    assert got[6].count("\n") == 19_999 and got[7] == ""
    assert html_text.extract(df.limit(0)).count() == 0


def test_tags_and_words_that_hide_nothing():
    text = lambda page: [b.text for b in html_text.blocks_of(page)]
    for tag in "select object video audio canvas svg math template noscript iframe noembed".split():
        assert text(f"<p>one</p><{tag} id=x><p>two</p><{tag}><p>three</p>") == ["one", "two", "three"], tag
    for tag in "select textarea script style template".split():
        assert text(f"<p>one</p><{tag}>x</{tag}><p>two</p>") == ["one", "two"], tag
    for tag in "object video audio canvas svg math noscript iframe noembed noframes".split():
        assert text(f"<p>one <{tag}>x</{tag}> two</p>") == ["one x two"], tag
    assert text("<p>a <svg><title>x</title><path d='m'/></svg> b<svg/> c</p><p>d</p>") == ["a b c", "d"]
    assert html_text.blocks_of("<svg><g/></svg><p>d</p>")[0].tags == ("p",)
    assert text("<p>one</p><script>two<p>three</p>") == ["one"]
    for kept in ('title="The hidden gems of Rome"', 'class="note hidden md:block"', "data-x='a hidden b'", 'title="display: none"', 'aria-hidden="false"'):
        assert not html_text.blocks_of(f"<p {kept}>one</p>")[0].hidden, kept
    for gone in ("hidden", 'class="a" hidden', "hidden=until-found", 'aria-hidden="true"', "aria-hidden=true", 'style="color: red; display : none"'):
        assert [b.hidden for b in html_text.blocks_of(f"<p {gone}>one</p><p>two</p>")] == [True, False], gone
    model = html_text.trained()
    page = "<nav><a href=x>Home</a></nav><article><h1>Title of it</h1><p>First words stand here.</p>{}<p>Last words stand here.</p></article><footer>end</footer>"
    for tag in "math svg noscript object canvas iframe".split():
        assert html_text.main_text(page.format(f"<p>The <{tag}>inner words</{tag}> stay.</p>"), model) == "Title of it\nFirst words stand here.\nThe inner words stay.\nLast words stand here.", tag
        assert html_text.main_text(page.format(f"<{tag}><p>The inner words stay.</p></{tag}>"), model).count("The inner words stay.") == 1, tag
    for attribute in ("hidden", "aria-hidden=true", "style='display:none'"):
        assert "banner" not in html_text.main_text(page.format(f"<div {attribute} class=notice>The banner words.</div>"), model)


def test_viterbi_and_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    scores, steps = rng.normal(size=6), rng.normal(size=(2, 2))
    total = lambda y: sum(s for s, v in zip(scores, y, strict=True) if v) + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False))
    ways = list(itertools.product((0, 1), repeat=6))
    model = html_text.Field(steps=steps)
    assert tuple(model.decode(scores)) == max(ways, key=total)
    weight = np.exp([total(y) for y in ways])
    main, pairs = html_text.marginals(scores, steps)
    assert main == pytest.approx([sum(w for w, y in zip(weight, ways, strict=True) if y[i]) / weight.sum() for i in range(6)])
    assert pairs.sum() == pytest.approx(5)


# --- n-gram Jaccard ---------------------------------------------------------------------------------


def shingles(text, words=4):
    own = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({65 + k: 97 + k for k in range(26)}))
    return frozenset(tuple(own[i : i + words]) for i in range(len(own) - words + 1)) if len(own) >= words else frozenset([tuple(own)] if own else [])


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_copies(seed=5, groups=12):
    """Texts and edited copies of them, on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    common_line = [word() for _ in range(14)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(int(rng.integers(3, 700 if g == 1 else 260)))] + common_line * int(g % 3 == 0)
        out.append(" ".join(base))
        for _ in range(int(rng.integers(1, 14))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(len(copy)))] = word()
            out.append((" " if rng.random() < 0.5 else "\n").join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return out


def jaccard_truth(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if i is not None and sets[i]]
    pairs = [(a, b) for a in ids for b in ids if a < b and 100 * (k := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - k)]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), grouped(pairs, sets).values(), strict=True)}


def test_jaccard_components(spark, docs, odd, none):
    copies = [(i, t) for i, t in enumerate(near_copies())]
    for df in (spark.createDataFrame(copies, "doc_id long, text string"), docs, odd):
        own = [(r["doc_id"], r["text"]) for r in df.collect()]
        rows = jaccard.group(df).collect()
        assert len(rows) == len(own)
        want = jaccard_truth([r for r in own if r[0] is not None])
        for r in rows:
            if r["doc_id"] is None:
                assert r["component_id"] is None
            else:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard.group(none).count() == 0


def test_prefix_lemma():
    for n in range(1, 900):
        assert 1 <= jaccard.allowance(n, 85) <= jaccard.lead_length(n, 85) <= n
        assert jaccard.least_shared(n, 85) == min(jaccard.allowance(m, 85) for m in range(n, 100 * n // 85 + 1))


def test_linked_sets_share_the_lead_tokens_that_are_asked_for():
    rng = np.random.default_rng(13)
    linked = 0
    for _ in range(6000):
        n = int(rng.integers(1, 900))
        x = rng.choice(1 << 40, n, replace=False)
        # Drop some tokens, add others: pairs on both sides of the threshold.
        y = np.concatenate([x[rng.permutation(n)[: n - int(rng.integers(0, n // 6 + 2))]], rng.integers(1 << 41, 1 << 42, int(rng.integers(0, n // 8 + 2)))])
        a, b = np.unique(x), np.unique(y)
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 85 * (len(a) + len(b) - same):
            linked += 1
            apart = sum(int(v).bit_count() for v in (jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64))
            assert apart <= len(a) + len(b) - 2 * same and 185 * (len(a) + len(b) - apart) >= 170 * (len(a) + len(b))
            shared = len(np.intersect1d(a[: jaccard.lead_length(len(a), 85)], b[: jaccard.lead_length(len(b), 85)]))
            assert shared >= max(jaccard.least_shared(len(a), 85), jaccard.least_shared(len(b), 85))
    assert linked > 1000


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in grouped([e for e in edges if e[0] != e[1]], nodes).items()}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_are_grouped_without_rounds_of_jobs(spark):
    chain = common.materialize(spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (None, 900)], "a long, b long").repartition(3), "edges")
    spark.sparkContext.setJobGroup("few", "few links")
    try:
        got = links.components(chain).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == [(i, 0) for i in range(301)]
    assert len(jobs) <= 2
    common.discard(chain)


@pytest.mark.parametrize("kind", ["long", "binary", "string"])
def test_many_links_have_the_same_components(spark, monkeypatch, kind):
    rng = np.random.default_rng(16)
    name = {"long": lambda x: int(x) - 100, "binary": lambda x: bytes([(x * 7) % 256]), "string": lambda x: chr(0xFFF0 + x % 8) + chr(97 + x // 8) if x % 2 else chr(0x10000 + x)}[kind]
    edges = spark.createDataFrame([(name(int(a)), name(int(b))) for a, b in rng.integers(0, 200, (110, 2))] + [(name(i), name(i + 1)) for i in range(20)], f"a {kind}, b {kind}")
    few = [tuple(bytes(x) if kind == "binary" else x for x in r) for r in links.components(edges).collect()]
    monkeypatch.setattr(links, "ALONE_BYTES", 0)
    many = [tuple(bytes(x) if kind == "binary" else x for x in r) for r in links.components(edges).collect()]
    assert sorted(few) == sorted(many) and len({c for _, c in few}) > 10


def test_shared_keys_lose_no_link(spark):
    rng = np.random.default_rng(7)
    linked = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.04}
    postings = spark.createDataFrame([(k, n, 0, 1) for n in range(40) for k in {int(x) for x in rng.integers(0, 3, 2)}], "key long, node long, rank int, size int")
    shared = {(a["node"], b["node"]) for a in postings.collect() for b in postings.collect() if a["key"] == b["key"] and a["node"] < b["node"]}
    table = spark.createDataFrame(sorted(linked), "a long, b long")
    got = links.shared_key_components(postings, lambda pairs: pairs.join(table, ["a", "b"], "left_semi"), lambda n, m: n == m, rounds=2)
    want = {n: c for n, c in grouped(linked & shared, range(40)).items()}
    found = {r["node"]: r["component"] for r in got.collect()}
    assert all(found.get(n, n) == want[n] for n in range(40))


# --- quality -----------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_scores_ignore_held_out_labels_and_other_columns(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert one == {r["doc_id"]: r["score"] for r in quality.classify(docs.drop("lang").withColumn("source", F.lit(None)), flipped).collect()}


def test_quality_of_odd_rows(spark, odd, none, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = labels.limit(0)
    assert all(r["score"] == 0.5 for r in quality.classify(odd, empty).collect())
    assert quality.classify(none, labels).count() == 0 and quality.keep_good(odd, empty).count() == len(ODD)
    assert quality.keep_good(odd.withColumn("score", F.lit(1)), labels).columns == [*odd.columns, "score"]
    odd_labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (7, 9)], "doc_id long, quality int")
    assert quality.classify(odd, odd_labels).count() == len(ODD)


def test_gradients():
    rng = np.random.default_rng(8)
    x, sizes, y = rng.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.train(x, sizes, y, hidden=3, gate=2, rounds=300)
    assert np.abs(model.bags(x, sizes) - y).max() < 0.1


def test_gradients_against_differences():
    rng = np.random.default_rng(18)
    x, sizes, y = rng.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    starts = np.cumsum(sizes) - sizes
    p = {k: rng.normal(size=s) for k, s in {"W": (5, 3), "a": (3,), "v": (3, 2), "u": (3, 2), "w": (2,), "c": (3,), "b": (1,)}.items()}

    def loss():  # written anew, a document at a time
        total = 0.0
        for at, n, label in zip(starts, sizes, y, strict=True):
            h = np.tanh(x[at : at + n] @ p["W"] + p["a"])
            e = np.exp((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["w"])
            score = 1 / (1 + np.exp(-((e / e.sum()) @ h @ p["c"] + p["b"][0])))
            total -= label * np.log(score) + (1 - label) * np.log(1 - score)
        return total / len(y)

    for name, slope in quality.gradients(p, x, starts, sizes, y).items():
        for at in np.ndindex(p[name].shape):
            kept = p[name][at]
            ways = []
            for step in (1e-6, -1e-6):
                p[name][at] = kept + step
                ways.append(loss())
            p[name][at] = kept
            assert slope[at] == pytest.approx((ways[0] - ways[1]) / 2e-6, abs=1e-7), (name, at)


# --- embeddings ---------------------------------------------------------------------------------------


def vectors(seed=9):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(400, 32))
    near = base[rng.integers(0, 60, 250)] + rng.normal(size=(250, 32)) * 0.08
    hot = base[3] + rng.normal(size=(80, 32)) * 0.02
    return [[float(np.float32(v)) for v in row] for row in np.concatenate([base, near, hot, base[:20], base[:20]])]


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    own = vectors()
    odd = [None, [0.0] * 32, [1.0, None] * 16, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [], [1.0] * 7]
    rows = [(i, v) for i, v in enumerate(own + odd)] + [(None, own[0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    x = np.array(own)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    found = sum(got[i]["n_links"] for i in range(len(own)))
    assert found <= linked.sum() and found >= 0.99 * linked.sum()
    want = grouped([(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)], range(len(own)))
    assert sum(got[i]["component_id"] == want[i] for i in range(len(own))) >= 0.99 * len(own)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(own)))
    for i in range(len(own), len(own) + len(odd)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_several_lengths(spark):
    rows = [(i, [1.0, 0.0, 0.01 * i]) for i in range(6)] + [(10, [1.0, 0.0]), (11, [1.0, 0.01]), (12, [0.0, 1.0]), (20, [2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample=7).collect()}
    assert got == {**{i: (5, 0) for i in range(6)}, 10: (1, 10), 11: (1, 10), 12: (0, 12), 20: (0, 20)}


# --- lines -----------------------------------------------------------------------------------------------


def test_edit_similarity_against_dynamic_programming():
    rng = np.random.default_rng(10)
    for _ in range(300):
        a, b = (list(rng.choice(list("abcd"), int(rng.integers(1, 12)))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        same = 2 * table[-1][-1] / (len(a) + len(b))
        for least in (0.5, 0.8, 0.95):
            assert line_dedup.edit_similar(a, b, least) == (same >= least - 1e-12)


def line_truth(rows):
    """Dropped (id, number) pairs by comparing all pairs of lines by their words alone."""
    own = [(i, no, tuple(w)) for i, t in rows if i is not None and t for no, line in enumerate(t.split("\n")) if (w := line_dedup.normal_words(line.encode()))]
    words = sorted({w for *_, w in own})
    long = [w for w in words if len(w) >= 5]
    pairs = [(a, b) for a in long for b in long if a < b and line_dedup.edit_similar(list(a), list(b), 0.8)]
    group = grouped(pairs, words)
    first = {}
    for i, no, w in sorted(own):
        first.setdefault(group[w], (i, no))
    return {(i, no) for i, no, w in own if first[group[w]] != (i, no)}


def test_line_dedup(spark, docs, odd, none):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdef"), 3))
    pool = [[word() for _ in range(int(rng.integers(2, 90)))] for _ in range(40)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(int(rng.integers(0, 9))):
            line = list(pool[int(rng.integers(len(pool)))])
            if rng.random() < 0.4:
                line[int(rng.integers(len(line)))] = word()
            lines.append("  ".join(line).upper() if rng.random() < 0.2 else " ".join(line))
        rows.append((i, "\n".join(lines)))
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    for df in (made, docs.limit(120).select("doc_id", "text"), odd):
        own = [(r["doc_id"], r["text"]) for r in df.collect()]
        gone = line_truth(own)
        want = collections.Counter((i, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)) for i, t in own)
        out = line_dedup.dedup(df)
        assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
        assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert line_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("changed", ["words", "cut", "both"])
def test_recall_of_blocks_at_the_limit(changed):
    """Pairs of lines as unlike as may be: shares of them that share a key, by edit
    similarity alone. Short lines miss none."""
    rng = np.random.default_rng(12)
    vocabulary = [b"w%d" % i for i in range(20_000)]
    for n in (5, 6, 7, 10, 15, 16, 20, 23, 24, 40, 48, 60, 95, 100, 192):
        lines = []
        for _ in range(150):
            line = [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
            near = list(line)
            for at in rng.choice(n, {"words": n // 5, "cut": 0, "both": n // 10}[changed], replace=False):
                near[at] = vocabulary[int(rng.integers(len(vocabulary)))]
            while changed != "words" and line_dedup.edit_similar(line, shorter := [w for i, w in enumerate(near) if i != rng.integers(len(near))], 0.8):
                near = shorter
            assert line_dedup.edit_similar(line, near, 0.8)
            lines += [line, near]
        _, _, sizes, one, two = line_dedup.line_words([b" ".join(x) for x in lines])
        assert sizes.tolist() == [len(x) for x in lines]
        at, found = line_dedup.candidate_keys(sizes, one, two, lambda w: np.full(len(w), 7.0), 18.0, 5, 0.8)
        keys = collections.defaultdict(set)
        for i, k in zip(at.tolist(), found.tolist(), strict=True):
            keys[i].add(k)
        pairs = [i for i in range(0, len(lines), 2) if len(lines[i + 1]) >= 5]
        share = np.mean([bool(keys[i] & keys[i + 1]) for i in pairs])
        assert share == 1 if n < line_dedup.PAIRED else share > 0.9, (n, share)


def test_words_disturb_one_block_each():
    """Blocks of lines that differ in D words: all but 2 D keep their bits."""
    rng = np.random.default_rng(13)
    line = [b"w%d" % i for i in rng.integers(0, 9_999, 60)]
    other = [b"new%d" % i if i in (3, 30, 31) else w for i, w in enumerate(line)]
    _, _, sizes, one, _ = line_dedup.line_words([b" ".join(line), b" ".join(other)])
    where, keys = line_dedup.block_keys(sizes, one, lambda w: np.full(len(w), 7.0), 18.0, posted=99)
    a, b = set(keys[where == 0].tolist()), set(keys[where == 1].tolist())
    assert len(a - b) <= 6 and len(b - a) <= 6 and len(a & b) >= 5
    many = np.repeat(one[:3], [300, 2, 1])  # more votes than a byte counts
    bits = line_dedup.simhash(many, np.array([0, 300]), np.array([300, 3]))
    voted = line_dedup.mixed(many ^ line_dedup.MIX[2])
    for at, own in enumerate((voted[:300], voted[300:])):
        assert int(bits[at]) == sum((2 * sum(int(v) >> i & 1 for v in own) > len(own)) << i for i in range(line_dedup.BLOCK_BITS))


def test_shared_keys_are_found_across_batches():
    rng = np.random.default_rng(14)
    for size in (1, 2, 3, 50):
        rows = sorted(((int(k), int(d)) for k, d in zip(rng.integers(-6, 6, 60), rng.integers(0, 4, 60))), key=lambda r: r[0])
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + size]]), pa.array([d for _, d in rows[i : i + size]])], names=["key", "d1"]) for i in range(0, 60, size)]
        found = [tuple(r.values()) for b in line_dedup._shared(iter(batches)) for r in b.to_pylist()]
        own = collections.defaultdict(set)
        for k, d in rows:
            own[k].add(d)
        first = {k: f for k, _, f, _ in found}
        assert all(first[k] == f and d != f for k, d, f, _ in found)
        assert {(k, d) for k, d, *_ in found} == {(k, d) for k, o in own.items() if len(o) > 1 for d in o if d != first[k]}
        assert all(m for k, _, _, m in found if len(own[k]) > 2)


def test_packed_keys_are_found_whatever_is_sorted_at_once(monkeypatch):
    lines = pa.RecordBatch.from_arrays([pa.array([1, 2, 3])], names=["id"])
    for seed, most in enumerate((1 << 21, 7, 40) * 20):
        monkeypatch.setattr(line_dedup, "SORTED", most)
        rng = np.random.default_rng(seed)
        rows = [(int(k) << 59 | 1, int(d)) for k, d in zip(rng.integers(-16, 16, 6 * seed), rng.integers(0, 6, 6 * seed))]
        packed = [line_dedup.with_packed(lines, [np.array(rows[i : i + 30], np.int64).reshape(-1, 2)], 2)["packed"].to_pylist() for i in range(0, len(rows), 30)]
        assert all(len(x[0]) <= 4 and x[1:] == [[], []] for x in packed)  # 30 postings make four rows at most
        parts = sorted((r for x in packed for r in x[0]), key=lambda r: r["part"])
        batches = [pa.RecordBatch.from_pylist(parts[i : i + 3], pa.schema([("part", pa.int32()), ("rows", pa.binary())])) for i in range(0, len(parts), 3)]
        found = [tuple(r.values()) for b in line_dedup._shared_packed(iter(batches)) for r in b.to_pylist()]
        own = collections.defaultdict(set)
        for k, d in rows:
            own[k].add(d)
        first = {k: f for k, _, f, _ in found}
        assert all(first[k] == f and d != f for k, d, f, _ in found)
        assert {(k, d) for k, d, *_ in found} == {(k, d) for k, o in own.items() if len(o) > 1 for d in o if d != first[k]}
        assert all(m for k, _, _, m in found if len(own[k]) > 2)


def test_poor_lines_have_blocks():
    """Lines of few and common words: cut by a tenth they still share a block."""
    lines = [[b"w"] * 50, [b"w"] * 46, [b"a", b"b"] * 30, [b"a", b"b"] * 28, [b"|"] * 80 + [b"x", b"y", b"z"], [b"|"] * 76 + [b"x", b"y", b"z", b"new"]]
    _, _, sizes, one, two = line_dedup.line_words([b" ".join(x) for x in lines])
    for rarity in (0.0, 0.1, 2.0):
        at, found = line_dedup.candidate_keys(sizes, one, two, lambda w, r=rarity: np.full(len(w), r), 18.0, 5, 0.8)
        keys = [set(found[at == i].tolist()) for i in range(len(lines))]
        assert all(keys) and keys[0] & keys[1] and keys[2] & keys[3] and (rarity < 1 or keys[4] & keys[5])


def test_lines_that_share_a_passage_are_told_apart_in_the_join(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(60)]
    rows = [" ".join([*(word() for _ in range(18)), *passage]) for _ in range(110)]  # 36 words apart, 31 would link
    rows += [" ".join(word() for _ in range(8)) for _ in range(2_000)]
    held, verifier = [], line_dedup._verifier

    def counted(*args):
        verify = verifier(*args)
        return lambda pairs: held.append(pairs.count()) or verify(pairs)

    monkeypatch.setattr(line_dedup, "_verifier", counted)
    near = rows[0].replace(rows[0].split()[0], "else", 1)
    gone = line_dedup.dropped_lines(spark.createDataFrame(list(enumerate([*rows, near])), "doc_id long, text string")).collect()
    assert [(r["id"], r["numbers"]) for r in gone] == [(len(rows), [0])]
    assert sum(held) < 600, held


def test_copies_under_first_lines_unlike_them_are_not_squared(spark, monkeypatch):
    """Every key's first line links with nothing, so the copies meet through leaders."""
    rng = random.Random(6)
    passage = [f"w{rng.randrange(10**9)}" for _ in range(60)]

    def line(n, fit):
        while True:
            words = [*(f"w{rng.randrange(10**9)}" for _ in range(n)), *passage]
            if fit(line_dedup.line_digests(*line_dedup.line_words([" ".join(words).encode()])[2:])[0][0]):
                return " ".join(words)

    unlike = [line(22, lambda d: d < -(15 << 59)) for _ in range(50)]  # 34 words and more apart, 32 would link
    copies = [line(12, lambda d: d > 0) for _ in range(60)]  # 24 words apart, 28 would link
    rows = [*copies, *unlike, *(" ".join(f"w{rng.randrange(10**9)}" for _ in range(8)) for _ in range(2_000))]
    held, verifier = [], line_dedup._verifier

    def counted(*args):
        verify = verifier(*args)
        return lambda pairs: held.append(pairs.count()) or verify(pairs)

    monkeypatch.setattr(line_dedup, "_verifier", counted)
    gone = line_dedup.dropped_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sorted((r["id"], r["numbers"]) for r in gone) == [(i, [0]) for i in range(1, 60)]
    assert sum(held) < 1_000, held


def test_rarities_count_all_lines(spark):
    rows = [(i, f"all {'half' if i % 2 else 'other'} all\n\n{'seldom' if i % 3000 == 7 else 'often'} all") for i in range(9_000)]
    for parts in (1, 5):
        known = line_dedup.word_rarity(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), "text")
        words = line_dedup.line_words([b"all half seldom unseen"])[3]
        want = [18_000, 4_500, 3, 1]
        assert known.line == pytest.approx(np.log2(18_000))
        assert np.allclose(known(words), [min(np.log2(18_000 / n), line_dedup.RAREST) for n in want])
    assert line_dedup.word_rarity(spark.createDataFrame([], "text string"), "text").line == 1


def test_line_words_and_pieces():
    texts = [b"", b" \n", b"One  two\tONE\n\n\x0bthree\r\n", b"\n\nx", b"a\x00b \xc3\x89"]
    owner, number, sizes, one, two = line_dedup.line_words(texts)
    assert (owner.tolist(), number.tolist(), sizes.tolist()) == ([2, 2, 3, 4], [0, 2, 2, 0], [3, 1, 1, 2])
    assert one[0] == one[2] and len(set(one.tolist())) == 6 and len(set(two.tolist())) == 6
    rng = np.random.default_rng(15)
    words = list({bytes(rng.choice(list(b"ab\x00\xff"), int(rng.integers(1, 40)))) for _ in range(5_000)})
    for order in (words, words[::-1]):
        *_, one, two = line_dedup.line_words([b" ".join(order)])
        assert len(one) == len(set(one.tolist())) == len(set(two.tolist())) == len(words)
        assert dict(zip(order, one.tolist())) == dict(zip(words, line_dedup.line_words([b" ".join(words)])[3].tolist()))
    long = "\n".join("line %d" % i for i in range(500)) + "\n"
    for limit in (1, 7, 64, 1 << 20):
        found = [(i, n + k, line) for group in line_dedup.pieces(pa.array([long, None, "", "x\n", "\n\n"]), limit) for i, n, t in group for k, line in enumerate(t.split(b"\n"))]
        want = [(i, k, line.encode()) for i, t in ((0, long), (3, "x\n"), (4, "\n\n")) for k, line in enumerate(t.split("\n"))]
        assert [x for x in found if x[2]] == [x for x in want if x[2]]


def test_line_dedup_misses_no_link(spark, docs, odd):
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for n in (5, 6, 10, 20, 33, 100):
        for _ in range(6):
            base = list(rng.choice(vocabulary, n))
            near = list(base)
            for at in rng.choice(n, n // 10, replace=False):
                near[at] = "changed"
            rows += [(number, " ".join(base)), (number + 1, " ".join(near[: n - n // 20]))]
            number += 2
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (made, docs.limit(120).select("doc_id", "text"), odd):
        own = [(r["doc_id"], r["text"]) for r in df.collect()]
        gone = {(r["id"], n) for r in line_dedup.dropped_lines(df).collect() for n in r["numbers"]}
        assert gone == line_truth(own)


def test_line_dedup_drops_short_copies(spark):
    rows = [(1, "All rights reserved.\n\nMenu\none two three four"), (2, "all RIGHTS  reserved.\n\nmenu\none two three five"), (3, "\n \nMenu items")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\none two three five", 2), 3: (rows[2][1], 0)}


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, data, tokenizer):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES][0] == "quality classifier" and len(p.STAGES) == 5 and p.ORACLE_SQL is None
    raw = spark.read.parquet(f"{data}/documents.parquet")
    docs, names = raw, raw.columns
    steps = []
    for _, stage in p.STAGES:
        docs = common.materialize(stage(spark, docs, data), "test-stage")
        steps.append(docs)
    assert all(s.columns == names for s in steps[:-1])
    good = quality.classify(raw, spark.read.parquet(f"{data}/labels.parquet")).where("predicted = 1")
    assert {r["doc_id"] for r in steps[0].collect()} == {r["doc_id"] for r in good.collect()}
    before = [(r["doc_id"], r["text"]) for r in steps[0].collect()]
    gone = line_truth(before)
    lines = {i: "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in before}
    kept = {r["doc_id"]: r for r in steps[1].collect()}
    assert all(r["text"] == lines[i] and (r["n_chars"] == len(r["text"]) or r["text"] == dict(before)[i]) for i, r in kept.items())
    assert {i for i, t in lines.items() if t.strip() or t == dict(before)[i]} == set(kept)
    truth = jaccard_truth([(i, r["text"]) for i, r in kept.items()])
    assert {r["doc_id"] for r in steps[2].collect()} == {i for i, (_, c) in truth.items() if c == i}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(steps[2]).collect()}
    assert collections.Counter(r["doc_id"] for r in steps[3].collect()) == collections.Counter({i: n for i, n in copies.items() if n})
    texts = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    for r in steps[4].collect():
        assert r["n_tokens"] == len(tokenizer.encode_ordinary(texts[r["doc_id"]] or ""))
    assert collections.Counter(map(tuple, steps[4].collect())) == collections.Counter(map(tuple, p.run(spark, data).collect()))


def test_stages_on_odd_rows(spark, odd, none, data):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        out = stage(spark, odd, data)
        assert out.count() >= 1, name
        assert stage(spark, none, data).count() == 0, name
    once = p.keep_one_of_each_group(spark, odd, data)
    assert sorted((r["doc_id"] for r in once.collect() if r["doc_id"] is not None)) == [1, 2, 3, 4, 5, 7, 8]
    assert once.where("doc_id is null").count() == 1
