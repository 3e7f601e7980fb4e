"""Fingerprints, secrets, licences and languages: edge cases, and brute force on a small table."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import fingerprint, langid, licenses, secret_scan
from tidewheel.llm import textkit as tk

SF = "/root/testdata/sf0.001"


def prose(seed: int, words: int) -> str:
    """The same prose as the fixture's."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("ba do ki lu men ra sto ti vo ze".split()) for _ in range(r.randint(1, 4))) for _ in range(words))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _shingles(text):
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_words_and_shingles():
    texts = [b"a b c d e f", b"", b"x", b" \n ", b"a b c d e", "é ü b".encode(), b"a\tb\x0bc\x0cd\re f"]
    found = tk.words(texts)
    assert [bytes(found.data[s:e]) for s, e in zip(found.start, found.end)] == [w for t in texts for w in t.split()]
    hashes, docs = tk.shingles(found, len(texts))
    assert np.bincount(docs, minlength=7).tolist() == [2, 0, 1, 0, 1, 1, 2]
    assert hashes[0] == hashes[docs == 4][0] and hashes[docs == 6].tolist() == hashes[docs == 0].tolist()


def test_fingerprints(spark, edge, none):
    rows = fingerprint.with_edits(edge).collect()
    assert len(rows) == edge.count() and fingerprint.with_edits(none).count() == 0
    assert [r["near_next"] for r in rows if r["doc_id"] == 2] .count(1.0) == 1
    prints = {(r["doc_id"]): r["fingerprint"] for r in rows}
    assert prints[1] == prints[8] and prints[4] == prints[5] == prints[6] == "" and len(prints[9]) == fingerprint.BINS
    alone = fingerprint.with_edits(edge.where("doc_id = 1")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == len(prose(1, 40))
    ties = edge.limit(1).select(F.lit(3).alias("doc_id"), F.explode(F.array(F.lit("b b"), F.lit("a a"), F.lit(None).cast("string"))).alias("text"))
    assert fingerprint.with_edits(ties).count() == 3
    a, b = F.lit(prints[1]), F.lit(prints[7])
    assert spark.range(1).select(fingerprint.likeness(a, a), fingerprint.likeness(a, b) < 0.1).first()[:] == (1.0, True)


def test_fingerprint_query(spark):
    from tidewheel.llm.queries import op9_fingerprints

    docs = _documents(spark)
    ids = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in op9_fingerprints(spark, SF).collect()}
    errors = []
    for k, i in enumerate(ids):
        text, other = docs[i]["text"], docs[ids[(k + 1) % len(ids)]]["text"]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(text)
        for near, to in ((rows[i]["near_edited"], edited), (rows[i]["near_next"], other)):
            a, b = _shingles(text), _shingles(to)
            errors.append(near - len(a & b) / len(a | b))
    assert np.sqrt(np.mean(np.square(errors))) < 0.06


def test_sequence_of_hot_and_null_keys(spark):
    r = random.Random(3)
    rows = [(r.choice([7, 7, 7, None, None, *range(50)]), prose(i, 6)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = fingerprint.in_sequence(df, parts=12)
    sizes = [x["count"] for x in dealt.where("visitor = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 200 and len(sizes) > 12
    name = {t: x for t, x in df.select("text", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), name[x[1]], x[1]))
    after = [order[(i + 1) % 600][1] for i in range(600)]
    want = sorted(hashlib.sha256(fingerprint.edited(x[1], y).encode()).hexdigest() for x, y in zip(order, after))
    assert sorted(x["edited_sha256"] for x in fingerprint.with_edits(df).collect()) == want


def test_densified_bins_estimate():
    """Sets far smaller than the bins, and larger ones: the estimate stays near the true similarity."""
    for size in (20, 300):
        words = prose(9, size + 4).split()
        words = [f"{w}{i}" for i, w in enumerate(words)]
        other = words[: len(words) // 2] + [w + "!" for w in words[len(words) // 2 :]]
        a, b = " ".join(words), " ".join(other)
        low = fingerprint.fingerprints([a.encode(), b.encode()])
        true = len(_shingles(a) & _shingles(b)) / len(_shingles(a) | _shingles(b))
        assert abs(fingerprint.likenesses(low[:1], low[1:])[0] - true) < 0.12


def test_secrets(spark, edge, none):
    text = 'password = "Tr0ub4dor&3xKq9Z!w" token=abcdefghijkl é AKIAABCDEFGHIJKLMN x deadbeefdeadbeef0 passwd: short, api_key:\'12345678901\' pwd: password123 secret=api_key:ABCDEFGHIJKLMNOP'
    found = {(k, text[a:b]) for a, k, b in secret_scan.spans(text)}
    assert (0, "token=abcdefghijkl") in found and (1, "AKIAABCDEFGHIJKLMN") in found and (2, "deadbeefdeadbeef0") in found
    assert (3, "Tr0ub4dor&3xKq9Z!w") in found and not any(k == 3 and v == "password123" for k, v in found)
    assert not any(k == 0 and "ABCDEFGHIJKLMNOP" in v for k, v in found)  # a failing match before it uses up its start
    assert secret_scan.guess_decades("password1") < 4 < secret_scan.guess_decades("x8Kq2-Lm9Zt")
    assert secret_scan.guess_decades("qwertyuiop") < 5 and secret_scan.guess_decades("19990412") < 6 and secret_scan.guess_decades("aaaaaaaaaaaa") < 4
    assert secret_scan.guess_decades("") == 0
    cost = secret_scan.guess_decades
    assert cost("monkey2019") <= cost("monkey") + cost("2019") + 0.31
    done = secret_scan.scan(edge)
    assert set(done.columns) == set(edge.columns) and all(r["secrets"] == [] for r in done.collect()) and secret_scan.scan(none).count() == 0
    cleaned = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(secret_scan.redacted(F.col("t")).alias("t")).collect()
    assert "AKIA" not in cleaned[0]["t"] and "deadbeef" not in cleaned[0]["t"] and [r["t"] for r in cleaned[1:]] == [None, ""]
    assert secret_scan.spans(cleaned[0]["t"]) == []


def test_secrets_of_words_repeats_and_addresses():
    guessed = lambda text: [text[a:b] for a, k, b in secret_scan.spans(text) if k == 3]
    for text in ("the token is invalid", "the secret is nothing", "auth: missing", "password: required", "the secret is ingredients", "the token is optional."):
        assert guessed(text) == [], text
    cost = secret_scan.guess_decades
    for n in (64, 200, 5000):
        assert guessed("password: " + "_" * n) == [] and cost("ab1" * n) < 9
    split = "q" * 61 + "nothing"
    assert cost(split) <= cost("q" * 61) + cost("nothing") + 0.31, "a word counts as one wherever it stands"
    secret = "x8Kq2-Lm9ZtW"
    assert guessed(f"see https://{'u' * 80}:{secret}@host") == [secret] and guessed(f"token is {secret}") == [secret]
    assert cost(secret * 3) >= cost(secret) > 9


def test_repeats_and_the_least_cost_by_brute_force():
    r = random.Random(8)
    for n in [*range(1, 11)] * 15 + [40] * 5:
        value = "".join(r.choice("é§ж") for _ in range(n))  # no words, dates or walks
        longest = [max((k for j in range(i) for k in range(n - i + 1) if value[j : j + k] == value[i : i + k]), default=0) for i in range(n)]
        assert secret_scan.repeats(value) == longest, value
        size, far = math.log10(secret_scan._charset(value)), math.log10(n)

        def least(i):
            """By trying every first part of what is left."""
            again = [math.log10(i) + (0.3 if k == longest[i] else far) + 0.3 + least(i + k) for k in range(secret_scan.REPEAT, longest[i] + 1)] if i < n else []
            return min([size + least(i + 1), *again]) if i < n else 0.0

        assert n > 10 or abs(secret_scan.guess_decades(value) - least(0)) < 1e-9, value
    assert [secret_scan.guess_decades(x * 7) < secret_scan.MIN_DECADES for x in ("a", "abcdefghi", "qwertyuiop1")] == [True] * 3
    assert secret_scan.guess_decades("k3Jx9Qz7" * 40) < secret_scan.guess_decades("k3Jx9Qz7") + 7
    assert secret_scan.guess_decades("x" * 20_000) < secret_scan.MIN_DECADES


def test_secret_query(spark):
    from tidewheel.llm.queries import op8_secret_scan

    either = "".join
    names = "|".join(either(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    assign = re.compile("(" + names + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    docs = _documents(spark)
    for r in op8_secret_scan(spark, SF).collect():
        t = docs[r["doc_id"]]["text"]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert not joined or set(joined.split(",")) <= set(r["spans"].split(","))


def test_licences(spark, edge, none):
    rules = licenses.standard()
    mit = " ".join(licenses.SENTENCES[k][0].format("THE AUTHORS") for k in ("mit-grant", "mit-notice-kept", "as-is", "no-liability"))
    assert [n for _, _, n in rules.matches("Copyright 2020.\n" + mit + "\nMore text.")] == ["MIT"]
    assert [n for _, _, n in rules.matches(mit.replace("\n", " ").upper())] == ["MIT"]
    bsd = [licenses.SENTENCES[k][0].format("the University") for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
    assert [n for _, _, n in rules.matches("\n".join(bsd))] == ["BSD-3-Clause"] and [n for _, _, n in rules.matches("\n".join(bsd[:3]))] == ["BSD-2-Clause"]
    assert rules.matches("\n".join([bsd[1], bsd[0], bsd[2]])) == [], "the order counts"
    far = "\n".join([bsd[0], "One.", "Two.", bsd[1], bsd[2]])
    assert [n for _, _, n in rules.matches(far)] == ["BSD-2-Clause"] and rules.matches(far.replace("Two.", "Two.\nThree.")) == []
    text = "la mentré Released under the MIT License and more; licensed under cc by-nc 4.0."
    assert [(text[a:b], n) for a, b, n in rules.matches(text)] == [("Released under the MIT License", "MIT"), ("licensed under cc by-nc 4.0.", "CC-BY-NC-4.0")]
    assert rules.matches("") == [] and rules.matches("the licence was written") == []
    assert all(r["licences"] == [] for r in licenses.scan(edge).collect()) and licenses.scan(none).count() == 0


def test_wrapped_licences():
    rules, known = licenses.standard(), {k: [x.replace("{}", "Some One, Inc.") for x in v] for k, v in licenses.SENTENCES.items()}
    texts = {
        "MIT": [known[k][0] for k in ("mit-grant", "mit-notice-kept", "as-is", "no-liability")],
        "BSD-2-Clause": [known["bsd-grant"][0], "1. " + known["bsd-source"][0], "2. " + known["bsd-binary"][0]],
        "BSD-3-Clause": [known["bsd-grant"][0], "1. " + known["bsd-source"][0], "2. " + known["bsd-binary"][0], "3. " + known["bsd-names"][0]],
        "GPL-3.0": [known[k][0] for k in ("gpl-free", "gpl-hope", "gpl-see")],
        "GPL-2.0": [known[k][0] for k in ("gpl2-free", "gpl-hope", "gpl-see")],
        "LGPL-2.1": [known["lgpl21-free"][0]], "LGPL-3.0": [known["lgpl3-free"][1]], "AGPL-3.0": [known["agpl3-free"][0]], "ISC": [known["isc-grant"][0]],
        "MPL-2.0": [known["mpl-notice"][0]], "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    }
    for name, paragraphs in texts.items():
        for width in (40, 72, 80):
            for mark in ("", " * ", "# ", "// ", "dnl ", "REM ", ";; "):
                lines = [mark + x for p in ["Copyright (c) 2020 Some One", *paragraphs] for x in [*textwrap.wrap(p, width), ""]]
                text = "\n".join(lines + ["int main() { return 0; }"])
                found = rules.matches(text)
                assert [n for _, _, n in found] == [name], (name, width, mark, found)
                words = licenses.normalised(re.sub(r"(?m)^(dnl|REM) ", "", text[found[0][0] : found[0][1]]))
                assert words.startswith(licenses.normalised(paragraphs[0])[:20]) or name == "EPL-2.0"
    assert rules.matches("Licensed under the\nMIT. License") != [] and rules.matches("Licensed under the MIT or another License") == []


NOTICE = """/*
 * Copyright (c) 1998, 2004 {holder}
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
{third} *
 * THIS SOFTWARE IS PROVIDED BY {holder} ``AS IS'' AND
 * ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
 * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
 * ARE DISCLAIMED.
 */
#include <stdio.h>
"""
THIRD = {
    "neither": " * 3. Neither the name of {holder} nor the names of its contributors\n *    may be used to endorse or promote products derived from this software\n *    without specific prior written permission.\n",
    "the name": " * 3. The name of the author may not be used to endorse or promote products\n *    derived from this software without specific prior written permission.\n",
    "advert": " * 3. All advertising materials mentioning features or use of this software\n *    must display the following acknowledgement:\n *      This product includes software developed by {holder}.\n"
    " * 4. Neither the name of {holder} nor the names of its contributors\n *    may be used to endorse or promote products derived from this software\n *    without specific prior written permission.\n",
}


def test_notices_of_any_holder():
    names = lambda text: [n for _, _, n in licenses.standard().matches(text) if n != "LicenseRef-reserved"]
    for holder in ("the copyright holder", "the University", "Google Inc.", "the <organization>", "The Regents of the University of California, Berkeley, and its contributors", "J. R. \"Bob\" Dobbs"):
        for third, want in (("", "BSD-2-Clause"), (THIRD["neither"], "BSD-3-Clause"), (THIRD["the name"], "BSD-3-Clause"), (THIRD["advert"], "BSD-4-Clause")):
            text = NOTICE.format(holder=holder, third=third.format(holder=holder))
            assert names(text) == [want], (holder, want)
            (a, b, _), = [x for x in licenses.standard().matches(text) if x[2] == want]
            assert text[a:b].lstrip(" *").startswith("Redistribution and use") and text[a:b].rstrip(".").endswith(("permission", "acknowledgement:") if third else "distribution")
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE."
    for holder in ("THE X CONSORTIUM", "THE\nAUTHORS OR COPYRIGHT HOLDERS"):
        (a, b, name), = licenses.standard().matches(mit.format(holder))
        assert name == "MIT" and b == len(mit.format(holder))


def test_tags():
    found = lambda text: [(n, text[a:b]) for a, b, n in licenses.standard().matches(text)]
    tag = "SPDX-License-Identifier: "
    for text, names in (
        ("MIT", ["MIT"]), ("MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("BSD-3-Clause", ["BSD-3-Clause"]), ("GPL-2.0", ["GPL-2.0"]), ("GPL-2.0+", ["GPL-2.0"]), ("GPL-3.0-or-later", ["GPL-3.0"]), ("(MIT AND (BSD-2-Clause OR ISC))", ["BSD-2-Clause", "ISC", "MIT"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0"]), ("LGPL-2.1-or-later WITH x-exception OR mit", ["LGPL-2.1", "MIT"]), ("LicenseRef-Own-1", ["LicenseRef-Own-1"]), ("Zlib", ["Zlib"]),
    ):
        for before, after in (("// ", "\n"), ("/* ", " */ int x;"), ("# ", ""), ("<!-- ", " -->")):
            assert found(before + tag + text + after) == [(n, (tag + text).rstrip()) for n in names], text
    assert found(tag + "see LICENSE") == [] and found(tag) == [] and found(tag + "\nMIT") == [] and found("MIT OR Apache-2.0") == []
    assert found(tag + "MIT and more words") == [("MIT", tag + "MIT")]
    both = f"# {tag}MIT\n\nLicensed under the Apache License, Version 2.0.\n"
    assert [n for n, _ in found(both)] == ["MIT", "Apache-2.0"]


def test_licence_query(spark):
    from tidewheel.llm.queries import op7_license_scan

    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    docs = _documents(spark)
    for r in op7_license_scan(spark, SF).collect():
        text = docs[r["doc_id"]]["text"]
        assert {n for line, n in lines.items() if line in text} <= set(r["licenses"].split(","))
        for span in filter(None, r["spans"].split(",")):
            name, a, b = span.rsplit(":", 2)
            assert re.search("licen|rights", text[int(a) : int(b)], re.I), name


def test_languages(spark, edge, none):
    profiles = langid.fit(edge)
    assert profiles.names == ["aa", "bb"]
    rows = langid.identify(edge, profiles).collect()
    assert len(rows) == edge.count()
    for r in rows:
        lang, score = r["language"]
        assert (lang == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= score <= 1
    assert langid.fit(none).predict("text") == ("und", 0.0) and langid.identify(none, profiles).count() == 0
    assert langid.Profiles({"b": [1, 2], "a": [1, 2]}).predict("q")[0] == "a", "ties go by name"


def test_languages_of_copies(spark):
    """A language of few texts in many copies is learned, and its copies count once."""
    few = spark.range(300).select(F.element_at(F.array(*(F.lit(f"{w} {w}") for w in ("xyx", "yzy", "zxz"))), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("xx").alias("lang"))
    once = spark.createDataFrame([("xyx xyx", "xx"), ("yzy yzy", "xx"), ("zxz zxz", "xx"), ("aba", "aa")], "text string, lang string")
    more = few.union(once.where("lang = 'aa'")).union(few.where("text = 'xyx xyx'"))
    for sample in (3, 20):
        learned, plain = langid.fit(more, sample=sample), langid.fit(once, sample=sample)
        assert learned.names == ["aa", "xx"] and (learned.codes == plain.codes).all() and (learned.ranks == plain.ranks).all()


def test_out_of_place_by_hand():
    from collections import Counter

    text = "aba ab"
    grams = Counter()
    padded = "_aba_ab_"
    for n in range(2, langid.ORDERS + 1):
        grams.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    grams.update(c for c in padded if c != "_")
    codes, counts = langid.ngrams(text)
    code = lambda g: sum(ord(c) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in grams.items()}


def test_language_query_is_accurate(spark):
    from tidewheel.llm.queries import op6_language_id

    docs = _documents(spark)
    held = [r for r in op6_language_id(spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def _languages_by_hand(docs):
    """Profiles and predictions by counters of strings: {doc_id: (lang, score)}."""
    from collections import Counter

    def ranked(texts):
        grams = Counter()
        for text in texts:
            runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
            own = "_" + "_".join(runs) + "_" if runs else ""
            grams.update(c for c in own if c != "_")
            for n in range(2, langid.ORDERS + 1):
                grams.update(own[i : i + n] for i in range(len(own) - n + 1))
        return sorted(grams, key=lambda g: (-grams[g], len(g), g))[: langid.PROFILE]

    learned = {}
    for i, r in docs.items():
        if zlib.crc32(str(i).encode()) % 5 and r["lang"] is not None and r["text"] is not None:
            learned.setdefault(r["lang"], set()).add(r["text"])
    profiles = {name: {g: k for k, g in enumerate(ranked(texts))} for name, texts in sorted(learned.items())}
    out = {}
    for i, r in docs.items():
        top = ranked([r["text"] or ""])
        apart = sorted((sum(abs(p[g] - k) if g in p else langid.PROFILE for k, g in enumerate(top)), name) for name, p in profiles.items())
        out[i] = (apart[0][1], 1 - apart[0][0] / apart[1][0]) if top else (langid.UNKNOWN, 0.0)
    return out


def test_language_query_by_brute_force(spark):
    from tidewheel.llm.queries import op6_language_id

    want = _languages_by_hand(_documents(spark))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op6_language_id(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, i


def _licences_by_hand(text):
    """Licences by trying every known sentence at every word and every rule at every sentence: (name, words of the span)."""
    at = list(re.finditer(r"[^\W_]+(?:\.[0-9]+)*", text))
    words = [m[0].lower() for m in at]
    sentence = [0]
    for a, b in zip(at, at[1:]):
        between = text[a.end() : b.start()]
        sentence.append(sentence[-1] + bool(re.search(r"[.:;!?]\s|\n[^\w\n]*\n", between)))
    seen = set()
    for k, several in licenses.SENTENCES.items():
        for s in several:
            head, *tail = [licenses.normalised(p).split() for p in s.split("{}")]
            for i in [i for i in range(len(words)) if words[i] == head[0] and words[i : i + len(head)] == head]:
                ends = [i + len(head) - 1]
                if tail:
                    ends = [c + len(tail[0]) - 1 for c in range(i + len(head) + 1, i + len(head) + licenses.HOLDER + 1) if words[c : c + len(tail[0])] == tail[0]][:1]
                seen |= {(i, end, k) for end in ends}
    seen = sorted(x for x in seen if not any(y[:2] != x[:2] and y[0] <= x[0] and x[1] <= y[1] for y in seen))
    out, i = [], 0
    while i < len(seen):
        fits = []
        for name, rules in licenses.RULES.items():
            for rule in rules:
                run = seen[i : i + len(rule)]
                near = all(sentence[b[0]] - sentence[a[1]] <= licenses.GAP + 1 for a, b in zip(run, run[1:]))
                fits += [(len(rule), name)] if [x[2] for x in run] == rule and near else []
        most = max((n for n, _ in fits), default=1)
        out += [(name, words[seen[i][0] : seen[i + most - 1][1] + 1]) for n, name in sorted(fits) if n == most]
        i += most
    return out


def test_licences_by_brute_force():
    r, rules = random.Random(11), licenses.standard()
    holders = ["the copyright holder", "Example, Inc.", "THE AUTHORS OR COPYRIGHT HOLDERS", "the <organization>", " ".join(["word"] * (licenses.HOLDER + 1))]
    every = [s.replace("{}", h) for several in licenses.SENTENCES.values() for s in several for h in (holders if "{}" in s else holders[:1])]
    orders = [rule for several in licenses.RULES.values() for rule in several]
    matched = 0
    for n in range(400):
        parts = []
        for _ in range(r.randint(1, 5)):
            parts += [r.choice(licenses.SENTENCES[k]).replace("{}", r.choice(holders)) for k in r.choice(orders)] if r.random() < 0.6 else [r.choice(every)]
            parts += [prose(n, 4) + r.choice(["", ".", "!"]) for _ in range(r.randint(0, 4))]
        text = "".join(p + r.choice([" ", "\n", "\n\n", "\n # \n", " * "]) for p in parts)
        want = _licences_by_hand(text)
        matched += len(want)
        assert [(name, licenses.normalised(text[a:b]).split()) for a, b, name in rules.matches(text)] == want, text
    assert matched > 400


def test_licence_query_by_brute_force(spark):
    from tidewheel.llm.queries import op7_license_scan

    docs = _documents(spark)
    rows = op7_license_scan(spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        text = docs[row["doc_id"]]["text"] or ""
        spans = [x.rsplit(":", 2) for x in row["spans"].split(",") if x]
        want = _licences_by_hand(text)
        assert [(name, licenses.normalised(text[int(a) : int(b)]).split()) for name, a, b in spans] == want, row["doc_id"]
        assert row["n_matches"] == len(want) and row["licenses"] == ",".join(sorted({name for name, _ in want}))
