import re

from loomlake.llm import licenses


def read(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}


def test_base_phrases(spark):
    texts = ["Released under the MIT License.", "mit... LICENSE mit-license", "submit license", "Apache\nLicense and General Public License", "general public licenses", None, "", "文字 mit license", "MİT license", "mit 2 license", "x " * 50_000 + "mit license"]
    for k, r in read(spark, texts).items():
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[k] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        spots = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for label, p in licenses.PHRASES.items()}
        flat = [i for s in spots.values() for i in s]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(flat), min(flat, default=None), max(flat, default=None)), texts[k]
        assert r.base_labels == ",".join(sorted(x for x, s in spots.items() if s))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": {"apache", "apache-notice"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-notice"},
        "licensed under the General Public License as published by the Free Software Foundation, version 2 or any later version": {"gpl", "gpl-notice"},
        "licensed in the GNU General Public License, version 3": {"gpl"},
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
        "Copyright (c) 2020 Somebody Or Other. All rights reserved.": {"rights-reserved"},
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": {"mit-text"},
        "Permission is hereby granted, free of charge, to every person obtaining a copy of this software and associated documentation files to deal in the Software without restriction": set(),
        "no notice at all": set(),
    }
    got = read(spark, list(cases))
    for k, want in enumerate(cases.values()):
        assert set(filter(None, got[k].labels.split(","))) == want
    assert got[8].score == 0 and got[3].score == 0.5 and got[0].score > 0.8


MIT = """Copyright (c) 2019 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_texts(spark):
    """A license as it is published, with optional wording added and names replaced; and with a mandatory word changed."""
    cases = {
        MIT: {"mit-text", "mit-whole"},
        MIT.replace("this permission notice shall", "this permission notice (including the next paragraph) shall").replace("AUTHORS OR COPYRIGHT HOLDERS", "FOUNDATION"): {"mit-text", "mit-whole"},
        MIT.replace("OUT OF OR IN", "OUT OF AND IN"): {"mit-text"},
    }
    got = read(spark, list(cases))
    for k, want in enumerate(cases.values()):
        assert set(filter(None, got[k].labels.split(","))) == want
    assert got[0].score > got[2].score > 0.9


def spoken(wording, optional, rng):
    """A text that a template accepts: its optional regions in or out, its replaceable ones filled."""
    wording = re.sub(r"\[\[(.*?)\]\]", r"\1" if optional else "", wording)
    filled = re.sub(r"\{\{(\d+)-(\d+)\}\}", lambda m: " ".join(f"Name{rng.randrange(9)}" for _ in range(rng.randint(int(m[1]), int(m[2])))), wording)
    return " ".join(w.upper() if rng.random() < 0.3 else w for w in filled.split()).replace(" and ", ", and ")


def test_every_template_accepts_its_variants_and_needs_its_mandatory_words(spark):
    import random

    rng = random.Random(3)
    texts, want = [], []
    for label, wording in licenses.TEMPLATES:
        for optional in (True, False):
            texts.append("Before it. " + spoken(wording, optional, rng) + ". After it: license.")
            want.append((label, True))
        mandatory = [w for w in re.sub(r"\[\[.*?\]\]|\{\{.*?\}\}", " ", wording).split()]
        word = mandatory[len(mandatory) // 2]
        texts.append(re.sub(rf"(?i)\b{word}\b", "otherword", spoken(wording, False, rng)) + " license")
        want.append((label, False))
    got = read(spark, texts)
    for k, (label, accepted) in enumerate(want):
        assert (label in got[k].labels.split(",")) == accepted, texts[k]


def test_compiled_automaton():
    pattern, mandatory = licenses.compile_template("a [[b c]] {{0-2}} d")
    assert mandatory == 2
    for text, ok in {" a d": True, " a b c d": True, " a x y d": True, " a b c x y d": True, " a x y z d": False, " a b d": True, " d a": False}.items():
        assert bool(re.search(pattern, text)) == ok, text


def test_odd_rows(spark, odd, none):
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(none).count() == 0
