import re
from re import _constants as ops
from re import _parser as parser

import pytest
from llm_help import EDGES, documents, frame

from stanceflow.llm import licenses
from stanceflow.llm.license_rules import BASE, signatures

ROWS = [(401, "under the MIT license under the mit-license"), (402, "CC BY-NC-SA 4.0, cc.by.nc"),
        (403, "Licensed under the Apache License, Version 2.0."), (404, "ist mit der"), (405, "é under the mit license"),
        (406, "SPDX-License-Identifier: BSD-3-Clause"), (407, "cc by nc " * 400)]


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    hits = [(i, label) for phrase, label in BASE for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return (len(words), len(hits), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in hits})))


def test_base_equals_brute_force(spark):
    edges = [(None if i is None else i + 1000, t) for i, t in EDGES]
    docs = documents(spark).select("doc_id", "text").unionByName(frame(spark, ROWS + edges))
    got = {}
    for r in licenses.digest(docs).collect():
        got.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(r.text)


def test_rules_find_forms_and_suppress_contained_ones(spark):
    got = {r.doc_id: r.labels for r in licenses.digest(frame(spark, ROWS)).collect()}
    assert got[406] == "bsd-3-clause" and got[404] == "" and got[403] == "apache-2"
    assert got[402] == "cc-by-nc,cc-by-nc-sa"
    scanner = licenses.Scanner(signatures())

    def found(text):
        return [(a, b, label) for a, b, label, _ in scanner.scan(scanner.words(text))[1]]

    assert found("GNU General Public License, version 3") == [(0, 6, "gpl-3")]
    assert found("distributed under the terms of the GNU Lesser General Public License v2.1")[0][2] == "lgpl-2.1"
    assert found("https://opensource.org/licenses/MIT") == [(1, 5, "mit")]


def test_every_rule_needs_its_keyword():
    rules = signatures()
    assert len(rules) > 250 and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    for r in rules:
        assert r.keyword == r.keyword.lower() and re.compile(r.pattern)


def samples(parts):
    """Texts of a pattern that between them take each of its alternatives."""
    out = []
    for op, arg in parts:
        if op is ops.LITERAL:
            out.append([chr(arg)])
        elif op is ops.IN:
            out.append([chr(x if kind is ops.LITERAL else x[0]) for kind, x in arg if kind is not ops.NEGATE])
        elif op is ops.BRANCH:
            out.append([t for way in arg[1] for t in samples(way)])
        elif op is ops.SUBPATTERN:
            out.append(samples(arg[3]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            out.append(samples(arg[2]) + [""] * (arg[0] == 0))
    most = max(map(len, out), default=1)
    return ["".join(o[(i + shift * k) % len(o)] for k, o in enumerate(out)) for i in range(most) for shift in (0, 1)]


def test_prefilter_loses_no_detection():
    rules = signatures()
    some, every = licenses.Scanner(rules), licenses.Scanner([r._replace(keyword=" ") for r in rules])
    texts = {t for r in rules for t in samples(parser.parse(r.pattern))}
    assert len(texts) > 1000
    for t in texts:
        words = every.words(f"x {t} x")
        assert some.scan(words) == every.scan(words), t


@pytest.mark.parametrize("text, label", [
    ("released under the GNU GPL", "gpl"), ("Expat License", "mit"), ("Internet Systems Consortium License", "isc"),
    ("PSF License", "python-2"), ("do what the fuck you want to public license", "wtfpl"),
    ("Open RAIL-M", "openrail"), ("SPDX-Licence-Identifier: MIT", "mit"),
    ("https://choosealicense.com/licenses/mit", "mit"),
    ("All advertising materials mentioning features or use of this software must display", "bsd-4-clause"),
    ("Neither the name of " + "the long-named institute " * 9 + "may be used to endorse or promote products",
     "bsd-3-clause")])
def test_forms_without_the_usual_word(text, label):
    scanner = licenses.Scanner(signatures())
    assert [d[2] for d in scanner.scan(scanner.words(text))[1]] == [label]


def test_base_places_do_not_depend_on_the_rules():
    few = licenses.Scanner([r for r in signatures() if r.label == "zlib"])
    for text in ("under the MIT license", "under the MIT license, or the zlib license"):
        assert few.scan(few.words(text))[0] == [(0, "mit")]


def test_name_of_a_bsd_notice_ends():
    scanner = licenses.Scanner(signatures())
    text = "neither the name of x. This software is provided as is. The names may be used to endorse or promote products"
    assert scanner.scan(scanner.words(text))[1] == []


def test_edges(spark):
    out = {r.doc_id: r for r in licenses.digest(frame(spark, EDGES, extra=True)).collect()}
    assert out[1].n_words == 0 and out[1].first_word is None and out[1].score == 0.0
    assert licenses.digest(frame(spark, [])).count() == 0
