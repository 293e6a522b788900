import re
from re import _parser

import pytest

from tests.llm import cases
from tidemark.llm import license_scan as ls
from tidemark.llm.license_rules import RULES

FOLDER = "/root/testdata/sf0.01"


def least(parsed):
    """A shortest match of a parsed pattern, alternatives as a list of all shortest matches."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "IN":
            parts = [chr(a[1][0] if isinstance(a[1], tuple) else a[1]) for a in arg if str(a[0]) in ("LITERAL", "RANGE")] or ["w"]
            parts = parts if str(arg[0][0]) != "NEGATE" else ["w"]
        elif name == "SUBPATTERN":
            parts = least(arg[-1])
        elif name == "BRANCH":
            parts = [x for b in arg[1] for x in least(b)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            parts = [x * max(arg[0], 0) for x in least(arg[2])]
        elif name == "NOT_LITERAL":
            parts = ["w"]
        else:  # word limits
            parts = [""]
        out = [a + b for a in out for b in dict.fromkeys(parts)]
    return out


def test_hundreds_of_rules():
    assert len(RULES) >= 200 and len({r.pattern.pattern for r in RULES}) == len(RULES)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.pattern.pattern[9:60])
def test_no_match_without_the_keyword(rule):
    for text in least(_parser.parse(rule.pattern.pattern)):
        assert rule.pattern.search(text), text
        assert rule.keyword in text, (rule.keyword, text)
        assert any(d[0] == rule.label or d[1] >= 0 for d in ls.Scanner()(text)[2])


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in ls.BASE.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return words, places


def test_base_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    made = [(2000, "CC-BY cc by 4.0, cc-bye xcc by"), (2001, "GENERAL\nPublic  License; all RIGHTS reserved all rights reserved")]
    docs = docs.union(spark.createDataFrame(made, "doc_id long, text string")).union(cases.documents(spark).selectExpr("doc_id + 5000", "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in ls.digest(ls.scan(docs)).collect():
        words, places = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_suppression_against_all_pairs():
    scanner = ls.Scanner()
    text = "Licensed under the Apache License, Version 2.0 and GNU General Public License version 3. Creative Commons Attribution-ShareAlike 4.0"
    words, spans = re.findall("[a-z0-9]+", text.lower()), []
    plain = " ".join(words)
    for order, rule in enumerate(RULES):
        for m in rule.pattern.finditer(plain):
            spans.append((plain[: m.start()].count(" "), plain[: m.end()].count(" ") + 1, order, rule))
    key = lambda s: (-s[3].priority, s[0] - s[1], s[2])
    held = [s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and key(o) < key(s) for o in spans)]
    assert [d[:3] for d in scanner(text)[2]] == [(s[3].label, s[0], s[1] - s[0]) for s in sorted(held)]
    assert {d[0] for d in scanner(text)[2]} == {"apache-2.0", "gpl-3.0", "cc-by-sa"}


def test_license_lines_of_the_tables():
    found = lambda t: {d[0] for d in ls.Scanner()(t)[2]}
    assert found("Released under the MIT License.") == {"mit"}
    assert found("Licensed under CC BY-NC 4.0.") == {"cc-by-nc"}
    assert found("This work is licensed under the GNU General Public License, version 3.") >= {"gpl-3.0"}
    assert found("All rights reserved.") == {"reserved"}
    assert found(None) == found("") == set()


def test_empty(spark):
    assert ls.digest(ls.scan(cases.empty(spark))).count() == 0
