"""License scan by ordered signature rules.

A text's words (in lower case, parted by one blank) are searched for all keywords of the rules at once; only rules whose
keyword occurs are tried. Their matches are intervals of words. A match is suppressed when another match contains its
interval and has a higher priority, or the same priority and a longer interval or, of equal ones, an earlier rule. What is
left are the detections. Base phrases are looked for in the same words and are reported whatever suppresses what.

Nothing is shuffled; a task holds one batch of texts. Cases: null and empty texts have no words and no detections; very long
texts are scanned whole; repeated rows are scanned each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_rules import RULES, Rule
from tidemark.llm.shared import LOWER, UPPER, slices

#: Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SCHEMA = (
    "doc_id long, n_words long, base array<struct<label: string, start: long, words: long>>, "
    "found array<struct<label: string, start: long, words: long, priority: int, weight: double>>"
)
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWERING = str.maketrans(UPPER, LOWER)


class Scanner:
    def __init__(self, rules: list[Rule] = RULES, base: dict[str, str] = BASE):
        import ahocorasick

        self.rules, self.base = rules, base
        self.gate = ahocorasick.Automaton()
        for keyword in {r.keyword for r in rules} | set(base):
            self.gate.add_word(keyword, keyword)
        self.gate.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words, base places ``(label, start, words)`` and detections ``(label, start, words, priority, weight)``."""
        words = _WORDS.findall((text or "").translate(_LOWERING))
        plain = " ".join(words)
        held = {keyword for _, keyword in self.gate.iter(plain)} if plain else set()
        if not held:
            return len(words), [], []
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        base = []
        for phrase, label in self.base.items():
            if phrase in held:
                n = phrase.count(" ") + 1
                for m in re.finditer(f"(?<![^ ])(?={phrase}(?![^ ]))", plain):
                    base.append((label, bisect_left(starts, m.start()), n))
        spans = []
        for order, rule in enumerate(self.rules):
            if rule.keyword in held:
                for m in rule.pattern.finditer(plain):
                    begin = bisect_left(starts, m.start())
                    spans.append((begin, bisect_left(starts, m.end() + 1), order, rule))
        return len(words), sorted(base, key=lambda b: (b[1], b[0])), [
            (r.label, begin, end - begin, r.priority, r.weight) for begin, end, _, r in resolve(spans)
        ]


def resolve(spans: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, int, Rule]]:
    """The spans ``(begin, end, order, rule)`` that no other suppresses, by place.

    From the strongest (priority, length, order) on, a span is dropped if one that was kept contains it: one that contains
    it and was dropped itself is contained in a stronger one in turn. Of the kept spans that begin at or before a place only
    the farthest end matters; kept spans of one priority never contain each other, so few are held per place.
    """
    kept: list[tuple[int, int, int, Rule]] = []
    begins: list[int] = []  # of kept spans, ascending, each reaching farther than all before it
    ends: list[int] = []
    for span in sorted(spans, key=lambda s: (-s[3].priority, s[0] - s[1], s[2])):
        begin, end = span[0], span[1]
        at = bisect_left(begins, begin + 1)
        if at and ends[at - 1] >= end:
            continue
        kept.append(span)
        while at < len(begins) and ends[at] <= end:
            del begins[at], ends[at]
        begins.insert(at, begin)
        ends.insert(at, end)
    return sorted(kept, key=lambda s: (s[0], s[1], s[2]))


@cache
def _scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words``, the base places and the detections of every whole text of ``docs (doc_id, text)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        base_kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
        found_kind = pa.list_(
            pa.struct(
                [("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64())]
            )
        )
        names = ["doc_id", "n_words", "base", "found"]
        for batch in slices(batches):
            counts, base, found = [], [], []
            for text in batch[1].to_pylist():
                n, places, detections = scanner(text)
                counts.append(n)
                base.append([dict(zip(("label", "start", "words"), p, strict=True)) for p in places])
                found.append([dict(zip(("label", "start", "words", "priority", "weight"), d, strict=True)) for d in detections])
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(counts, pa.int64()), pa.array(base, base_kind), pa.array(found, found_kind)], names
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    """Base counts and labels. The score is the chance that some detection holds, were they independent."""
    starts = F.transform("base", lambda b: b["start"])
    names = lambda c: F.transform(c, lambda b: b["label"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    strongest = F.aggregate(
        F.transform("found", lambda f: f["weight"]), F.lit(1.0), lambda s, w: s * (1 - w), lambda s: 1 - s
    )
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(names("base")).alias("base_labels"),
        joined(F.concat(names("base"), names("found"))).alias("labels"), strongest.alias("score"),
        F.size("found").cast("long").alias("n_detections"),
    )
