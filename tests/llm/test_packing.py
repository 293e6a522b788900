import itertools
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from tidemark.llm import packing as pk
from tidemark.llm import queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_split(numbers, k):
    best = None
    for where in itertools.product(range(k), repeat=len(numbers)):
        sums = [sum(n for n, w in zip(numbers, where) if w == g) for g in range(k)]
        best = min(best or 10**9, max(sums) - min(sums))
    return best


def test_differencing_is_near_the_best_split():
    rng = random.Random(4)
    for k in (2, 3):
        for _ in range(10):
            numbers = [rng.randint(1, 500) for _ in range(8)]
            groups = pk.differencing(numbers, k)
            assert sorted(i for g in groups for i in g) == list(range(8))
            sums = [sum(numbers[i] for i in g) for g in groups]
            assert max(sums) - min(sums) <= brute_split(numbers, k) + 120


def test_textbook_case():
    groups = pk.differencing([8, 7, 6, 5, 4], 2)  # 16 and 14
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in groups) == [14, 16]


def test_window_count_rises_until_all_fit():
    assert pk.pack_lengths([], 10) == []
    assert sorted(map(len, pk.pack_lengths([6, 6, 6], 10))) == [1, 1, 1]  # 18 ids would fill two windows, but no two fit
    rng = random.Random(1)
    lengths = [rng.randint(1, 512) for _ in range(1500)]
    groups = pk.pack_lengths(lengths, 2048)
    assert max(sum(lengths[i] for i in g) for g in groups) <= 2048
    assert len(groups) * 2048 <= sum(lengths) * 1.01 + 2048


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_round_trip_of_the_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(
        cases.documents(spark).selectExpr("doc_id + 10000", "text").where("doc_id is not null").dropDuplicates()
    ).repartition(3)
    rows = pk.pack_documents(docs, PATH).collect()
    whole = Tokenizer.from_file(PATH)
    texts = {r[0]: r[1] or "" for r in docs.collect()}
    want = {i: e.ids + [1] for i, e in zip(texts, whole.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    pieces, places = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, ids in want.items():
        found = sorted(pieces[i])
        assert [x for _, p in found for x in p] == ids
        assert [s for s, _ in found] == list(itertools.accumulate([0] + [len(p) for _, p in found[:-1]]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) * 2048 <= sum(map(len, want.values())) * 1.02 + 3 * 2048


def test_chunks_give_the_ids_of_whole_texts():
    whole, tokens = Tokenizer.from_file(PATH), pk.Tokens(PATH, most=50)
    odd = [
        "á e ́x", "don't 's 'LL", "tab\tand nbsp em", "<|endoftext|> x<|startoftext|>y", "ΑΣ Σ ΟΔΟΣ.", "  \n\n ",
        "ñandú straße façade über ÿ ö÷x éÉ à á â ã ä å æ ç è é ê ë ì í î ï ð ñ ò ó ô õ ö ø ù ú û ü ý þ ß", "İstanbul ß ﬁ 1234 ½", "👩‍👩‍👧 ok", "x" * 5000, "<|STARTOFTEXT|> A <|EndOfText|>", "A.B, C.. d., e', F.", "\x00\x1f\x85 z", "한국어 한",
    ]
    for text, got in zip(odd, tokens([t.encode() for t in odd]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_query_and_hard_rows(spark):
    r = queries.QUERIES["op4_packing"](spark, "/root/testdata/sf0.001").first()
    assert set(r.asDict()) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    empty = pk.pack_documents(cases.documents(spark).where("doc_id = 3"), PATH).collect()
    assert [(e["length"], zlib.crc32(e["ids"])) for e in empty] == [(1, zlib.crc32(b"\1\0\0\0"))]
    assert pk.pack_documents(cases.documents(spark), PATH).select("doc_id").distinct().count() == 9
    assert pk.pack_documents(cases.empty(spark), PATH).count() == 0


def test_a_file_with_other_rules_gets_whole_texts(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  words, and. a\nline", "", " It's <|endoftext|> 12é"]
    plain = Tokenizer.from_file(path)
    tokens = pk.Tokens(path)
    assert tokens.whole is not None
    assert [np.frombuffer(t, "<u4").tolist() for t in tokens([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert pk.Tokens(public_tokenizers.path("word_bpe_49k.json")).whole is None


def test_a_small_memory_changes_no_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"word{i % 7} and {i} more, of it. The end" for i in range(50)]
    one, two = pk.Tokens(path), pk.Tokens(path, most=3)
    plain = Tokenizer.from_file(path)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert one([t.encode() for t in texts]) == want == two([t.encode() for t in texts])
    assert len(two.held) <= 3 and len(two.held.before) <= 3


def test_chunks_held_stay_few():
    """Both generations together, whatever the number of different chunks."""
    tokens = pk.Tokens(PATH)
    tokens([" ".join(f"w{k}" for k in range(at, at + 13_000)).encode() for at in range(0, 260_000, 13_000)])
    assert len(tokens.held) + len(tokens.held.before) <= 200_000


def test_chunks_go_when_a_task_ends(spark, monkeypatch):
    """Read to its end or stopped early, a task leaves no chunks in a worker that serves other stages next."""
    tasks = []

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, task, schema):
            tasks.append(task)

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pk, "TaskContext", Context)
    pk.pack_documents(Docs(), PATH)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of it " * 600, "others"])], ["doc_id", "text"])
    held = pk._tokens(PATH).held
    assert sum(sum(b.column("length").to_pylist()) for b in tasks[0](iter([batch]))) > 2400
    assert not held and not held.before
    rows = tasks[0](iter([batch, batch]))
    next(rows)
    assert held
    rows.close()
    assert not held and not held.before


def test_letter_merges_are_those_of_the_vocabulary():
    """Every rule makes a token of its own, later rules later tokens, and words merge as the tokenizer merges them."""
    model = json.load(open(PATH, encoding="utf-8"))["model"]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    assert made == list(range(512, 512 + len(made)))
    held = pk.Tokens(PATH).held
    assert held.letters is not None
    rng, letters = random.Random(8), "abcdefghijklmnopqrstuvwxyzßäöüéø"
    words = ["".join(rng.choice(letters[: rng.choice((5, 26, 32))]) for _ in range(rng.randint(1, 24))) for _ in range(30_000)]
    words += [t.removesuffix("</w>") for t in model["vocab"] if re.fullmatch("[a-z]+(</w>)?", t)]
    for word in words:
        assert held.letters(word + "_") == [t.id for t in held.merge(word.encode().decode("latin-1").translate(pk._BYTES))], word
