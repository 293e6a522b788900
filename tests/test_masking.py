import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import masking as mk

SEED = "seed"


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(500).select(
        "id",
        F.concat(F.lit("First"), "id", F.lit(" Second"), "id", F.lit(" Third"), "id").alias("name"),
        F.concat(F.lit("u"), "id", F.lit("@d"), "id", F.lit(".x")).alias("email"),
        (F.col("id") * 7 + 12345).alias("number"),
    )


def drawn_order(ids):
    return sorted(ids, key=lambda i: hashlib.md5(f"{SEED}|{i}".encode()).hexdigest())


def draw(purpose, i, low, high):
    return low + int(hashlib.md5(f"{SEED}|{purpose}|{i}".encode()).hexdigest()[:7], 16) % (high - low + 1)


def test_rank_is_the_sorted_position(spark, people):
    for digits in (1, 4):
        ranks = {r["id"]: r["_rank"] for r in mk.global_rank(people, ["id"], SEED, digits).collect()}
        assert ranks == {i: n for n, i in enumerate(drawn_order(range(500)))}


@pytest.mark.parametrize("block", [16, 100, 1 << 16])
def test_swap_takes_the_drawn_neighbour_whatever_the_block(spark, people, block):
    order = drawn_order(range(500))
    place = {i: n for n, i in enumerate(order)}

    def want(i):
        back = place[i] - draw("number.1", i, 1, 6)
        other = order[back] if back >= 0 else order[place[i] + draw("number.2", i, 1, 6)]
        return other * 7 + 12345

    done = mk.scramble(people, ["id"], {"number": mk.swapped()}, SEED, block=block)
    assert {r["id"]: r["number"] for r in done.collect()} == {i: want(i) for i in range(500)}


def test_rows_keys_and_other_columns_stay(spark, people):
    spec = [
        {"column": "name", "method": "name"},
        {"column": "email", "method": "email", "args": {"substitute": True}},
        {"column": "number", "method": "digits", "args": {"as_number": True}},
    ]
    done = mk.mask_by_spec(people.withColumn("note", F.lit("n")), ["id"], spec, SEED)
    rows = done.collect()
    assert sorted(r["id"] for r in rows) == list(range(500)) and {r["note"] for r in rows} == {"n"}
    again = mk.mask_by_spec(people.repartition(3).withColumn("note", F.lit("n")), ["id"], spec, SEED).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    real = {r["id"]: r["name"].upper() for r in people.collect()}
    assert not any(r["name"] == real[r["id"]] for r in rows)
    assert all(not set("_iu") & set(r["email"].split("@")[0]) for r in rows)


def test_short_words_and_tiny_tables(spark):
    two = spark.createDataFrame([(1, "a b"), (2, "c d")], "id long, name string")
    done = {r["id"]: r["name"] for r in mk.scramble(two, ["id"], {"name": mk.name_words()}, SEED).collect()}
    assert len(done) == 2 and all(v is None or v.isupper() or " " in v for v in done.values())
    assert mk.scramble(two.limit(0), ["id"], {"name": mk.name_words()}, SEED).count() == 0
    missing = spark.createDataFrame([(i, None if i % 2 else f"v{i}") for i in range(40)], "id long, name string")
    assert mk.scramble(missing, ["id"], {"name": mk.swapped()}, SEED).count() == 40


def test_updates_need_unique_keys(spark, people):
    new = spark.createDataFrame([(1, "x"), (1, "y")], "id long, name string")
    with pytest.raises(Exception, match="duplicate key"):
        mk.apply_updates(people, new, ["id"]).collect()
    done = mk.apply_updates(people, new.limit(1), ["id"])
    assert done.count() == 500 and done.where("name IN ('x', 'y')").count() == 1


def test_unknown_method_is_refused(spark, people):
    with pytest.raises(ValueError, match="unknown masking method"):
        mk.mask_by_spec(people, ["id"], [{"column": "name", "method": "rot13"}], SEED)
