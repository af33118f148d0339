import pytest
from pyspark.sql import functions as F

from dyadic.functions.numeric import affinity_label, coerce_number
from dyadic.functions.text import char_vocabulary, code_point_table, encode_chars, hash_vector, ngram_features, normalize_sequence
from dyadic.operators.pairs import PairData, densify, entity_index, grid, last_write
from dyadic.operators.skew import find_hot_keys, lookup
from dyadic.operators.splits import assign_environments, sample_exact, split_pairs
from dyadic.predictors.mixhop import training_view


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(f"a{i}", f"b{j}", float((i * 7 + j) % 5)) for i in range(10) for j in range(8)]
    return spark.createDataFrame(rows, "a string, b string, y double")


def members(frame, fold):
    return {(r.a, r.b) for r in frame.where(f"fold = '{fold}'").collect()}


@pytest.mark.parametrize("strategy, column, total", [("random", None, 80), ("cold_drug", "a", 10), ("Cold_Target ", "b", 8)])
def test_split_invariants(pairs, strategy, column, total):
    found = split_pairs(pairs, strategy, 0.25, 3).persist()
    train, test = members(found, "train"), members(found, "test")
    assert not train & test and len(train | test) == 80
    held_out = {x for x in test} if column is None else {p["ab".index(column)] for p in test}
    assert len(held_out) == max(1, round(total * 0.25))
    if column:
        assert not held_out & {p["ab".index(column)] for p in train}
    assert members(split_pairs(pairs, strategy, 0.25, 3), "test") == test
    assert members(split_pairs(pairs, strategy, 0.25, 4), "test") != test


def test_split_leaves_unknown_values_out_and_rejects_bad_arguments(spark, pairs):
    holes = pairs.withColumn("y", F.when(F.col("a") == "a0", F.lit(float("nan"))).otherwise(F.col("y")))
    assert split_pairs(holes).count() == 72
    for ratio in (0.0, 1.0, -1):
        with pytest.raises(ValueError):
            split_pairs(pairs, test_ratio=ratio)
    with pytest.raises(ValueError):
        split_pairs(pairs, "warm")
    one = spark.createDataFrame([("x", "y", 1.0)], "a string, b string, y double")
    assert [r.fold for r in split_pairs(one).collect()] == ["test"]
    assert split_pairs(one.where("false")).count() == 0


def test_samples_and_environments_have_exact_sizes(pairs):
    assert sample_exact(pairs, ["a", "b"], 13, 1).count() == 13
    assert sample_exact(pairs, ["a", "b"], 500, 1).count() == 80
    sizes = {r.env: r["count"] for r in assign_environments(pairs.select("a").distinct(), "a", 4, 1).groupBy("env").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 2, 3: 2}
    assert {r.env for r in assign_environments(pairs, "a", 1, 1).collect()} == {0}


def test_hot_keys_are_spread_and_joined_completely(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("a"),
        F.col("id").cast("string").alias("b"),
    )
    table = facts.select("a").distinct().withColumn("v", F.length("a"))
    hot = find_hot_keys(facts, ["a", "b"], min_rows=100, share=20)
    assert hot["a"].pieces.keys() == {"hot"} and hot["a"].pieces["hot"] >= 6 and not hot["b"].pieces
    salted = hot["a"].salt(facts, ["b"])
    assert salted.where("a = 'hot'").select("_salt").distinct().count() == hot["a"].pieces["hot"]
    found = lookup(facts, table, "a", hot["a"], ["b"])
    assert found.count() == 3000 and found.where("v is null or v <> length(a)").count() == 0
    assert find_hot_keys(facts, ["a"])["a"].pieces == {}


def test_last_write_and_index(spark):
    rows = spark.createDataFrame([("x", "y", 1.0, 1), ("x", "y", 9.0, 3), ("x", "y", 5.0, 2)], "a string, b string, v double, seq int")
    assert last_write(rows, ["a", "b"], "v", ["seq"]).first().y == 9.0
    entities = spark.createDataFrame([("10",), ("2",), ("1",)], "key string")
    assert {r.key: r.idx for r in entity_index(entities).collect()} == {"1": 0, "10": 1, "2": 2}


def test_grid_in_blocks_and_densify(spark):
    left = spark.createDataFrame([(f"l{i}",) for i in range(23)], "key string")
    right = spark.createDataFrame([(f"r{i}",) for i in range(7)], "key string")
    cells = grid(left, right, block=5)
    assert cells.count() == cells.distinct().count() == 161
    known = spark.createDataFrame([("l1", "r1", 2.0)], "a string, b string, y double")
    assert densify(cells, known).agg(F.sum("y")).first()[0] == 2.0
    assert densify(cells, known, "null").where("y is null").count() == 160
    with pytest.raises(ValueError):
        grid(left, right, limit=100)


def test_training_view(spark, pairs):
    split = split_pairs(pairs)
    data = PairData(split, None, None)
    view = training_view(data, split)
    mean = split.where("fold = 'train'").agg(F.avg("y")).first()[0]
    held = view.join(split.where("fold = 'test'").select("a", "b"), ["a", "b"])
    assert held.where(F.abs(F.col("y") - mean) > 1e-12).count() == 0
    nothing = PairData(split.withColumn("fold", F.lit("test")), None, None)
    assert training_view(nothing, split).agg(F.max("y")).first()[0] == 0.0


def test_scalar_functions(spark):
    row = spark.sql("select 10D v10, 1000D v1000, 1D v1, 0.4D v04, ' 2.5 ' n, 'abc' bad, 'NaN' nan").select(
        affinity_label("v10").alias("l10"), affinity_label("v1000").alias("l1000"), affinity_label("v1").alias("l1"),
        affinity_label("v04").alias("l04"), coerce_number("n").alias("n"), coerce_number("bad").alias("bad"), coerce_number("nan").alias("nan"),
    ).first()
    assert (row.l10, row.l1000, row.l1, row.l04, row.n, row.bad, row.nan) == (0, 1, 1, 0, 2.5, None, None)


def test_text_features(spark):
    data = spark.createDataFrame([(1, "aab"), (2, ""), (3, "é😀")], "k int, t string")
    vecs = {r.k: r.v for r in data.select("k", hash_vector("t").alias("v")).collect()}
    assert vecs[1][ord("a") % 16] == pytest.approx(2 / 5 ** 0.5) and vecs[2] == [0.0] * 16
    assert vecs[3][ord("é") % 16] > 0 and vecs[3][ord("😀") % 16] > 0
    grams = ngram_features(data, "k", "t", normalize=False).groupBy("k").agg(F.sum("w").alias("w")).collect()
    assert {r.k: r.w for r in grams} == {1: 2.0, 2: 1.0, 3: 1.0}
    table = code_point_table(char_vocabulary(data, "t"))
    ids = {r.k: r.i for r in data.select("k", encode_chars("t", table, 4).alias("i")).collect()}
    assert ids == {1: [1, 1, 2, 0], 2: [0, 0, 0, 0], 3: [3, 4, 0, 0]}
    assert spark.sql("select '\n mubz ' t").select(normalize_sequence("t").alias("n")).first().n == "MXXX"


def test_ngram_plan_has_two_exchanges(spark):
    """By gram with partial sums, then by key; buckets, norms and weights need no more."""
    data = spark.range(50).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t")).repartition(3)
    plan = ngram_features(data, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    lengths = ngram_features(data, "id", "t").groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert len(lengths) == 50 and all(abs(r.n - 1) < 1e-12 for r in lengths)


def test_grams_never_become_rows(spark):
    """Only the finished buckets of a key are rows; scans and exchanges see one row per text."""
    data = spark.range(50).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    plan = ngram_features(data, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Exchange")


@pytest.mark.parametrize("n, stretch, dense", [(1, 5, 1 << 22), (2, 1 << 20, 1 << 22), (2, 3, 0), (3, 7, 50)])
def test_ngrams_are_counted_whole(spark, monkeypatch, n, stretch, dense):
    import hashlib
    from collections import Counter

    import pyarrow as pa

    from dyadic.functions import text

    monkeypatch.setattr(text, "STRETCH", stretch)
    monkeypatch.setattr(text, "DENSE", dense)
    rows = [("a", "abcabcabcabc \x00é😀😀😀\n"), ("a", "bcab"), (None, "xy"), ("b", ""), ("c", None), ("d", "é"), ("a", "ab"), (None, "xyz"), ("e", "zz" * 40)]
    wanted = {}
    for key, value in rows:
        if value is not None:
            value = value.ljust(n, "_")
            for at in range(len(value) - n + 1):
                bucket = int(hashlib.md5(value[at : at + n].encode()).hexdigest()[:8], 16) % 512
                wanted.setdefault(key, Counter())[bucket] += 1
    data = spark.createDataFrame(rows, "k string, t string").repartition(3)
    # The task's own functions first: the settings above are not seen by Python workers.
    known = [(k, v.ljust(n, "_").encode()) for k, v in rows if v is not None]
    keys, counts = text._count_grams(pa.array([k for k, _ in known], "string"), [v for _, v in known], n, 512)
    assert dict(zip(keys.to_pylist(), map(dict, counts.to_pylist()), strict=True)) == wanted
    found = {}
    for r in ngram_features(data, "k", "t", n, normalize=False).collect():
        assert r.bucket not in found.setdefault(r.k, {})
        found[r.k][r.bucket] = r.w
    assert found == wanted


def test_ngrams_of_bytes_that_are_not_utf8(spark):
    data = spark.sql("select 1 k, cast(X'61FF62' as string) t")
    assert sum(r.w for r in ngram_features(data, "k", "t", normalize=False).collect()) == 2
