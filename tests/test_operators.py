import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkbags.bag import Bag
from sparkbags.functions.text import join_tokens, tokenize
from sparkbags.operators import aggregate, join, reduce, skew, split, transform
from sparkbags.sources import binary, generators


@pytest.mark.parametrize("text,want", [("a  b ", ["a", "", "b"]), ("a b", ["a", "b"]), ("", []), (" ", [""]), (" a", ["", "a"])])
def test_tokenize(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokenize("t")).first()[0] == want


def test_tokenize_quotes_the_separator_and_joins_back(spark):
    df = spark.createDataFrame([("a.b",)], "t string")
    assert df.select(tokenize("t", ".")).first()[0] == ["a", "b"]
    assert df.select(join_tokens(tokenize("t", "."), ".")).first()[0] == "a.b."


@pytest.mark.parametrize("rows", [1, 7, 10000])
def test_transform_does_not_depend_on_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    got = transform.transform(spark.range(50), lambda b: [b, b], "id long")
    assert sorted(r[0] for r in got.collect()) == sorted(2 * list(range(50)))


def test_map_udf_and_flat_map(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "value string")
    assert [r[0] for r in transform.map_udf(df, str.upper, "up string").collect()] == ["AB", "C"]
    assert transform.flat_map(df, F.split("value", ""), "c").count() == 3


def test_split_outputs_make_up_the_input(spark, tmp_path):
    df = spark.range(30).withColumn("v", F.col("id") % 5)
    bags = [Bag(spark, str(tmp_path), f"b{i}", "id long, v long") for i in range(3)]
    split.to_bags(split.split_by(df, 3, F.col("id") % 3), bags)
    assert [b.df.count() for b in bags] == [10, 10, 10]
    assert sorted(r.id for r in split.union(*[b.df for b in bags]).collect()) == list(range(30))


def test_split_out_of_range_is_an_error(spark):
    with pytest.raises(PySparkException, match="flow out of range"):
        split.split_by(spark.range(5), 2, F.col("id")).collect()


def test_salted_and_merged_aggregates_equal_direct_ones(spark):
    df = generators.zipf(spark, 20, 1.5, 5000, 1).withColumn("x", F.monotonically_increasing_id())
    direct = df.groupBy("value").agg(F.count("*").alias("n"), F.max("x").alias("m"))
    salted = skew.two_phase(df, ["value"], {"a": F.count("*"), "b": F.max("x")}, {"n": F.sum("a"), "m": F.max("b")})
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, salted.collect()))
    f = lambda p: p.groupby("value", as_index=False).agg(n=("x", "size"))
    g = lambda p: p.groupby("value", as_index=False).agg(n=("n", "sum"))
    merged = aggregate.group_merge(df, ["value"], f, g, "value int, n long", 4)
    assert sorted(map(tuple, direct.select("value", "n").collect())) == sorted(map(tuple, merged.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = generators.zipf(spark, 30, 1.2, 2000, 2).withColumnRenamed("value", "k").withColumn("x", F.rand(1))
    right = spark.range(0, 60, 2).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("y"))
    plain = left.join(right, "k", how).groupBy("k").count()
    salted = skew.salted_join(left, right, "k", how, share=0.05, salts=4).groupBy("k").count()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_lookup_rejects_repeated_build_keys(spark):
    probe = spark.range(3).withColumnRenamed("id", "k")
    build = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(PySparkException, match="repeated build key"):
        join.lookup(probe, build, ["k"], cardinality="n:1").collect()
    assert join.lookup(probe, build.limit(1), ["k"], "left", "n:1", {"v": "?"}).where("v = '?'").count() == 2


def test_as_of_and_range_join(spark):
    p = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    b = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, bt int, v string")
    assert {(r.k, r.t): r.v for r in join.as_of(p, b, ["k"], "t", "bt", ["v"]).collect()} == {("a", 5): "y", ("a", 1): None, ("b", 9): None}
    r = spark.createDataFrame([(0.0, 2.5), (2.0, 4.0)], "lo double, hi double")
    x = spark.createDataFrame([(2.0,), (2.4,), (2.5,), (4.0,)], "x double")
    got = join.range_join(x, r, "x", "lo", "hi", 1.0)
    assert got.count() == 5


def test_zip_reduce(spark):
    bags = [spark.createDataFrame([(i, v) for i, v in enumerate(x)], "pos long, value long") for x in ([1, 2, 3], [10, 20], [100, 200, 300])]
    parts = reduce.zip_bags(bags)
    assert sorted(map(tuple, reduce.zip_reduce(parts).collect())) == [(0, 111), (1, 222)]
    assert sorted(map(tuple, reduce.zip_reduce(parts, outer=True).collect())) == [(0, 111), (1, 222), (2, 303)]
    fold = reduce.zip_reduce(parts.repartition(5), lambda a, v: a * 2 + v)
    assert sorted(map(tuple, fold.collect())) == [(0, 124), (1, 248)]


def test_generators(spark):
    assert generators.zero(spark, 0).count() == 0
    u = [r[0] for r in generators.uniform(spark, 3, 3, 10, 1).collect()]
    assert u == [3] * 10
    a = sorted(r[0] for r in generators.zipf(spark, 9, 0.5, 500, 4).repartition(7).collect())
    assert a == sorted(r[0] for r in generators.zipf(spark, 9, 0.5, 500, 4).collect())
    assert min(a) >= 1 and max(a) <= 9


@pytest.mark.parametrize("name,rows", [("int", [(0,), (-1,), (2**31 - 1,), (-(2**31),)]), ("long", [(2**63 - 1,), (-5,)]), ("double", [(float("inf"),), (-0.0,)]), ("float", [(1.5,)]), ("short", [(-32768,)]), ("char", [("é",), ("x",)]), ("int_pair", [(1, 1), (1, 1), (-7, 9)])])
def test_binary_round_trip(spark, tmp_path, name, rows):
    schema = binary.FORMATS[name][1]
    binary.write_binary(spark.createDataFrame(rows, schema), str(tmp_path / "b"), name)
    assert sorted(map(tuple, binary.read_binary(spark, str(tmp_path / "b"), name).collect())) == sorted(rows)


def test_binary_bytes_and_ragged_tail():
    assert binary.encode([[1], [2]], "int_pair") == b"\1\0\0\0\2\0\0\0"
    assert binary.encode([[1]], "int") == b"\0\0\0\1"
    assert binary.decode(b"\0\0\0\1\0\0", "int")[0].tolist() == [1]


def test_text_keeps_carriage_returns(spark, tmp_path):
    df = spark.createDataFrame([("a\r",), ("",), ("b",)], "value string")
    binary.write_text(df.coalesce(1), str(tmp_path / "t"), replication=1)
    assert sorted(r[0] for r in binary.read_text(spark, str(tmp_path / "t")).collect()) == ["", "a\r", "b"]
