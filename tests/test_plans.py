import pytest
from pyspark.sql import functions as F

from sparkbags import cli
from sparkbags.bag import Bag
from sparkbags.plans.app import Application, Blueprint, BySize, Fixed
from sparkbags.stats import measured_write, progress
from sparkbags.streaming import consume


class Sums(Application):
    fail = False

    def blueprints(self):
        make = lambda: self.spark.range(100).select((F.col("id") % 7).alias("k"), "id")

        def group(df):
            if self.fail:
                raise RuntimeError("a task fails")
            return df.groupBy("k").agg(F.sum("id").alias("s"))

        return [[Blueprint("make", make, (), ("in",))], [Blueprint("sum", group, ("in",), ("out",), True)]]

    def merge(self, phase, blueprint, parts):
        from sparkbags.operators.split import union

        return union(*parts).groupBy("k").agg(F.sum("s").alias("s"))


def test_phases_merge_and_restart(spark, tmp_path):
    app = Sums(spark, str(tmp_path)).run()
    want = {k: sum(range(k, 100, 7)) for k in range(7)}
    assert {r.k: r.s for r in app.bag("out").df.collect()} == want
    app.run(from_phase=1)
    assert {r.k: r.s for r in app.bag("out").df.collect()} == want and [i for i, _ in app.timings] == [1]
    assert app.describe().splitlines()[1] == "phase 1: sum(in) -> out [merge]"


def test_clones_are_admitted_by_strategy(spark, tmp_path):
    """No clone for small inputs, several for large ones; the result is the same."""
    want = {k: sum(range(k, 100, 7)) for k in range(7)}
    for name, strategy in (("one", BySize(1 << 40)), ("some", BySize(100, 3)), ("four", Fixed(4))):
        app = Sums(spark, str(tmp_path / name))
        app.strategy, seen = strategy, []
        merge = app.merge
        app.merge = lambda phase, b, parts, merge=merge, seen=seen: seen.append(len(parts)) or merge(phase, b, parts)
        assert {r.k: r.s for r in app.run().bag("out").df.collect()} == want
        assert seen == {"one": [], "some": [3], "four": [4]}[name]
        assert not app.bag("out.shares").exists() and not app.bag("out.clone0").exists()


def test_a_failing_task_ends_the_run(spark, tmp_path):
    app = Sums(spark, str(tmp_path))
    app.fail = True
    with pytest.raises(RuntimeError, match="a task fails"):
        app.run()


def test_bag_and_statistics(spark, tmp_path):
    bag = Bag(spark, str(tmp_path), "b", "id long").create()
    assert bag.df.count() == 0 and bag.exists()
    got = measured_write(spark.range(10), bag)
    assert got.rows == 10 and got.bytes_written > 0 and "10 rows" in str(got)
    bag.write(spark.range(5))
    assert bag.df.count() == 15 and progress(spark) == 1.0
    assert bag.truncate().df.count() == 0
    with pytest.raises(FileNotFoundError):
        Bag(spark, str(tmp_path), "none").df  # noqa: B018


def test_consume_once_and_rewind(spark, tmp_path):
    bag = Bag(spark, str(tmp_path), "b", "id long").write(spark.range(10))
    cursor = f"{tmp_path}/cursor"
    take = lambda c: consume.consume(bag, c, f"{tmp_path}/out").count()
    assert take(cursor) == 10
    assert take(cursor) == 0
    bag.write(spark.range(3))
    assert take(cursor) == 3
    assert take(consume.rewind(cursor)) == 13


def test_command_line():
    a = cli.parse(["m:App", "--root", "/x", "-G", "n=3", "--restart-phase", "2", "--text-mode"])
    assert (a.app, a.G, a.restart_phase, a.text_mode) == ("m:App", ["n=3"], 2, True)
