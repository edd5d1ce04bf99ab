"""The registered queries over the dataflow operators, and their SQL.

Each query runs over its whole tables.  SQL is DuckDB's; queries without SQL have
property tests instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bag import Bag
from .functions.hashing import flow_of
from .functions.text import join_tokens, tokenize
from .operators import aggregate, join, reduce, skew, split, transform
from .plans.app import Application, Blueprint
from .session import shared_dir
from .sources import binary, generators
from .streaming import consume

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


#: Price after discount, exact: doubles are rounded differently by different engines.
_PRICE = ("cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as double)")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("select l_orderkey, l_partkey, l_quantity from lineitem")
def scan_source(spark, d):
    bag = Bag(spark, shared_dir(spark), "lines").write(_t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"))
    return bag.df


@query("select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by word")
def wordcount(spark, d):
    words = transform.flat_map(_t(spark, d, "documents"), tokenize("text"), "word")
    return aggregate.group(transform.filter_rows(words, "word <> ''"), ["word"], n=F.count("*"))


@query("select l_orderkey, cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as double) as revenue from lineitem")
def map_project(spark, d):
    return transform.map_rows(_t(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), revenue=F.expr(_PRICE))


@query("select c_custkey, array_to_string(list_transform(string_split(c_name, ''), lambda x: case when x = upper(x) then lower(x) else upper(x) end), '') as name from customer")
def map_python(spark, d):
    """A function that no built-in is, on Arrow batches."""
    swapped = F.pandas_udf(lambda s: s.str.swapcase(), "string")
    return _t(spark, d, "customer").select("c_custkey", swapped("c_name").alias("name"))


@query("select event_id, user_id, value from events where event_type = 'purchase' and value > 100")
def filter_rows(spark, d):
    return transform.filter_rows(_t(spark, d, "events"), "event_type = 'purchase' and value > 100").select("event_id", "user_id", "value")


@query("select doc_id, cast(len(list_filter(string_split(text, ' '), lambda x: x <> '')) as bigint) as n_tokens from documents")
def flatmap_tokenize(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(F.filter(tokenize("text"), lambda x: x != "")).cast("long").alias("n_tokens"))


@query("select event_id, user_id from events where event_id % 2 = 0")
def transform_batches(spark, d):
    even = lambda b: b.filter(pc.equal(pc.bit_wise_and(b.column(0), 1), 0))
    return transform.transform(_t(spark, d, "events").select("event_id", "user_id"), even, "event_id long, user_id long")


@query("select event_type, count(*) as n from events group by event_type")
def group_count(spark, d):
    return aggregate.group(_t(spark, d, "events"), ["event_type"], n=F.count("*"))


@query("select l_returnflag, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price, count(*) as n, cast(sum(l_linenumber) as bigint) as lines from lineitem group by l_returnflag")
def group_sum(spark, d):
    return aggregate.group(_t(spark, d, "lineitem"), ["l_returnflag"], price=F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), n=F.count("*"), lines=F.sum(F.col("l_linenumber").cast("long")))


@query("select user_id, min(value) as lo, max(value) as hi from events group by user_id")
def group_minmax(spark, d):
    return aggregate.group(_t(spark, d, "events"), ["user_id"], lo=F.min("value"), hi=F.max("value"))


@query("select event_type, count(distinct user_id) as users from events group by event_type")
def group_distinct(spark, d):
    return aggregate.group(_t(spark, d, "events"), ["event_type"], users=F.count_distinct("user_id"))


@query("select event_type, true as near from events group by event_type")
def group_approx_distinct(spark, d):
    """Sketches by type and day, merged by type: within 5 % of the exact number."""
    e = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    got = aggregate.merge_sketches(aggregate.distinct_sketch(e, ["event_type", "day"], "user_id"), ["event_type"])
    exact = aggregate.group(e, ["event_type"], exact=F.count_distinct("user_id"))
    return join.lookup(got, exact, ["event_type"]).select("event_type", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query("select cast(c_nationkey as bigint) as k, count(*) as n, max(c_acctbal) as top from customer group by c_nationkey")
def group_apply(spark, d):
    """A Python function over all rows of a key at once."""
    t = _t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"), "c_acctbal")
    f = lambda p: p.groupby("k", as_index=False).agg(n=("c_acctbal", "size"), top=("c_acctbal", "max"))
    return aggregate.group_apply(t, ["k"], f, "k long, n long, top double")


@query("select user_id, 1 as flows, count(*) as n from events group by user_id")
def split_by_hash(spark, d):
    """Flows by the hash of a key, each in one partition: a key has one flow."""
    e = split.exchange(_t(spark, d, "events").select("user_id"), 8, flow_of("user_id", 8, hashed=True))
    return aggregate.group(e, ["user_id"], flows=F.count_distinct("_flow").cast("int"), n=F.count("*"))


@query("select cast(props->>'$.k' as bigint) as key, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1")
def group_value_parser(spark, d):
    e = _t(spark, d, "events")
    return aggregate.group_value(e, F.get_json_object("props", "$.k").cast("long"), F.col("event_id"), n=F.count, ids=F.sum)


@query("select event_type, count(*) as n, max(event_id) as last_id from events group by event_type")
def group_state(spark, d):
    """A Python state for each key, updated on shares and merged."""
    update = lambda p: p.groupby("event_type", as_index=False).agg(n=("event_id", "size"), last_id=("event_id", "max"))
    merge = lambda p: p.groupby("event_type", as_index=False).agg(n=("n", "sum"), last_id=("last_id", "max"))
    return aggregate.group_merge(_t(spark, d, "events").select("event_type", "event_id"), ["event_type"], update, merge, "event_type string, n long, last_id long", 8)


@query("select cast(user_id % 3 as int) as _flow, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by 1")
def split_by_k(spark, d):
    e = split.split_by(_t(spark, d, "events"), 3, F.pmod("user_id", F.lit(3)))
    return aggregate.group(e, ["_flow"], n=F.count("*"), ids=F.sum("event_id"))


@query("select event_id, cast(user_id % 3 as int) as flow from events")
def split_to_bags(spark, d):
    root = shared_dir(spark)
    e = _t(spark, d, "events").select("event_id", "user_id")
    bags = [Bag(spark, root, f"flow{i}", "event_id long, user_id long") for i in range(3)]
    split.to_bags(split.split_by(e, 3, F.pmod("user_id", F.lit(3))), bags)
    return split.union(*[b.df.select("event_id", F.lit(i).alias("flow")) for i, b in enumerate(bags)])


@query("select c_nationkey as nationkey from customer union all select s_nationkey from supplier")
def union_bags(spark, d):
    return split.union(_t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")), _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")))


@query(ORACLE["map_project"])
def parallelize_k(spark, d):
    t = split.parallelize(_t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"), 8)
    return transform.map_rows(t, l_orderkey=F.col("l_orderkey"), revenue=F.expr(_PRICE))


_BRAND = "select p_brand, count(*) as n from lineitem join part on l_partkey = p_partkey group by p_brand"


@query(_BRAND)
def join_lookup(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    got = join.lookup(_t(spark, d, "lineitem").select("l_partkey"), part, ["l_partkey"], cardinality="n:1")
    return aggregate.group(got, ["p_brand"], n=F.count("*"))


@query("select d.doc_id, coalesce(quality, -1) as quality from documents d left join labels l on d.doc_id = l.doc_id")
def join_left_default(spark, d):
    return join.lookup(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "left", defaults={"quality": -1})


@query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem)")
def join_semi(spark, d):
    return join.lookup(_t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], "left_semi")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def join_anti(spark, d):
    return join.lookup(_t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], "left_anti")


@query("select o_custkey, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) as last_order from orders where o_orderdate < timestamp '1998-01-01' group by o_custkey")
def join_theta(spark, d):
    probe = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.expr("timestamp_ntz'1997-12-31 23:59:59.999999'").alias("at"))
    got = join.as_of(probe, _t(spark, d, "orders"), ["o_custkey"], "at", "o_orderdate", ["o_orderkey"])
    return got.where("o_orderkey is not null").select("o_custkey", F.col("o_orderkey").alias("last_order"))


@query("select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal")
def join_theta_pairs(spark, d):
    """An equality and an inequality in one condition."""
    a, b = (_t(spark, d, "supplier").select(*[F.col(c).alias(f"{x}_{c}") for c in ("s_suppkey", "s_nationkey", "s_acctbal")]) for x in "ab")
    got = join.theta(a, b, (F.col("a_s_nationkey") == F.col("b_s_nationkey")) & (F.col("a_s_acctbal") < F.col("b_s_acctbal")))
    return got.select(F.col("a_s_suppkey").alias("a"), F.col("b_s_suppkey").alias("b"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as r from events) where r = 1")
def probe_dedup(spark, d):
    """A probe that offers each key once."""
    return join.dedup(_t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("select user_id, event_id, count(*) over w as seen, max(value) over w as top from events window w as (partition by user_id order by event_id rows unbounded preceding)")
def probe_running(spark, d):
    """A probe that carries a state for each key from row to row."""
    e = _t(spark, d, "events").select("user_id", "event_id", "value")
    return join.running(e, ["user_id"], ["event_id"], seen=F.count("*"), top=F.max("value")).drop("value")


@query("select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey")
def join_right(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return join.lookup(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), n, ["k"], "right").select("n_name", "s_suppkey")


@query("select coalesce(c.k, s.k) as k, c.n as customers, s.n as suppliers from (select c_custkey as k, 1 as n from customer) c full join (select s_suppkey * 100 as k, 1 as n from supplier) s on c.k = s.k")
def join_full(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("customers"))
    return join.lookup(c, _t(spark, d, "supplier").select((F.col("s_suppkey") * 100).alias("k"), F.lit(1).alias("suppliers")), ["k"], "full")


@query("select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey")
def join_one_to_many(spark, d):
    items = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return join.lookup(_t(spark, d, "orders").select("o_orderkey"), items, ["o_orderkey"])


@query("select b.lo, count(*) as n from events e join (select range * 10 as lo from range(0, 50)) b on e.value >= b.lo and e.value < b.lo + 10 group by b.lo")
def join_range(spark, d):
    bins = spark.range(50).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 10).alias("hi"))
    return aggregate.group(join.range_join(_t(spark, d, "events").select("value"), bins, "value", "lo", "hi", 10.0), ["lo"], n=F.count("*"))


@query("select o_orderpriority, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by o_orderpriority")
def join_partitioned(spark, d):
    got = join.partitioned(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority"), "k", 8)
    return aggregate.group(got, ["o_orderpriority"], n=F.count("*"))


@query("select label, pos, round(sum(cast(v as double)), 4) as value from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by label, pos")
def zip_reduce_vectors(spark, d):
    """Vectors of a label added up in the order of their ids."""
    parts = _t(spark, d, "embeddings").select("label", F.col("vec_id").alias("bag"), F.posexplode("embedding").alias("pos", "v"))
    parts = parts.select("label", "bag", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("value"))
    return reduce.zip_reduce(parts, keys=("label",)).select("label", "pos", F.round("value", 4).alias("value"))


@query("select pos, cast(sum(value) as bigint) as value from (select c_custkey as pos, c_nationkey as value from customer union all select s_suppkey, s_nationkey from supplier) group by pos having count(*) = 2")
def zip_reduce_sum(spark, d):
    """Two bags of numbers, added position by position up to the shorter one's end."""
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").cast("long").alias("value"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_nationkey").cast("long").alias("value"))
    return reduce.zip_reduce(reduce.zip_bags([a, b]))


@query("select pos, cast(2 * a.value + b.value as bigint) as value from (select c_custkey as pos, c_nationkey as value from customer) a join (select s_suppkey as pos, s_nationkey as value from supplier) b using (pos)")
def zip_reduce_fold(spark, d):
    """A fold that depends on the order of the bags: 2 * (2 * 0 + a) + b."""
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").cast("long").alias("value"))
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_nationkey").cast("long").alias("value"))
    return reduce.zip_reduce(reduce.zip_bags([a, b]), lambda acc, v: acc * 2 + v)


@query("select user_id, count(*) as n, max(event_id) as last_id from events group by user_id")
def clone_merge_agg(spark, d):
    return skew.two_phase(_t(spark, d, "events").select("user_id", "event_id"), ["user_id"], {"pn": F.count("*"), "pl": F.max("event_id")}, {"n": F.sum("pn"), "last_id": F.max("pl")})


@query(_BRAND)
def salted_join(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return aggregate.group(skew.salted_join(_t(spark, d, "lineitem").select("l_partkey"), part, "l_partkey", share=0.0001, salts=4), ["p_brand"], n=F.count("*"))


@query("select count(distinct user_id) as keys, count(*) as rows, (select max(n) from (select count(*) as n from events group by user_id)) as largest from events")
def skew_report(spark, d):
    return skew.report(_t(spark, d, "events"), "user_id").select("keys", "rows", "largest")


class _Purchases(Application):
    """Filter, then group by clones whose outputs are merged."""

    source = ""

    def blueprints(self):
        read = lambda: self.spark.read.parquet(self.source).where("event_type = 'purchase'").select("user_id", "value")
        group = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
        return [[Blueprint("filter", read, (), ("purchases",))], [Blueprint("group", group, ("purchases",), ("by_user",), needs_merge=True)]]

    def merge(self, phase, blueprint, parts):
        return split.union(*parts).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


@query("select user_id, count(*) as n, max(value) as top from events where event_type = 'purchase' group by user_id")
def phase_pipeline(spark, d):
    app = _Purchases(spark, shared_dir(spark))
    app.source = f"{d}/events.parquet"
    return app.run().bag("by_user").df


@query("select event_type, count(*) as n from events group by event_type")
def stream_consume_once(spark, d):
    """The bag is drained twice with one cursor; the second drain adds nothing."""
    root = shared_dir(spark)
    bag = Bag(spark, root, "events", "event_id long, event_type string").write(_t(spark, d, "events").select("event_id", "event_type"))
    got = [consume.consume(bag, f"{root}/cursor", f"{root}/out") for _ in range(2)]
    return split.union(*got).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n from events where ts is not null group by all")
def stream_windows(spark, d):
    """Daily counts by type, with a watermark; the windows that are still open at the
    end of the table are written too."""
    root = shared_dir(spark)
    e = _t(spark, d, "events").select("ts", "event_type")
    bag = Bag(spark, root, "events", e.schema).write(e)
    counts = consume.windowed_counts(consume.stream(spark, bag.path, bag.schema), "ts", "event_type")
    counts = counts.select(F.col("window.start").alias("day"), "event_type", "n")
    return consume.drain_counts(counts, ["day", "event_type"], f"{root}/out", f"{root}/cursor")


@query("select cast(0 as bigint) as value, 1000 as n")
def gen_zero(spark, d):
    return generators.zero(spark, 1000).groupBy("value").agg(F.count("*").cast("int").alias("n"))


@query("select 100000 as n, 1 as lo, 6 as hi, true as even")
def gen_uniform(spark, d):
    v = generators.uniform(spark, 1, 6, 100_000, 3).groupBy("value").agg(F.count("*").alias("c"))
    return v.agg(F.sum("c").cast("int").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("c") - F.min("c") < 1000).alias("even"))


@query("select 100000 as n, true as near")
def gen_poisson(spark, d):
    v = generators.poisson(spark, 4.0, 100_000, 3)
    return v.agg(F.count("*").cast("int").alias("n"), (F.abs(F.avg("value") - 4) < 0.05).alias("near"))


@query("select 100000 as n, 1 as lo, true as near")
def gen_zipf(spark, d):
    """The share of the first of 100 numbers is 1 / sum(1 / k)."""
    v = generators.zipf(spark, 100, 1.0, 100_000, 3)
    head = 1 / float((1 / np.arange(1, 101)).sum())
    return v.agg(F.count("*").cast("int").alias("n"), F.min("value").alias("lo"), (F.abs(F.avg((F.col("value") == 1).cast("int")) - head) < 0.01).alias("near"))


@query("select 500 as n, 500 as different")
def gen_random(spark, d):
    return generators.random(spark, 500, 9).agg(F.count("*").cast("int").alias("n"), F.count_distinct("value").cast("int").alias("different"))


@query("select 50 as n, true as whole")
def gen_lorem(spark, d):
    t = generators.lorem(spark, 50, 20)
    known = F.array(*map(F.lit, generators.LOREM))
    ok = F.forall(F.split("text", " "), lambda w: F.array_contains(known, w)) & (F.size(F.split("text", " ")) == 20)
    return t.agg(F.count("*").cast("int").alias("n"), F.bool_and(ok).alias("whole"))


@query("select text as value from documents where text <> ''")
def text_roundtrip(spark, d):
    """Texts hold line feeds, so records end with a byte that texts don't hold."""
    path = f"{shared_dir(spark)}/text"
    binary.write_text(_t(spark, d, "documents").where("text <> ''"), path, "text", "\x1e")
    return binary.read_text(spark, path, "\x1e")


@query("select doc_id, text from documents where not ends_with(text, ' ') and text <> ''")
def token_roundtrip(spark, d):
    t = _t(spark, d, "documents").where("not endswith(text, ' ') and text <> ''")
    joined = t.select("doc_id", join_tokens(tokenize("text")).alias("t"))
    return joined.select("doc_id", F.array_join(tokenize("t"), " ").alias("text"))


@query("select cast(c_custkey as int) as _1, c_nationkey as _2 from customer")
def binary_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/pairs"
    binary.write_binary(_t(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("_1"), F.col("c_nationkey").alias("_2")), path, "int_pair")
    return binary.read_binary(spark, path, "int_pair")


@query("select s_suppkey as k, s_nationkey as v from supplier")
def sequence_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/seq"
    binary.write_sequence(_t(spark, d, "supplier"), path, "s_suppkey", "s_nationkey")
    return binary.read_sequence(spark, path, "k long, v int")


@query("select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by n_name")
def sql_over_bag(spark, d):
    root = shared_dir(spark)
    for name in ("customer", "nation"):
        Bag(spark, root, f"bag_{name}").write(_t(spark, d, name)).view()
    return spark.sql("select n_name, count(*) as customers from bag_customer join bag_nation on c_nationkey = n_nationkey group by n_name")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r <= 3")
def window_rank(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return _t(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id")


@query("select event_id, value from events order by value desc, event_id limit 20")
def top_k(spark, d):
    return _t(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("(select c_nationkey as k from customer intersect select s_nationkey from supplier) union all (select n_nationkey from nation except select s_nationkey from supplier)")
def set_ops(spark, d):
    c, s, n = (_t(spark, d, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).unionAll(n.subtract(s))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_count(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select event_type, user_id, count(*) as n from events group by grouping sets ((event_type), (user_id), ())")
def grouping_sets(spark, d):
    return _t(spark, d, "events").groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count("*").alias("n"))


@query("select n_nationkey, n_name, f.format from nation, (values ('csv'), ('json'), ('orc')) f(format)")
def format_roundtrips(spark, d):
    """Spark's own formats, written and read back."""
    t, root, out = _t(spark, d, "nation").select("n_nationkey", "n_name"), shared_dir(spark), []
    for kind in ("csv", "json", "orc"):
        t.write.format(kind).save(f"{root}/{kind}")
        out.append(spark.read.format(kind).schema(t.schema).load(f"{root}/{kind}").withColumn("format", F.lit(kind)))
    return split.union(*out)


@query("select c_custkey, c_nationkey from customer")
def bag_chunks(spark, d):
    """A bag read chunk by chunk, each by its place."""
    bag = Bag(spark, shared_dir(spark), "customers").write(_t(spark, d, "customer").select("c_custkey", "c_nationkey").repartition(3))
    return split.union(*[bag.chunk(i) for i in range(len(bag.chunks()))])


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_count(spark, d):
    return _t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
