"""The trade network and its companions over the star-schema tables, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


class Tables:
    """The views over one folder of tables, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small view, written when it is first asked for; each call reads it anew, so that joins of two don't share columns."""
        if name not in self._written:
            self._written[name] = written(make(), f"view-{name}")
        known = self._written[name]
        files = known.inputFiles()
        return self.spark.read.schema(known.schema).parquet(*files) if files else known

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def trades(self) -> DataFrame:
        """A row for each line item: t, src (the customer's nation), dst (the supplier's), value and quantity.

        The large tables meet once, on the order's key; customers and suppliers are joined by key and adaptive execution
        broadcasts them when they are small.
        """
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("t"), F.col("o_totalprice").alias("value"))
        customer = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("src"))
        supplier = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
        bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("quantity"))
        return (
            lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("t", "src", "dst", "value", "quantity")
        )

    def sums(self) -> DataFrame:
        """t, src, dst, w, and sums and numbers of value and quantity: a row for a year and two nations.

        The large tables meet once for all views over these sums. What windows by year make of them is written too: without that,
        modularity_dynamic gave a wrong row and modularity_static an error on unequal partitions (Spark 4.1; probably its unions).
        """
        parts = [f(c).alias(f"{name}_{c}") for c in ("value", "quantity") for name, f in (("sum", F.sum), ("n", F.count))]
        return self._once("sums", lambda: self.trades().groupBy("t", "src", "dst").agg(F.count("*").alias("w"), *parts))

    def cells(self) -> DataFrame:
        return self.sums().select("t", "src", "dst", "w")

    def net(self) -> DataFrame:
        """Directed edges: cells above their year's mean, without loops."""
        mean = F.avg("w").over(W.partitionBy("t"))
        return self._once("net", lambda: self.cells().withColumn("mean", mean).where("w > mean AND src <> dst").select("t", "src", "dst", "w"))

    def nodes(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("z"))

    def labels(self) -> DataFrame:
        return self.nodes().select("node", "z")

    def dynamic_labels(self) -> DataFrame:
        """t, node, z: a quarter by each year's volume."""
        volume = self.sums().groupBy("t", F.col("src").alias("node")).agg(F.sum("w").alias("volume"))
        return self._once("labels", lambda: volume.select("t", "node", (F.ntile(4).over(W.partitionBy("t").orderBy("volume", "node")) - 1).alias("z")))

    def positions(self) -> DataFrame:
        """t, node, x: a nation's mean order value and quantity, standardised within the year."""
        avg = lambda c: F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}"))
        mean = self.sums().groupBy("t", F.col("src").alias("node")).agg(avg("value").alias("v"), avg("quantity").alias("q"))
        year = W.partitionBy("t")
        score = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(year), F.stddev_pop(c).over(year)), F.lit(0.0))
        return self._once("positions", lambda: mean.select("t", "node", F.array(score("v"), score("q")).alias("x")))

    def samples(self) -> DataFrame:
        """iter, t, node, z: a pseudo-posterior of labels; the commonest event type (first by name among equals)."""
        events = self.table("events").select(
            F.dayofmonth("ts").alias("iter"), F.expr("CAST(hour(ts) DIV 12 AS INT)").alias("t"), (F.col("user_id") % 25).cast("int").alias("node"), "event_type"
        )
        counts = events.groupBy("iter", "t", "node", "event_type").agg(F.count("*").alias("n"))
        top = counts.groupBy("iter", "t", "node").agg(F.min(F.struct(-F.col("n"), F.col("event_type"))).alias("top"))
        kinds = events.select("event_type").distinct().withColumn("z", F.dense_rank().over(W.orderBy("event_type")) - 1)
        return top.select("iter", "t", "node", F.col("top.event_type").alias("event_type")).join(kinds, "event_type").select("iter", "t", "node", "z")

    def trace(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("iter"), F.col("value").alias("x"))

    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").alias("z"))
