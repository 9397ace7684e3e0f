"""Numbers of shared identifiers of all pairs of sets, kept up to date by signed deltas.

The state is a log of memberships and a log of pair counts. A batch of changes is first brought down to what it changes: +1 for a
pair (set, identifier) that joins, -1 for one that leaves. With memberships m and changes d,
``(m_a + d_a)(m_b + d_b) - m_a m_b = d_a m_b + m_a d_b + d_a d_b``: every change is joined by its identifier to the other
memberships from before and to the other changes of the batch, and the signed products are added up by pair, in the map tasks
first. Both logs only ever grow by the batch's signed rows, so a batch writes what it changes and no more.

The log of memberships is a table bucketed by identifier: a batch is shuffled to the buckets, the memberships stay where they
are. It lies in a folder of its own and can be opened again by another session. An identifier costs the square of the sets it
is in, however often it occurs, and no set or intersection is ever in one place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom.session import Scratch, delete

BUCKETS, PER_BUCKET, MOST_BUCKETS = 8, 2_000_000, 50_000


def buckets_for(memberships: int) -> int:
    """Buckets of a state that will hold so many memberships."""
    return min(MOST_BUCKETS, max(BUCKETS, -(-memberships // PER_BUCKET)))


class PairCounts:
    """Shared and total counts of all pairs of sets that have an identifier in common.

    ``root`` is the folder of the state, a new one of the scratch space if there is none; what it holds is gone on with. Its
    number of buckets is that with which it was made.
    """

    def __init__(self, scratch: Scratch, root: str | None = None, buckets: int = BUCKETS):
        self.scratch, self.spark = scratch, scratch.spark
        self.root = (root or f"{scratch.root}/counts-{uuid.uuid4().hex[:8]}").rstrip("/")
        made = self._made()
        self.buckets = made or buckets
        if not made:
            self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{self.root}/made")
            self.spark.createDataFrame([], "set_a string, set_b string, shared bigint").write.parquet(f"{self.root}/pairs")
        self._log = f"fragloom_members_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self._log} (set_name STRING, id STRING, d INT) USING parquet CLUSTERED BY (id) INTO {self.buckets} BUCKETS LOCATION '{self.root}/members'")

    def _made(self) -> int | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/made")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.root}/made").first()["buckets"]

    @property
    def members(self) -> DataFrame:
        """(set_name, id): who is in which set now; grouped where the rows lie."""
        log = self.spark.table(self._log)
        return log.groupBy("id", "set_name").agg(F.sum("d").alias("n")).where("n > 0").select("set_name", "id")

    def _sets(self) -> DataFrame:
        """(id, sets): the sets each identifier is in; an identifier is shuffled nowhere."""
        return self.members.groupBy("id").agg(F.collect_list("set_name").alias("sets"))

    @property
    def pairs(self) -> DataFrame:
        log = self.spark.read.schema("set_a string, set_b string, shared bigint").parquet(f"{self.root}/pairs")
        return log.groupBy("set_a", "set_b").agg(F.sum("shared").alias("shared")).where("shared <> 0")

    def _net(self, changes: DataFrame) -> DataFrame:
        """(set_name, id, d) of what really changes; of several changes of one membership the last by ``seq`` counts, joining before leaving at equal ``seq``."""
        known = changes.where("set_name IS NOT NULL AND id IS NOT NULL AND present IS NOT NULL")
        last = known.groupBy("set_name", "id").agg(F.max(F.struct("seq", "present")).alias("last")).select("set_name", "id", "last.present")
        last = last.repartition(self.buckets, "id")
        joined = last.join(self._sets(), "id", "left").withColumn("had", F.coalesce(F.array_contains("sets", F.col("set_name")), F.lit(False)))
        return joined.where("present <> had").select("set_name", "id", F.when(F.col("present"), 1).otherwise(-1).cast("int").alias("d"))

    def apply(self, changes: DataFrame) -> None:
        """Takes in a batch (set_name, id, present, seq): whether the identifier is in the set from then on.

        Rows with a null set, identifier or ``present`` change nothing; so do repeated rows, joining twice and leaving a set
        one is not in. An empty batch is allowed. Other columns are not read.
        """
        d = self.scratch.table(self._net(changes))
        new = d.repartition(self.buckets, "id")
        others = new.select("id", F.col("set_name").alias("other"), F.col("d").alias("weight"))
        inside = new.join(others, "id").where("set_name < other")
        before = new.join(self._sets(), "id").select("id", "set_name", "d", F.explode("sets").alias("other"), F.lit(1).alias("weight")).where("set_name <> other")
        met = [x.select(F.least("set_name", "other").alias("set_a"), F.greatest("set_name", "other").alias("set_b"), (F.col("d") * F.col("weight")).alias("w")) for x in (inside, before)]
        delta = met[0].unionByName(met[1]).groupBy("set_a", "set_b").agg(F.sum("w").cast("bigint").alias("shared"))
        delta.where("shared <> 0").write.mode("append").parquet(f"{self.root}/pairs")
        new.write.mode("append").insertInto(self._log)
        self.spark.catalog.refreshTable(self._log)

    def compact(self, root: str) -> PairCounts:
        """The same state in a new folder, each membership and each pair once."""
        out = PairCounts(self.scratch, root, self.buckets)
        self.members.select("set_name", "id", F.lit(1).cast("int").alias("d")).repartition(self.buckets, "id").write.mode("append").insertInto(out._log)
        self.pairs.write.mode("append").parquet(f"{out.root}/pairs")
        self.spark.catalog.refreshTable(out._log)
        return out

    def close(self) -> None:
        """Takes the log's table out of the session's catalogue; the state stays in its folder, and what ``overlaps`` gave can be read."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._log}")

    def forget(self) -> None:
        """Deletes the state's folder; no frame that reads it may be used after that."""
        self.close()
        delete(self.spark, self.root)

    def overlaps(self) -> DataFrame:
        """(set_a, set_b, size_a, size_b, shared, total), set_a < set_b, of every pair with something in common."""
        sizes = self.scratch.table(self.members.groupBy("set_name").agg(F.count(F.lit(1)).alias("n")))
        a = sizes.select(F.col("set_name").alias("set_a"), F.col("n").alias("size_a"))
        b = sizes.select(F.col("set_name").alias("set_b"), F.col("n").alias("size_b"))
        out = self.pairs.join(a, "set_a").join(b, "set_b")
        return out.select("set_a", "set_b", "size_a", "size_b", "shared", (F.col("size_a") + F.col("size_b") - F.col("shared")).alias("total"))


def open_counts(spark: SparkSession, root: str) -> PairCounts:
    """The state in a folder that ``PairCounts`` made, in this or another session."""
    return PairCounts(Scratch(spark, "counts"), root)
