"""Exact dedup by a persistent digest index: tables bucketed and sorted by digest, met by sort-merge anti-join and appended to."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, shuffle_partitions
from .common import table as source

#: Characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Keys that hold more than one in so many rows are joined by broadcast; there are at most as many of them.
HEADS = 1000
#: A row's claim to stay, the least wins: most code points, an id, the smaller id, the earlier delivery, the earlier row.
_CLAIM = ("less", "no_id", "id", "batch", "row")
_FIELDS = "digest BINARY, less INT, no_id BOOLEAN, id BIGINT, batch STRING, row BIGINT, n BIGINT"


def digested(docs: DataFrame, name: str, parts: int = 1, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document, written to the shared folder: doc (struct of the columns in carry), digest, and its claim to stay.

    The digest is the SHA-256 of the text without blanks; a null text counts as empty. row numbers the rows and is fixed by
    being written, so of repeated rows exactly one wins. batch names the delivery: name, or name and a number where there are several parts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*carry).alias("doc"), F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("digest"), (-F.length(text)).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return materialize(rows.withColumn("batch", F.lit(name) if parts == 1 else F.concat(F.lit(f"{name}-"), F.pmod("row", F.lit(parts)))), "digests")


class DigestIndex:
    """All digests met so far, in two tables under a folder that outlives the session, both bucketed and sorted by digest.

    entries: a row for each digest, from the delivery that brought it first. repeats: a row for each digest and later delivery
    that brought it again. Each holds the best claim in that delivery and the number of its rows. Joins and groupings by digest
    over them need no shuffle. Opening an index takes its number of buckets from the folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.buckets = spark.read.parquet(f"{self.path}/layout").first()["buckets"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self.buckets = buckets or shuffle_partitions(spark)
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.path}/layout")
        self._names = {}
        for name in ("entries", "repeats"):
            known = self._names[name] = f"digest_{name}_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {known} ({_FIELDS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._names[name])

    def add(self, rows: DataFrame) -> None:
        """Add a delivery, as digested gives it: new digests are those that an anti-join with the entries leaves, and are appended.

        Each delivery has a name of its own (batch). One that was cut off is added again under the same name: what it had
        appended is not counted twice.
        """
        claims = rows.groupBy("digest").agg(F.min(F.struct(*_CLAIM)).alias("c"), F.count("*").alias("n")).select("digest", "c.*", "n")
        claims = claims.repartition(self.buckets, "digest").hint("merge")
        entries = self.table("entries").select("digest", F.col("batch").alias("first"))
        again = claims.join(entries, (claims["digest"] == entries["digest"]) & (claims["batch"] != entries["first"]), "left_semi")
        again.write.insertInto(self._names["repeats"])
        claims.join(entries, claims["digest"] == entries["digest"], "left_anti").write.insertInto(self._names["entries"])

    def groups(self) -> DataFrame:
        """digest, stays (the best claim of all deliveries), group_size: one row for each digest, joined by bucket."""
        once = self.table("repeats").groupBy("digest", "batch").agg(F.min(F.struct(*_CLAIM)).alias("c"), F.max("n").alias("n"))
        later = once.groupBy("digest").agg(F.min("c").alias("c"), F.sum("n").alias("more"))
        both = self.table("entries").hint("merge").join(later, "digest", "left")
        return both.select("digest", F.least(F.struct(*_CLAIM), "c").alias("stays"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"))

    def decide(self, rows: DataFrame) -> DataFrame:
        """rows, which are in the index, with keep_id, group_size and kept. Large groups are met by broadcast, so none fills a task."""
        groups, total = self.groups(), rows.count()
        large = materialize(groups.filter(F.col("group_size") * HEADS > total), "large-groups")
        rest = rows.join(F.broadcast(large.select("digest")), "digest", "left_anti").repartition(self.buckets, "digest")
        met = rows.join(F.broadcast(large), "digest").unionByName(rest.join(groups, "digest"))
        same = (F.col("batch") == F.col("stays.batch")) & (F.col("row") == F.col("stays.row"))
        return met.select("*", F.col("stays.id").alias("keep_id"), same.alias("kept")).drop("stays")

    def close(self) -> None:
        """Forget the tables' names in this session; the folder stays."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def exact_groups(docs: DataFrame, index: DigestIndex, name: str, parts: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs, by all that the index knows once they are in it.

    Texts are equal when identical without blanks. Of equal ones the row with the most code points stays, then that with
    the smallest id; a null id comes after all others, and of repeated rows one stays. Null and empty texts, and those of
    blanks alone, are one group. The rows are added in parts, so a load that is cut off keeps what is done; the answer does not
    depend on their number. Columns besides doc_id and text are left out. An empty table adds nothing and gives no rows.
    """
    rows = digested(docs, name, parts)
    for k in range(parts):
        index.add(rows.filter(F.col("batch") == f"{name}-{k}") if parts > 1 else rows)
    return index.decide(rows).select("doc.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def new_documents(docs: DataFrame, index: DigestIndex, name: str) -> DataFrame:
    """The rows of docs, with all their columns, whose text no earlier delivery brought, one of each group; the index then knows them.

    For continuous loads: what was let through before stays, even if a longer original of it comes later.
    """
    rows = digested(docs, name, carry=tuple(docs.columns))
    index.add(rows)
    stays = index.table("entries").filter(F.col("batch") == name).select("row")
    return rows.join(stays, "row", "left_semi").select("doc.*")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"{shared_dir(spark).rstrip('/')}/tables/digest-index-{uuid.uuid4().hex}")
    return exact_groups(source(spark, sf_dir, "documents").select("doc_id", "text"), index, "documents")
