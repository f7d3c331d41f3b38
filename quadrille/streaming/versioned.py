"""Versioned event streams and snapshots.

A member is one version of an object: (id, base, ts, seq), seq its place in the order of arrival; its content are the quads whose
graph is the member's id. Of versions with one ts the last that arrived counts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.operators.frames import fresh
from quadrille.sources.ntriples import instant
from quadrille.storage import parts_for, written
from quadrille.terms import DATETIME, RDF, Iri, key

DCT = "http://purl.org/dc/terms/"
LDES = "https://w3id.org/ldes#"
TREE = "https://w3id.org/tree#"
MEMBERS = "id string, base string, ts timestamp_ntz, seq bigint"
QUADS = "s string, p string, o string, g string"


class Transform(Protocol):
    """How the content of members lies in a stream's quads."""

    def encode(self, content: DataFrame) -> DataFrame:
        """Quads (s, p, o, g) of content (s, p, o, id)."""

    def decode(self, quads: DataFrame, ids: DataFrame) -> DataFrame:
        """Quads (s, p, o, g) of the members in ids (one column, id), g the member."""


class GraphBased:
    """Each member's content is the graph that is named like it."""

    def encode(self, content: DataFrame) -> DataFrame:
        return content.select("s", "p", "o", F.col("id").alias("g"))

    def decode(self, quads: DataFrame, ids: DataFrame) -> DataFrame:
        return quads.join(ids.select(F.col("id").alias("_g")), F.col("g") == F.col("_g"), "left_semi")


class VersionedStream:
    """transform: how content is encoded; another one than GraphBased may be given."""

    def __init__(self, spark: SparkSession, members: DataFrame | None = None, quads: DataFrame | None = None, transform: Transform | None = None):
        self.spark, self.transform = spark, transform or GraphBased()
        self.members = members if members is not None else spark.createDataFrame([], MEMBERS)
        self.quads = quads if quads is not None else spark.createDataFrame([], QUADS)

    def append(self, versions: DataFrame) -> None:
        """versions: (base, ts, s, p, o), one row a quad of a version; (base, ts) names a version, whose id is base_vN."""
        have = self.members.groupBy("base").agg(F.count("*").alias("had"))
        start = self.members.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        new = versions.groupBy("base", "ts").agg(F.count("*").alias("_n"))
        new = new.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("ts"))).join(have, "base", "left")
        # one arrival: all its versions share a place, and ts tells them apart
        new = written(new.select(F.concat("base", F.lit("_v"), (F.coalesce("had", F.lit(0)) + F.col("k") - 1).cast("string")).alias("id"), "base", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(start).cast("bigint").alias("seq")), "members")
        content = versions.withColumn("ts", F.col("ts").cast("timestamp_ntz")).join(new.select("id", "base", "ts"), ["base", "ts"]).select("s", "p", "o", "id")
        self.members = self.members.select("id", "base", "ts", "seq").union(new)
        self.quads = self.quads.select("s", "p", "o", "g").union(written(self.transform.encode(content), "versions"))

    def latest(self, until=None, inclusive: bool = True) -> DataFrame:
        """The newest member of each base, up to a time."""
        m = self.members
        if until is not None:
            at = F.lit(str(until)).cast("timestamp_ntz")
            m = m.where(F.col("ts") <= at if inclusive else F.col("ts") < at)
        return m.groupBy("base").agg(F.max_by("id", F.struct("ts", "seq")).alias("id"), F.max("ts").alias("ts"))

    def as_of(self, until=None) -> DataFrame:
        """Quads of everything as it was, g the version that says so."""
        return self.transform.decode(self.quads, self.latest(until).select("id"))

    def version(self, base: str, ts, inclusive: bool = True) -> DataFrame:
        """Quads of one object as it was at a time (or just before it). base: its term key."""
        one = VersionedStream(self.spark, self.members.where(F.col("base") == base), self.quads)
        return self.transform.decode(self.quads, one.latest(ts, inclusive).select("id")).select("s", "p", "o")

    def to_quads(self, identifier: str, timestamp_path: str = DCT + "modified", version_of_path: str = DCT + "isVersionOf") -> DataFrame:
        """The stream as RDF: what it is, its members with their times and objects, and their content. Paths and identifier are IRIs."""
        iri = lambda x: F.lit("I" + x)
        me = [("type", RDF + "type", LDES + "EventStream"), ("t", LDES + "timestampPath", timestamp_path), ("v", LDES + "versionOfPath", version_of_path)]
        head = self.spark.createDataFrame([("I" + identifier, "I" + p, "I" + o, None) for _, p, o in me], QUADS)
        cells = F.array(
            F.struct(iri(identifier).alias("s"), iri(TREE + "member").alias("p"), F.col("id").alias("o")),
            F.struct(F.col("id").alias("s"), iri(version_of_path).alias("p"), F.col("base").alias("o")),
            F.struct(F.col("id").alias("s"), iri(timestamp_path).alias("p"), F.concat(F.lit(f"L{DATETIME}|"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("o")),
        )
        rows = self.members.select(F.explode(cells).alias("c")).select("c.s", "c.p", "c.o", F.lit(None).cast("string").alias("g"))
        return head.union(rows).union(self.quads)

    @classmethod
    def of_quads(cls, spark: SparkSession, quads: DataFrame, identifier: str, transform: Transform | None = None) -> VersionedStream:
        """The stream that quads hold under this IRI; ValueError if they don't say which paths it uses. Members without time or object
        are left out; of equal times the order of ids counts as that of arrival."""
        quads = written(quads.select("s", "p", "o", "g"), "stream")  # read several times, and perhaps parsed from text
        me = quads.where((F.col("s") == "I" + identifier) & F.col("p").isin("I" + LDES + "timestampPath", "I" + LDES + "versionOfPath"))
        paths = {r.p[1 + len(LDES) :]: r.o for r in me.select("p", "o").collect()}
        if set(paths) != {"timestampPath", "versionOfPath"}:
            raise ValueError(f"<{identifier}> is no versioned stream here")
        member = (F.col("s") == "I" + identifier) & (F.col("p") == key(Iri(TREE + "member")))
        said = [member, *(F.col("p") == paths[p] for p in ("versionOfPath", "timestampPath"))]
        # a quad may say more than one of these; one shuffle by member brings them together
        cells = F.array(*(F.when(t, F.struct((F.col("o") if t is member else F.col("s")).alias("id"), F.lit(k).alias("k"), F.col("o").alias("o"))) for k, t in enumerate(said)))
        rows = quads.where(said[0] | said[1] | said[2]).select(F.explode(cells).alias("c")).where("c IS NOT NULL").select("c.*")
        of = lambda k: F.min(F.when(F.col("k") == k, F.col("o")))
        found = rows.groupBy("id").agg(of(0).alias("is"), of(1).alias("base"), of(2).alias("at")).where("is IS NOT NULL AND base IS NOT NULL AND at IS NOT NULL")
        found = found.withColumn("ts", instant(F.substring_index("at", "|", -1))).where("ts IS NOT NULL")
        members = found.select("id", "base", "ts", (F.row_number().over(Window.partitionBy("base").orderBy("ts", "id")) - 1).cast("bigint").alias("seq"))
        stream = cls(spark, written(members, "members"), None, transform)
        stream.quads = quads.where("g IS NOT NULL").select("s", "p", "o", "g") if isinstance(stream.transform, GraphBased) else quads.select("s", "p", "o", "g")
        return stream


def as_of_rows(table: DataFrame, base: str, ts: str, order: str, until) -> DataFrame:
    """Of a table whose rows are versions: the newest row of each base with ts up to `until`; of equal ts the one last in `order`."""
    w = Window.partitionBy(base).orderBy(F.col(ts).desc(), F.col(order).desc())
    return table.where(F.col(ts) <= F.lit(str(until)).cast("timestamp_ntz")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def diff(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that came and rows that went, between two sets of like columns. Both sets are read when it is called."""
    side, low, high = fresh("_side"), fresh("_low"), fresh("_high")
    rows = before.withColumn(side, F.lit(1)).unionAll(after.toDF(*before.columns).withColumn(side, F.lit(2)))
    # dealt out first: rows are mostly distinct, so an aggregate before the shuffle would only hold those of a whole split
    by = [F.col(f"`{c}`") for c in before.columns]
    sides = rows.repartition(parts_for(rows), *by).groupBy(*by).agg(F.min(side).alias(low), F.max(side).alias(high))
    changed = written(sides.where(F.col(low) == F.col(high)), "diff")
    return changed.where(F.col(low) == 2).select(*by), changed.where(F.col(low) == 1).select(*by)


def by_subject() -> Column:
    """The cluster of a quad: its subject."""
    return F.col("s")


class SnapshotStore:
    """Snapshots of a graph as versions of clusters of quads, by default of its subjects: a snapshot stores only the clusters that
    changed, a minute after the last. Clusters are compared by 128 bits of hashes of their quads."""

    def __init__(self, spark: SparkSession, start: str, clustering: Callable[[], Column] = by_subject):
        self.spark, self.start, self.count, self.clustering = spark, start, 0, clustering
        self.hashes = spark.createDataFrame([], "base string, h binary")
        self.stream = VersionedStream(spark)

    def add(self, quads: DataFrame) -> None:
        rows = written(quads.select("s", "p", "o").distinct().withColumn("base", self.clustering()), "snapshot")
        if rows.where("s LIKE 'B%'").head(1):
            raise ValueError("a blank node can't be followed from snapshot to snapshot")
        at = F.lit(self.start).cast("timestamp_ntz") + F.expr(f"INTERVAL {self.count} MINUTES")
        # sums of two hashes of each quad, whatever the order of the quads
        sums = [F.sum(F.xxhash64(F.lit(k), "s", "p", "o").cast("decimal(38,0)")).alias(f"d{k}") for k in (1, 2)]
        now = written(rows.groupBy("base").agg(*sums, F.count("*").alias("n")).select("base", F.unhex(F.md5(F.concat_ws("|", "d1", "d2", "n"))).alias("h")), "hashes")
        old = self.hashes.select(F.col("base").alias("b_"), F.col("h").alias("h_"))
        both = now.join(old, F.col("base") == F.col("b_"), "full").where("NOT (h <=> h_)")
        changed = written(both.select(F.coalesce("base", "b_").alias("base"), F.col("base").isNull().alias("gone")), "changed")
        content = rows.join(changed.where("NOT gone").select("base"), "base").select("base", at.alias("ts"), "s", "p", "o")
        # a subject that went has a version that says only this
        none = changed.where("gone").select("base", at.alias("ts"), F.col("base").alias("s"), F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("o"))
        self.stream.append(content.union(none))
        self.hashes = now
        self.count += 1

    def snapshot(self, k: int) -> DataFrame:
        """Quads (s, p, o) of the k-th snapshot."""
        until = self.spark.range(1).select((F.lit(self.start).cast("timestamp_ntz") + F.expr(f"INTERVAL {k} MINUTES")).cast("string")).first()[0]
        return self.stream.as_of(until).where("p IS NOT NULL").select("s", "p", "o")

    def diffs(self):
        """(insertions, deletions) of each snapshot, against the one before it; the first against nothing."""
        before = self.spark.createDataFrame([], "s string, p string, o string")
        for k in range(self.count):
            after = written(self.snapshot(k), "state")
            yield diff(before, after)
            before = after
