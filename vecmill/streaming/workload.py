"""Logs of inserts, deletes and queries over a table of vectors, and their application in micro-batches."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from ..functions.ranks import numbered
from ..operators import knn, layers, quality
from ..operators.index import Index, IndexConfig, search
from ..operators.maintenance import policy
from ..sources.scratch import exists

OPS = "seq long, batch int, op string, id long, vec array<double>"


def offsets(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The first half in order of id; the rest with ``place`` (from 0); the number of the rest.

    Ids are unique. Where they run from 0 without gaps they are places themselves, else they are numbered.
    """
    r = vectors.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    n = r["n"]
    if not n or (r["low"], r["high"]) == (0, n - 1):
        rows, at = vectors, F.col("id")
    else:
        rows, at = numbered(vectors, [], ["id"], "_place").drop("total"), F.col("_place")
    first = rows.where(at < n // 2).select(*vectors.columns)
    rest = rows.where(at >= n // 2).select(*vectors.columns, (at - n // 2).alias("place"))
    return first, rest, n - n // 2


def fifo_log(rest: DataFrame, delete_every: int = 10, batch: int = 250) -> DataFrame:
    """seq, batch, op, id: inserts in order of place; each ``delete_every``-th is followed by a delete of the oldest live insert.

    The t-th delete removes the insert at place t - 1, so that no state is needed to write the log.
    """
    ins = rest.select((F.col("place") + F.floor(F.col("place") / delete_every)).alias("seq"), F.lit("insert").alias("op"), "id", "place")
    due = (F.col("place") + 1) * delete_every - 1  # the insert that this place's delete follows
    n = rest.agg(F.max("place").alias("last"))  # one row
    gone = rest.join(F.broadcast(n)).where(due <= F.col("last")).select((due + 1 + F.col("place")).alias("seq"), F.lit("delete").alias("op"), "id", due.alias("place"))
    return ins.union(gone).select(F.col("seq").cast("long").alias("seq"), F.floor(F.col("place") / batch).cast("long").alias("batch"), "op", "id")


def live_at(place: Column, inserted: Column | int, delete_every: int = 10) -> Column:
    """Whether the insert at ``place`` is live after so many inserts."""
    n = F.lit(inserted) if isinstance(inserted, int) else inserted
    return (place < n) & (place >= F.floor(n / delete_every))


def mixed_log(n_inserts: int, n_base: int, mix: tuple[float, float, float], total: int, batch: int, spark, seed: int = 42) -> DataFrame:
    """seq, batch, op, at: exactly round(total x share) operations of each kind in hash order; ``at`` numbers the kind's operations.

    Inserts wrap around n_inserts; a delete's victim is an insert that the hash picks among those before it, and a delete
    before any insert is dropped.
    """
    n = [round(total * m) for m in mix]
    kind = F.when(F.col("k") < n[0], "insert").when(F.col("k") < n[0] + n[1], "query").otherwise("delete")
    ops = spark.range(sum(n)).select(F.col("id").alias("k")).withColumn("op", kind).withColumn("h", F.xxhash64("k", F.lit(seed)))
    # ranges of the hash order the operations; each range is numbered on its own and starts where the one before it ends
    parts = max(1, sum(n) // 100_000)
    ops = ops.withColumn("part", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts))
    own = Window.partitionBy("part").orderBy("h", "k")
    before = ops.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == "insert").alias("i"), F.count_if(F.col("op") == "query").alias("q"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = before.select("part", *(F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"{c}0") for c in "niq"))
    seq = F.row_number().over(own) - 1 + F.col("n0")
    so_far = lambda op, c: F.count_if(F.col("op") == op).over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col(c)
    out = ops.join(F.broadcast(before), "part").select(seq.cast("long").alias("seq"), "op", "h", so_far("insert", "i0").alias("ins"), so_far("query", "q0").alias("qry"))
    victim = F.when(F.col("ins") > 0, F.pmod(F.col("h"), F.col("ins")))
    at = F.when(F.col("op") == "insert", (F.col("ins") - 1) % n_inserts).when(F.col("op") == "query", (F.col("qry") - 1) % n_base).otherwise(victim)
    return out.withColumn("at", at.cast("long")).where("at is not null").select("seq", F.floor(F.col("seq") / batch).cast("long").alias("batch"), "op", "at")


def apply_batch(index: Index, ops: DataFrame, name: str = "frozen") -> Index:
    """The index after a batch of OPS: an id's last insert or delete counts; ``name`` is the policy that follows."""
    last = ops.where("op <> 'query'").groupBy("id").agg(F.max_by(F.struct("op", "vec"), "seq").alias("last")).select("id", "last.*")
    return policy(name)(index, last.where("op = 'insert'"), last.where("op = 'delete'"))


def version(spark: SparkSession, path: str, number: int, config: IndexConfig) -> Index | None:
    """The index that ``follow`` left after a batch; None where it isn't wholly written."""
    found = layers.load(spark, path, number, config)
    return found and found[0]


def latest(spark: SparkSession, path: str, config: IndexConfig) -> Index | None:
    """The index after the last batch that is wholly written."""
    for number in sorted(layers.versions(spark, path), reverse=True):
        if (found := version(spark, path, number, config)) is not None:
            return found
    return None


@dataclass(frozen=True)
class Measure:
    """How a batch's queries are asked: neighbours and probed partitions."""

    k: int = 10
    nprobe: int = 8


MEASURES = "batch long, inserts long, deletes long, queries long, vectors long, partitions long, splits long, merges long, reassigned long, recall double, boundary double"


def measured(index: Index, ops: DataFrame, number: int, how: Measure) -> DataFrame:
    """A row of MEASURES: a batch's operations, the index after it, mean recall of its queries (by the index against all live vectors) and mean boundary score.

    Without queries recall and score are null. Counters are those since the stream began.
    """
    spark = index.postings.sparkSession
    n = ops.agg(*(F.count_if(F.col("op") == op).alias(op) for op in ("insert", "delete", "query"))).first()
    sizes = index.sizes().agg(F.sum("n").alias("vectors"), F.count(F.lit(1)).alias("partitions")).first()
    recall = score = None
    if n["query"]:
        queries = ops.where("op = 'query'").select(F.col("id").alias("qid"), "vec")
        found, truth = search(queries, index, how.k, how.nprobe), knn.exact(queries, index.postings, how.k, index.config.metric)
        recall = quality.recall(found, truth, how.k).agg(F.avg("recall")).first()[0]
        score = quality.boundary_scores(queries, index.centroids).agg(F.avg("score")).first()[0] if len(index.centroids) > 1 else None
    counters = [index.counters.get(c, 0) for c in ("splits", "merges", "reassigned")]
    return spark.createDataFrame([(number, n["insert"], n["delete"], n["query"], sizes["vectors"] or 0, sizes["partitions"], *counters, recall, score)], MEASURES)


def measures(spark: SparkSession, path: str) -> DataFrame:
    """MEASURES of all batches that ``follow`` measured."""
    return spark.read.schema(MEASURES).parquet(f"{path}/measures/*")


class Progress(StreamingQueryListener):
    """Of every batch of the queries that it listens to: rows, seconds, rows a second and operations by kind (``observed``)."""

    def __init__(self):
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        ops = p.observedMetrics.get("ops") if p.observedMetrics else None
        if p.numInputRows:
            self.rows.append((p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000, float(p.processedRowsPerSecond), *((ops["inserts"], ops["deletes"], ops["queries"]) if ops else (None,) * 3)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "batch long, rows long, seconds double, per_second double, inserts long, deletes long, queries long")


def follow(ops: DataFrame, index: Index, path: str, checkpoint: str, name: str = "frozen", measure: Measure | None = None) -> StreamingQuery:
    """Apply a stream of OPS batch by batch; the index after batch i is version i of ``path`` (``operators.layers``).

    A batch starts from the version before it, the first from ``index``, and writes what it changes: its own vectors and ids,
    and the partitions that the policy deals anew. With ``measure`` its queries are asked of the version after it, and a row
    of MEASURES is written. After a restart the query goes on from the version that it left; a batch that comes again and
    whose version is whole changes nothing.
    """
    count = lambda op: F.count_if(F.col("op") == op)
    ops = ops.observe("ops", count("insert").alias("inserts"), count("delete").alias("deletes"), count("query").alias("queries"))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = layers.load(spark, path, number, index.config)
        if now is None:
            found = layers.load(spark, path, number - 1, index.config) if number else (replace(index, changes=None), None)
            if found is None:
                raise RuntimeError(f"{path} holds no index of batch {number - 1}")
            before, held = found
            layers.save(apply_batch(before, batch, name), path, number, held)
        at = f"{path}/measures/{number}"
        if measure is not None and not exists(spark, f"{at}/_SUCCESS"):
            measured(now[0] if now else version(spark, path, number, index.config), batch, number, measure).coalesce(1).write.mode("overwrite").parquet(at)

    return ops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assigned_stream(vectors: DataFrame, index: Index) -> DataFrame:
    """A stream of vectors (id, vec) with cluster and distance: stateless, since frozen centroids never move."""
    return knn.nearest(vectors, index.centroids, index.config.metric)


def mixed_recall(vectors: DataFrame, queries: DataFrame, index: Index, rest: DataFrame, inserts: int, k: int = 10, nprobe: int = 8, rounds: int = 5, delete_every: int = 10) -> DataFrame:
    """round, qid, recall of a frozen index after each round of inserts and deletes, against exact neighbours among the live vectors.

    ``queries`` (qid, vec, turn): each is asked once, in round ``turn`` mod ``rounds`` plus 1.
    """
    queries = queries.withColumn("round", F.pmod(F.col("turn").cast("long"), F.lit(rounds)) + 1)
    grown = index.changed(knn.nearest(rest.select("id", "vec"), index.centroids, index.config.metric))
    place = rest.select("id", "place")
    alive = lambda df, n: df.join(place, "id", "left").where(F.col("place").isNull() | live_at(F.col("place"), n, delete_every)).drop("place")
    turns = queries.select("qid", "round")
    found = truth = None
    for r in range(1, rounds + 1):
        own, n = queries.where(F.col("round") == r).select("qid", "vec"), inserts * r // rounds
        one = search(own, replace(grown, postings=alive(grown.postings, n)), k, nprobe)
        two = knn.exact(own, alive(vectors.select("id", "vec"), n), k, index.config.metric)
        found, truth = (one, two) if found is None else (found.union(one), truth.union(two))
    return quality.recall(found, truth, k).join(turns, "qid").select("round", "qid", "recall")
