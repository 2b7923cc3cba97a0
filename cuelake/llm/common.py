"""Shared helpers: durable intermediate tables, shared-folder files, connected components."""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stores import Stored, delete_folder, keep, materialise, new_folder, release, scratch, shuffle_partitions  # noqa: F401


def gathered(blobs: DataFrame, fold: Callable[[Iterator[bytes]], bytes], fan: int = 32) -> bytes | None:
    """Folds the one binary column of ``blobs``, one of bounded size from each task, in a tree of tasks, ``fan``
    at a time; the driver gets the last. None: there was none."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([fold(x.as_py() for b in batches for x in b.column(0))], pa.binary())], names=["blob"])

    blobs = blobs.toDF("blob")
    n = blobs.count()
    while n > 1:
        n = -(-n // fan)
        blobs = blobs.repartition(n).mapInArrow(folded, "blob binary")
    first = blobs.first()
    return bytes(first[0]) if first else None


@contextlib.contextmanager
def written_file(uri: str):
    """Binary stream to a new shared file. It appears under its name only when it is whole, so a task
    that is lost, repeated or run twice leaves either nothing or the same bytes."""
    import os

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.{os.getpid()}.tmp"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)


def opened_file(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph as rows (id, component); component = smallest id in it.

    Alternating large-star and small-star rounds, each a shuffle over the edges, until only stars
    are left; a round that would change nothing isn't run. Ids without an edge to another id give no row; null ends are dropped. Edge tables of
    any shape work: a hub's smallest neighbour is found by a map-side combined minimum, and the join that
    tells it to the hub's edges has one row on that side, so that adaptive execution can split the edges.
    """
    # One row per edge with u > v.
    now = materialise(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc"
    )
    while True:
        # Done when all are stars: who has a smaller neighbour has no other.
        ends = now.select("u", F.lit(1).alias("up")).union(now.select("v", F.lit(0)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(small.select("e.u", "e.v").where("u != v").distinct(), "cc")
        release(now)
        release(large)
        now = after
    tops = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... : an operator's own names clash with none of them. ``toDF`` gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
