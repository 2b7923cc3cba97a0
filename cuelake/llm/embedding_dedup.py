"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors of a label first fold into one class. A class gets one bucket in each table: the signs
of its products with ``bits`` random hyperplanes. Pairs that share a bucket get their exact cosine in
double precision; a pair that shares several buckets is looked at in the first of them only, which
both signature lists tell without a shuffle. Large buckets are cut into blocks, and blocks meet in
pairs, so that no task holds more than two blocks at once. The links found there leave the task as a number
for each vector and as one edge from each vector to the smallest one it is connected with there, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, keep, materialise, scratch, shuffle_partitions

#: Vectors of a bucket that meet in one task, twice over.
BLOCK = 1024


def _signatures(batches: Iterator[pa.RecordBatch], tables: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, labels, vectors, copies = (batch.column(i) for i in range(4))
        size = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, int)
        out = [b""] * len(size)
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            x = flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
            signs = (x @ planes[dim] >= 0).reshape(len(rows), tables, bits)
            code = (signs.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
            for r, c in zip(rows, code):
                out[r] = c.astype("<u4").tobytes()
        sigs = np.frombuffer(b"".join(out), "<u4")
        codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sigs) + 1, tables), pa.int32()), pa.array(sigs.astype(np.int64)))
        yield pa.record_batch(
            [ids, labels, vectors, copies, pa.array(out, pa.binary()), codes], names=["rep", "label", "vector", "copies", "signature", "codes"]
        )


_KEYS = ("label", "table", "code", "dim", "left", "right")
_FOUND = "a long, b long, n long"


def _pairs_in_blocks(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``_KEYS``; each group is one bucket or one pair of its blocks."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        label = batch.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        keys = np.stack([label.astype(np.int64), *[batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _KEYS[1:]]])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        last = int(cut[-1]) if len(cut) else 0
        if last:
            yield from _linked(batch.slice(0, last), np.concatenate([[0], cut]), threshold)
        held = batch.slice(last)
    if held is not None:
        yield from _linked(held, np.array([0, held.num_rows]), threshold)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _linked(batch: pa.RecordBatch, bounds: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """What the links of a stretch of groups come to, in no more rows than twice its own: (a, null, vectors linked with a)
    and (a, b, null), a connected with b."""
    rep, table, block, left, right, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "table", "block", "left", "right", "copies"))
    codes = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(batch.num_rows, -1)
    vectors = batch.column("vector")
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(size)])
    ii, jj, cc = [], [], []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo < 2:
            continue
        x = flat[starts[lo] : starts[hi]].reshape(hi - lo, -1)
        x = x / np.linalg.norm(x, axis=1)[:, None]
        cosine = x @ x.T
        # A margin for the other order of summation; the exact test follows.
        i, j = np.nonzero(np.triu(cosine >= threshold - 1e-9, 1))
        if left[lo] != right[lo]:
            across = block[lo + i] != block[lo + j]
            i, j = i[across], j[across]
        ii.append(i + lo)
        jj.append(j + lo)
        cc.append(cosine[i, j])
    if not ii:
        return
    i, j, cosine = np.concatenate(ii), np.concatenate(jj), np.concatenate(cc)
    first = (codes[i] == codes[j]).argmax(axis=1) == table[i]
    i, j, cosine = i[first], j[first], cosine[first]
    near = cosine >= threshold + 1e-9
    for at in np.flatnonzero(~near):
        a, b = flat[starts[i[at]] : starts[i[at] + 1]], flat[starts[j[at]] : starts[j[at] + 1]]
        near[at] = (a @ b) / np.sqrt((a @ a) * (b @ b)) >= threshold
    i, j = i[near], j[near]
    n = batch.num_rows
    links = np.zeros(n, np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root, some = _roots(n, i, j), np.flatnonzero(links)
    joined = np.flatnonzero(root != np.arange(n))
    a = np.concatenate([rep[some], rep[joined]])
    b = pa.array(np.concatenate([rep[some], rep[root[joined]]]), mask=np.arange(len(a)) < len(some))
    count = pa.array(np.concatenate([links[some], np.zeros(len(joined), np.int64)]), mask=np.arange(len(a)) >= len(some))
    yield pa.record_batch([pa.array(a), b, count], names=["a", "b", "n"])


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tables: int = 32,
    bits: int = 16,
    seed: int = 7,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, rep (smallest id with the same vector and label), n_links, component_id.

    Vectors link when their labels are equal and not null and their cosine is at least ``threshold``
    in double precision; vectors of other lengths never link. Null, empty and zero vectors and those
    with null or non-finite components link with nothing. Labels may be of any type that has a text. Equal vectors of a label always link. A pair of other
    vectors at cosine c shares a table's bucket with probability (1 - acos(c) / pi) ** bits, so with
    the defaults a pair at 0.98 is missed once in about a million. Rows that repeat an id count as
    further vectors: classes are told apart by a key of label and vector, and a component is named by its
    smallest id at the end, null if none of its rows has one. An empty table gives no rows.
    """
    with scratch(vectors.sparkSession):
        ids = F.col(id_col).cast("long").alias("id")
        good = (
            F.col(label_col).isNotNull()
            & (F.size(vector_col) > 0)
            & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
            & F.exists(vector_col, lambda x: x != 0)
        )
        rows = vectors.select(ids, F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
        # -0.0 and 0.0 are one value.
        rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
        rows = rows.withColumn("mark", F.when(F.col("good"), F.sha2(F.to_json("vector"), 256)))
        member = materialise(rows.select("id", "label", "mark"), "vec-members")
        # A map-side combined minimum: a vector that makes up a third of the rows costs one row a task.
        classes = rows.where("good").groupBy("label", "mark").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
        # Classes are known by a number of their own: one id may stand on several vectors or labels, or on none.
        classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "vec-classes")
        signed = classes.select(F.col("class").alias("rep"), "label", "vector", "copies").mapInArrow(
            lambda b: _signatures(b, tables, bits, seed),
            "rep long, label string, vector array<double>, copies long, signature binary, codes array<long>",
        )
        signed = materialise(signed, "vec-signed")
        keys = ["label", "table", "code", "dim"]
        placed = signed.select("rep", "label", F.size("vector").alias("dim"), F.posexplode("codes").alias("table", "code"))
        crowd = placed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        crowd = crowd.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).drop("n")
        placed = placed.join(crowd, keys).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        placed = placed.select("rep", *keys, "block", other.alias("o")).select(
            "rep", *keys, "block", F.least("block", "o").alias("left"), F.greatest("block", "o").alias("right")
        )
        full = placed.join(signed.select("rep", "vector", "signature", "copies"), "rep")
        sort = [*keys, "left", "right"]
        full = full.repartition(shuffle_partitions(vectors.sparkSession), *sort).sortWithinPartitions(*sort)
        found = full.select("rep", *sort, "block", "vector", "signature", "copies").mapInArrow(lambda b: _pairs_in_blocks(b, threshold), _FOUND)
        found = materialise(found, "vec-links")
        degree = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("outside"))
        parts = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "class")
        placed = classes.select("class", "label", "mark", "rep", "copies").join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
        placed = materialise(placed, "vec-placed")
        named = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
        classed = (
            placed.join(degree, "class", "left").join(named, "component")
            .select("label", "mark", "rep", (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("classed"))
        )
        # Back to the rows in pieces: a copied vector's class is told to each of SALT shares of its rows.
        salt = 16
        shares = classed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        member = member.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int"))
        out = member.join(shares, ["label", "mark", "share"], "left").select(
            "id", F.when(F.col("classed"), F.col("rep")).otherwise(F.col("id")).alias("rep"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("classed"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        )
        return keep(materialise(out, "vec-found"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) d ON d.x = e.vec_id
LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = e.vec_id
"""
