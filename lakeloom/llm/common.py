"""Helpers shared by the corpus operators: cutting lineage, binding values, finding components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow where the executors need not have this package: it goes to them with the job, once a context.

    Spark cuts batches by rows, 10 000 unless told otherwise, and each is held on both sides of the pipe; documents are
    long rows, so a session that has not chosen a number gets BATCH_ROWS.
    """
    context, rows = df.sparkSession.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(rows) == "10000":
        df.sparkSession.conf.set(rows, BATCH_ROWS)
    if not getattr(context, "_lakeloom_sent", False):
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="lakeloom-")) / "lakeloom.zip"  # Spark reads it on the driver and serves it
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(target))
        context._lakeloom_sent = True
    return df.mapInArrow(function, schema)


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most most_bytes, or one row: what Python makes of a batch is a multiple of it."""
    for batch in batches:
        if batch.nbytes <= most_bytes or batch.num_rows < 2:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from pieces(iter((batch.slice(0, half), batch.slice(half))), most_bytes)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lakeloom/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What make() gave for key in this worker; a worker keeps one such object, so a model makes way for the next one."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ, in any case, from all that are taken."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once for body, so that a lambda below does not evaluate it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stand still, which takes a number of rounds
    logarithmic in the longest path.  Each round is joins and partial aggregates keyed by node, so the hub of a
    large star is split as any skewed join is; each round's edges are written to the shared folder.  Nothing but a
    count and a checksum comes to the driver.  Rows with a null end or equal ends are ignored; an empty input gives
    an empty result.
    """
    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = stamp(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(small.union(root.select("hi", "m")).distinct())
        last, seen = seen, stamp(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `rows`, but for the last: arrays of short rows are dear to start on."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.num_rows for b in some) >= rows:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some = []
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by their first column, dealt out anew so that no value of it is split between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in gathered(batches):
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1]))
        if held and held[-1].column(0)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if not last:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
