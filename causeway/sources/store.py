"""Files: range scans, trades from CSV, array bundles, and a store of runs that never takes a control for a real run."""

from __future__ import annotations

import io
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, time: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parquet with pruned columns and an inclusive time range, both pushed to the files."""
    df = spark.read.parquet(path)
    if time and start:
        df = df.where(F.col(time) >= F.lit(start).cast(dict(df.dtypes)[time]))
    if time and end:
        df = df.where(F.col(time) <= F.lit(end).cast(dict(df.dtypes)[time]))
    return df.select(*columns) if columns else df


def inventory(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """source, present, n_files, n_bytes and n_rows of each Parquet source of a folder; one that is missing is a row as well.

    Files and their sizes come from the metadata that Spark's scan gives with each row, of no column's contents.
    """
    hadoop, out = spark._jsparkSession.sessionState().newHadoopConf(), None
    for name in names:
        path = f"{folder}/{name}.parquet"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        row = spark.range(1).select(F.lit(name).alias("source"), F.lit(False).alias("present"), *(F.lit(0).cast("long").alias(c) for c in ("n_files", "n_bytes", "n_rows")))
        if where.getFileSystem(hadoop).exists(where):
            files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.first("file_size").alias("size"), F.count("*").alias("n"))
            total = [F.count("*").alias("n_files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("size", "n_bytes"), ("n", "n_rows")))]
            row = files.agg(*total).select(F.lit(name).alias("source"), F.lit(True).alias("present"), "n_files", "n_bytes", "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def closed_trades(backtest: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Back-test trades and closed live positions in one; pnl_pct falls back to the marked profit."""
    both = backtest.unionByName(positions.where("upper(status) = 'CLOSED'"), allowMissingColumns=True) if positions is not None else backtest
    pnl = [F.expr(f"try_cast({c} as double)") for c in ("pnl_pct", "mtm_pnl_pct") if c in both.columns]
    return both.withColumn("pnl_pct", F.coalesce(*pnl, F.lit(0.0)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def array_bundles(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row for each row of array ``name`` in each .npz file: file, row, values."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                with np.load(io.BytesIO(data.as_py()), allow_pickle=False) as held:
                    values = np.atleast_2d(held[name]).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([where] * len(values)), pa.array(range(len(values)), pa.int64()), pa.array(values.tolist(), pa.list_(pa.float64()))], names=["file", "row", "values"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, row long, values array<double>")


def save_run(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], null_mode: str = "none", seed: int = 0, when: datetime | None = None) -> None:
    """Each table under root/<table>/run_id=..., then the row that describes the run: a run without it does not exist."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
    row = (run_id, null_mode, seed, sorted(tables), when or datetime.now(timezone.utc))
    spark.createDataFrame([row], "run_id string, null_mode string, seed int, tables array<string>, written_at timestamp").write.mode("append").parquet(f"{root}/meta")


def select_run(spark: SparkSession, root: str, require_tables: list[str] = (), explicit: str | None = None) -> str:
    """The run asked for, else the newest real one that has all tables; control runs and stubs are never taken by default."""
    meta = spark.read.parquet(f"{root}/meta")
    if explicit:
        meta = meta.where(F.col("run_id") == explicit)
    else:
        meta = meta.where("null_mode = 'none'")
        for t in require_tables:
            meta = meta.where(F.array_contains("tables", t))
    best = meta.orderBy(F.desc("written_at"), F.desc("run_id")).limit(1).collect()
    if not best:
        raise FileNotFoundError(f"no run of {root} fits")
    return best[0]["run_id"]
