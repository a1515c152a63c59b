"""Changes to tables: each takes tables and gives the tables as they are afterwards. Writing is one atomic swap of a version."""

from __future__ import annotations

import json
import time
from functools import reduce
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from biblioweave.functions import names as N


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """New rows with defaults where a column is null or missing."""
    for c, v in defaults.items():
        lit = F.array().cast("array<string>") if v == [] else F.lit(v)
        rows = rows.withColumn(c, F.coalesce(F.col(c), lit) if c in rows.columns else lit)
    return rows


def stamped(rows: DataFrame, at: str) -> DataFrame:
    """Rows with updated_at set to the ISO time ``at``, which the caller gives so that a repeated run writes the same."""
    return rows.withColumn("updated_at", F.lit(at).cast("timestamp"))


def patch(table: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """``table`` with the given columns of the rows in ``changes``: a null there keeps the old value, so nothing can be set to null."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"{c}_new_") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(f"{c}_new_", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """``table`` with rows of new keys added, and of known keys only ``columns`` taken over; rows must be unique in keys."""
    new = rows.select(*keys, *[F.col(c).alias(f"{c}_new_") for c in columns], F.lit(True).alias("hit_"))
    joined = table.join(new, keys, "left")
    kept = joined.select(*[F.when(F.col("hit_"), F.col(f"{c}_new_")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])
    return kept.unionByName(rows.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of keys it doesn't have; others are passed over, as are repeated ones."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows whose key is in ``gone``."""
    return table.join(gone.select(key), key, "left_anti")


def delete_cascade(publications: DataFrame, authorships: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publications without those in ``gone`` (publication_id), and authorships without theirs."""
    return delete(publications, gone, "publication_id"), delete(authorships, gone, "publication_id")


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """``children`` with those of every parent that occurs in ``new`` replaced by the new ones."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def quarantine(rows: DataFrame, ok: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reason``: the names of the checks they fail); a check that is null fails."""
    reason = F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in ok.items()])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason = ''").drop("reason"), marked.where("reason <> ''")


def overwrite(table: DataFrame, rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """``table`` after an import by key: of several rows of a key the last by ``order`` counts; a known key has ``columns`` taken over, nulls too, a new key is added."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    one = rows.withColumn("last_", F.row_number().over(last)).where("last_ = 1").drop("last_")
    return upsert(table, one.select(*[c for c in rows.columns if c in table.columns]), keys, *columns)


def renamed(authors: DataFrame, changes: DataFrame, key: str = "author_id") -> DataFrame:
    """Authors after a change of full_name: the normalized name follows, the slug stays as it is; a null keeps the old name."""
    new = patch(authors, changes, key, "full_name")
    return new.withColumn("normalized_name", N.normalize_name(F.col("full_name")))


class Outcome(str):
    """What a change comes to, with the code a service would answer."""

    CODES: ClassVar[dict[str, int]] = {"created": 201, "read": 200, "deleted": 204, "invalid": 400, "unknown": 404, "conflict": 409}

    @property
    def code(self) -> int:
        return self.CODES[self]


def insert_outcomes(table: DataFrame, rows: DataFrame, key: str, unique: list[list[str]], parents: dict[str, tuple[DataFrame, str]], ok: dict[str, object]) -> DataFrame:
    """(``key``, outcome, code) of each row to be inserted: ``invalid`` if a check fails or a parent is missing, ``conflict`` if a unique key is
    held by the table or an earlier right row, whatever becomes of that, else ``created``; a null in a unique key holds nothing."""
    checked = rows.withColumn("bad_", ~reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in ok.values()], F.lit(True)))
    for column, (parent, parent_key) in parents.items():
        known = parent.select(F.col(parent_key).alias(column)).distinct().withColumn("known_", F.lit(True))
        checked = checked.join(known, column, "left").withColumn("bad_", F.col("bad_") | (F.col(column).isNotNull() & F.col("known_").isNull())).drop("known_")
    checked = checked.withColumn("clash_", F.lit(False))
    for keys in unique:
        held = table.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys)).distinct().withColumn("held_", F.lit(True))
        # a key within the new rows goes to the first of them that is right
        turn = F.row_number().over(Window.partitionBy("bad_", *keys).orderBy(key))
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        checked = checked.withColumn("turn_", turn).join(held, keys, "left").withColumn("clash_", F.col("clash_") | F.col("held_").isNotNull() | whole & (F.col("turn_") > 1)).drop("held_", "turn_")
    outcome = F.when(F.col("bad_"), "invalid").when(F.col("clash_"), "conflict").otherwise("created")
    codes = F.create_map(*[F.lit(x) for kv in Outcome.CODES.items() for x in kv])
    return checked.select(key, outcome.alias("outcome")).withColumn("code", F.try_element_at(codes, F.col("outcome")))


def _files(spark: SparkSession, path: str) -> tuple[object, object, object]:
    """(JVM, file system, path object) of a path on whatever file system the session knows."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where  # noqa: SLF001


def refresh(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables as a new version under ``base`` and make it current in one step; returns the version.

    Readers see the old version until the manifest is replaced, and none or all of the new tables after. All goes through
    the session's file systems, so that ``base`` may lie on any of them.
    """
    version = f"v{time.time_ns()}"
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{base}/{version}/{name}")
    text = json.dumps({"version": version, "tables": sorted(tables)}).encode()
    jvm, fs, new = _files(spark, f"{base}/manifest.{version}")
    out = fs.create(new, True)
    out.write(bytearray(text))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(new, jvm.org.apache.hadoop.fs.Path(f"{base}/manifest.json"), options)
    return version


def current(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the current version."""
    manifest = spark.read.text(f"{base}/manifest.json", wholetext=True).first()[0]
    return spark.read.parquet(f"{base}/{json.loads(manifest)['version']}/{name}")
