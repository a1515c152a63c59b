"""Column functions under names that SQL texts can call."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from biblioweave.functions import names as N

#: Functions of one text that are registered.
FUNCTIONS = {"normalize_name": N.normalize_name, "normalize_loose": N.normalize_loose, "slugify": N.slugify, "title_plain": N.title_plain, "title_folded": N.title_folded}


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS callable in ``spark.sql``; they stay expressions of the JVM, as if written out in the query."""
    for name, f in FUNCTIONS.items():
        body = f(F.col("x"))._jc.node().sql()  # noqa: SLF001
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    return sorted(FUNCTIONS)
