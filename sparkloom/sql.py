"""SQL over registered tables. The language is Spark SQL; both front-ends give the same plans."""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_VIEWS = threading.Lock()


class SqlContext:
    """Names for tables, and queries over them.

    A name that is registered again stands for the new table from then on; queries made before keep the old one. A context's
    names are its own: they are views of the session only while a query is analysed, so contexts that share a session do
    not see each other's, and a view of the same name that the session has comes back.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        if not name.isidentifier():
            raise ValueError(f"not a table name: {name!r}")
        self.tables[name.lower()] = df

    def query(self, text: str) -> DataFrame:
        """The result of a SELECT, analysed now. Errors in it are Spark's ParseException, with line and position, and
        AnalysisException."""
        with _VIEWS:
            held = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary}
            before = {name: self.spark.table(name) for name in self.tables if name in held}
            try:
                for name, df in self.tables.items():
                    df.createOrReplaceTempView(name)
                return self.spark.sql(text)
            finally:
                for name in self.tables:
                    if name in before:
                        before[name].createOrReplaceTempView(name)
                    else:
                        self.spark.catalog.dropTempView(name)


def parse_sql(text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The plan of a SELECT over the given tables, without a context or a session of the caller's: the tables bring theirs.
    Nothing runs until an action."""
    if not tables:
        raise ValueError("a query needs a table")
    context = SqlContext(next(iter(tables.values())).sparkSession)
    for name, df in tables.items():
        context.register(name, df)
    return context.query(text)
