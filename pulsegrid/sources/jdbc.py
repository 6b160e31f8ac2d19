"""Tables of a database: partitioned reads with pushed predicates, and staged upserts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a connection fetches or sends at a time.
BATCH = "10000"


@dataclass(frozen=True)
class Database:
    """A database by its JDBC url; ``options`` go to Spark's reader and writer (driver, user, password and the like).

    Spark plans a frame read by JDBC anew whenever it is used, so the static side of a stream is the present one in every batch.
    """

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)

    def _reader(self):
        return self.spark.read.format("jdbc").option("url", self.url).option("fetchsize", BATCH).options(**self.options)

    def read(self, table: str, by: str | None = None, partitions: int = 8) -> DataFrame:
        """A table. ``by``, a number, date or time, deals the rows to so many connections by ranges between its least and largest value.

        Filters, columns and aggregates of what is read are pushed to the database. The bounds are asked for once, by a pushed
        aggregate; rows beyond them that come later, and null ones, are read by the outer ranges.
        """
        whole = self._reader().option("dbtable", table).load()
        if by is None:
            return whole
        low, high = whole.agg(F.min(by), F.max(by)).first()
        if low is None or low == high:
            return whole
        ranges = {"partitionColumn": by, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
        return self._reader().option("dbtable", table).options(**ranges).load()

    def run(self, *statements: str) -> None:
        """Statements in one transaction."""
        jvm = self.spark._jvm
        properties = jvm.java.util.Properties()
        for key, value in self.options.items():
            properties.setProperty(key, value)
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            for text in statements:
                statement = connection.createStatement()
                statement.executeUpdate(text)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def upsert(self, rows: DataFrame, table: str, key: Sequence[str], update: Sequence[str] | None = None, guard: str | None = None) -> None:
        """Rows, one a key, into a table: executors write a staging table, then one MERGE of the database moves them.

        ``update`` are the columns that a present row takes over (all but the key; none: insert if absent), where ``guard``
        holds, an SQL condition on ``t``, the present row, and ``s``, the new one. A task that is run again, or a crash
        before the MERGE, touches the staging table alone.
        """
        columns = rows.columns
        update = [c for c in columns if c not in key] if update is None else list(update)
        staging = f"{table}_{uuid.uuid4().hex[:12]}"
        rows.write.format("jdbc").option("url", self.url).option("dbtable", staging).option("batchsize", BATCH).options(**self.options).mode("overwrite").save()
        quoted = lambda c: f'"{c}"'
        on = " AND ".join(f"t.{quoted(k)} = s.{quoted(k)}" for k in key)
        merge = f"MERGE INTO {table} t USING {staging} s ON {on}"
        if update:
            merge += " WHEN MATCHED" + (f" AND {guard}" if guard else "") + " THEN UPDATE SET " + ", ".join(f"{quoted(c)} = s.{quoted(c)}" for c in update)
        merge += f" WHEN NOT MATCHED THEN INSERT ({', '.join(map(quoted, columns))}) VALUES ({', '.join(f's.{quoted(c)}' for c in columns)})"
        try:
            self.run(merge)
        finally:
            self.run(f"DROP TABLE {staging}")
