"""Logs: LogsQL over a DataFrame of entries.

Entries: ts BIGINT (microseconds), level STRING, message STRING, metadata STRING (a JSON object); optionally seq, which orders entries of one time.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.operators import logsql


class Logs:
    def __init__(self, entries: DataFrame):
        self.entries = entries

    def query(self, text: str, now: int, *fields: str, ordered: bool = True) -> DataFrame:
        """now: the request's clock in µs. With fields: their texts as columns; else a column `row` of JSON objects.

        ordered=False leaves out the final sort, which large results seldom need; limits and offsets within the query keep their order.
        """
        rows = logsql.run(self.entries, text, now)
        if ordered:
            rows = replace(rows, df=rows.df.orderBy(*rows.sort))
        if fields:
            return rows.df.select(*[rows.text(f).alias(f) for f in fields])
        rows = rows.mapped()
        return rows.df.select(logsql.as_object(F.col("row"), []).alias("row"))

    def filter(self, text: str, now: int = 0) -> DataFrame:
        """The entries that a query without pipes selects, in their own columns."""
        from tellurion.errors import QueryError
        from tellurion.plans import logsql as P

        query = P.parse(text, now)
        if query.pipes:
            raise QueryError("only a filter is allowed here")
        rows = logsql.Rows(self.entries)
        return self.entries.where(logsql.predicate(rows, query.filter, logsql.Run(self.entries, now)))


