"""An opened index: its tables with repeated rows merged once, and its full-text postings.

Merging repeated rows shuffles whole rows. It is done once when an index is opened (each table when it is
first used) and kept as a table in the shared folder for the rest of the session, so that a query's filters
and columns reach the scan and no query moves bodies to merge rows. An index that is changed is opened again.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession

from loomindex.operators.postings import TextIndex
from loomindex.session import materialize
from loomindex.sources import tables


class OpenedIndex:
    """The tables of the index in ``folder``; see ``sources.tables`` for what each row is."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    @cached_property
    def symbols(self) -> DataFrame:
        return materialize(tables.symbols(self._spark, self._folder), "symbols")

    @cached_property
    def relations(self) -> DataFrame:
        return materialize(tables.relations(self._spark, self._folder), "relations")

    @cached_property
    def files(self) -> DataFrame:
        return materialize(tables.files(self._spark, self._folder), "files")

    @cached_property
    def text(self) -> TextIndex:
        return TextIndex.build(self.symbols)


@lru_cache(maxsize=64)
def _opened(application: str, spark: SparkSession, folder: str) -> OpenedIndex:
    return OpenedIndex(spark, folder)


def open_index(spark: SparkSession, folder: str) -> OpenedIndex:
    """The index in ``folder``, opened once per session."""
    return _opened(spark.sparkContext.applicationId, spark, folder)
