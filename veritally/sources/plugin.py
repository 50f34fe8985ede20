"""Dataset plug-ins: a user's loader as a format of ``spark.read``.

A loader says into which parts a dataset falls and yields the rows of one
part; Spark plans the parts as tasks.  Comparisons with a constant that the
loader can use (``pushable`` columns) are given to it, so that parts and rows
that cannot match are not read; rows that do not match all the same are left
out here, in the task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The session setting under which Spark gives filters to Python sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class DatasetLoader:
    """What a dataset needs; subclass it and give it to :func:`register_loader`.

    ``wanted`` has per pushable column the set of values that are asked for; a
    column that is not in it may have any.
    """

    schema: str | StructType = "instance_index long, text string, category string, metadata map<string,string>"
    pushable: Sequence[str] = ()

    def __init__(self, options: Mapping[str, str]):
        self.options = options

    def parts(self, wanted: Mapping[str, frozenset]) -> Sequence[Any]:
        """The parts of the dataset, each small and picklable; asked for on the driver."""
        return [None]

    def rows(self, part: Any, wanted: Mapping[str, frozenset]) -> Iterator[tuple]:
        """The rows of a part, in the order of the schema; called in a task."""
        raise NotImplementedError


class _Part(InputPartition):
    def __init__(self, value: Any):
        super().__init__(value)


class _Reader(DataSourceReader):
    def __init__(self, loader: DatasetLoader, columns: Sequence[str]):
        self.loader, self.columns, self.wanted = loader, list(columns), {}

    def partitions(self) -> Sequence[InputPartition]:
        return [_Part(p) for p in self.loader.parts(self.wanted)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        # Without any part Spark still plans one task.
        if partition is None:
            return iter(())
        checks = [(self.columns.index(c), values) for c, values in self.wanted.items()]
        return (r for r in self.loader.rows(partition.value, self.wanted) if all(r[i] in values for i, values in checks))


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of pushable columns; Spark keeps the other filters."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = ".".join(f.attribute) if values is not None else None
            if name in self.loader.pushable:
                known = self.wanted.get(name)
                self.wanted[name] = frozenset(values if known is None else known & values)
            else:
                yield f


def register_loader(spark: SparkSession, name: str, loader: type[DatasetLoader]) -> None:
    """Makes ``spark.read.format(name).options(...).load()`` read through ``loader``.

    Filters are given to it if the session allows that (``PUSHDOWN``) at the
    time of registration.
    """
    reader = _FilteringReader if loader.pushable and spark.conf.get(PUSHDOWN, "false").lower() == "true" else _Reader

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return loader.schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return reader(loader({k: self.options[k] for k in self.options}), schema.names)

    spark.dataSource.register(Source)
