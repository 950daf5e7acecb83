"""The input views of one warehouse, read lazily."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger.functions.clock import DAY_PARTITION
from slotledger.schemas import VIEWS, view_schema


class Warehouse:
    """Named views (see ``slotledger.schemas``), each built on first use.

    ``wh.jobs`` and ``wh["jobs"]`` give the same DataFrame.
    """

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]]):
        unknown = set(loaders) - set(VIEWS)
        if unknown:
            raise ValueError(f"unknown views: {sorted(unknown)}")
        self.spark = spark
        self._loaders = dict(loaders)
        self._views: dict[str, DataFrame] = {}

    @classmethod
    def from_path(
        cls,
        spark: SparkSession,
        root: str,
        fmt: str = "parquet",
        by_day: Collection[str] = (),
    ) -> Warehouse:
        """Views stored as ``root/<view>``, read with the declared schema.

        The declared schema saves inference and lets zone-less time stamps be
        read as UTC instants, with their filters still pushed to the scan. Views
        in ``by_day`` are laid out in ``dt=<date>`` folders; time windows then
        prune whole folders.
        """

        def loader(name: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                fields = list(view_schema(name).fields)
                if name in by_day:
                    fields.append(T.StructField(DAY_PARTITION, T.DateType()))
                reader = spark.read.schema(T.StructType(fields)).format(fmt)
                return reader.load(f"{root}/{name}")

            return load

        return cls(spark, {name: loader(name) for name in VIEWS})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> Warehouse:
        """Views stored as catalog tables ``database.<view>`` of any format."""
        return cls(
            spark,
            {
                name: (lambda name=name: conform(spark.table(f"{database}.{name}"), name))
                for name in VIEWS
            },
        )

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> Warehouse:
        """Views given as DataFrames."""
        return cls(spark, {name: (lambda df=df: df) for name, df in frames.items()})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._views:
            if name not in self._loaders:
                raise KeyError(f"this warehouse has no view {name!r}")
            self._views[name] = self._loaders[name]()
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self[name]
        raise AttributeError(name)

    @property
    def names(self) -> tuple[str, ...]:
        """Names of the views this warehouse has."""
        return tuple(self._loaders)

    def refresh(self) -> None:
        """Forget the views built so far: the next use lists their files again."""
        self._views.clear()

    def register(self, prefix: str = "") -> None:
        """Make every view a temporary view of the session, for ad-hoc SQL.

        A temporary view of the session that no warehouse registered is an error.
        """
        made = _REGISTERED.setdefault(self.spark, set())
        for name in self._loaders:
            view = f"{prefix}{name}"
            if view not in made and _is_temporary(self.spark, view):
                raise ValueError(f"the session has a view {view!r} of its own; give a prefix")
            self[name].createOrReplaceTempView(view)
            made.add(view)


#: Temporary views that warehouses have made, by session.
_REGISTERED: WeakKeyDictionary[SparkSession, set[str]] = WeakKeyDictionary()


def _is_temporary(spark: SparkSession, view: str) -> bool:
    return spark.catalog.tableExists(view) and spark.catalog.getTable(view).isTemporary


def _as_declared(name: str, actual: T.DataType, declared: T.DataType) -> Column:
    """The column with the declared type; other fields of nested columns are left out."""
    column = F.col(name)
    if actual == declared:
        return column
    if isinstance(declared, T.StructType):
        fields = [column[f.name].cast(f.dataType).alias(f.name) for f in declared.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(declared, T.ArrayType) and isinstance(declared.elementType, T.StructType):
        # Zipped leaves, unlike a lambda over the elements, let the scan skip the others.
        leaves = [
            column[f.name].cast(T.ArrayType(f.dataType)).alias(f.name)
            for f in declared.elementType.fields
        ]
        return F.arrays_zip(*leaves)
    return column.cast(declared)


def conform(df: DataFrame, view: str) -> DataFrame:
    """Select the view's columns (and ``dt``, if any) with the declared types."""
    present = {f.name: f.dataType for f in df.schema.fields}
    fields = view_schema(view).fields
    missing = [f.name for f in fields if f.name not in present]
    if missing:
        raise ValueError(f"view {view!r} lacks columns {missing}")
    if any(present[f.name] == T.TimestampNTZType() for f in fields):
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        if zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
            raise ValueError("zone-less time stamps need a session in UTC")
    columns = [_as_declared(f.name, present[f.name], f.dataType).alias(f.name) for f in fields]
    if DAY_PARTITION in present:
        columns.append(F.col(DAY_PARTITION).cast("date").alias(DAY_PARTITION))
    return df.select(*columns)
