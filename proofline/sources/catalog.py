"""Named evidence tables, read lazily and brought to one flat shape."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofline.functions.exprs import as_utc
from proofline.sources.schemas import TABLES


class MissingTable(LookupError):
    """The evidence store has no such table."""


def _has_path(schema: T.StructType, path: str) -> bool:
    head, _, rest = path.partition(".")
    for field in schema.fields:
        if field.name == head:
            if not rest:
                return True
            return isinstance(field.dataType, T.StructType) and _has_path(field.dataType, rest)
    return False


def _find(df: DataFrame, name: str, paths: tuple[str, ...]) -> Column | None:
    if name in df.columns:
        return F.col(name)
    for path in paths:
        if "$" in path:
            text, _, field = path.partition("$")
            if text in df.columns:
                return F.get_json_object(text, "$" + field)
        elif _has_path(df.schema, path):
            return F.col(path)
    return None


def normalise(df: DataFrame, table: str) -> DataFrame:
    """Keep the known columns of ``table``, flat and typed.

    Columns the store lacks stay absent, so an operator that needs one fails
    at analysis and its check becomes an ERROR row. Columns already of the
    right type are passed on untouched, so filters still reach the scan. Times
    become zone-less UTC: instants and text with an offset are converted.
    """
    kept = []
    for name, dtype, paths in TABLES[table]:
        source = _find(df, name, paths)
        if source is not None:
            if dtype.lower() == "timestamp_ntz":
                stored = df.select(source.alias("c")).schema["c"].dataType.simpleString()
                kept.append(as_utc(source, stored).alias(name))
            else:
                kept.append(source.cast(dtype.lower()).alias(name))
    return df.select(*kept)


class EvidenceCatalog(Mapping):
    """Logical table name -> DataFrame.

    A source is a DataFrame, a function that makes one, a path, or the name of
    a catalog table. It is read when first asked for.
    """

    def __init__(self, spark: SparkSession, sources: Mapping[str, object], fmt: str = "parquet"):
        unknown = set(sources) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown evidence tables: {sorted(unknown)}")
        self.spark = spark
        self._sources = dict(sources)
        self._fmt = fmt
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def from_directory(
        cls, spark: SparkSession, root: str, fmt: str = "parquet",
        overrides: Mapping[str, str] | None = None,
    ) -> EvidenceCatalog:
        """One sub-directory per table under ``root``; ``overrides`` renames some."""
        names = {t: f"{root.rstrip('/')}/{(overrides or {}).get(t, t)}" for t in TABLES}
        return cls(spark, names, fmt)

    @classmethod
    def from_tables(
        cls, spark: SparkSession, prefix: str = "", overrides: Mapping[str, str] | None = None
    ) -> EvidenceCatalog:
        """Catalog tables named ``prefix + logical name``, some renamed by ``overrides``."""
        return cls(spark, {t: (overrides or {}).get(t, prefix + t) for t in TABLES})

    def replaced(self, **sources: object) -> EvidenceCatalog:
        """A catalog with some tables exchanged."""
        return EvidenceCatalog(self.spark, {**self._sources, **sources}, self._fmt)

    def without(self, *tables: str) -> EvidenceCatalog:
        kept = {t: s for t, s in self._sources.items() if t not in tables}
        return EvidenceCatalog(self.spark, kept, self._fmt)

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._sources:
            raise MissingTable(f"evidence table {table!r} is not in the store")
        if table not in self._frames:
            self._frames[table] = normalise(self._read(self._sources[table]), table)
        return self._frames[table]

    def _read(self, source: object) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        if callable(source):
            return source()
        if "/" in source:
            return self.spark.read.format(self._fmt).load(source)
        return self.spark.table(source)

    def __iter__(self):
        return iter(self._sources)

    def __len__(self) -> int:
        return len(self._sources)
