"""A lazily evaluated table with declared column types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.functions import types
from millrace.functions.expressions import assign_cast, quoted


@dataclass(frozen=True)
class Column:
    name: str
    sql_type: str


@dataclass(frozen=True)
class Relation:
    """df's columns are those of `columns`, in order. The type names are kept as declared, as some checks compare them as texts."""

    df: DataFrame
    columns: tuple[Column, ...]

    @classmethod
    def of(cls, df: DataFrame) -> Relation:
        return cls(df, tuple(Column(f.name, types.name_of(f.dataType)) for f in df.schema.fields))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def find(self, name: str) -> Column | None:
        """A column by name in any case; it keeps its own spelling."""
        key = name.strip().lower()
        return next((c for c in self.columns if c.name.lower() == key), None)

    def resolve(self, name: str) -> Column:
        found = self.find(name)
        if found is None:
            raise ValueError(f"column {name!r} not found")
        return found

    def kind(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def filtered(self, condition: SparkColumn) -> Relation:
        return Relation(self.df.filter(condition), self.columns)

    def project(self, outputs: list[tuple[Column, SparkColumn, T.DataType | None]]) -> Relation:
        """One projection of (column, value, the value's type if known), each assigned to its declared type."""
        names = [c.name.lower() for c, _, _ in outputs]
        if repeated := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"duplicate output columns: {', '.join(repeated)}")
        if any(kind is None for _, _, kind in outputs):
            probe = self.df.select(*(v.alias(f"_{k}") for k, (_, v, _) in enumerate(outputs)))
            kinds = [f.dataType for f in probe.schema.fields]
        else:
            kinds = [kind for _, _, kind in outputs]
        df = self.df.select(*(assign_cast(v, kind, types.parse(c.sql_type)).alias(c.name) for (c, v, _), kind in zip(outputs, kinds, strict=True)))
        return Relation(df, tuple(c for c, _, _ in outputs))

    def own(self, name: str | None = None) -> list[tuple[Column, SparkColumn, T.DataType]]:
        """This relation's columns (or one of them) as outputs of project()."""
        return [(c, quoted(c.name), self.kind(c.name)) for c in self.columns if name in (None, c.name)]
