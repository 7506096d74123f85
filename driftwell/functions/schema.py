"""Versioned table schemas: columns with ids that are never used twice, and the changes between versions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.types import may_promote


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: T.DataType
    field_id: int
    nullable: bool = True
    key: bool = False
    dropped: bool = False


@dataclass(frozen=True)
class Change:
    kind: str  # add, drop, promote
    name: str
    type: T.DataType | None = None


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[ColumnDef, ...]
    partitions: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, schema: T.StructType, key: list[str], partitions: tuple[str, ...] = ()) -> TableSchema:
        missing = set(key) - set(schema.names)
        if missing or not key:
            raise ValueError(f"a table needs a key among its columns: {sorted(missing) or 'none given'}")
        return cls(tuple(ColumnDef(f.name, f.dataType, i, f.name not in key, f.name in key) for i, f in enumerate(schema, 1)), partitions)

    @property
    def key(self) -> list[str]:
        return [c.name for c in self.columns if c.key]

    def live(self) -> list[ColumnDef]:
        return [c for c in self.columns if not c.dropped]

    def struct(self) -> T.StructType:
        """All columns, dropped ones included: rows written before the drop still hold them."""
        return T.StructType([T.StructField(c.name, c.type, True, {"id": c.field_id}) for c in self.columns])

    def to_json(self) -> dict:
        return {"columns": [{"name": c.name, "type": c.type.jsonValue(), "id": c.field_id, "nullable": c.nullable, "key": c.key, "dropped": c.dropped} for c in self.columns], "partitions": list(self.partitions)}

    @classmethod
    def from_json(cls, raw: dict) -> TableSchema:
        kind = lambda v: T.StructType.fromJson({"type": "struct", "fields": [{"name": "c", "type": v, "nullable": True, "metadata": {}}]})["c"].dataType
        return cls(tuple(ColumnDef(c["name"], kind(c["type"]), c["id"], c["nullable"], c["key"], c["dropped"]) for c in raw["columns"]), tuple(raw["partitions"]))


def diff(schema: TableSchema, incoming: dict[str, T.DataType]) -> list[Change]:
    """Changes that lead from the table's live columns to the incoming ones. A rename reads as a drop and an add."""
    out, live = [], {c.name: c for c in schema.live()}
    for name, kind in incoming.items():
        old = live.get(name)
        if old is None:
            out.append(Change("add", name, kind))
        elif old.type != kind:
            if old.key or not may_promote(old.type, kind):
                raise ValueError(f"column {name} cannot change from {old.type.simpleString()} to {kind.simpleString()}")
            out.append(Change("promote", name, kind))
    for name, old in live.items():
        if name not in incoming:
            if old.key:
                raise ValueError(f"key column {name} cannot be dropped")
            out.append(Change("drop", name))
    return out


def apply(schema: TableSchema, changes: list[Change]) -> TableSchema:
    """The next version. A dropped column stays, marked; adding its name again makes a new column with a new id."""
    columns = list(schema.columns)
    for c in changes:
        at = next((i for i, x in enumerate(columns) if x.name == c.name and not x.dropped), None)
        if c.kind == "add":
            if at is not None:
                raise ValueError(f"column {c.name} exists")
            old = next((i for i, x in enumerate(columns) if x.name == c.name), None)
            if old is not None:
                columns[old] = replace(columns[old], name=f"{c.name}__dropped{columns[old].field_id}")
            columns.append(ColumnDef(c.name, c.type, max(x.field_id for x in columns) + 1))
        elif at is None:
            raise ValueError(f"no column {c.name}")
        elif c.kind == "drop":
            if columns[at].key:
                raise ValueError(f"key column {c.name} cannot be dropped")
            columns[at] = replace(columns[at], dropped=True, nullable=True)
        elif c.kind == "promote":
            if columns[at].key or not may_promote(columns[at].type, c.type):
                raise ValueError(f"illegal change of {c.name}")
            columns[at] = replace(columns[at], type=c.type)
        else:
            raise ValueError(f"unknown change {c.kind}")
    return replace(schema, columns=tuple(columns))


def conform(df: DataFrame, schema: TableSchema, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows under the table's schema: columns by name, promoted by cast, missing ones NULL."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{c.name}`") if c.name in have else F.lit(None)).cast(c.type).alias(c.name) for c in schema.columns), *extra)


def not_null(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Raise on NULL in a column that doesn't allow it."""
    for c in schema.live():
        if not c.nullable:
            df = df.withColumn(c.name, F.when(F.col(f"`{c.name}`").isNull(), F.raise_error(F.lit(f"NULL in {c.name}")).cast(c.type)).otherwise(F.col(f"`{c.name}`")))
    return df
