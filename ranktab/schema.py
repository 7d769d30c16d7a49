"""Column roles of the tabular top-k task.

Operators never hard-code a column name: they take a :class:`Columns`, which
says which physical column plays which role.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Names of the identifier, the label, six measurements and two strings."""

    id: str = "id"
    label: str = "label"
    temperature: str = "temperature"
    humidity: str = "humidity"
    moisture: str = "moisture"
    nitrogen: str = "nitrogen"
    phosphorous: str = "phosphorous"
    potassium: str = "potassium"
    crop: str = "crop_type"
    soil: str = "soil_type"
    combo: str = "Crop_Soil_combo"

    @property
    def climate(self) -> list[str]:
        return [self.temperature, self.humidity, self.moisture]

    @property
    def nutrients(self) -> list[str]:
        return [self.nitrogen, self.phosphorous, self.potassium]

    @property
    def numerics(self) -> list[str]:
        return self.climate + self.nutrients

    @property
    def strings(self) -> list[str]:
        return [self.crop, self.soil]

    @property
    def inputs(self) -> list[str]:
        return self.numerics + self.strings


#: Lower-case names, used by the registered queries.
SNAKE = Columns()

#: Names used in the public data files (fixed values).
TITLE = Columns(
    label="Fertilizer Name",
    temperature="Temperature",
    humidity="Humidity",
    moisture="Moisture",
    nitrogen="Nitrogen",
    phosphorous="Phosphorous",
    potassium="Potassium",
    crop="Crop Type",
    soil="Soil Type",
)

#: Column names that are misspelt in the files, and their right spelling.
MISSPELT = {"Temparature": "Temperature", "temparature": "temperature"}


def column_type(cols: Columns, name: str) -> T.DataType:
    """Declared type of an input column; columns without a role stay strings."""
    if name.lower() == cols.id.lower():
        return T.LongType()
    if name in cols.numerics:
        return T.DoubleType()
    return T.StringType()


def role_spelling(df: DataFrame, cols: Columns) -> DataFrame:
    """Columns whose names differ from a role's in case alone get the role's spelling."""
    roles = {v.lower(): v for v in vars(cols).values()}
    taken = set(df.columns)
    names = {c: roles[c.lower()] for c in df.columns if c.lower() in roles and roles[c.lower()] not in taken}
    return df.withColumnsRenamed(names)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def has_columns(df: DataFrame, names: list[str]) -> bool:
    present = {c.lower() for c in df.columns}
    return all(n.lower() in present for n in names)
