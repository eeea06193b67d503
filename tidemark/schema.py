"""Column conventions of the readings table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Short column name -> original column name, core features first.
FEATURE_COLUMNS = {
    "water_temp": "水温(℃)",
    "ph": "pH(无量纲)",
    "dissolved_oxygen": "溶解氧(mg/L)",
    "conductivity": "电导率(μS/cm)",
    "turbidity": "浊度(NTU)",
    "permanganate_index": "高锰酸盐指数(mg/L)",
    "ammonia_n": "氨氮(mg/L)",
    "total_p": "总磷(mg/L)",
    "total_n": "总氮(mg/L)",
    "chlorophyll_a": "叶绿素α(mg/L)",
    "algae_density": "藻密度(cells/L)",
}
CORE_FEATURES = list(FEATURE_COLUMNS)[:9]
EXT_FEATURES = list(FEATURE_COLUMNS)
KEY_COLUMNS = {"station": "断面名称", "obs_time": "监测时间", "category": "水质类别"}

METRICS = ["RMSE", "MAE", "MAPE", "R2"]
METRICS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("station", "feature", "model_type")]
    + [T.StructField("step", T.IntegerType())]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
    + [T.StructField("params", T.StringType())]
)


@dataclass(frozen=True)
class Layout:
    """Which columns of a readings DataFrame play which part.

    ``ties`` completes ``time`` to a total order inside a station; list enough
    columns to make the order unique, or results on equal times are arbitrary.
    """

    station: str = "station"
    time: str = "obs_time"
    category: str = "category"
    features: list[str] = field(default_factory=lambda: list(CORE_FEATURES))
    ties: list[str] = field(default_factory=list)

    def available(self, df) -> list[str]:
        return [f for f in self.features if f in df.columns]


def raw_schema(features: list[str] | None = None) -> T.StructType:
    """All-string schema of a raw readings file, original column names."""
    names = [*KEY_COLUMNS.values(), *(FEATURE_COLUMNS[f] for f in features or EXT_FEATURES)]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def short_names(df):
    """Rename original column names to the short ones used by every operator."""
    renames = {v: k for k, v in {**KEY_COLUMNS, **FEATURE_COLUMNS}.items() if v in df.columns}
    return df.withColumnsRenamed(renames)
