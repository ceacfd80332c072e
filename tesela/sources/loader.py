"""Loading CSV with inferred types and NDJSON against a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT, _REAL = r"^[+-]?\d{1,19}$", r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_POINT = r"^POINT\(\s*([^,\s]+)\s*,\s*([^)\s]+)\s*\)$"
_VECTOR = r"^\[\s*[^\[\]]+\]$"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header. Types come from all cells: boolean, integer, real, date, point, vector,
    else text; integers beyond 64 bits and vectors of several sizes are text. An empty cell is null,
    a column of empty cells an integer, and a row of another width is an error."""
    raw = spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, mode="FAILFAST", quote='"', escape='"', multiLine=True, nullValue="", emptyValue="")
    tests = {}
    for c in raw.columns:
        x = F.col(f"`{c}`")
        size = F.when(x.rlike(_VECTOR), F.size(F.split(x, ",")))
        tests |= {
            (c, "n"): F.count(x), (c, "boolean"): F.count_if(x.isin("true", "false")), (c, "bigint"): F.count_if(x.rlike(_INT) & x.try_cast("bigint").isNotNull()), (c, "wide"): F.count_if(x.rlike(r"^[+-]?\d+$") & x.try_cast("bigint").isNull()),
            (c, "double"): F.count_if(x.rlike(_REAL)), (c, "date"): F.count_if(x.rlike(r"^\d{4}-\d\d-\d\d$") & x.try_cast("date").isNotNull()), (c, "point"): F.count_if(x.rlike(_POINT)), (c, "vector"): F.count(size), (c, "sizes"): F.count_distinct(size),
        }
    found = dict(zip(tests, raw.agg(*[e.alias(f"t{i}") for i, e in enumerate(tests.values())]).first() or ()))
    out = []
    for c in raw.columns:
        x, n = F.col(f"`{c}`"), found[c, "n"]
        if found[c, "boolean"] == n and n:
            typed = x.cast("boolean")
        elif found[c, "bigint"] == n:
            typed = x.cast("bigint")
        elif found[c, "double"] == n and not found[c, "wide"]:
            typed = x.cast("double")
        elif found[c, "date"] == n:
            typed = x.cast("date")
        elif found[c, "point"] == n:
            typed = F.when(x.isNotNull(), F.struct(F.regexp_extract(x, _POINT, 1).cast("double").alias("lat"), F.regexp_extract(x, _POINT, 2).cast("double").alias("lon")))
        elif found[c, "vector"] == n and found[c, "sizes"] == 1:
            typed = F.transform(F.split(F.regexp_replace(x, r"[\[\]\s]", ""), ","), lambda v: v.cast("float"))
        else:
            typed = x
        out.append(typed.alias(c))
    return raw.select(*out)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows by name; a missing column is null, and an unknown one or a bad line is an error."""
    lines = spark.read.text(path)
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    keys = F.json_object_keys("value")
    bad = F.when(keys.isNull(), F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))))
    odd = F.array_except(keys, names)
    checked = lines.filter(F.length(F.trim("value")) > 0).withColumn("ok", F.coalesce(bad, F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown columns: "), F.array_join(odd, ", ")))), F.lit(True)))
    return checked.filter("ok").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
