"""Float -> fixed decimal conversion for the keyed store (PRJ6).

Every floating value becomes DECIMAL(38,6) after rounding to 6 places. The
walk is schema driven: structs are rebuilt field by field and arrays are
mapped with ``transform``, so nested values are converted too, all inside
the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_DECIMAL = T.DecimalType(38, 6)


def to_store_decimal(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.round(c, 6).cast(STORE_DECIMAL)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: to_store_decimal(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [to_store_decimal(c.getField(f.name), f.dataType).alias(f.name)
                  for f in dtype.fields]
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _k, v: to_store_decimal(v, dtype.valueType))
    return c


def decimalise_columns(df: DataFrame) -> list[Column]:
    return [to_store_decimal(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
