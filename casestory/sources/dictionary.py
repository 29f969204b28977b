"""S3: translation dictionaries as ordered ``(pos, src, dst)`` tables.

The reference keeps a JSON object source -> English whose key order matters (the
case-insensitive lookup takes the first matching key, the inverse takes the last
source). A JSON object is read whole (it is dictionary-sized: hundreds of entries) and
exploded into rows; everything downstream joins against the small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DICT_SCHEMA = T.StructType([
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), True),
])


def read_json_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """JSON object file -> ``(pos, src, dst)`` in key order."""
    txt = spark.read.text(path, wholetext=True)
    keys = F.json_object_keys("value")
    m = F.from_json("value", "map<string,string>")
    rows = txt.select(F.posexplode(keys).alias("pos", "src"), m.alias("m"))
    return normalise(rows.select(F.col("pos").cast("int"), "src", F.element_at("m", F.col("src")).alias("dst")))


def from_pairs(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Inline dictionary (list of source/target pairs, in order)."""
    return spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(pairs)], DICT_SCHEMA)


def normalise(d: DataFrame) -> DataFrame:
    """Same keys collapse as a JSON object does: first position, last value."""
    return (d.groupBy("src")
             .agg(F.min("pos").alias("pos"), F.max_by("dst", "pos").alias("dst"))
             .select(F.col("pos").cast("int"), "src", "dst"))


def write_json_dictionary(d: DataFrame, path: str) -> None:
    """Dictionary -> one JSON object file, keys in ``pos`` order (dictionary-sized)."""
    obj = d.agg(F.to_json(F.map_from_entries(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "src", "dst"))),
                    lambda x: F.struct(x["src"], x["dst"])))).alias("value"))
    obj.coalesce(1).write.mode("overwrite").text(path)
