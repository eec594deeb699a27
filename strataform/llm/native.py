"""Java beside this file, run over the partitions of a DataFrame: compiled on the driver by Janino, which is part of
every Spark (its generated code is compiled by it), and sent to executors as a jar. No compiler has to be installed."""

from __future__ import annotations

import pkgutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_COMPILED: dict[tuple[str, str], object] = {}


def compiled(spark: SparkSession, source: str):
    """The class loader of a source file's classes, once an application; executors get them in a jar."""
    context = spark.sparkContext
    key = context.applicationId, source
    if key not in _COMPILED:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data(__package__, source).decode())
        classes = compiler.getBytecodes()
        jar = Path(tempfile.mkdtemp(prefix="strataform-")) / f"{Path(source).stem}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name in list(classes):
                z.writestr(f"{name.replace('.', '/')}.class", bytes(classes[name]))
        context._jsc.addJar(str(jar))
        _COMPILED[key] = compiler.getClassLoader()
    return _COMPILED[key]


def over_partitions(df: DataFrame, source: str, name: str, mode: int, sent: dict[str, bytes], schema: str) -> DataFrame:
    """Rows that the class ``name`` makes of each partition; ``sent`` is broadcast to it by name."""
    spark = df.sparkSession
    jvm = spark._jvm
    made = compiled(spark, source).loadClass(name).getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
    held = jvm.java.util.HashMap()
    for k, v in sent.items():
        held.put(k, v)
    made.set(mode, spark.sparkContext._jsc.broadcast(held))
    kind = spark._jsparkSession.parseDataType(StructType.fromDDL(schema).json())
    return DataFrame(df._jdf.mapPartitions(made, jvm.org.apache.spark.sql.Encoders.row(kind)), spark)
