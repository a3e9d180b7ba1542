"""Spark's SQL parser in the executors, where no session is: a Java function that the driver compiles and sends to them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_CLASS = "tributary.SqlDigest"
_NAME = "tributary_sql_digest"
_compiled: dict[str, object] = {}


def _function(spark: SparkSession):
    """The compiled function, once an application; Janino, with which Spark compiles its own code, needs no JDK."""
    context = spark.sparkContext
    if _compiled.get("application") != context.applicationId:
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
        compiler.cook(Path(__file__).with_name("SqlDigest.java").read_text())
        jar = Path(tempfile.mkdtemp(prefix="tributary-jar-")) / "tributary.jar"
        with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as out:
            for name, code in dict(compiler.getBytecodes()).items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        context._jsc.addJar(str(jar))
        _compiled.update(application=context.applicationId, function=compiler.getClassLoader().loadClass(_CLASS).newInstance())
    return _compiled["function"]


def digest(spark: SparkSession, text: str) -> Column:
    """JSON of what ``SqlLineage`` needs of the plan of the SQL in a column."""
    string = spark._jvm.org.apache.spark.sql.types.DataType.fromDDL("string")
    spark._jsparkSession.udf().register(_NAME, _function(spark), string)
    return F.call_function(_NAME, F.col(text))
