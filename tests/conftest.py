import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]")
        .appName("callscope-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="callscope-test-ckpt-", dir="/tmp")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


def statuses(spark, texts, schema):
    """Status of each text for a schema given as [(key, type), ...]."""
    from pyspark.sql import functions as F

    from callscope.functions import status as S

    keys = [k for k, _ in schema]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df = df.withColumn("keys", F.array(*[F.lit(k) for k in keys]).cast("array<string>"))
    pairs = []
    for k, t in schema:
        pairs += [F.lit(k), F.lit({"float": "number"}.get(t, t))]
    df = df.withColumn("types", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))
    out = S.add_status(df).select(
        "i", "status", S.accepted(F.col("text"), F.col("keys"), F.col("types")).alias("acc")
    ).orderBy("i").collect()
    return [r["status"] for r in out], [r["acc"] for r in out]
