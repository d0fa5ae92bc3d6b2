"""The run log of a batch: its replies are read and parsed once."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.sources import landing


def test_replies_are_read_once(spark, criteria):
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [("1", '{"rubro": "uno"}'), ("2", '{"rubro": "dos"}'), ("2", '{"idTesis": "9"}'), ("3", "no"), (None, "{}")]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("requested_id", "payload")])
    replies = spark.createDataFrame(rows, schema).mapInPandas(through, schema)
    log = landing.run_log(replies, criteria([{"id_tesis": "1"}, {"id_tesis": "7"}]))
    assert [tuple(r) for r in log.select("nuevas", "errores", "total").collect()] == [(3, 1, 5)]
    assert log.where(F.col("estado").startswith("Completado con 1 error")).count() == 1
    assert read.value == len(rows)
