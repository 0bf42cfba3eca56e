"""Which ids a stream has passed on, as keyed state.

The state is one flag per id, in RocksDB, snapshots of which go to the stream's checkpoint. The
ids are dealt to buckets by hash, and a bucket's are the keys of one map: what Spark and
Python say to each other per key of the state is said per bucket, not per id. A
micro-batch looks up and enters its own ids only, whatever the stream has done
before, and a batch that is replayed after a failure starts from the state it
started from the first time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import MapType

from gradeframe.spec import column

cloudpickle.register_pickle_by_value(sys.modules["gradeframe"])

_KEY, _BUCKET = "_gf_key", "_gf_bucket"
# Many times the tasks of a stage. Part of a checkpoint: with another number its ids are not found again.
_BUCKETS = 8192
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstBatch(StatefulProcessor):
    """Passes on the rows of an id in the micro-batch that has it first, all of them; rows without an id always."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._passed = handle.getMapState("passed", "id string", "passed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Whether the bucket's ids of this micro-batch are new, each looked up once; their rows come in any order.
        new: dict[str, bool] = {}
        empty = not self._passed.exists()
        for row in rows:
            name = row[_KEY]
            if name is not None and name not in new:
                new[name] = empty or not self._passed.containsKey((name,))
                if new[name]:
                    self._passed.updateValue((name,), (True,))
            if name is None or new[name]:
                yield row

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def first_batch_of_each(items: DataFrame, id_col: str) -> DataFrame:
    """The rows of a stream whose id no earlier micro-batch had.

    Ids are compared as text. Rows without an id are dealt out by what else they
    hold, so that they do not meet in one task; they leave no state.
    """
    plain = [f.name for f in items.schema.fields if not isinstance(f.dataType, MapType)]
    key = column(id_col).cast("string")
    dealt = F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*[column(n) for n in plain]))
    keyed = items.withColumns({_KEY: key, _BUCKET: F.pmod(dealt, F.lit(_BUCKETS)).cast("int")})
    return keyed.groupBy(_BUCKET).transformWithState(_FirstBatch(), keyed.schema, "append", "None").drop(_KEY, _BUCKET)
