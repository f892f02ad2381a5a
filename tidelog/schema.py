"""The log's constant schemas and codes. Schemas are never inferred."""

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("ts", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
    ]
)

#: How a record entered the log. A deletion is a record too.
PUT, DELETE, BATCH = "put", "delete", "batch"

HEADER = 20  # bytes of a record before its key: crc(4) ts(8) key size(4) value size(4)
INDEX_HEADER = 24  # bytes of an index entry before its key: ts(8) key size(4) value size(4) offset(8)
TOMBSTONE = -1  # value size that marks a deletion
MAX_FILE_SIZE = 256 << 20

#: Fixed values of the wire protocol.
OPCODES = {"put": 1, "get": 2, "delete": 3, "range": 4, "batch": 5, "compact": 6}
STATUS = {"ok": 0, "not_found": 1, "error": 2, "redirect": 3}
