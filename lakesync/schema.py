"""Row types of the data model."""

from pyspark.sql import types as T

_s, _l = T.StringType(), T.LongType()
_row = lambda **fields: T.StructType([T.StructField(k, v) for k, v in fields.items()])

ENVELOPE = _row(seq=_l, t_us=_l, tenant_id=_s, op=_s, object_key=_s)
INTENT = _row(seq=_l, t_us=_l, tenant_id=_s, table_fqn=_s, partition_key=_s, partition_prefix=_s, kind=_s, proof=_s, object_key=_s)
EFFECTIVE = _row(tenant_id=_s, table_fqn=_s, partition_key=_s, partition_prefix=_s, kind=_s, proof_keys=T.ArrayType(_s))
RESULT = _row(tenant_id=_s, table_fqn=_s, partition_key=_s, kind=_s, status=_s, reason=_s, heads=_l, lists=_l, in_catalog_after=T.BooleanType())
CATALOG = _row(tenant_id=_s, table_fqn=_s, partition_key=_s, location=_s)
INVENTORY = _row(tenant_id=_s, object_key=_s, live=T.BooleanType())
MESSAGE = _row(partition=T.IntegerType(), offset=_l, key=_s, value=_s)
ROUTES = _row(table_root=_s, table_fqn=_s)
