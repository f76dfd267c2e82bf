"""The fixed Spark schema of parsed messages."""

from __future__ import annotations

from pyspark.sql import types as T

INTS = T.ArrayType(T.IntegerType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n.rstrip("_") if n != "for_" else n, t) for n, t in fields.items()])


S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()
DATE = _struct(year=I, month=I, day=I, hour=I, minute=I, second=I, tz_before_gmt=B, tz_hour=I, tz_minute=I)
ADDR = _struct(name=S, address=S)
ADDRESS = _struct(is_group=B, groups=T.ArrayType(_struct(name=S, addresses=T.ArrayType(ADDR))))
CONTENT_TYPE = _struct(c_type=S, c_subtype=S, attributes=T.ArrayType(_struct(name=S, value=S)))
HOST = _struct(name=S, ip=S)
RECEIVED = _struct(from_=HOST, from_ip=S, from_iprev=S, by=HOST, for_=S, with_=S, tls_version=S, tls_cipher=S, id=S, ident=S, helo=HOST, helo_cmd=S, via=S, date=DATE)
#: ``kind`` tells which other field is set: Text, TextList, Address, DateTime, ContentType, Received or Empty.
VALUE = _struct(kind=S, text=S, texts=T.ArrayType(S), address=ADDRESS, date=DATE, content_type=CONTENT_TYPE, received=RECEIVED)
HEADER = _struct(name=S, name_id=I, value=VALUE, offset_field=I, offset_start=I, offset_end=I)
#: ``msg_path`` lists the part ids from the root to the message that owns the part, [] for the root.
#: Offsets count in the outermost raw bytes, or (``offset_base`` = decoded) in those of the decoded message.
PART = _struct(msg_path=INTS, part_id=I, offset_base=S, headers=T.ArrayType(HEADER), is_encoding_problem=B, encoding=S, kind=S, text=S, bytes=T.BinaryType(), children=INTS, offset_header=I, offset_body=I, offset_end=I)
BODIES = _struct(msg_path=INTS, html_body=INTS, text_body=INTS, attachments=INTS)
#: Root parts come first, so a root part's position is its id; nested messages follow in order.
MESSAGE = _struct(messages=T.ArrayType(BODIES), parts=T.ArrayType(PART))
