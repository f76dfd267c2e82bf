"""Column functions over parsed messages and over plain columns."""

from .accessors import *  # noqa: F403
from .addresses import *  # noqa: F403
from .dates import *  # noqa: F403
from .text import *  # noqa: F403


def register(spark) -> None:
    """Make the text and decoding functions known to SQL, under their own names."""
    from . import text

    for name in ("html_to_text", "html_entity_decode", "thread_name_of", "trim_trailing_fwd", "quoted_printable_decode", "percent_decode"):
        spark.udf.register(f"mail_{name}", getattr(text, name))
    spark.udf.register("mail_base64_decode", text._base64_decode)
