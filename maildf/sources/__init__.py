"""Readers of mailboxes and loose messages."""

from .files import FilesDataSource, read_files
from .maildir import MaildirDataSource, maildir_flags, read_maildir, stream_maildir
from .mbox import MboxDataSource, read_eml, read_mbox, split_mbox

__all__ = ["FilesDataSource", "MaildirDataSource", "MboxDataSource", "maildir_flags", "read_eml", "read_files", "read_maildir", "read_mbox", "register", "split_mbox", "stream_maildir"]


def register(spark) -> None:
    """Make ``spark.read.format("mbox")`` and ``format("maildir")`` known."""
    spark.dataSource.register(MboxDataSource)
    spark.dataSource.register(MaildirDataSource)
