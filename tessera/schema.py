"""Schemas and fixed values of the index tables."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = 3

# Content states.
STATUSES = ["extracted", "empty_pdf", "unsupported_format", "metadata_only", "too_big", "error", "no_text_type"]
#: States whose result may be taken over for an unchanged file.
REUSABLE = ["extracted", "empty_pdf", "too_big"]

# Extension groups, by extractor.
EXTRACTORS = {
    "pdftotext": ["pdf"],
    "ooxml-word": ["docx", "docm", "dotx"],
    "ooxml-excel": ["xlsx", "xlsm", "xltx"],
    "odt": ["odt"],
    "text": ["txt", "md", "csv"],
    "html": ["htm", "html"],
}
UNSUPPORTED = ["doc", "xls", "ppt", "rtf", "msg"]

# Limits in bytes unless named otherwise.
KIB, MIB = 1 << 10, 1 << 20
MAX_TEXT = 500 * KIB
SOURCE_LIMITS = {"text": 8 * MIB, "html": 8 * MIB, "ooxml-word": 256 * MIB, "ooxml-excel": 256 * MIB, "odt": 256 * MIB, "pdftotext": 512 * MIB}

_S, _L, _I = StringType(), LongType(), IntegerType()


def _table(**columns) -> StructType:
    return StructType([StructField(k, t[0] if isinstance(t, tuple) else t, not isinstance(t, tuple)) for k, t in columns.items()])


FILES = _table(
    relpath=(_S,), relpath_nfc=(_S,), filename=(_S,), filename_nfc=(_S,), area=(_S,), ext=(_S,), size_bytes=(_L,), mtime=(_L,), mtime_ns=(_L,), ctime_ns=(_L,), st_dev=(_S,), st_ino=(_S,),
    source_hash=_S, path_year=_I, name_meta=_S, metadata_only=(_I,), content_present=(_I,), content_status=(_S,),
)
CONTENT = _table(relpath=(_S,), text=(_S,), extractor=(_S,), source_sig=_S)
#: The columns of a search hit, in order.
HIT_COLUMNS = ["relpath", "filename", "area", "ext", "size_bytes", "mtime", "path_year", "name_meta", "metadata_only"]
