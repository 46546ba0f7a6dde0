"""Formats: routing by name, magic bytes, and archives that may be opened."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.kinds import kind

#: The kinds and the extensions that lead to them.
EXTENSIONS = {
    "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx xls xlsm ods", "csv": "csv tsv", "html": "html htm", "text": "txt md markdown log",
    "image": "png jpg jpeg webp bmp tif tiff gif", "audio": "mp3 wav m4a flac ogg",
}
KIND_OF = {e: k for k, names in EXTENSIONS.items() for e in names.split()}

#: Limits on what an upload's archive may hold.
MAX_ENTRIES, MAX_UNCOMPRESSED, MAX_RATIO = 4096, 1 << 30, 100


def extension(path: Column) -> Column:
    """The extension of a path's last part, in lower case; empty without one (a dot that a name begins with makes none)."""
    return F.regexp_extract(F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)), r"(?s).\.([^.]+)$", 1)


def format_of(path: Column) -> Column:
    """The kind of a file by its extension alone, or null."""
    out = F.lit(None).cast("string")
    for k, names in EXTENSIONS.items():
        out = F.when(extension(path).isin(*names.split()), k).otherwise(out)
    return out


def magic(content: Column) -> Column:
    """The kind that a file's first bytes tell, or null."""
    head = F.hex(F.substring(content, 1, 16))
    at = lambda h: head.startswith(h)
    return (
        F.when(at("25504446"), "pdf").when(at("504B0304") | at("504B0506"), "zip").when(at("D0CF11E0A1B11AE1"), "ole").when(at("89504E470D0A1A0A"), "png").when(at("FFD8FF"), "jpeg")
        .when(at("474946383761") | at("474946383961"), "gif").when(at("424D"), "bmp").when(at("49492A00") | at("4D4D002A"), "tiff").when(at("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(at("52494646") & (F.substring(head, 17, 8) == "57415645"), "wav").when(at("4F676753"), "ogg").when(at("664C6143"), "flac").when(at("494433") | head.rlike("^FF(FB|F3|F2)"), "mp3")
        .when(F.substring(head, 9, 8) == "66747970", "m4a")
        .when(F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1")).rlike(r"^(\u00ef\u00bb\u00bf)?\s*(<!doctype html|<html|<head|<body)"), "html")
        .when(~F.decode(F.substring(content, 1, 512), "ISO-8859-1").rlike(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]"), "text")
    )


_MAY = {"zip": "docx pptx xlsx xlsm ods zip", "ole": "xls", "jpeg": "jpg jpeg", "tiff": "tif tiff", "text": "txt md markdown log csv tsv html htm", "html": "html htm txt md", "m4a": "m4a"}


def spoofed(path: Column, content: Column) -> Column:
    """Whether a file's bytes are of another kind than its name says; null if the bytes tell nothing."""
    m, ext = magic(content), extension(path)
    fits = F.lit(False)
    for k in ("pdf", "zip", "ole", "png", "jpeg", "gif", "bmp", "tiff", "webp", "wav", "ogg", "flac", "mp3", "m4a", "html", "text"):
        fits = fits | ((m == k) & ext.isin(*_MAY.get(k, k).split()))
    return F.when(m.isNotNull(), ~fits)


def archive_reason(content: bytes) -> str | None:
    """Why an archive may not be opened, or None."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = z.infolist()
    except zipfile.BadZipFile:
        return "corrupt"
    if len(entries) > MAX_ENTRIES:
        return "too_many_entries"
    for e in entries:
        parts = e.filename.replace("\\", "/").split("/")
        if e.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
            return "path_traversal"
        if e.filename.lower().endswith((".zip", ".7z", ".rar", ".tar", ".gz", ".jar")):
            return "nested_archive"
        if e.flag_bits & 1:
            return "encrypted"
        if e.file_size > MAX_RATIO * max(e.compress_size, 1) and e.file_size > 1 << 20:
            return "ratio"
    return "too_large" if sum(e.file_size for e in entries) > MAX_UNCOMPRESSED else None


def zip_family(content: bytes) -> str:
    """docx, pptx, xlsx or ods by the parts of an archive, else zip."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            mime = z.read("mimetype")[:64].decode("ascii", "ignore") if "mimetype" in names else ""
    except zipfile.BadZipFile:
        return "zip"
    for part, family in (("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx")):
        if part in names:
            return family
    return "ods" if "opendocument.spreadsheet" in mime else "zip"


@F.pandas_udf(kind("struct<family:string,reason:string>"))
def archive(content: pd.Series) -> pd.DataFrame:
    """Family of an archive, and why it may not be opened."""
    return pd.DataFrame({"family": [zip_family(bytes(c)) for c in content], "reason": [archive_reason(bytes(c)) for c in content]})
