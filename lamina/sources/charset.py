"""Charset labels and decoding of small text files.

The label is a vote over byte tokens. The tokens are one regular language, so the counting is a
single pass of the regex engine over Arrow batches; everything around it is columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

C = F.col

# Labels in order of preference when votes tie, with the codec of each.
VOTED = [("UTF-8", "utf8"), ("EUC-JP", "euc"), ("Shift_JIS", "sjis"), ("ISO-2022-JP", "iso")]
CODECS = {"EUC-JP": "euc_jp", "Shift_JIS": "cp932", "ISO-2022-JP": "iso2022_jp"}

# A probe that fails keeps the lead byte it consumed, so later probes look at the next byte.
# Possessive groups state exactly that. A lead byte counts only when enough bytes follow.
_MORE = rb"(?=[\x00-\xff])"
_MORE2 = rb"(?=[\x00-\xff]{2})"
_U = rb"(?:[\xc2-\xdf]" + _MORE + rb"|[\xe0-\xef]" + _MORE2 + rb")?+"
_E = _U + rb"(?:\x8e" + _MORE + rb"|[\xa1-\xfe]" + _MORE + rb")?+"
_S = _E + rb"(?:[\x81-\x9f\xe0-\xef]" + _MORE + rb")?+"
TOKENS = re.compile(
    rb"[\x07-\x0e\x20-\x7f]+"
    rb"|(?P<nul>\x00)"
    rb"|(?P<utf8>[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2})"
    rb"|(?P<euc>" + _U + rb"(?:\x8e[\xa1-\xdf]|[\xa1-\xfe]{2}))"
    rb"|(?P<sjis>" + _E + rb"(?:[\xa1-\xdf]|[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]))"
    rb"|(?P<iso>" + _S + rb"(?:\x1b\$[@BD]|\x1b\([BIJ]))"
    rb"|(?P<odd>" + _S + rb"(?:\x1b" + _MORE2 + rb"(?:[$(])?+)?+[\x00-\xff])"
)


def charset_of(content: bytes) -> str:
    """Label of one byte string by marks, then by votes."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    if content[:3] == b"\xef\xbb\xbf":
        return "UTF-8"
    if content[:5] == b"%PDF-":
        return "Binary"
    votes = Counter(m.lastgroup for m in TOKENS.finditer(content))
    if votes["nul"] or votes["odd"] * 2 > len(content):
        return "Binary"
    label, group = max(VOTED, key=lambda v: votes[v[1]])
    return label if votes[group] else "ASCII"


def decode_as(content: bytes, label: str) -> str:
    if label == "UTF-16":
        order = "le" if content[:2] == b"\xff\xfe" else "be"
        body = content[2:] if content[:2] in (b"\xff\xfe", b"\xfe\xff") else content
        return body[: len(body) // 2 * 2].decode("utf-16-" + order, "replace")
    if label == "UTF-8" and content[:3] == b"\xef\xbb\xbf":
        content = content[3:]
    return content.decode(CODECS.get(label, "utf-8"), "replace")


def decode_texts(files: DataFrame, column: str = "content") -> DataFrame:
    """Adds ``charset`` and ``text``; whole files, Arrow batch by batch."""
    schema = StructType(
        [*files.schema.fields, StructField("charset", StringType()), StructField("text", StringType())]
    )

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = [bytes(b) for b in batch[column]]
            labels = [charset_of(b) for b in content]
            yield batch.assign(charset=labels, text=[decode_as(b, s) for b, s in zip(content, labels)])

    return files.mapInPandas(label, schema)


def charset_census(files: DataFrame, column: str = "content") -> DataFrame:
    """(charset, files)."""
    return decode_texts(files.select(column), column).groupBy("charset").agg(F.count("*").alias("files"))


def doc_charset(layers: DataFrame) -> DataFrame:
    """Adds ``charset`` and ``name``: legacy names decoded with one charset per document.

    ``layers``: doc_id, seq_id, sort_path, unicode_name, legacy_name (BINARY). The charset is
    read off all legacy names of the document in tree order, which the format bounds to 255
    bytes for each of at most 32,767 layers. It is used where only a legacy name exists.
    """
    joined = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("sort_path", F.hex("legacy_name").alias("h")))), lambda e: e["h"]
        ),
        "",
    )
    names = layers.groupBy("doc_id").agg(F.unhex(joined).alias("content"))
    labels = decode_texts(names).select("doc_id", "charset")
    rows = layers.join(labels, "doc_id")
    schema = StructType([*rows.schema.fields, StructField("name", StringType())])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [
                u if u or not b else bytes(b).decode(CODECS.get(s, "utf-8"), "replace")
                for u, b, s in zip(batch["unicode_name"], batch["legacy_name"], batch["charset"])
            ]
            yield batch.assign(name=names)

    return rows.mapInPandas(decode, schema)
