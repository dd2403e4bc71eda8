"""Language identification by compression.

For each language a zstandard dictionary is made of raw text. A text is compressed, block by block, with
each of them; the language of the smallest sum wins, and the prediction is rejected where the margin to
the second is narrow. Case is folded on both sides.

Null and empty texts and texts without a letter (Unicode's categories L) are `und`, with score 0, and rejected. Ties of
sizes go to the language with more distinct training texts, then to the first by name. With no usable training row, as
of an empty table, every text is `und`. Repeated rows are judged alike, very long texts block by block to their end;
columns with other names are ignored, and kept by keep_identified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ready, table

#: The bounded sample: a dictionary is filled with whole distinct texts, drawn by a hash from all rows of its language,
#: until no other fits into so many bytes. Texts of more than TEXT_BYTES are not drawn; of a language that has no other
#: the start of the shortest is taken, DICTIONARY_BYTES at most.
DICTIONARY_BYTES, TEXT_BYTES = 112 << 10, 14 << 10
#: Bytes that are drawn for each that is wanted, so that chance hardly leaves a dictionary short.
DRAWN = 3
BLOCK = 8 << 10
LEVEL = 6
#: The least difference to the second size, as a share of it, and 1 - 1/e of the way to score 1.
NARROW, SOFT = 0.0015, 0.02
_LETTER = regex.compile(r"\p{L}")
_HASHES = 1 << 40


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, bytes]:
    """Raw-content dictionaries by language, the language with most distinct texts first, from rows with a non-null
    language and a letter in their text. The driver gets two numbers a language and DRAWN dictionaries of text."""
    usable = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    usable = usable.select("lang", "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"))
    # copies count once
    distinct = usable.select("lang", "h", "bytes").distinct()
    found = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.when(F.col("bytes") <= TEXT_BYTES, F.col("bytes"))).alias("bytes")).collect()
    if not found:
        return {}
    share = [(r.lang, int(min(1.0, DRAWN * DICTIONARY_BYTES / r.bytes) * _HASHES)) for r in found if r.bytes]
    drawn = rows.sparkSession.createDataFrame(share, "lang string, most long")
    sample = usable.where(F.col("bytes") <= TEXT_BYTES).join(F.broadcast(drawn), "lang").where(F.pmod(F.xxhash64("h"), F.lit(_HASHES)) < F.col("most"))
    texts = sample.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    if long := [r.lang for r in found if not r.bytes]:
        texts += usable.where(F.col("lang").isin(long)).groupBy("lang").agg(F.min_by(F.substring("text", 1, DICTIONARY_BYTES), F.struct("bytes", "h")).alias("text"), F.lit(0).alias("h")).collect()
    out: dict[str, bytes] = {r.lang: b"" for r in sorted(found, key=lambda r: (-r.texts, r.lang))}
    for row in sorted(texts, key=lambda r: r.h):
        raw = (row.text.lower().encode() + b"\n")[:DICTIONARY_BYTES]
        if not out[row.lang] or len(out[row.lang]) + len(raw) <= DICTIONARY_BYTES:
            out[row.lang] += raw
    return {k: v for k, v in out.items() if v}


class Classifier:
    """sizes() of one text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)  # in order of preference
        self.compressors = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 4:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        out = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        return out if len(out) > 1 else [*out, sum(len(self.plain.compress(b)) for b in blocks)]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        if not self.names or text is None or not _LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best, second = sizes[order[0]], sizes[order[1]]
        margin = max(0.0, (second - best) / second)
        return self.names[min(int(order[0]), len(self.names) - 1)], float(1 - 0.5 * np.exp(-margin / SOFT)), margin


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, `lang_pred`, `score` (0 to 1), `margin` and `rejected` (und, or narrow)."""
    ready(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches):
        c = Classifier(dictionaries)
        for batch in batches:
            out = [c.judge(t.as_py()) for t in batch.column(1)]
            names, scores, margins = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array([n == "und" or m < NARROW for n, m in zip(names, margins)], pa.bool_())], ["id", "lang_pred", "score", "margin", "rejected"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double, margin double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose language is not rejected."""
    ready(df.sparkSession)
    place = df.columns.index(text_col)

    def run(batches):
        c = Classifier(dictionaries)
        for batch in batches:
            found = (c.judge(t.as_py()) for t in batch.column(place))
            yield batch.filter(pa.array([name != "und" and margin >= NARROW for name, _, margin in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
