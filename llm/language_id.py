"""Language identification by compression: a text is encoded against one raw-content zstandard dictionary for each
language, and the language whose dictionary makes it smallest wins; a narrow margin marks the answer as rejected.

The dictionaries are fitted on a bounded sample: training documents are cut into excerpts of EXCERPT characters, and for
each language those of smallest hash, by doc_id and place in the text, are taken up to DICTIONARY_BYTES. What reaches
the driver is at most that sample.
Predictions encode whole texts.

Defined cases: a text that is null or has no letter gets `und`, score 0. Ties go to the language that sorts first.
With no training text at all, every answer is `und`.
"""

from __future__ import annotations

import re

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unsigned_crc

#: The bound of the fitted sample, for each language.
DICTIONARY_BYTES = 110 << 10
EXCERPT = 1000
LEVEL = 6
#: Saved bytes, as a share of the smallest encoding, under which the answer counts as rejected.
MARGIN = 0.01
_OTHERS = re.compile(r"[\W\d_]+")
#: Texts are compared by blocks of so many bytes: a window as long as the dictionary would learn the text itself.
BLOCK = 1 << 14


def letters(text: str) -> bytes:
    """Small letters and single spaces: what is left of a text once case, digits and marks no longer tell."""
    return _OTHERS.sub(" ", text.lower()).strip().encode()


def dictionaries(docs: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """docs: text, lang, doc_id. At most size bytes of text a language come to the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", "text")
    last = F.greatest(F.ceil(F.char_length("text") / EXCERPT).cast("int") - 1, F.lit(0))
    held = known.groupBy("lang").agg(F.sum(F.octet_length("text") + last + 1).alias("held"))
    # about four times the sample of each language stays; the smallest hashes of these make the sample
    unit = lambda h: h / F.lit(2.0**64) + 0.5
    h = lambda k: F.xxhash64("doc_id", k)
    places = F.filter(F.sequence(F.lit(0), last), lambda k: unit(h(k)) < F.lit(4.0 * size) / F.col("held"))
    own = known.join(F.broadcast(held), "lang").select("lang", "doc_id", F.explode(F.transform(places, lambda k: F.struct(h(k).alias("h"), F.substring("text", k * EXCERPT + 1, F.lit(EXCERPT)).alias("text")))).alias("e"))
    near = own.select("lang", "e.h", "e.text").withColumn("n", F.octet_length("text") + 1)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1))
    got = near.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size).select("lang", "h", "text").collect()
    out: dict[str, bytes] = {}
    for row in sorted(got, key=lambda r: (r["lang"], r["h"], r["text"])):
        out[row["lang"]] = (out.get(row["lang"], b"") + letters(row["text"]) + b" ")[:size]
    return out


def _compressors(content: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in sorted(content.items()):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and rejected (margin too narrow) for each row of docs."""

    def run(batches):
        each = _compressors(content)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                raw = letters(text) if isinstance(text, str) else b""
                if not each or not raw:
                    rows.append(("und", 0.0, True))
                    continue
                blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
                sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in each]
                order = sorted(range(len(each)), key=lambda k: (sizes[k], k))
                best = sizes[order[0]]
                gap = (sizes[order[1]] - best) / best if len(each) > 1 else 1.0
                rows.append((each[order[0]][0], gap / (gap + 0.05), gap < margin))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **dict(zip(("lang_pred", "score", "rejected"), map(list, zip(*rows, strict=True)), strict=True))} if rows else {"doc_id": [], "lang_pred": [], "score": [], "rejected": []})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = unsigned_crc("doc_id") % 4 == 2
    content = dictionaries(docs.where(~out))
    return identify(docs, content).withColumn("held_out", F.coalesce(out, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "rejected")
