"""Language identification by compression (operator 10).

Each language has a raw-content zstandard dictionary of its training texts. A text is encoded block by block with every
dictionary; the language with the fewest bytes wins. The score is the share of bytes saved against the runner-up, put on
a scale of 0 to 1; a text whose margin is narrow is rejected.

Training reads at most `train_docs` labelled documents of each language, chosen by a hash of doc_id, and the first bytes of
each, in equal shares of `dictionary_bytes` (what short ones leave goes to the others). These bounds are parameters, and a
language's dictionary does not grow with the corpus. More than `most_languages` languages are an error.

Null text, or text without a letter, is `und` with score 0 and rejected; so is everything if nothing is labelled. Ties go
to the first language in order, with score 0. Rows with equal doc_id are judged one by one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tidy

TRAIN_DOCS, DICTIONARY_BYTES, MOST_LANGUAGES = 120, 48 << 10, 256
#: Bytes encoded at a time, the level, and the shortest match; chosen by accuracy on fold 3 after learning from 0 and 1.
BLOCK, LEVEL, SHORTEST_MATCH = 4 << 10, 3, 5
_PLAIN = re.compile("[A-Za-z]")
#: Texts that save less than this share against the runner-up are rejected; chosen on fold 3, too.
MARGIN = 0.006


def has_letter(text: str) -> bool:
    """Whether a text has a character of Unicode category L."""
    return _PLAIN.search(text) is not None or any(map(str.isalpha, text))


def fold_of(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, most_languages: int = MOST_LANGUAGES) -> dict[str, bytes]:
    """Dictionaries by language from documents (doc_id, text, lang) with a language; the caller leaves out held-out rows."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if (n := len(known.select("lang").distinct().limit(most_languages + 1).collect())) > most_languages:
        raise ValueError(f"{n} languages or more; most_languages is {most_languages}")
    # A row is chosen by hashes alone: texts move only once it is known which, and only their first bytes.
    pick = F.struct(F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"))
    order = W.partitionBy("lang").orderBy("_pick")
    chosen = known.select("lang", pick.alias("_pick")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= train_docs).groupBy("lang", "_pick").agg(F.min("_n").alias("_n"))
    texts = known.select("lang", pick.alias("_pick"), F.substring("text", 1, dictionary_bytes).alias("text"))
    rows = texts.join(F.broadcast(chosen), ["lang", "_pick"]).select("lang", "_n", "text").distinct().collect()
    own: dict[str, list] = {}
    for r in rows:
        own.setdefault(r["lang"], []).append((r["_n"], r["text"].encode()))
    return {lang: data for lang, of in sorted(own.items()) if len(data := dictionary([t for _, t in sorted(of)], dictionary_bytes)) >= 8}


def dictionary(texts: list[bytes], most: int) -> bytes:
    """The beginnings of texts in equal shares of `most` bytes, the first text last (where matches are cheapest)."""
    share = {}
    left = most
    for n, k in enumerate(sorted(range(len(texts)), key=lambda k: (len(texts[k]), k))):
        share[k] = min(len(texts[k]) + 1, left // (len(texts) - n))
        left -= share[k]
    return b"".join((texts[k] + b"\n")[: share[k]] for k in reversed(range(len(texts))))


def _judge(dictionaries: dict[str, bytes], margin: float, only_accepted: bool = False):
    langs = sorted(dictionaries)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packers = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(dictionaries[lang]), min_match=SHORTEST_MATCH, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

        def judge(text: str | None) -> tuple[str, float, bool]:
            if text is None or not packers or not has_letter(text):
                return "und", 0.0, False
            raw = text.encode()
            blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
            sizes = [sum(len(p.compress(b)) for b in blocks) for p in packers]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min((s for k, s in enumerate(sizes) if k != best), default=len(raw) + 16)
            saved = min(1.0, max(0.0, 1.0 - sizes[best] / second))
            return langs[best], saved, saved >= margin and saved > 0

        for batch in batches:
            found = [judge(text) for text in batch.column("text").to_pylist()]
            if only_accepted:
                yield batch.filter(pa.array([f[2] for f in found], pa.bool_()))
                continue
            names, scores, taken = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(taken, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, accepted for documents (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_judge(dictionaries, margin), "doc_id long, lang_pred string, score double, accepted boolean")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the folds other than 2 and judge every document: doc_id, held_out, lang_pred, score, accepted."""
    held_out = fold_of(F.col("doc_id")) == 2
    dictionaries = train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return identify(docs, dictionaries).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is recognised, with their own columns; rejected ones go."""
    held_out = fold_of(F.col("doc_id")) == 2
    dictionaries = train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return docs.mapInArrow(_judge(dictionaries, MARGIN, only_accepted=True), docs.schema)
