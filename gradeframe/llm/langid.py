"""Language ID by compression.

Each language has a zstandard dictionary of raw content: sample text of that
language. A text is compressed with each dictionary, block by block, and the
language whose dictionary gives the fewest bytes is chosen. A text whose best
size is not clearly smaller than the second is rejected.

Cases: NULL texts and texts without a letter are ``und`` with score 0 and
rejected. With equal sizes the language with more training rows (then the
smaller name) is chosen; such a text is rejected. With one learned language
every text with a letter gets it with score 1, with none all are ``und``. Rows
with a NULL text or language train nothing. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeframe.llm.common import trimmed

UND = "und"
_RESULT = "lang_pred string, score double, rejected boolean"

# Everything that is ASCII but no letter separates words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """Languages, most frequent first, with the sample text of each."""

    langs: tuple[str, ...]
    samples: tuple[bytes, ...]
    level: int = 5
    block_bytes: int = 4096
    min_margin: float = 0.01


def normalised(text: str) -> bytes:
    """Lower-cased words without ASCII signs and digits, one space between them."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def _most_bytes(sizes: list[int], room: int) -> int:
    """The length that pieces of these sizes, in rising order, are cut to so that all fit."""
    for at, size in enumerate(sizes):
        share = max(0, room) // (len(sizes) - at)
        if size > share:
            return share
        room -= size
    return sizes[-1]


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, docs_per_lang: int = 256,
    chars_per_doc: int = 1024, bytes_per_lang: int = 131_072, seed: int = 0, **settings,
) -> LanguageModel:
    """Learn from rows with text and language.

    The sample is bounded: per language, of ``docs_per_lang`` different texts
    (those with the smallest seeded hashes) ``chars_per_doc`` characters from a
    seeded place, and ``bytes_per_lang`` in all; where these are too few, the
    longest pieces are cut to one length, so that every text of the sample is in.
    Only this sample comes to the driver. Copies of a text count once, however many there are.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit(seed)).alias("h"))
    counted = rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("lang").orderBy("h")
    picks = counted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= docs_per_lang)
    # At most docs_per_lang rows of a language, whatever the input.
    spare = F.greatest(F.length("text") - chars_per_doc + 1, F.lit(1))
    start = F.pmod(F.xxhash64("h", F.lit(seed)), spare).cast("int") + 1
    texts = rows.join(F.broadcast(picks.select("lang", "h")), ["lang", "h"]) \
        .groupBy("lang", "h").agg(F.first(F.substring("text", start, F.lit(chars_per_doc))).alias("text")).collect()
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    samples: dict[str, list[bytes]] = {}
    for r in sorted(texts, key=lambda r: r.h):
        if piece := normalised(r.text):
            samples.setdefault(r.lang, []).append(piece)
    for lang, pieces in samples.items():
        most = _most_bytes(sorted(map(len, pieces)), bytes_per_lang - len(pieces) + 1)
        samples[lang] = [piece[:most] for piece in pieces]
    langs = sorted(samples, key=lambda lang: (-totals[lang], lang))
    return LanguageModel(
        tuple(langs), tuple(b" ".join(samples[lang])[:bytes_per_lang] for lang in langs), **settings)


class _Sizer:
    """Compressed size of a text with each language's dictionary."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.compressors = []
        for sample in model.samples:
            data = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=model.level)
            self.compressors.append(zstandard.ZstdCompressor(
                level=model.level, dict_data=data, write_content_size=False, write_checksum=False,
                write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        step = self.model.block_bytes
        if len(text) <= step:
            return [len(c.compress(text)) for c in self.compressors]
        blocks = [text[i:i + step] for i in range(0, len(text), step)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.compressors or not any(map(str.isalpha, text)):
            return UND, 0.0, True
        sizes = self.sizes(normalised(text))
        if len(sizes) == 1:
            return self.model.langs[0], 1.0, False
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.model.langs[best], margin, margin < self.model.min_margin


def language_column(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred, score (how much smaller the best size is than the second) and rejected."""

    @F.arrow_udf(_RESULT)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizer = _Sizer(model)
        for part in texts:
            langs, scores, rejected = [], [], []
            for text in part:
                lang, score, narrow = sizer.predict(text.as_py())
                langs.append(lang)
                scores.append(score)
                rejected.append(narrow)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["lang_pred", "score", "rejected"])
        trimmed()

    return predict(text)


def is_held_out(doc_id: Column) -> Column:
    """Documents that train nothing: a quarter, by checksum of the id. NULL ids train nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred, score and rejected of each row, under its id."""
    found = docs.select(F.col(id_col), language_column(F.col(text_col), model).alias("_found"))
    return found.select(id_col, "_found.*")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is clear, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    found = docs.toDF(*names).withColumn("found", language_column(F.col(text), model))
    return found.where(~F.col("found.rejected")).select(*names).toDF(*docs.columns)
