"""Quality rules from how a public vocabulary splits a text.

For each document: characters per token, the share of byte-fallback tokens and
the entropy of its tokens, beside plain counts of words, symbols, repeated lines
and repeated windows of words. Texts that fall outside the band of their language
(or script) are rejected: junk, encodings and foreign scripts take many tokens
per character or bytes, repetition has low entropy. Signs strewn over words leave
characters per token as they are, but few letters per token, many tokens per word
and many signs per word.

Words are tokenised one by one, each different word of a batch once: pieces of
the vocabulary do not reach across blanks.

Cases: NULL and empty texts have no words, no tokens and fail the base rules. A
text without letters gets the band of script "none". A language that is NULL or
has no band gets the band of the text's script. Bands are wide enough for short
texts; the entropy is measured against the most that so many tokens can
have and only for texts of ``entropy_tokens`` and more. Repeated rows are judged
alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm.common import SPACES, mix, parts, starts_of, trimmed, within, word_hashes
from gradeframe.llm.segmentation import default_model

_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 600_000  # bytes of text
_SYMBOLS = b"#*$%&|<>"

# First code point after each stretch, and the script of the stretch.
_SCRIPTS = (
    (0x0250, "latin"), (0x0370, "none"), (0x0400, "greek"), (0x0530, "cyrillic"), (0x0590, "armenian"), (0x0600, "hebrew"),
    (0x0780, "arabic"), (0x0900, "none"), (0x0E00, "indic"), (0x0E80, "thai"), (0x1100, "none"), (0x1200, "hangul"),
    (0x1E00, "none"), (0x1F00, "latin"), (0x2000, "greek"), (0x3040, "none"), (0x3100, "kana"), (0x3400, "none"),
    (0xA000, "han"), (0xAC00, "none"), (0xD7B0, "hangul"), (0xF900, "none"), (0xFB00, "han"), (0x20000, "none"), (0x32000, "han"),
)

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
          "n_byte_tokens long, entropy double, script string")


@dataclass(frozen=True)
class Band:
    """What a text of a script may measure."""

    chars_per_token: tuple[float, float] = (1.25, 12.0)
    byte_share: float = 0.25
    # Of the most entropy that so many tokens, or all of the vocabulary, can have.
    entropy_share: float = 0.35
    # Characters of words, less signs, per token.
    letters_per_token: float = 0.0
    tokens_per_word: float = float("inf")
    signs_per_word: float = 0.1


@dataclass(frozen=True)
class Fertility:
    model_path: str | None = None
    # By language, where ``band_col`` names a column of languages, and by script; others get ``default``.
    # The least letters lie between clean and sign-strewn texts of 20 words and more; clean short ones have up to 4.4 tokens a word.
    bands: Mapping[str, Band] = field(default_factory=lambda: {
        "en": Band(letters_per_token=1.5, tokens_per_word=5), "de": Band(letters_per_token=1.55, tokens_per_word=5),
        "fr": Band(letters_per_token=1.4, tokens_per_word=5), "es": Band(letters_per_token=1.45, tokens_per_word=5),
        "latin": Band(letters_per_token=1.25),
        "greek": Band((0.8, 12.0), 0.35), "cyrillic": Band((1.0, 12.0), 0.25),
        "han": Band((0.3, 6.0), 0.75), "kana": Band((0.3, 6.0), 0.6), "hangul": Band((0.3, 6.0), 0.75),
        "none": Band((0.5, 12.0), 0.5),
    })
    default: Band = Band((0.2, 12.0), 0.95)
    entropy_tokens: int = 64
    # Size of the vocabulary.
    vocabulary: int = 32_000
    repeat_words: int = 8
    least_words: int = 20
    most_repeat_percent: int = 30


def script_of(text: str) -> str:
    """The script that most letters of a text have; ties go to the first name."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letters = int(np.isin(points | 0x20, np.arange(97, 123, dtype=np.uint32)).sum())
    counts = {"latin": ascii_letters} if ascii_letters else {}
    other = points[points >= 0xAA]
    if len(other):
        edges = np.array([e for e, _ in _SCRIPTS], np.uint32)
        which = np.bincount(np.searchsorted(edges, other, side="right"), minlength=len(_SCRIPTS) + 1)
        for (_, name), n in zip(_SCRIPTS, which.tolist()):
            if n and name != "none":
                counts[name] = counts.get(name, 0) + n
    return min(counts, key=lambda s: (-counts[s], s)) if counts else "none"


def _repeats(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Per text the words that lie in a window of ``size`` words found twice or more in it."""
    with np.errstate(over="ignore"):
        window = hashes.copy()
        for step in range(1, size):
            if step < len(window):
                window[:-step] = window[:-step] * _FACTOR + hashes[step:]
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(within(counts) + size <= np.repeat(counts, counts))
    if not len(at):
        return np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        key = mix(window[at] + mix(text[at].astype(np.uint64) + _GAMMA))
    _, name, often = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[often[name] > 1]
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(text[covered], minlength=len(counts))


def _repeated_lines(data: bytes) -> int:
    seen, again = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    return again


def _tokens(model, words: list[bytes], hashes: np.ndarray, counts: np.ndarray, is_byte: np.ndarray):
    """Per text: tokens, byte tokens and entropy of the tokens in bits."""
    _, example, name = np.unique(hashes, return_index=True, return_inverse=True)
    pieces = model.encode([words[i].decode("utf-8", "replace") for i in example.tolist()], num_threads=1)
    sizes = np.array([len(p) for p in pieces], np.int64)
    flat = np.array([t for p in pieces for t in p], np.int64)
    first, each = starts_of(sizes)[:-1], sizes[name]
    token = flat[np.repeat(first[name], each) + within(each)]
    text = np.repeat(np.repeat(np.arange(len(counts)), counts), each)
    total = np.bincount(text, minlength=len(counts))
    spelt = np.bincount(text, weights=is_byte[token], minlength=len(counts)).astype(np.int64)
    pair, often = np.unique(text * len(is_byte) + token, return_counts=True)
    owner = pair // len(is_byte)
    share = often / total[owner]
    entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=len(counts))
    return total, spelt, entropy


def measured(text: Column, job: Fertility = Fertility()) -> Column:
    """Struct of ``FIELDS``."""

    @F.arrow_udf(FIELDS)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=job.model_path or default_model())
        is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for _, _, data in parts(batch, _CHUNK):
                lists = [d.split() for d in data]
                counts = np.array([len(w) for w in lists], np.int64)
                words = [w for part in lists for w in part]
                hashes = word_hashes(words)
                repeats = _repeats(hashes, counts, job.repeat_words)
                total, spelt, entropy = _tokens(model, words, hashes, counts, is_byte) if words else (
                    np.zeros((3, len(counts)), np.int64))
                for i, d in enumerate(data):
                    s = d.decode("utf-8", "replace")
                    row = (counts[i], len(s) - (len(d) - len(d.translate(None, SPACES))),
                           len(d) - len(d.translate(None, _SYMBOLS)), _repeated_lines(d), repeats[i],
                           total[i], spelt[i], float(entropy[i]), script_of(s))
                    for column, value in zip(columns, row):
                        column.append(value)
            names = [f.split()[0] for f in FIELDS.split(", ")]
            types = [pa.int64()] * 7 + [pa.float64(), pa.string()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        trimmed()

    return measure(text)


def _within_band(m: Column, band: Band, job: Fertility) -> Column:
    per_token = m["word_chars"] / m["n_tokens"]
    low, high = band.chars_per_token
    most = F.log2(F.least(m["n_tokens"], F.lit(job.vocabulary)).cast("double"))
    even = (m["n_tokens"] < job.entropy_tokens) | (m["entropy"] >= band.entropy_share * most)
    words = (m["word_chars"] - m["n_symbols"] >= band.letters_per_token * m["n_tokens"]) \
        & (m["n_tokens"] <= band.tokens_per_word * m["n_words"]) & (m["n_symbols"] <= band.signs_per_word * m["n_words"])
    return (per_token >= low) & (per_token <= high) & (m["n_byte_tokens"] <= band.byte_share * m["n_tokens"]) & even & words


def verdicts(
    docs: DataFrame, job: Fertility = Fertility(), id_col: str = "doc_id", text_col: str = "text", band_col: str | None = None,
) -> DataFrame:
    """id, the counts, the measures, base_failed and kept, one row per row."""
    m = F.col("m")
    fits = _within_band(m, job.default, job)
    for name in [m["script"], *([F.col("band")] if band_col else [])]:
        for key, band in job.bands.items():
            fits = F.when(name == key, _within_band(m, band, job)).otherwise(fits)
    rows = docs.select(F.col(id_col).alias("id"), measured(F.col(text_col), job).alias("m"),
                       *([F.col(band_col).alias("band")] if band_col else []))
    failed = (m["n_words"] < job.least_words) | (100 * m["n_repeat_words"] > job.most_repeat_percent * m["n_words"])
    return rows.withColumn("failed", failed).select(
        F.col("id").alias(id_col), "m.*", F.col("failed").alias("base_failed"),
        F.when(F.col("failed"), False).otherwise(F.coalesce(fits, F.lit(False))).alias("kept"))
