"""Quality rules from tokeniser fertility: how well public vocabularies fit a text.

For each document and vocabulary: characters per token, share of tokens that
fall back to bytes, and entropy of the token distribution. A document is
rejected if a measure leaves the band of its main script and language. The bands
are fitted to the corpus: fences around the middle half of the documents that
pass the base rule, inside wide limits that hold for any corpus. Scripts whose clean
texts fall back to bytes in one vocabulary are judged by the vocabulary that fits
better: its byte tokens per character. Words are tokenised
on their own (each distinct word of a slice once), so counts don't depend on
white space. One narrow pass measures,
a small aggregate fits the bands, a second pass over the measures decides.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .tables import written

TOKENIZERS = "/opt/tokenizers"
VOCABULARIES = {"piece": "piece_bpe_32k.model", "bpe": "byte_bpe_50k.tiktoken"}
#: Bytes of text that are measured at once; a slice's arrays take tens of times that.
SLICE_BYTES = 1 << 20
#: Words whose tokens a worker remembers; then it begins anew.
REMEMBERED = 400_000
#: Words that a vocabulary encodes at once, as lists of Python numbers.
ENCODED = 20_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

#: By script: least and most characters per token, most byte-fallback share, least entropy as a share of the
#: log2 of the number of tokens or of EVEN, the smaller (documents of 50 tokens and more).
EVEN = 2048
BANDS = {
    "latin": (1.2, 8.0, 0.12, 0.45),
    "greek": (0.5, 6.0, 0.60, 0.30),
    "cyrillic": (0.7, 7.0, 0.40, 0.35),
    "hebrew": (0.4, 6.0, 0.80, 0.25),
    "arabic": (0.4, 6.0, 0.80, 0.25),
    "indic": (0.2, 5.0, 1.00, 0.20),
    "han": (0.2, 3.0, 1.00, 0.30),
    "hangul": (0.2, 3.0, 1.00, 0.25),
    "symbol": (0.2, 8.0, 0.80, 0.35),
    "other": (0.2, 8.0, 1.00, 0.20),
}
#: Most byte tokens per character, in the vocabulary with the fewest; a character that it lacks takes 2 to 4. "symbol"
#: are pictures, private-use and replacement characters. Of the scripts in "other" the vocabularies lack some (Odia, Lao):
#: clean text of these takes 3, as junk does, so that only characters of four bytes are too many there.
FALLBACKS = {"indic": 2.3, "han": 2.0, "hangul": 1.8, "symbol": 0.3, "other": 3.05}
SCRIPTS = list(BANDS)


def _script_table() -> np.ndarray:
    """Lead byte to script; other bytes to none."""
    table = np.full(256, -1)
    ranges = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [*range(0xD0, 0xD5)], "hebrew": [0xD6, 0xD7], "arabic": [*range(0xD8, 0xDC)], "han": [*range(0xE3, 0xEA)], "hangul": [*range(0xEA, 0xEE)], "symbol": [0xEE, 0xF3, 0xF4], "other": [0xE1]}
    for name, leads in ranges.items():
        table[leads] = SCRIPTS.index(name)
    return table


#: Lead bytes whose script hangs on the second byte: (first, last, script).
SECOND = {
    0xE0: [(0xA0, 0xA1, "other"), (0xA2, 0xA3, "arabic"), (0xA4, 0xA7, "indic"), (0xA8, 0xA9, "other"), (0xAA, 0xAB, "indic"), (0xAC, 0xAD, "other"), (0xAE, 0xB9, "indic"), (0xBA, 0xBF, "other")],
    0xE2: [(0x86, 0xAF, "symbol"), (0xB0, 0xB7, "other"), (0xBA, 0xBF, "han")],
    0xEF: [(0x80, 0xA3, "symbol"), (0xA4, 0xAB, "han"), (0xAD, 0xB7, "arabic"), (0xB9, 0xBB, "arabic"), (0xBF, 0xBF, "symbol")],
    0xF0: [(0x90, 0x9C, "other"), (0x9D, 0x9D, "symbol"), (0x9E, 0x9E, "other"), (0x9F, 0x9F, "symbol"), (0xA0, 0xBF, "han")],
}


def second_byte_letters(buf: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """By document and script: the characters whose script hangs on their second byte."""
    n = len(doc_starts) - 1
    out = np.zeros((n, len(SCRIPTS)), np.int64)
    for lead, ranges in SECOND.items():
        at = np.flatnonzero(buf == lead)
        owner, second = X.owners(at, doc_starts), buf[at + 1]
        for first, last, name in ranges:
            out[:, SCRIPTS.index(name)] += np.bincount(owner[(second >= first) & (second <= last)], minlength=n)
    return out


class Vocabulary:
    """Token ids of single words, and which ids stand for a byte or a part of a character."""

    def __init__(self, file: str) -> None:
        if file.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=file)
            self.encode = lambda words: model.encode(words, num_threads=1)
            self.byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        else:
            import tiktoken

            with open(file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            model = tiktoken.Encoding(os.path.basename(file), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [model.encode_ordinary(" " + w) for w in words]
            self.byte = np.zeros(max(ranks.values()) + 1, bool)
            self.byte[[i for b, i in ranks.items() if len(b) == 1 and b[0] >= 0x80]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # ascending
        self.row = np.empty(0, np.int32)
        self.tokens = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)

    def rows(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """The row of each word, its hashes ascending and none twice; text_of gives the texts of words by their place in the list."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, np.uint64(0))[at] == hashes
        known &= at < len(self.hashes)
        new = np.flatnonzero(~known)
        if len(new) and len(self.hashes) + len(new) > REMEMBERED:
            self.forget()
            new, at = np.arange(len(hashes)), np.zeros(len(hashes), np.int64)
        if len(new):
            n = len(self.hashes)
            for i in range(0, len(new), ENCODED):
                self.remember(self.encode(text_of(new[i : i + ENCODED].tolist())))
            self.row = np.insert(self.row, at[new], np.arange(n, n + len(new), dtype=np.int32))
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
        return self.row[np.searchsorted(self.hashes, hashes)]

    def remember(self, ids: list[list[int]]) -> None:
        """Adds a row of tokens for each of the lists."""
        held = int(self.ends[-1])
        ends = held + np.cumsum([len(x) for x in ids])
        if ends[-1] > len(self.tokens):
            self.tokens = np.concatenate([self.tokens[:held], np.empty(max(held, int(ends[-1]) - held), np.int32)])
        self.tokens[held : ends[-1]] = np.fromiter((t for x in ids for t in x), np.int32)
        self.ends = np.append(self.ends, ends)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(file: str) -> Vocabulary:
    if file not in _vocabularies:
        _vocabularies[file] = Vocabulary(file)
    return _vocabularies[file]


def token_measures(model: Vocabulary, distinct: np.ndarray, inverse: np.ndarray, doc_of: np.ndarray, n_docs: int, text_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: number of tokens, of byte tokens, entropy in bits."""
    row = model.rows(distinct, text_of)[inverse]
    begin, size = model.ends[row], model.ends[row + 1] - model.ends[row]
    total = int(size.sum())
    tokens = model.tokens[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)]
    owner = np.repeat(doc_of, size)
    n = np.bincount(owner, minlength=n_docs)
    fallback = np.bincount(owner, weights=model.byte[tokens], minlength=n_docs).astype(np.int64)
    key = np.sort((owner.astype(np.uint64) << np.uint64(32)) | tokens.astype(np.uint64))
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if total else np.empty(0, np.int64)
    count = np.diff(np.append(edge, total)).astype(float)
    sums = np.bincount((key[edge] >> np.uint64(32)).astype(np.int64), weights=count * np.log2(np.maximum(count, 1)), minlength=n_docs)
    m = np.maximum(n, 1)
    return n, fallback, np.maximum(0, np.log2(m) - sums / m)


def repeated_window_words(hashes: np.ndarray, doc_of: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """By document: words inside a run of `width` words that the document has twice or more."""
    keys = X.window_hashes(hashes, width)
    if not len(keys):
        return np.zeros(n_docs, np.int64)
    whole = np.flatnonzero(doc_of[: len(keys)] == doc_of[width - 1 :])
    keys = X.mix(keys[whole] ^ X.mix(doc_of[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = whole[np.union1d(order[1:][same], order[:-1][same])]
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return np.bincount(doc_of[np.cumsum(edge)[:-1] > 0], minlength=n_docs)


def repeated_lines(buf: np.ndarray, doc_starts: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """By document: lines with a word that equal an earlier line of it."""
    not_newline = np.arange(256) != 10
    a, b = X.word_spans(buf, not_newline)
    has_word = np.searchsorted(word_starts, b) > np.searchsorted(word_starts, a)
    a, b = a[has_word], b[has_word]
    owner = X.owners(a, doc_starts)
    keys = X.mix(X.span_hashes(buf, a, b) ^ X.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    n = len(doc_starts) - 1
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def measures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", language: str | None = None, tokenizers: str = TOKENIZERS, vocabularies: dict[str, str] | None = None, bands: dict[str, tuple[float, float, float, float]] | None = None, fallbacks: dict[str, float] | None = None) -> DataFrame:
    """One row per input row: the base counts, the script, each vocabulary's measures, base_failed, whether the wide limits hold, and the language.

    The script is that of most letters (the first in the order of BANDS on a
    tie; "other" without letters). Measures of a text without words are null,
    and such a text fails on its length. Empty and null texts count as no words.
    Other columns are ignored.
    """
    files = {k: f"{tokenizers}/{v}" for k, v in (vocabularies or VOCABULARIES).items()}
    band = np.array([{**BANDS, **(bands or {})}[s] for s in SCRIPTS])
    fallback_limit = np.array([{**FALLBACKS, **(fallbacks or {})}.get(s, np.inf) for s in SCRIPTS])
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("script", T.StringType())]
    for k in files:
        fields += [T.StructField(f"{k}_tokens", T.LongType()), *(T.StructField(f"{k}_{m}", T.DoubleType()) for m in ("chars_per_token", "byte_share", "entropy", "evenness"))]
    schema = T.StructType([*fields, T.StructField("base_failed", T.BooleanType()), T.StructField("within", T.BooleanType()), T.StructField("language", T.StringType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scripts = _script_table()
        space = np.flatnonzero(~X.NON_SPACE)
        for part, texts in X.text_chunks(batches, "__text", SLICE_BYTES):
            n_docs = len(texts)
            buf, starts = X.joined(texts)
            a, b = X.word_spans(buf, X.NON_SPACE)
            doc_of = X.owners(a, starts)
            hashes = X.span_hashes(buf, a, b)
            n_words = np.bincount(doc_of, minlength=n_docs)
            kinds = np.stack([np.bincount(buf[s:e], minlength=256) for s, e in zip(starts[:-1], starts[1:] - 1, strict=True)]) if n_docs else np.zeros((0, 256), np.int64)
            points = kinds.sum(1) - kinds[:, 0x80:0xC0].sum(1)
            chars = points - kinds[:, space].sum(1)
            letters = np.stack([kinds[:, scripts == s].sum(1) for s in range(len(SCRIPTS))], 1) + second_byte_letters(buf, starts)
            script = np.where(letters.any(1), letters.argmax(1), len(SCRIPTS) - 1)
            repeats = repeated_window_words(hashes, doc_of, n_docs)
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (n_words, chars, kinds[:, list(SYMBOLS)].sum(1), repeated_lines(buf, starts, a), repeats)), pa.array([SCRIPTS[s] for s in script])]
            distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            whole, spans = buf.tobytes(), list(zip(a[at].tolist(), b[at].tolist(), strict=True))
            within, fewest = np.ones(n_docs, bool), np.full(n_docs, np.inf)
            least, most, fallback_most, spread = band[script].T
            for file in files.values():
                text_of = lambda which: [whole[x:y].decode(errors="replace") for x, y in (spans[i] for i in which)]  # noqa: B023, E731
                n, fallback, entropy = token_measures(vocabulary(file), distinct, inverse, doc_of, n_docs, text_of)
                none, m = n == 0, np.maximum(n, 1)
                per_token, share = chars / m, fallback / m
                even = entropy / np.maximum(1, np.log2(np.minimum(m, EVEN)))
                columns += [pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=hidden) for x, hidden in ((per_token, none), (share, none), (entropy, none), (even, n < 50)))]
                fewest = np.minimum(fewest, fallback / np.maximum(chars, 1))
                within &= (per_token >= least) & (per_token <= most) & (share <= fallback_most) & ((n < 50) | (entropy >= spread * np.log2(np.minimum(m, EVEN))))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(within & (fewest <= fallback_limit[script])), part.column(2)], names=schema.names)

    return docs.select(F.col(id_col), F.col(text).alias("__text"), (F.col(language).cast("string") if language else F.lit(None).cast("string")).alias("__language")).mapInArrow(measure, schema)


#: A fence lies FENCE times the middle half's width beyond it, or the measure's least slack (a share of the middle for
#: characters per token, else as it is). A script and language has fences of its own from LEAST_ROWS documents, and a
#: thousandth of all, on; else its script has, from as many; else only the wide limits hold.
FENCE = 2.0
SLACK = {"chars_per_token": 0.10, "byte_share": 0.02, "evenness": 0.05}
#: Texts of fewer tokens have wider fences, by the square root of what they lack.
STEADY_TOKENS = 200
LEAST_ROWS = 100
MOST_BANDS = 1000


def fences(measured: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """(by, fences): [lower quarter, upper quarter, width beyond them] of each measure, for the groups that are large enough; at most MOST_BANDS rows."""
    good = measured.where("NOT base_failed")
    least = max(LEAST_ROWS, good.count() // MOST_BANDS)
    quarters = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in measures]
    rows = good.groupBy(*by).agg(F.count("*").alias("n"), *quarters).where(F.col("n") >= least)

    def fence(m: str) -> Column:
        q, slack = F.col(m), F.lit(SLACK[m.partition("_")[2]])
        if m.endswith("chars_per_token"):
            slack = slack * q[1]
        width = F.greatest(FENCE * (q[2] - q[0]), slack)
        return F.array(q[0], q[2], width).alias(m)

    return rows.select(*by, F.struct(*map(fence, measures)).alias("fences"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", language: str | None = "lang", **options) -> DataFrame:
    """One row per input row: what `measures` gives, `band_failed`, and `kept`, which neither the base rule nor a band fails.

    `language` names a column whose values part the bands of a script (None, or
    no such column: by script alone; null languages are a group of their own). A
    measure that is null passes. Repeated rows are judged alike; texts that are
    null or empty fail the base rule; a very long text is measured whole, by one
    task; an empty table gives no rows.
    """
    language = language if language in docs.columns else None
    measured = measures(docs, id_col, text, language=language, **options)
    columns = [c for c in measured.columns if c not in ("within", "language") and not c.endswith("_evenness")]
    measured = written(measured)
    names = [c for c in measured.columns if c.partition("_")[2] in SLACK]
    own = fences(measured, ["script", "language"], names).withColumnsRenamed({"script": "s1", "language": "l1", "fences": "own"})
    any_ = fences(measured, ["script"], names).withColumnsRenamed({"script": "s2", "fences": "any"})
    rows = measured.join(F.broadcast(own), (F.col("script") == F.col("s1")) & F.col("language").eqNullSafe(F.col("l1")), "left").join(F.broadcast(any_), F.col("script") == F.col("s2"), "left")
    rows = rows.withColumn("band", F.coalesce("own", "any"))
    outside = ~F.col("within")
    for m in names:
        tokens = F.col(m.partition("_")[0] + "_tokens")
        low, high, width = (F.col(f"band.{m}")[k] for k in range(3))
        width = width * F.sqrt(F.greatest(F.lit(1.0), STEADY_TOKENS / F.greatest(tokens, F.lit(1))))
        outside = outside | F.coalesce((F.col(m) < low - width) | (F.col(m) > high + width), F.lit(False))
    return rows.select(*columns, outside.alias("band_failed"), (~F.col("base_failed") & ~outside).alias("kept"))


BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: The base counts, which hang on no vocabulary.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(range(len(l))) AS i, unnest(l) AS word FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o
        || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS run FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM g WHERE run IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k) AS n_repeat FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY 1),
n AS (SELECT r, count(*) AS n_words FROM w GROUP BY 1),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
      FROM d JOIN l USING (r) LEFT JOIN n USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a
"""
