"""Phrase collocations: phrases of 2 and 3 words whose parts meet more often than chance, by language.

A sketch, then automata. The sketch has 2^36 cells in 4096 ranges. A task hashes
the phrases of 1 to 3 words of its texts, counts them by cell and sends each
range its cells and counts; a range is summed in one array of fixed size, whose
counters stop at 255. A cell's count is never less than any of its phrases', so
phrases of cells below the least count are out. Cells that reach it are put in a
bitmap of bounded size that all tasks hold.

A second scan then takes, for each shard of a language (a slice of some 4 MB of
text), the shard's phrases whose cells are in the bitmap, compiles them to an
Aho-Corasick automaton and counts all their matches, overlapping ones included.
Words are guarded by blanks and pieces by line ends, so a match is of whole words
of one piece. Spark sums the shards' counts, and the exact counts decide. Cells
or bits that are shared only let phrases through that the sums then drop: a
corpus that overfills the sketch gets the same rows at the price of more shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from .lookup import passes, sieve
from .tables import written

MOST_WORDS = 3
LEAST = 10
#: The rows of the answer for each language.
TOP = 2000
SCALE = 1_000_000
#: The sketch: bits that name a range, and bits that name a cell inside.
RANGE_BITS, CELL_BITS = 12, 24
#: Full shards' worth of text that a task keeps back at most, until one language's is full.
WAITING = 4
#: Distinct cells that a task holds before it sends them on.
HELD = 1 << 21
#: Parts that a language's ranking is dealt to before the last step.
PARTS = 64

#: Upper-case A-Z to lower-case, what ends a piece to a line end, a tab to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
WORD = np.array([c not in b" \n" for c in range(256)])


class Shard:
    """The words of some texts of one language: hashes of the phrases of k words, where they lie in `text`."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        whole = (b"\n" + b"\n".join(texts) + b"\n").translate(FOLD)
        buf = np.frombuffer(whole, np.uint8)
        a, b = X.word_spans(buf, WORD)
        piece = np.cumsum(buf == 10)[a] if len(a) else np.empty(0, np.int64)
        # words of a piece one blank apart, pieces by a line end between blanks: " a b \n c "
        sizes = b - a
        new = np.append(False, piece[1:] != piece[:-1]) if len(a) else np.empty(0, bool)
        at = 1 + np.cumsum(sizes + 1 + 2 * new) - sizes - 1 if len(a) else a
        self.text = np.full(int(at[-1] + sizes[-1] + 1) if len(a) else 1, 32, np.uint8)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.text[np.repeat(at, sizes) + inside] = buf[np.repeat(a, sizes) + inside]
        self.text[at[new] - 2] = 10
        self.first, self.last, self.piece = at, at + sizes, piece
        self.words = X.span_hashes(buf, a, b)
        # languages that share this only share cells
        self.salt = X.mix(np.frombuffer(lang.encode().ljust(8, b"\0")[:8], np.uint64))

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all phrases of k words, and the word at which each begins."""
        at = np.flatnonzero(self.piece[: len(self.words) - k + 1] == self.piece[k - 1 :]) if len(self.words) >= k else np.empty(0, np.int64)
        return X.mix(X.window_hashes(self.words, k)[at] ^ self.salt), at


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """The texts of (lang, text) apart by language: a shard is full at some 4 MB, or when a task holds too much of all languages."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for part, texts in X.text_chunks(batches):
        for name, text in zip(part.column(0).to_pylist(), texts, strict=True):
            held.setdefault(name, []).append(text)
            size[name] = size.get(name, 0) + len(text) + 1
        while size and (max(size.values()) >= X.CHUNK_BYTES or sum(size.values()) > WAITING * X.CHUNK_BYTES):
            name = max(size, key=size.get)
            del size[name]
            yield name, Shard(name, held.pop(name))
    for name, texts in held.items():
        yield name, Shard(name, texts)


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, with their counts up to 255."""
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.empty(0, np.int64)
    return cells[first], np.minimum(np.add.reduceat(counts, first), 255) if len(first) else counts


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, cells, counts): three bytes for each cell of the range, one for its count."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        cells, counts = _summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
        ranges = (cells >> np.uint64(CELL_BITS)).astype(np.int64)
        edge = np.searchsorted(ranges, np.arange((1 << RANGE_BITS) + 1)).astype(np.int32)
        used = np.flatnonzero(np.diff(edge))
        low = np.ascontiguousarray((cells & np.uint64((1 << CELL_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
        offsets = np.append(edge[used], edge[-1]).astype(np.int32)
        blobs = [pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets * width), pa.py_buffer(data)]) for width, data in ((3, low), (1, counts.astype(np.uint8)))]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *blobs], names=["range", "cells", "counts"])

    for _, shard in _shards(batches):
        for k in range(1, MOST_WORDS + 1):
            found, counts = np.unique(shard.hashes(k)[0] >> np.uint64(64 - RANGE_BITS - CELL_BITS), return_counts=True)
            held.append((found, counts))
        if sum(len(c) for c, _ in held) > HELD:
            held = [_summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))]
            if len(held[0][0]) > HELD // 2:
                yield sent()
                held = []
    if sum(len(c) for c, _ in held):
        yield sent()


class Range:
    """The counters of one range, up to 255 each; what a small range takes to read and clear hangs on its cells alone."""

    def __init__(self) -> None:
        self.sums, self.seen, self.n = np.zeros(1 << CELL_BITS, np.uint8), [], 0

    def add(self, cells: bytes, counts: bytes) -> None:
        three = np.frombuffer(cells, np.uint8).reshape(-1, 3).astype(np.uint32)
        where = three[:, 0] | (three[:, 1] << 8) | (three[:, 2] << 16)
        self.sums[where] = np.minimum(self.sums[where].astype(np.uint16) + np.frombuffer(counts, np.uint8), 255)
        self.n += len(where)
        self.seen = [*self.seen, where] if self.n <= len(self.sums) >> 2 else []

    def taken(self, least: int) -> np.ndarray:
        """The cells that reach `least`; then all counters are 0 again."""
        seen = np.unique(np.concatenate(self.seen)) if self.seen else slice(None)
        reached = np.flatnonzero(self.sums[seen] >= min(least, 255))
        out = seen[reached] if self.seen else reached
        self.sums[seen] = 0
        self.seen, self.n = [], 0
        return out.astype(np.uint64)


def _reached(least: int):
    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key) of each cell that reaches the least count, from rows sorted by range."""
        sums, now = Range(), None

        def out() -> pa.RecordBatch:
            cells = sums.taken(least) | (np.uint64(now) << np.uint64(CELL_BITS))
            return pa.RecordBatch.from_arrays([pa.array((cells << np.uint64(64 - RANGE_BITS - CELL_BITS)).view(np.int64))], names=["key"])

        for batch in batches:
            for at, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if now is not None and at != now:
                    yield out()
                now = at
                sums.add(cells.as_buffer(), counts.as_buffer())
        if now is not None:
            yield out()

    return reached


def _automaton(shard: Shard, bitmap: np.ndarray) -> tuple[ahocorasick.Automaton | None, list[bytes], list[int]]:
    """The shard's phrases that the sketch lets through, compiled with a blank on each side; their texts and words."""
    made, phrases, sizes = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], []
    whole = shard.text.tobytes()
    for k in range(1, MOST_WORDS + 1):
        hashes, at = shard.hashes(k)
        there = passes(bitmap, hashes & ~np.uint64((1 << (64 - RANGE_BITS - CELL_BITS)) - 1))
        _, first = np.unique(hashes[there], return_index=True)
        at = at[there][first]
        for i, j in zip(shard.first[at].tolist(), shard.last[at + k - 1].tolist(), strict=True):
            made.add_word(whole[i - 1 : j + 1].decode("utf-8", "surrogateescape"), len(phrases))
            phrases.append(whole[i:j])
            sizes.append(k)
    if phrases:
        made.make_automaton()
    return made if phrases else None, phrases, sizes


def _counted(bitmap: Broadcast):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, k, f) for each shard; k = 0 counts its words."""
        for lang, shard in _shards(batches):
            automaton, phrases, sizes = _automaton(shard, bitmap.value)
            f = np.empty(0, np.int64)
            if automaton is not None:
                text = shard.text.tobytes().decode("utf-8", "surrogateescape")
                f = np.bincount(np.fromiter((p for _, p in automaton.iter(text)), np.int64), minlength=len(phrases))
            texts = pa.array([*phrases, b""], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(texts), pa.string()), texts, pa.array([*sizes, 0], pa.int32()), pa.array(np.append(f, len(shard.words)))], names=["lang", "phrase", "k", "f"]
            )

    return counted


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, f): each phrase of k = 1 to 3 words with f >= `least`, and for k = 0 the language's words in all.

    Null languages are `und`. Null, empty and wordless texts have no words; a
    language of such texts has f = 0 for k = 0. Repeated rows count each time,
    ties don't matter, texts of any length are one slice at most. Other columns
    are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blobs = rows.mapInArrow(_sketched, "range int, cells binary, counts binary")
    cells = written(blobs.repartition("range").sortWithinPartitions("range").mapInArrow(_reached(least), "key long"))
    bitmap = sieve(cells)
    found = rows.mapInArrow(_counted(bitmap), "lang string, phrase binary, k int, f long")
    out = written(found.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0)))
    bitmap.unpersist()
    return out.withColumn("phrase", F.col("phrase").cast("string"))


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of each phrase of 2 and 3 words, by its lowest-scoring cut; numbers exact."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("cut"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("right"))
    phrases = counts.where("k > 1").withColumnRenamed("f", "a")
    cuts = phrases.select("lang", "phrase", "k", "a", F.explode(F.when(F.col("k") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("c"))
    cuts = cuts.select("lang", "phrase", "k", "a", "c.*")
    parts = counts.where("k > 0")
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    # a <= l and a <= r, so no score passes the scale; scale * a * a has 38 digits at most up to a = 1e16
    score = F.expr("(scaled * squared) div product").cast("long")
    cuts = cuts.withColumns({"scaled": F.lit(scale).cast("decimal(10,0)"), "squared": (exact("a") * exact("a")).cast("decimal(28,0)"), "product": exact("l") * exact("r")}).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def without_parts(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """The phrases without those inside a longer one that has at least `percent` of their count."""
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))
    longer = phrases.where("k = 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language, with their rank: first by parts of a language, then among what the parts keep."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part: Column = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for by in (["lang", part], ["lang"]):
        phrases = phrases.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return phrases.withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, percent: int = 50, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language.

    a: the phrase's occurrences, l and r those of the two sides of the cut that
    scores least (ties: the earliest), n the language's words, score
    floor(1000000 a a / (l r)). Phrases are of 2 and 3 words with a >= `least`;
    one inside a longer one with at least `percent` of its count is dropped. Ties
    in score and count go by the phrase's bytes. Rows without words add nothing;
    an empty table gives no rows.
    """
    found = ranked(without_parts(scored(phrase_counts(docs, text, lang, least)), percent), top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.k, u.phrase, u.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f * r.f) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:cut], ' ') AND l.k = cut
      JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[cut + 1:], ' ') AND r.k = u.k - cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM b LEFT JOIN m USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
"""
