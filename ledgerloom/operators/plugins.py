"""Plug points for models: one extractor per document, engines by name, batches of tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Extractor(Protocol):
    """Fields of one document, from its words in order and their boxes."""

    def predict(self, words: list[str], boxes: list[list[float]]) -> dict[str, str | None]: ...


#: Makes an extractor; called once in each task that needs it.
Factory = Callable[[], Extractor]


def extracted(docs: DataFrame, registry: dict[str, Factory], model: str, key: str = "doc_id") -> DataFrame:
    """(key, field, value) by the registered model; a name that isn't registered gives no rows.

    docs: a row per document with arrays `words` and `boxes`, so no shuffle is
    needed and a task holds a batch of documents at a time.
    """
    factory = registry.get(model)
    schema = f"{key} {dict(docs.dtypes)[key]}, field string, value string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = factory() if factory else None
        for batch in batches:
            rows = []
            if extractor:
                for doc, words, boxes in zip(batch[key], batch["words"], batch["boxes"], strict=True):
                    found = extractor.predict([] if words is None else list(words), [] if boxes is None else [list(b) for b in boxes])
                    rows += [(doc, field, value) for field, value in found.items()]
            yield pd.DataFrame(rows, columns=[key, "field", "value"])

    return docs.select(key, "words", "boxes").mapInPandas(run, schema)


def encoded(rows: DataFrame, tokenizer: Callable[[], Callable[[str], list[int]]], words: str = "words", key: str = "id", length: int = 512) -> DataFrame:
    """(key, token_ids, word_ids): the tokens of each row's words, one word after another, cut at `length`."""
    schema = f"{key} {dict(rows.dtypes)[key]}, token_ids array<int>, word_ids array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer()
        for batch in batches:
            made = []
            for doc, texts in zip(batch[key], batch[words], strict=True):
                pairs = [(t, n) for n, w in enumerate([] if texts is None else texts) for t in encode(w)][:length]
                made.append((doc, [t for t, _ in pairs], [n for _, n in pairs]))
            yield pd.DataFrame(made, columns=[key, "token_ids", "word_ids"])

    return rows.select(key, words).mapInPandas(run, schema)


def transformed_images(files: DataFrame, make: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """Image contents through any image function, made once in each task; one that fails leaves the content as it was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        change = make()

        def one(content: bytes) -> bytes:
            try:
                return change(content)
            except (ValueError, OSError):
                return content

        for batch in batches:
            batch["content"] = batch["content"].map(one, na_action="ignore")
            yield batch

    return files.mapInPandas(run, files.schema)
