"""Test items that leaked into a corpus, by one Aho-Corasick scan of the texts.

Texts and items are normalised to lower-case ASCII words. Any ``min_words``
consecutive words of an item hold one whole block of ``(min_words + 1) // 2``
words cut at a multiple of that length, so the blocks of all items are the
automaton's patterns. Each text is scanned once; a hit is extended
word by word to the longest common passage, which makes the result exact, and
the passage's words are mapped back to offsets in the original text.

The items are written once to the shared folder, and every Python worker builds the automaton
from there once. So they pass neither through the driver nor through the plan, and the corpus is scanned once
whatever their size. The bound is a worker's memory: about 60 bytes per byte of item text (measured at 2 and 7 MB of items).
"""

from __future__ import annotations

import re
import sys
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesoflow.session import ensure_checkpoint_dir

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[A-Za-z0-9]+")


def words_of(text: str) -> list[str]:
    """Longest runs of ASCII letters and digits, in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("ascii").split()


def _automaton(folder: str, min_words: int):
    """The automaton over the items' blocks, and the items' words; kept by the worker for its next tasks."""
    import ahocorasick
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    kept = vars(ahocorasick).setdefault("_kept", {})
    if (folder, min_words) not in kept:
        kept.clear()
        files, path = FileSystem.from_uri(re.sub("^file:/+", "/", folder))
        items = pq.read_table(path, filesystem=files)
        block = (min_words + 1) // 2
        texts = {i: [sys.intern(w) for w in words_of(t)] for i, t in zip(items.column("item_id").to_pylist(), items.column("item_text").to_pylist(), strict=True)}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, w in texts.items():
            for k in range(0, len(w) - block + 1, block):
                places[" " + " ".join(w[k : k + block]) + " "].append((item, k))
        automaton = ahocorasick.Automaton()
        for pattern, at in places.items():
            automaton.add_word(pattern, (len(pattern), at))
        if places:
            automaton.make_automaton()
        kept[folder, min_words] = (automaton if places else None, texts)
    return kept[folder, min_words]


def _scan(folder: str, min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, texts = _automaton(folder, min_words)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if automaton is None or not text.is_valid:
                    continue
                said = text.as_buffer().to_pybytes()
                flat = " " + " ".join(said.translate(_FOLD).decode("ascii").split()) + " "
                hits = list(automaton.iter(flat))
                if not hits:
                    continue
                own = flat.split()
                starts, at = [], 1
                for w in own:
                    starts.append(at)
                    at += len(w) + 1
                best: dict[int, tuple[int, int, int]] = {}
                done: dict[tuple[int, int], int] = {}
                for end, (length, where) in hits:
                    i = bisect_right(starts, end - length + 2) - 1
                    for item, k in where:
                        # one passage per alignment of item and text is extended once
                        if done.get((item, i - k), -1) >= i:
                            continue
                        w = texts[item]
                        a = b = 0
                        while a < min(i, k) and own[i - a - 1] == w[k - a - 1]:
                            a += 1
                        while b < min(len(own) - i, len(w) - k) and own[i + b] == w[k + b]:
                            b += 1
                        done[item, i - k] = i + b - 1
                        if a + b >= min_words and a + b > best.get(item, (0, 0, 0))[0]:
                            best[item] = (a + b, i - a, k - a)
                if best:
                    spans = [m.span() for m in _WORD.finditer(said.decode("utf-8", "replace"))]
                    for item, (n, i, k) in best.items():
                        rows.append((doc, item, n, k, n == len(texts[item]), spans[i][0], spans[i + n - 1][1]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "n_words", "item_word", "whole", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = 20) -> DataFrame:
    """``doc_id, item_id, n_words, item_word, whole, start, end``: each document with each item of which it holds ``min_words`` consecutive words.

    One row per pair, with the longest passage (the first of equals): its words, the
    item's word at which it starts, whether it is the whole item, and its
    place in the original text (code points, end exclusive). NULL texts and
    items, and items of under ``min_words`` words, match nothing; of several texts under one item_id
    the largest counts. Documents with equal ids give a row each. Empty tables give no rows.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_text").cast("string").alias("item_text")).where("item_id is not null and item_text is not null")
    folder = f"{ensure_checkpoint_dir(documents.sparkSession)}/items-{uuid.uuid4().hex}"
    own.groupBy("item_id").agg(F.max("item_text").alias("item_text")).write.parquet(folder)
    return docs.mapInArrow(_scan(folder, min_words), "doc_id bigint, item_id bigint, n_words int, item_word int, whole boolean, start bigint, end bigint")


def item_report(leaks: DataFrame) -> DataFrame:
    """``item_id, n_docs, longest, whole_docs``: what leaked, per item."""
    return leaks.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"), F.count_distinct(F.when(F.col("whole"), F.col("doc_id"))).alias("whole_docs"))
