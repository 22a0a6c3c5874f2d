"""Counts of word n-grams (B10) from sorted windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.functions.text import ngrams

#: Windows of a partition, about 70 bytes each.
PART_WINDOWS = 1_000_000


def windows(tokens: str, hi: int) -> Column:
    """The ``hi``-grams of a token list and its shorter endings: one window a word, which every n-gram there begins."""
    size = F.size(tokens)
    ends = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(hi - 1))),
                       lambda n: F.array_join(F.slice(tokens, size - n + 1, n), " "))
    ends = F.when((size >= 1) & F.lit(hi > 1), ends).otherwise(F.array())
    return F.concat(F.transform(ngrams(tokens, hi, hi), lambda g: g["gram"]), ends)


def _words(column: pa.Array, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) of the windows' words, ``hi`` columns; -1 where a window has ended."""
    lists = pc.split_pattern(column, " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    place = (np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    codes, lengths = np.full((len(sizes), hi), -1), np.zeros((len(sizes), hi), np.int64)
    codes[place] = coded.indices.to_numpy()
    lengths[place] = pc.utf8_length(coded.dictionary).to_numpy()[codes[place]]
    return codes, lengths


def ngram_counts(df: DataFrame, tokens: str, hi: int = 10) -> DataFrame:
    """(n, n_grams, n_distinct, total_chars) of the word n-grams, n = 1..hi, of token lists of letters.

    Each word sends one window of ``hi`` words, sorted over ranges, in place of ``hi`` n-grams: equal n-grams begin
    neighbouring windows, so a window adds a distinct n-gram for every n beyond the words it shares with the one
    before it.  The driver sees the first and the last window of each range.
    """
    spark = df.sparkSession
    n_windows = df.agg(F.sum(F.greatest(F.size(tokens), F.lit(0)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_windows // PART_WINDOWS))
    rows = df.select(F.explode(windows(tokens, hi)).alias("w")).repartitionByRange(parts, "w").sortWithinPartitions("w")

    def kernel(batches):
        first = last = None
        total = np.zeros((3, hi), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                column = batch.column(0).slice(at, 10_000)
                if first is None:
                    first = column[0].as_py()
                codes, lengths = _words(pa.concat_arrays([pa.array([last or ""], column.type), column]), hi)
                there, same = codes[1:] >= 0, codes[1:] == codes[:-1]
                shared = np.logical_and.accumulate(same & there, axis=1)
                if last is None:
                    shared[0] = False
                chars = np.cumsum(lengths[1:], axis=1) + np.arange(hi)
                total += [there.sum(0), (there & ~shared).sum(0), (chars * there).sum(0)]
                last = column[-1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "total": [total.ravel().tolist()]})

    found = sorted(rows.mapInArrow(kernel, "first string, last string, total array<long>").collect(),
                   key=lambda r: r["first"].encode())
    total = sum((np.array(r["total"]).reshape(3, hi) for r in found), np.zeros((3, hi), np.int64))
    for a, b in zip(found, found[1:]):
        x, y = a["last"].split(" "), b["first"].split(" ")
        for n in range(1, min(len(x), len(y)) + 1):
            total[1, n - 1] -= x[:n] == y[:n]
    out = [(n + 1, *(int(v) for v in total[:, n])) for n in range(hi) if total[0, n]]
    return spark.createDataFrame(out, "n long, n_grams long, n_distinct long, total_chars long")
