"""Finite checks: prefix codes by group, and their bounds."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def huffman(symbols: DataFrame, key: str) -> DataFrame:
    """A Huffman code for each group of ``symbols`` (key, symbol, weight): key, symbol, weight, code. Equal
    weights are merged in order of symbols; a group of one symbol has the code 0. A group is an alphabet, not a corpus."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol", kind="stable").reset_index(drop=True)
        codes = {i: "" for i in pdf.index}
        heap = [(w, i, [i]) for i, w in enumerate(pdf["weight"])]
        heapq.heapify(heap)
        if len(heap) == 1:
            codes[0] = "0"
        while len(heap) > 1:
            (w0, p0, low), (w1, _, high) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, members in (("0", low), ("1", high)):
                for i in members:
                    codes[i] = bit + codes[i]
            heapq.heappush(heap, (w0 + w1, p0, low + high))
        return pdf.assign(code=pdf.index.map(codes))

    kind = dict(symbols.dtypes)
    return symbols.select(key, "symbol", "weight").groupBy(key).applyInPandas(run, f"{key} {kind[key]}, symbol {kind['symbol']}, weight double, code string")


def code_lengths(coded: DataFrame, key: str) -> DataFrame:
    """Entropy and average code length of each group; a code without waste lies less than one bit above."""
    p = F.col("weight") / F.sum("weight").over(W.partitionBy(key))
    return coded.withColumn("p", p).groupBy(key).agg(F.round(F.sum(-F.col("p") * F.log2("p")), 9).alias("entropy"), F.round(F.sum(F.col("p") * F.length("code")), 9).alias("average_length"))
