"""Filling fixed-capacity containers with texts: vector bin packing by the dot-product heuristic.

A container limits tokens, segments and loss-bearing tokens at once. It is filled by the item that fits and whose demand has the
greatest dot product with what is left of the container, until nothing fits. A text is divided only if it has more tokens than a
container; one that alone bears more loss than a container may is not divided but shares its container with no loss-bearing text.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@dataclass(frozen=True)
class Limits:
    """What a container holds at once. segments and loss are set so that they bind: instruction batches mix texts that are all
    loss-bearing with texts that are mostly prompt."""

    tokens: int = 2048
    segments: int = 32
    loss: int = 1792


def sizes(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, n_prompt): the tokens of each whole text and of its first line, the prompt, which bears no loss.

    A text of one line is all loss-bearing. Null ids or texts are left out, an empty text has no tokens; repeated rows are
    sized each, where the table lies: texts are not shuffled. tokenizer: a tokenizers JSON file that all executors can read; nothing
    is trained.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        lengths = lambda ts: [len(e.ids) for e in tok.encode_batch(ts, add_special_tokens=False)]
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                texts = part[text].tolist()
                heads = [t[: t.index("\n") + 1] if "\n" in t else "" for t in texts]
                total = np.array(lengths(texts), dtype=np.int64)
                head = np.array(lengths(heads), dtype=np.int64)
                yield pd.DataFrame({doc_id: part[doc_id].to_numpy(), "n_tokens": total, "n_prompt": np.minimum(head, total)})

    return docs.mapInPandas(count, f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, n_tokens bigint, n_prompt bigint")


def pieces(sized: DataFrame, doc_id: str, limits: Limits) -> DataFrame:
    """Texts as they are placed: (doc_id, piece, first_token, n_tokens, n_loss); only texts beyond a container have several pieces."""
    n = F.col("n_tokens")
    x = sized.select(doc_id, "n_tokens", "n_prompt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(n / limits.tokens)).cast("int") - 1)).alias("piece"))
    first = F.col("piece").cast("long") * limits.tokens
    end = F.least(n, first + limits.tokens)
    return x.select(doc_id, "piece", first.alias("first_token"), (end - first).alias("n_tokens"), (end - F.greatest(first, F.least(end, F.col("n_prompt")))).alias("n_loss"))


def fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """The container number of each item. An item of more loss than the limit opens a container, which then takes none that bears loss."""
    n = len(tokens)
    if n and tokens.max() > limits.tokens:
        raise ValueError("an item is larger than a container")
    out = np.full(n, -1, dtype=np.int64)
    order = np.lexsort((np.arange(n), -loss, -tokens))
    tk, ls = tokens[order].astype(np.int64), loss[order].astype(np.int64)
    number = 0
    while len(order):
        left_t, left_s, left_l = limits.tokens, limits.segments, limits.loss
        free = np.ones(len(order), dtype=bool)
        while left_s > 0:
            start = np.searchsorted(-tk, -left_t, side="left")  # larger items come first
            if start == len(tk):
                break
            t, l_ = tk[start:], ls[start:]
            # the segment's share is the same for all items and decides nothing among them
            score = t * (left_t / limits.tokens**2) + l_ * (left_l / limits.loss**2)
            opens = left_s == limits.segments
            score = np.where(free[start:] & ((l_ <= left_l) | opens), score, -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                break
            at = start + best
            free[at] = False
            left_t, left_s, left_l = left_t - tk[at], left_s - 1, max(0, left_l - ls[at])
            if left_t == 0 and tk[-1] > 0:
                break
        out[order[~free]] = number
        order, tk, ls = order[free], tk[free], ls[free]
        number += 1
    return out


def _placer(doc_id: str, limits: Limits, r: int):
    def place(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([doc_id, "piece"], kind="stable")
        number = fill(g["n_tokens"].to_numpy(), g["n_loss"].to_numpy(), limits)
        return g.drop(columns="_g").assign(container=(np.int64(r) << 58) + (np.int64(key[0]) << 24) + number)

    return place


def pack(items: DataFrame, doc_id: str, limits: Limits = Limits(), group_items: int = 16_384, rounds: int = 3, full: float = 0.985) -> DataFrame:
    """items (from pieces()) with `container`, a number that rows share if they are placed together.

    Items are dealt at random to groups of group_items that are packed independently; whatever lies in containers less than
    `full` in every limit is dealt anew among fewer groups, so that remainders of all groups meet. Every item is placed once; the groups, and
    with them a task's memory, stay of one size however many items there are. Empty tables give an empty result.
    """
    spark = items.sparkSession
    ship(spark)
    schema = f"`{doc_id}` {dict(items.dtypes)[doc_id]}, piece int, first_token bigint, n_tokens bigint, n_loss bigint, container bigint"
    rest, done = items, []
    for r in range(rounds):
        n = rest.count()
        groups = max(1, math.ceil(n / group_items))
        last = r == rounds - 1 or groups == 1

        # as many tasks as groups: their number is stated, so small groups are not merged into one task
        dealt = rest.withColumn("_g", F.pmod(F.xxhash64(doc_id, "piece", F.lit(r)), F.lit(groups))).repartition(groups, "_g")
        placed = dealt.groupBy("_g").applyInPandas(_placer(doc_id, limits, r), schema)
        if last:
            done.append(placed)
            break
        placed = staged(placed, "packed")
        # full in any of the limits: what is left of the others nothing can use
        used = placed.groupBy("container").agg(F.greatest(F.sum("n_tokens") / limits.tokens, F.sum("n_loss") / limits.loss, F.count("*") / limits.segments).alias("_used"))
        good = F.col("_used") >= full
        marked = staged(placed.join(used, "container"), "packed_marked")
        done.append(marked.where(good).select(placed.columns))
        rest = marked.where(~good).drop("container", "_used")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def packed(docs: DataFrame, doc_id: str, text: str, limits: Limits = Limits(), tokenizer: str = TOKENIZER, group_items: int = 16_384) -> DataFrame:
    """Texts sized, divided where they must be, and placed."""
    sized = staged(pieces(sizes(docs, doc_id, text, tokenizer), doc_id, limits), "sized")
    return pack(sized, doc_id, limits, group_items)
