"""Mixing sources to target shares (problem 9).

Texts are grouped by membership pattern, the set of sources that hold them. A min-cost flow on this small
table routes token capacity to source quotas: using a text for the k-th time costs k - 1, so repetition is
spread evenly and used only where a share needs it. Then documents are selected in a seeded order so that
each (pattern, source) takes the tokens its flow says.
"""

from __future__ import annotations

import base64
import math
import os
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.common import prefix_sums, stage

#: Vocabulary file of a public byte-level tokenizer (ranks in base64), and its splitting pattern.
VOCABULARY = os.environ.get("STRATALINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Most (pattern, source) arcs that are broadcast.
BROADCAST_ARCS = 50_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, text_key, tokens) of every document; whole texts. A null text has no tokens; rows without an
    id are left out. The key is equal for equal texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).encode_ordinary
        for pdf in batches:
            yield pdf.drop(columns="text").assign(tokens=[len(encode(t)) if t else 0 for t in pdf["text"]])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.sha2("text", 256).alias("text_key"), "text").filter("doc_id is not null")
    return rows.mapInPandas(count, "doc_id bigint, source string, text_key string, tokens bigint")


class Flow:
    """Min-cost maximum flow by successive cheapest paths; amounts are integers."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            far = [math.inf] * len(self.out)
            via, waiting, queued = [-1] * len(self.out), deque([source]), [False] * len(self.out)
            far[source] = 0
            while waiting:
                u = waiting.popleft()
                queued[u] = False
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] > 0 and far[u] + self.cost[e] < far[v]:
                        far[v], via[v] = far[u] + self.cost[e], e
                        if not queued[v]:
                            waiting.append(v)
                            queued[v] = True
            if via[sink] < 0:
                return total
            amount, v = math.inf, sink
            while v != source:
                amount, v = min(amount, self.room[via[v]]), self.to[via[v] ^ 1]
            v = sink
            while v != source:
                self.room[via[v]] -= amount
                self.room[via[v] ^ 1] += amount
                v = self.to[via[v] ^ 1]
            total += amount


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each source: as much of the quotas as possible, with the least repetition."""
    patterns, sources = sorted(capacity), sorted(quota)
    flow = Flow(2 + len(patterns) + len(sources))
    at = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    arcs = {}
    for i, p in enumerate(patterns):
        # Copies of one text in the whole mixture stay within the largest cap of its sources.
        for use in range(max((repeats[s] for s in p if s in at), default=0)):
            flow.arc(0, 2 + i, capacity[p], use)
        for s in p:
            if s in at:
                arcs[p, s] = flow.arc(2 + i, at[s], capacity[p] * repeats[s])
    for s in sources:
        flow.arc(at[s], 1, quota[s])
    flow.run(0, 1)
    return {k: flow.room[e ^ 1] for k, e in arcs.items() if flow.room[e ^ 1]}


def quotas(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole-token quotas of the available sources; shares of others are spread in proportion."""
    known = sum(shares.values())
    return {s: int(total * x / known) for s, x in shares.items()} if known > 0 else dict.fromkeys(shares, 0)


def largest_total(capacity: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which all quotas can be met within the caps (by bisection on the flow)."""
    low, high = 0, sum(c * max((repeats[s] for s in p if s in shares), default=0) for p, c in capacity.items()) + 1
    while high - low > max(1, high // 1_000_000):
        middle = (low + high) // 2
        want = quotas(shares, middle)
        if sum(route(capacity, want, repeats).values()) == sum(want.values()):
            low = middle
        else:
            high = middle
    return low


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of a mixture.

    ``documents``: doc_id, source, text. ``targets``: source, target_share, max_repeats (one row a source; null
    or non-positive values take no part). Equal texts count as one text, held by all its sources and named
    by its least doc_id; documents of sources without a target, null and empty texts are not mixed. ``total_tokens``
    defaults to the largest total at which every source that has documents meets its share exactly; shares of targets
    without documents are spread over the others in proportion. With a greater total, sources are filled as far
    as their caps allow.

    selection: doc_id, source, repeats, tokens (of one copy). shares: source, target_share, max_repeats,
    available_tokens, taken_tokens, share.
    """
    spark = documents.sparkSession
    wanted = targets.filter("source is not null and target_share > 0 and max_repeats > 0").select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    # A target names a source; there are as many rows as the mixture has parts.
    parts = {r["source"]: (r["target_share"], r["max_repeats"]) for r in wanted.collect()}
    # Texts are tokenised once, and only those of sources with a target.
    counted = stage(token_counts(documents.filter(F.col("source").isin(*parts) if parts else F.lit(False)), vocabulary).filter("tokens > 0"))
    # Map-side combine keeps a text with very many copies to one row a task.
    texts = stage(
        counted.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("source")), "\u001f").alias("pattern"))
    )
    # At most as many rows as there are sets of sources in use.
    table = {tuple(r["pattern"].split("\u001f")): int(r["held"]) for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("held")).collect()}
    present = {s for p in table for s in p}
    shares = {s: x for s, (x, _) in parts.items() if s in present}
    repeats = {s: n for s, (_, n) in parts.items()}
    total = largest_total(table, shares, repeats) if total_tokens is None else total_tokens
    routed = route(table, quotas(shares, total), repeats)
    # Each pattern's texts lie on a circle in seeded order; sources take consecutive arcs of their flow's length, and
    # a text is taken as often as an arc passes its start.
    arcs, start = [], dict.fromkeys(table, 0)
    for (p, s), amount in sorted(routed.items()):
        arcs.append(("\u001f".join(p), s, start[p], start[p] + amount, table[p]))
        start[p] += amount
    plan = spark.createDataFrame(arcs, "pattern string, source string, lo bigint, hi bigint, held bigint")
    # One pattern may hold most texts; its few arcs are sent to all tasks while their number is small.
    plan = F.broadcast(plan) if len(arcs) <= BROADCAST_ARCS else plan
    placed = prefix_sums(texts.withColumn("seeded", F.xxhash64(F.lit(seed), "text_key")), ["pattern"], ["seeded", "text_key"], "tokens", "place")
    # Copies with start place + k * held in [lo, hi), over whole k.
    upto = lambda x: F.ceil((F.col(x) - F.col("place")) / F.col("held"))
    selection = (
        placed.join(plan, "pattern").withColumn("repeats", (F.greatest(upto("hi"), F.lit(0)) - F.greatest(upto("lo"), F.lit(0))).cast("int"))
        .filter("repeats > 0").select("doc_id", "source", "repeats", "tokens")
    )
    taken = selection.groupBy("source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("taken_tokens"))
    held = counted.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    out = wanted.join(held, "source", "left").join(taken, "source", "left").fillna(0, ["available_tokens", "taken_tokens"])
    all_taken = taken.agg(F.sum("taken_tokens").alias("all"))
    report = out.join(F.broadcast(all_taken)).withColumn("share", F.coalesce(F.col("taken_tokens") / F.col("all"), F.lit(0.0))).drop("all")
    return selection, report
