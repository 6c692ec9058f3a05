"""Documents put together into containers of a fixed number of tokens.

Mixture-controlled packing: documents queue by source, and every container (window) is filled by deficit
round-robin towards target proportions of tokens: those given, or the sources' own shares of the whole table. A
source earns its share of what a window holds; the source with the largest deficit gives its largest document
that still fits, as long as any fits. Deficits carry over from window to window and from shard to shard: what
the shards of a level still owe each source is summed and spread over the shards of the next level. A source that
has run out leaves its share to the others. Only a document longer than a container is split, into full
containers and one remainder that is packed like a document.

Shards are cut by a hash of the document, so a source with a third of all rows is spread evenly, and each
task holds a bounded number of tokens. A shard's emptiest windows are handed on to a second round, where those
of many shards are packed together.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.store import cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of one shard.
SHARD_TOKENS = 4_000_000
#: A window that is filled to this share is closed for good.
FULL = 0.99
# The published pattern that splits text before the merges of this vocabulary (a fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_name(path: str = TOKENIZER) -> str:
    return path.rsplit("/", 1)[-1]


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(tokenizer_name(path), pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every row; a null text has none, a null source is the source ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for b in batches:
            b["n_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield b[["doc_id", "source", "n_tokens"]]

    rows = documents.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("source"), "text")
    return rows.mapInPandas(run, "doc_id long, source string, n_tokens int")


def fill(items: list[tuple[str, int]], capacity: int, deficits: dict[str, float] | None = None, shares: dict[str, float] | None = None) -> tuple[list[list[int]], dict[str, float]]:
    """Containers, each a list of item numbers, and the tokens that each source is still owed (below 0: has had too many).

    ``items``: (source, tokens), none larger than the capacity. ``shares`` are target proportions of any sum, by
    default those of the items; a source without a share comes last.
    """
    queues: dict[str, list[tuple[int, int]]] = {}
    for k, (source, n) in enumerate(items):
        queues.setdefault(source, []).append((n, k))
    for q in queues.values():
        q.sort()
    if shares is None:
        shares = {s: float(sum(n for n, _ in q)) for s, q in queues.items()}
    owed = {s: (deficits or {}).get(s, 0.0) for s in sorted({*queues, *(deficits or {})})}
    live = set(queues)
    out: list[list[int]] = []
    while live:
        whole = sum(shares.get(s, 0.0) for s in live)
        share = {s: shares.get(s, 0.0) / whole if whole else 1 / len(live) for s in live}
        room, window, given = capacity, [], dict.fromkeys(live, 0)
        # A source's claim: what it is owed, and its share of the window.
        waiting = [(-(owed[s] + share[s] * capacity), s) for s in live]
        heapq.heapify(waiting)
        while waiting and room > 0:
            claim, s = heapq.heappop(waiting)
            q = queues[s]
            at = bisect.bisect_right(q, (room, len(items))) - 1
            if at < 0:
                continue  # nothing of it fits this window any more
            n, k = q.pop(at)
            window.append(k)
            room -= n
            given[s] += n
            if q:
                heapq.heappush(waiting, (claim + n, s))
        # Only what the window holds is shared out; unused room is owed to nobody.
        for s in live:
            owed[s] += share[s] * (capacity - room) - given[s]
        live = {s for s in live if queues[s]}
        out.append(window)
    return out, owed


def _pack_shard(capacity: int, last: bool, shares: dict[str, float]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        level, shard = key[0], key[1]
        owed: dict[str, float] = {}
        for s, d in zip(pdf["source"], pdf["owed"], strict=True):
            owed[s] = owed.get(s, 0.0) + d
        pdf = pdf[pdf["n_tokens"].notna()]
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        containers, left = fill(list(zip(pdf["source"], (int(n) for n in pdf["n_tokens"]), strict=True)), capacity, owed, shares)
        number = [""] * len(pdf)
        place = [0] * len(pdf)
        used = pdf["n_tokens"].tolist()
        # At most an eighth of the windows, the emptiest, is handed on, so every round leaves less.
        fills = [sum(used[r] for r in rows) for rows in containers]
        emptiest = sorted((f, c) for c, f in enumerate(fills) if f < capacity * FULL)[: 0 if last else max(1, len(containers) // 8)]
        handed = {c for _, c in emptiest}
        for c, rows in enumerate(containers):
            for p, r in enumerate(rows):
                if c in handed:
                    left[pdf["source"][r]] += used[r]  # given back, so still owed
                else:
                    number[r], place[r] = f"{level}-{shard:06d}-{c:07d}", p
        pdf["container_id"], pdf["place"], pdf["owed"] = number, place, 0.0
        # What each source is owed goes on as a row without a document.
        rest = pd.DataFrame({"source": list(left), "owed": list(left.values())}) if not last else pd.DataFrame({"source": [], "owed": []})
        rest = rest.assign(doc_id=None, piece=None, token_start=None, n_tokens=None, container_id="", place=None)
        names = [c.split()[0] for c in _PACKED.split(", ")]
        return pd.concat([pdf[names].astype(object), rest[names].astype(object)], ignore_index=True) if len(rest) else pdf[names]

    return run


_PACKED = "doc_id long, source string, piece int, token_start int, n_tokens int, owed double, container_id string, place int"


def source_tokens(counted: DataFrame) -> dict[str, float]:
    """Tokens by source over all rows; the number of sources is the bound (they are boards or collections, not documents)."""
    return {r["source"]: float(r["n"] or 0) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS, targets: dict[str, float] | None = None) -> DataFrame:
    """(container_id, place, doc_id, piece, source, token_start, token_end, n_tokens, capacity, tokenizer): one row per document, or per piece of one longer than a container.

    ``targets`` are proportions of tokens by source (a null source is ''); without them every window aims at the
    proportions of the whole table. The tokens of a container never exceed ``capacity``. Documents without tokens
    (null or empty text) are placed too and take no room. Repeated rows are separate documents. An empty table
    gives no container.
    """
    counted = cut(token_counts(documents, tokenizer), "packing-tokens")
    n = F.col("n_tokens")
    whole = F.floor(n / capacity).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.when(n == 0, 0).otherwise(F.ceil(n / capacity).cast("int") - 1)),
        lambda k: F.struct(k.alias("piece"), (k * capacity).alias("token_start"), F.when(k < whole, F.lit(capacity)).otherwise(n - k * capacity).alias("n_tokens")),
    )
    rest = counted.select("doc_id", "source", F.inline(pieces)).withColumn("owed", F.lit(0.0))
    shares = source_tokens(counted)
    total = int(sum(shares.values()))
    shares = shares if targets is None else targets
    done: list[DataFrame] = []
    level, before = 1, None
    while True:
        shards = max(1, -(-total // max(shard_tokens, 16 * capacity)))
        last = shards == 1 or before is not None and total > before / 2
        shard = F.pmod(F.xxhash64("doc_id", "piece", "source", F.lit(level)), F.lit(shards)).cast("int")
        packed = cut(rest.select(F.lit(level).alias("level"), shard.alias("shard"), "*").groupBy("level", "shard").applyInPandas(_pack_shard(capacity, last, shares), _PACKED), "packing-level")
        done.append(packed.where("container_id <> ''").select("container_id", "place", "doc_id", "piece", "source", "token_start", "n_tokens"))
        if last:
            break
        open_ = packed.where("container_id = ''").select("doc_id", "source", "piece", "token_start", "n_tokens", "owed")
        # One row of deficit per source and shard of the next level.
        owed = open_.where("n_tokens is null").groupBy("source").agg(F.sum("owed").alias("owed"))
        before, total = total, open_.agg(F.sum("n_tokens")).first()[0] or 0
        spread = max(1, -(-total // max(shard_tokens, 16 * capacity)))
        owed = owed.select(F.lit(None).cast("long").alias("doc_id"), "source", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("piece"), F.lit(None).cast("int").alias("token_start"), F.lit(None).cast("int").alias("n_tokens"), (F.col("owed") / spread).alias("owed"))
        rest = open_.where("n_tokens is not null").unionByName(owed)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("*", (F.col("token_start") + F.col("n_tokens")).alias("token_end"), F.lit(capacity).alias("capacity"), F.lit(tokenizer_name(tokenizer)).alias("tokenizer"))


def mixture(containers: DataFrame) -> DataFrame:
    """(source, target, mean_share, deviation): tokens of a source in the table, its mean share of a container, and the mean distance of that share from the target."""
    size = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("size")).where("size > 0")
    windows = size.count()
    total = containers.agg(F.sum("n_tokens")).first()[0] or 1
    target = containers.groupBy("source").agg((F.sum("n_tokens") / F.lit(total)).alias("target"))
    part = containers.groupBy("container_id", "source").agg(F.sum("n_tokens").alias("n")).join(size, "container_id").join(target, "source")
    share = F.col("n") / F.col("size")
    # A container without a source has a share of 0 of it.
    return part.groupBy("source", "target").agg(F.sum(share).alias("s"), F.sum(F.abs(share - F.col("target"))).alias("d"), F.count("*").alias("k")).select(
        "source", F.round("target", 6).alias("target"), F.round(F.col("s") / windows, 6).alias("mean_share"), F.round((F.col("d") + (windows - F.col("k")) * F.col("target")) / windows, 6).alias("deviation"),
    )
