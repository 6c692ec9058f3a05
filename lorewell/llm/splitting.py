"""Oversized items cut into pieces under a limit at natural boundaries, with overlap.

Agglomerative merging: an item starts as atomic segments (messages; of a message that does not fit its
paragraphs, of those its lines, sentences, words, characters). Adjacent pairs lie in a heap, the weakest
boundary first, of equals the smaller pair; a pair is merged while its size plus the overlap fits. The
boundaries that are left are the strongest, and become the cuts. Each piece but the first starts with the
end of the piece before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3000, 200
#: Characters of an item that are merged together; the bound on what one task holds of it. Only an item beyond it is
#: cut into blocks, at a boundary between messages, the strongest kind, whatever its number of lines.
BLOCK_CHARS = 4_000_000
#: Lines of the messages table under one join key.
JOIN_LINES = 256
PARAGRAPHS, LINES, SENTENCES, WORDS = (re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n", r"[.!?…。！？][\"'”’)\]]*\s+", r"\s+"))
CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH, MESSAGE = range(6)


def _atoms(text: str, room: int) -> list[tuple[int, int]]:
    """(length, strength of the boundary before it) of the segments of one message."""
    out: list[tuple[int, int]] = []

    def cut(start: int, end: int, level: int, strength: int) -> None:
        if end - start <= room:
            out.append((end - start, strength))
            return
        if level < 0:
            for at in range(start, end, room):
                out.append((min(room, end - at), strength if at == start else CHARACTER))
            return
        pattern = (WORDS, SENTENCES, LINES, PARAGRAPHS)[level]
        at = start
        for m in pattern.finditer(text, start, end):
            if start < m.end() < end:
                cut(at, m.end(), level - 1, strength if at == start else level + 1)
                at = m.end()
        cut(at, end, level - 1, strength if at == start else level + 1)

    if text:
        cut(0, len(text), 3, MESSAGE)
    return out


def pieces(contents: list[str], limit: int = LIMIT, overlap: int = OVERLAP, context: str = "") -> list[tuple[str, int]]:
    """(text, characters repeated from before) of each piece of an item; no content gives none.

    Without the repeated parts the pieces make up the contents exactly. ``context`` is what came before.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    whole = "".join(contents)
    if not whole:
        return []
    if len(whole) + min(overlap, len(context)) <= limit:
        lead = context[-overlap:] if overlap else ""
        return [(lead + whole, len(lead))]
    room = limit - overlap
    atoms = [a for c in contents for a in _atoms(c, room)]
    n = len(atoms)
    size = [a[0] for a in atoms]
    strength = [a[1] for a in atoms]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    # The first piece repeats nothing, so it may be larger.
    fits = lambda i, total: total <= (limit if i == 0 and not context else room)
    heap = [(strength[j], size[j - 1] + size[j], j - 1, j) for j in range(1, n) if fits(j - 1, size[j - 1] + size[j])]
    heapq.heapify(heap)
    while heap:
        _, total, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or size[i] + size[j] != total or not fits(i, total):
            continue
        size[i], alive[j] = total, False
        after[i] = after[j]
        if after[i] < n:
            k = after[i]
            before[k] = i
            if fits(i, size[i] + size[k]):
                heapq.heappush(heap, (strength[k], size[i] + size[k], i, k))
        if before[i] >= 0:
            h = before[i]
            if fits(h, size[h] + size[i]):
                heapq.heappush(heap, (strength[i], size[h] + size[i], h, i))
    out, at, i = [], 0, 0
    while i < n:
        past = whole[max(0, at - overlap) : at] if at else ""
        if len(past) < overlap and context:
            past = (context + past)[-overlap:] if overlap else ""
        past = past[-overlap:] if overlap else ""
        out.append((past + whole[at : at + size[i]], len(past)))
        at += size[i]
        i = after[i]
    return out


def _split_rows(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, block, contents, context in zip(b["key"], b["block"], b["contents"], b["context"], strict=True):
                for k, (text, repeated) in enumerate(pieces(list(contents), limit, overlap, context or "")):
                    rows.append((key, block, k, text, len(text), repeated))
            yield pd.DataFrame(rows, columns=["key", "block", "piece", "text", "n_chars", "n_repeated"])

    return run


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, block, piece, text, n_chars, n_repeated) of items (key, block, contents, context); the key is a text."""
    return items.mapInPandas(_split_rows(limit, overlap), "key string, block int, piece int, text string, n_chars int, n_repeated int")


def delta_items(deltas: DataFrame, messages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The messages of each delta of more than ``limit`` characters in blocks: (session_id, delta_number, block, contents, context, total).

    ``context`` is what came before the block, at most ``overlap`` characters. A range join on keys: both sides carry
    the session and a run of ``JOIN_LINES`` lines, so a session with a tenth of all rows is spread over many keys, and
    the content of a delta meets by run. Where a run begins in its delta is a running sum over lengths alone.
    Repeated deliveries (same session, seq and content) count once, null content as empty. Repeated rows of a
    delta count once; rows with a null id or bound are left out, as are empty ranges.
    """
    keys = ["session_id", "delta_number", "line_start", "line_end"]
    d = deltas.select(*keys).where("session_id is not null and delta_number is not null and line_end > line_start").distinct()
    d = d.select("*", F.explode(F.sequence(F.floor(F.col("line_start") / JOIN_LINES), F.floor((F.col("line_end") - 1) / JOIN_LINES))).alias("run"))
    m = messages.where("session_id is not null and content is not null and content <> ''").select("session_id", "line_no", "seq", "content", F.floor(F.col("line_no") / JOIN_LINES).alias("run"))
    met = d.join(m, ["session_id", "run"]).where("line_no >= line_start and line_no < line_end")
    runs = met.groupBy(*keys, "run").agg(F.sort_array(F.collect_set(F.struct("seq", "content"))).alias("x")).select(*keys, "run", F.transform("x", lambda e: e["content"]).alias("contents"))
    length = F.aggregate("contents", F.lit(0).cast("long"), lambda a, c: a + F.length(c))
    sizes = runs.select(*keys, "run", length.alias("n"), F.right(F.array_join("contents", ""), F.lit(overlap)).alias("tail"))
    delta = Window.partitionBy(*keys)
    at = sizes.select("*", (F.sum("n").over(delta.orderBy("run")) - F.col("n")).alias("start"), F.sum("n").over(delta).alias("total")).where(F.col("total") > limit)
    at = at.withColumn("block", F.floor(F.col("start") / BLOCK_CHARS).cast("int"))
    grouped = runs.join(at.select(*keys, "run", "block", "total"), [*keys, "run"]).groupBy(*keys, "block", "total").agg(F.sort_array(F.collect_list(F.struct("run", "contents"))).alias("x"))
    # Every run holds a character, so the last ``overlap`` runs are enough for the context of the next block.
    ends = at.where(F.col("total") > BLOCK_CHARS).select(*keys, "run", "block", F.array_join(F.collect_list("tail").over(delta.orderBy("run").rowsBetween(-max(overlap, 1), -1)), "").alias("past"))
    past = ends.groupBy(*keys, "block").agg(F.right(F.min_by("past", "run"), F.lit(overlap)).alias("context"))
    out = grouped.join(past, [*keys, "block"], "left")
    return out.select("session_id", "delta_number", "block", F.flatten(F.transform("x", lambda e: e["contents"])).alias("contents"), F.coalesce("context", F.lit("")).alias("context"), "total")


def split_deltas(deltas: DataFrame, messages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of all deltas that are larger than ``limit``: (session_id, delta_number, block, piece, text, n_chars, n_repeated).

    Blocks are numbered from 0; all but the largest deltas have one.
    """
    keyed = delta_items(deltas, messages, limit, overlap).select(F.to_json(F.struct("session_id", "delta_number")).alias("key"), "block", "contents", "context")
    out = split_items(keyed, limit, overlap).withColumn("key", F.from_json("key", "session_id string, delta_number int"))
    return out.select("key.session_id", "key.delta_number", "block", "piece", "text", "n_chars", "n_repeated")


def oversized(pieces_: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(session_id, delta_number) of the deltas whose pieces hold more than ``limit`` characters of content."""
    total = pieces_.groupBy("session_id", "delta_number").agg(F.sum(F.col("n_chars") - F.col("n_repeated")).alias("n"))
    return total.where(F.col("n") > limit).select("session_id", "delta_number")


def split_messages(messages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of single messages longer than ``limit``: (message_id, piece, text, n_chars, n_repeated). Every delivery is an item."""
    long = messages.where(F.length("content") > limit).select(F.col("message_id").cast("string").alias("key"), F.lit(0).alias("block"), F.array("content").alias("contents"), F.lit("").alias("context"))
    return split_items(long, limit, overlap).select(F.col("key").cast("long").alias("message_id"), "piece", "text", "n_chars", "n_repeated")
