"""Benchmark decontamination: passages of documents within an edit distance of a test item.

By the pigeonhole principle, an item cut into budget + 1 pieces that occurs with at most ``budget`` edits has a piece
that occurs unchanged. Taken in pairs, there is even a pair with at most one edit (or the last, single piece without
any), as pairs with two edits each would exceed the budget. Exact hits of all pieces are found in one pass over each
text; where the other piece of the pair follows with at most one edit, the whole item is matched around the hit by
Myers' bit-parallel algorithm.
"""

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.sources.session import materialize

#: Characters of test items that go to the executors in one broadcast.
CHUNK_CHARS = 8_000_000


def plain(text: str | None) -> str:
    """Lower case, with every run of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def one_edit(piece: str, text: str) -> bool:
    """Whether ``text`` starts with ``piece`` but for at most one edit."""
    n = len(piece)
    if text.startswith(piece):
        return True
    same = next((i for i in range(min(n, len(text))) if piece[i] != text[i]), min(n, len(text)))
    rest = piece[same + 1 :]
    return text.startswith(rest, same + 1) or text.startswith(rest, same) or text.startswith(piece[same:], same + 1)


def best_match(item: str, text: str, budget: int) -> int | None:
    """Smallest edit distance between ``item`` and any part of ``text``, or None if it is above ``budget``.

    The column of the distance table is kept as bits of its differences, all rows of a column are computed at once.
    """
    size = len(item)
    if not size:
        return None
    masks = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, last = (1 << size) - 1, 1 << (size - 1)
    up, down, score, least = full, 0, size, size
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < least:
            least = score
    return least if least <= budget else None


class Items:
    """Test items with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], error_percent: int):
        import ahocorasick

        self.items = [(i, t, len(t) * error_percent // 100) for i, t in items]
        owners = defaultdict(list)
        for n, (_, text, budget) in enumerate(self.items):
            cut = pieces(text, budget)
            for j, (place, piece) in enumerate(cut):
                # The pair's other piece: after this one as it is, before it both are read backwards.
                before = cut[j - 1][1][::-1] if j % 2 else ""
                after = cut[j + 1][1] if j % 2 == 0 and j + 1 < len(cut) else ""
                owners[piece].append((n, place, before, after))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str):
        """(item id, distance) of every item that occurs within its budget."""
        if not len(self.automaton):
            return
        starts = defaultdict(set)
        for end, (size, where) in self.automaton.iter(text):
            at = end + 1 - size
            for n, place, before, after in where:
                if after and not one_edit(after, text[end + 1 : end + 2 + len(after)]):
                    continue
                if before and not one_edit(before, text[max(0, at - len(before) - 1) : at][::-1]):
                    continue
                starts[n].add(at - place)
        for n, found in starts.items():
            item_id, item, budget = self.items[n]
            least, low, high = None, None, None
            for start in [*sorted(found), None]:
                if low is not None and (start is None or start > high + 2 * budget):
                    window = text[max(0, low - budget) : high + len(item) + budget]
                    distance = 0 if item in window else best_match(item, window, budget)
                    if distance is not None and (least is None or distance < least):
                        least = distance
                    low = None
                if start is not None:
                    low, high = start if low is None else low, start
            if least is not None:
                yield item_id, least


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    error_percent: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The table with ``hits``, which replaces a column of that name: (item_id, distance) of every item that a part of
    the text is within ``error_percent`` of the item's length in edits of; ``distance`` is the smallest over all parts.

    Both sides are compared in lower case with white space runs as single spaces. Null, empty and blank items match
    nothing, nor do null and empty texts. Items alike are found each; null and repeated ids of documents do not matter,
    as rows are judged by their texts. Texts of any length are searched whole. An empty benchmark gives empty arrays.

    Items reach the executors in broadcasts of about ``CHUNK_CHARS`` characters, one at a time. A benchmark that fits in one
    is searched without a shuffle. A larger one takes a pass over the texts for each part; the hits of a pass are stored
    by a hash of 128 bits of the text and its broadcast is given up before the next, so that neither the driver nor an
    executor ever holds more than one part. The few texts with hits are joined back.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    chunks = max(1, math.ceil(total / CHUNK_CHARS))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    text = F.col(f"`{text_col}`").cast("string")

    def part(chunk):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == chunk).collect()
        shared = spark.sparkContext.broadcast([(r.i, plain(r.t)) for r in own if plain(r.t)])
        return shared, _search(shared, error_percent, kind)(text)

    if chunks == 1:
        return docs.withColumn("hits", part(0)[1])
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    found = None
    for chunk in range(chunks):
        shared, hits = part(chunk)
        own = materialize(docs.select(key.alias("key"), hits.alias("hits")).where(F.size("hits") > 0).dropDuplicates(["key"]))
        shared.destroy()
        found = own if found is None else found.unionByName(own)
    merged = found.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    others = [c for c in docs.columns if c != "hits"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), key.alias("key"))
    none = F.array().cast("array<struct<item_id:bigint,distance:int>>")
    joined = rows.join(merged, "key", "left").withColumn("hits", F.coalesce("hits", none))
    order = docs.columns if "hits" in docs.columns else [*docs.columns, "hits"]
    return joined.select(*[F.col("hits") if c == "hits" else F.col(f"row.`{c}`").alias(c) for c in order])


def _search(shared, error_percent, kind):
    built = []

    @F.arrow_udf("array<struct<item_id:bigint,distance:int>>")
    def search(texts: pa.Array) -> pa.Array:
        if not built:  # once per Python worker and task
            built.append(Items(shared.value, error_percent))
        return pa.array([[{"item_id": i, "distance": d} for i, d in built[0].find(plain(t.as_py()))] for t in texts], kind)

    return search
