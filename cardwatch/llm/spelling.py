"""Grouping of spelling variants: words one inserted, deleted or replaced letter apart, compared in dense tiles.

Two words of lengths M and M or M - 1 are one edit apart exactly if their common prefix and their common suffix together
have at least M - 1 letters. Tiles are padded matrices of code points; the rows of a tile are compared pair by pair, from
the front and from the back.

Which words share a tile follows from the same sum. If p + s >= M - 1, then p reaches half of the letters or s reaches
the rest, so near words agree on one half; the half that is left open is halved again, and so on. A group is the words
that agree on ``a`` letters in front and ``b`` behind. A group too large for a tile is halved once more, and only its
own words move; with all M - 1 letters fixed it can hold no more words than there are letters. Nothing is capped and no
group is ever compared as a whole if it is large.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.lines import ascii_lower
from cardwatch.sources.session import materialize

#: Letters of a word: the unaccented ones and those of Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of one tile, and matrix cells that a worker compares at a time. Neither changes results.
TILE = 256
CELLS = 1 << 22
#: Halvings before the sizes of groups are looked at for the first time.
FIRST_HALVINGS = 2

_RESULT = "word string, n_near long, best_n long, best string"
_GROUP = ["m", "a", "b", "cap"]


def count_words(docs: DataFrame, shortest: int = 7, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words with at least ``shortest`` letters.

    A word is a maximal run of ``LETTERS`` with A-Z lowered. If the unsigned crc32 h of ``<id>:<run>`` can be divided by
    ``noise``, the run loses its letter h % length. Null texts have no words, a null id counts as an empty one, repeated
    rows count again. Texts are read whole; counts are combined before the only shuffle.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col(f"`{text_col}`")), F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(name.alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run"))
    words = rows.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _halved(state: Column) -> Column:
    """The two groups that a group (m, a, b, cap) is dealt to: near words agree on the first half of the open letters,
    or their prefix ends before it (``cap``) and they agree on what comes behind. Without open letters, the group itself."""
    m, a, b, cap = (state[name] for name in _GROUP)
    open_ = m - F.lit(1) - a - b
    x = F.floor((open_ + 1) / 2).cast("int")
    front = F.struct(m.alias("m"), (a + x).alias("a"), b.alias("b"), cap.alias("cap"))
    back = F.struct(m.alias("m"), a.alias("a"), (b + open_ - x + 1).alias("b"), (a + x).alias("cap"))
    return F.when(open_ > 0, F.array(front, back)).otherwise(F.array(state))


def _keyed(members: DataFrame) -> DataFrame:
    ends = [F.substring("word", F.lit(1), F.col("a")), F.right("word", F.col("b"))]
    return members.withColumn("key", F.xxhash64(*_GROUP, *ends))


def _first_members(words: DataFrame) -> DataFrame:
    """Every word in the groups for pairs of its own length, and for pairs with a word one letter longer."""
    size = F.length("word")

    def start(longer):
        return F.struct((size + longer).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"), (size + longer + 1).alias("cap"))

    groups = F.array(start(0), start(1))
    for _ in range(FIRST_HALVINGS):
        groups = F.flatten(F.transform(groups, _halved))
    return _keyed(words.select("word", "n", F.explode(groups).alias("g")).select("g.*", "word", "n"))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and padded matrices of code points from the front and from the back."""
    text = "".join(words.to_pylist())
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if text.isascii() or max(text) <= "\xff":
        flat = np.frombuffer(text.encode("latin-1"), np.uint8)
    else:
        flat = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = int(sizes.max()) + 1  # the last column differs from no letter of the longest word but ends the search
    inside = np.arange(width) < sizes[:, None]
    front = np.zeros((len(sizes), width), flat.dtype)
    front[inside] = flat
    back = np.zeros_like(front)
    ends = np.cumsum(sizes)
    place = np.repeat(ends + ends - sizes, sizes) - 1 - np.arange(len(flat))  # each word mirrored in itself
    back[inside] = flat[place]
    return sizes, front, back


def _common(matrix: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of equal columns in front of two rows that differ somewhere."""
    return (matrix[left] != matrix[right]).argmax(axis=1)


def near_pairs(words: pa.Array, state: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of near rows of consecutive groups; ``state`` has a row (m, a, b, cap) per word."""
    sizes, front, back = _codes(words)
    m, a, b, cap = state.T
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    partners = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(group)) - 1
    pairs_before = np.concatenate([[0], np.cumsum(partners)])
    step, at, found = max(1, CELLS // front.shape[1]), 0, []
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(pairs_before, pairs_before[at] + step, side="right")) - 1)
        count = partners[at:stop]
        left = np.repeat(np.arange(at, stop), count)
        right = left + 1 + np.arange(len(left)) - np.repeat(pairs_before[at:stop] - pairs_before[at], count)
        # One of two words is as long as its group says; equal hashes of other groups are told apart here.
        alike = (np.maximum(sizes[left], sizes[right]) == m[left]) & (state[left] == state[right]).all(axis=1)
        left, right = left[alike], right[alike]
        p, s = _common(front, left, right), _common(back, left, right)
        near = (p + s >= m[left] - 1) & (p >= a[left]) & (s >= b[left]) & (p < cap[left])
        found.append((left[near], right[near]))
        at = stop
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _tile(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words of each row of whole groups: how many, and the most frequent."""
    words = table["word"].combine_chunks().cast(pa.string())
    n = table["n"].to_numpy()
    state = np.stack([table[name].to_numpy() for name in _GROUP], axis=1)
    left, right = near_pairs(words, state, table["key"].to_numpy())
    if not len(left):
        return
    own, other = np.concatenate([left, right]), np.concatenate([right, left])
    pairs = pa.table({"own": own, "n": n[other], "word": words.take(pa.array(other))})
    order = pc.sort_indices(pairs, [("own", "ascending"), ("n", "descending"), ("word", "ascending")])
    pairs = pairs.take(order)
    own = pairs["own"].to_numpy()
    first = np.flatnonzero(np.diff(own, prepend=-1))
    best = pairs.take(pa.array(first))
    out = {
        "word": words.take(best["own"].combine_chunks()),
        "n_near": pa.array(np.diff(np.append(first, len(own)))),
        "best_n": best["n"].combine_chunks(),
        "best": best["word"].combine_chunks(),
    }
    yield pa.RecordBatch.from_pydict(out)


def _runs(table: pa.Table) -> Iterator[pa.Table]:
    """Runs of whole groups whose matrices stay within ``CELLS``, or single groups."""
    key = table["key"].to_numpy()
    size = pc.utf8_length(table["word"]).to_numpy() + 1
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    widest = np.maximum.reduceat(size, starts[:-1]) if len(key) else size
    at = 0
    while at < len(widest):
        end, width = at + 1, widest[at]
        while end < len(widest):
            width = max(width, widest[end])
            if (starts[end + 1] - starts[at]) * width > CELLS:
                break
            end += 1
        yield table.slice(starts[at], starts[end] - starts[at])
        at = end


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of a partition sorted by group. A group that goes on in the next batch waits for it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = table["key"].to_numpy()
        if not len(key):
            continue
        last = int(np.flatnonzero(np.diff(key, prepend=~key[0]))[-1])
        for run in _runs(table.slice(0, last)):
            yield from _tile(run)
        rest = table.slice(last)
    if rest is not None:
        yield from _tile(rest)


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near`` and ``best`` (n, word), the near word of the largest n and of those the smallest in
    code-point order, of a table of different words. Words without near words have 0 and null."""
    found = []
    level = materialize(_first_members(words))
    while True:
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        large = materialize(sizes.where(F.col("size") > TILE).select("key"))
        none = large.isEmpty()
        can_grow = F.col("m") - 1 - F.col("a") - F.col("b") > 0
        small = level
        if not none:
            marked = level.join(large.withColumn("large", F.lit(True)), "key", "left")
            hot = F.coalesce("large", F.lit(False)) & can_grow
            small = marked.where(~hot).select(level.columns)
        sorted_ = small.repartition("key").sortWithinPartitions("m", "key")
        found.append(sorted_.mapInArrow(_tiles, _RESULT))
        if none:
            break
        halves = F.explode(_halved(F.struct(*_GROUP))).alias("g")
        split = _keyed(marked.where(hot).select(halves, "word", "n").select("g.*", "word", "n"))
        level = materialize(split)
        if level.isEmpty():
            break
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    for part in found:
        rows = rows.unionByName(part.withColumn("n", F.lit(None).cast("long")))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word")))
    sums = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best.minus_n")).alias("n"), F.col("best.word").alias("word")))
    return sums.withColumn("best", best)


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain, of the rows (word, form). Every step looks up where the form's own
    chain has got to, so the rounds are the logarithm of the longest chain; forms must not run in a circle."""
    chain = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(chain.join(ahead, "root", "left"))
        if moved.where("further IS NOT NULL").isEmpty():
            return chain
        chain = moved.select("word", F.coalesce("further", "root").alias("root"))


def spelling_groups(words: DataFrame, times: int = 10) -> DataFrame:
    """Variants of the words of a table (word, n): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    The form of a word is its near word of the largest n if that n is at least ``times`` the word's own; the root is the
    last form of the chain, the word itself without a form. Rows with a null or empty word or a null n are left out,
    repeated words count together, other columns are not read; an empty table gives an empty one.
    """
    clean = words.where("word <> '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    near = materialize(near_words(materialize(clean)))
    fits = F.col("best.n") >= F.col("n") * times
    formed = near.select(
        "word", "n", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, F.col("best.n")).alias("form_n")
    )
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
