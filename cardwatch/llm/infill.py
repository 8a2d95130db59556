"""Fill-in-the-middle: texts cut at token boundaries into prefix, middle and suffix, and put together in another order.

The cuts are numbers of tokens. A learned index turns them into offsets: straight segments, each fitted to a run of
boundaries so that no prediction is off by more than an error bound, and the differences, one byte per boundary. A cut
is a prediction of its segment, corrected by the stored difference, which is exact. The index is built window by window
of the text, so a very long text needs a byte per token instead of all its offsets.
"""


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The signs in front of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SIGNS = (PREFIX, SUFFIX, MIDDLE)

#: Largest difference between a prediction and a boundary; it fits in a signed byte.
ERROR = 127
#: Code points looked at at a time.
WINDOW = 1 << 18



def boundaries(text: str):
    """Code-point offsets after each token, in pieces. A token is a run of other characters with the white space before
    it, or the white space at the end."""
    inside = False
    for start in range(0, len(text), WINDOW):
        codes = np.frombuffer(text[start : start + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        word = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
        before = np.concatenate([[inside], word[:-1]])
        ends = np.flatnonzero(before & ~word) + start  # the first white space after a word
        inside = bool(word[-1])
        if len(ends):
            yield ends
    if text:
        yield np.array([len(text)])


class RankIndex:
    """Offsets of ascending boundaries by their rank, as segments with an error bound and stored differences."""

    def __init__(self, error: int = ERROR):
        if not 0 < error <= ERROR:
            raise ValueError(f"differences are stored in a byte: 1 to {ERROR}")
        self.error = error
        self.segments: list[tuple[int, int, float]] = []  # first rank, its offset, slope
        self.residuals: list[np.ndarray] = []
        self.size = 0

    def add(self, offsets: np.ndarray) -> None:
        """Append the next boundaries. A segment starts at an exact point and holds as many boundaries as one slope
        reaches within the error."""
        at = 0
        while at < len(offsets):
            slope, count = self._reach(offsets[at:])
            run = offsets[at : at + count]
            guess = run[0] + np.rint(slope * np.arange(count)).astype(np.int64)
            self.segments.append((self.size, int(run[0]), slope))
            self.residuals.append((run - guess).astype(np.int8))
            self.size += count
            at += count

    def _reach(self, offsets: np.ndarray) -> tuple[float, int]:
        """The cone of slopes that meet all boundaries so far narrows with each; how far it stays open."""
        least, most, done, step = -np.inf, np.inf, 1, 256
        while done < len(offsets):
            part = offsets[done : done + step]
            ranks = np.arange(done, done + len(part))
            # Half a unit is left for rounding the prediction.
            low = np.maximum.accumulate(np.maximum((part - offsets[0] - self.error + 0.5) / ranks, least))
            high = np.minimum.accumulate(np.minimum((part - offsets[0] + self.error - 0.5) / ranks, most))
            closed = np.flatnonzero(low > high)
            good = int(closed[0]) if len(closed) else len(part)
            if good:
                least, most = low[good - 1], high[good - 1]
            done += good
            if good < len(part):
                break
            step *= 2
        return (0.0 if done == 1 else float(least + most) / 2), done

    def freeze(self) -> "RankIndex":
        self._first = np.array([s[0] for s in self.segments], np.int64)
        self._differences = np.concatenate(self.residuals) if self.residuals else np.empty(0, np.int8)
        return self

    def offset(self, rank: int) -> int:
        """The offset of a boundary, from 0."""
        first, start, slope = self.segments[int(np.searchsorted(self._first, rank, side="right")) - 1]
        return start + int(np.rint(slope * (rank - first))) + int(self._differences[rank])


def index_of(text: str, error: int = ERROR) -> RankIndex:
    index = RankIndex(error)
    for part in boundaries(text):
        index.add(part)
    return index.freeze()


def cut_points(text: str, one: int, other: int) -> tuple[int, int, int]:
    """Number of tokens, and the offsets after the smaller and the larger of two numbers taken modulo it plus one."""
    index = index_of(text)
    ranks = sorted((one % (index.size + 1), other % (index.size + 1)))
    return index.size, *(index.offset(r - 1) if r else 0 for r in ranks)


def _cuts(texts: Column, one: Column, other: Column) -> Column:
    """:func:`cut_points` of a batch of texts, each taken on its own."""
    names = ["n", "first", "second"]

    @F.arrow_udf("struct<n:bigint,first:bigint,second:bigint>")
    def cuts(texts: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
        found = [cut_points(t.as_py(), x.as_py(), y.as_py()) for t, x, y in zip(texts, ones, others)]
        columns = zip(*found) if found else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return cuts(texts, one, other)


def _hash_part(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The table with ``n_tokens``, ``form``, ``prefix``, ``middle``, ``suffix`` and ``output``, which replace columns of
    those names.

    A text is cut after two numbers of tokens that follow from the seed and the id. ``rate`` percent of the ids are
    changed, ``spm`` percent of these to suffix, prefix, middle, the others to prefix, suffix, middle. A null or empty
    text, and one that holds a sign, stays plain: its output is the text (null: empty) and its parts are null. A null id
    counts as an empty one; rows alike in id are cut at the same numbers. Texts are taken whole. No shuffle.
    """
    added = ["n_tokens", "form", "prefix", "middle", "suffix", "output"]
    body = F.coalesce(F.col("body"), F.lit(""))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"),
        F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256).alias("digest"),
    )
    h = [_hash_part(F.col("digest"), i) for i in range(4)]
    has_sign = F.lit(False)
    for sign in SIGNS:
        has_sign |= F.contains(body, F.lit(sign))
    form = (
        F.when((body == "") | has_sign | (h[2] % 100 >= rate), F.lit("plain"))
        .when(h[3] % 100 < spm, F.lit("spm"))
        .otherwise(F.lit("psm"))
    )
    cut = rows.select("row", "body", form.alias("form"), _cuts(F.col("body"), h[0], h[1]).alias("cuts"))
    first, second = F.col("cuts.first").cast("int"), F.col("cuts.second").cast("int")
    changed = F.col("form") != "plain"

    def part(start, length):
        return F.when(changed, F.substring("body", start + 1, length))

    parts = cut.select(
        "row",
        "body",
        "form",
        F.col("cuts.n").alias("n_tokens"),
        part(F.lit(0), first).alias("prefix"),
        part(first, second - first).alias("middle"),
        part(second, F.length("body")).alias("suffix"),
    )
    p, s, m = (F.concat(F.lit(sign), F.col(c)) for sign, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return parts.withColumn("output", output.otherwise(F.col("body"))).select(*kept, *added)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from. A text with a sign was left plain, so each sign is there
    once."""

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, end, 1), start, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
