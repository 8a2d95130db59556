"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

The different words of a batch that no earlier batch had are joined to one text, and its suffixes are sorted. A binary
search of every piece of the vocabulary gives the range of suffixes that start with it, so all occurrences: the edges of
a lattice over the positions. Edges are sorted by their depth, the distance of their end from the start of the word, and
relaxed in that order. A merge-based vocabulary has no path costs; what makes an edge part of the encoding is that it
and the last piece before it stay apart when merged: every prefix has one such last piece, and walking back over them
gives the encoding.
"""

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.words import mix

SPACE = "▁"
#: Code points whose words are encoded at a time; a longer text is taken in parts that end before a space.
CHARS = 1 << 21
#: Code points indexed at a time, and rows that are held as Python objects at a time.
INDEX_CHARS = 1 << 19
ROWS = 1024
#: Different words that a Python worker remembers between batches (one batch more at most).
CACHED_WORDS = 1 << 20

_SPACES = re.compile(f"(?<=[^ {SPACE}])[ {SPACE}]")
_NEVER = np.iinfo(np.int64).max


class Vocabulary:
    """The pieces of a model file with merges and byte fallback, and what they do to each other."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: model.get_score(i) for i in normal}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.letters = {p for p in self.ids if len(p) == 1}
        self.longest = max(map(len, self.ids))
        # For decoding: what each id stands for.
        self.raw = [self.pieces[i].replace(SPACE, " ").encode() for i in ids]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        for i in ids:
            if model.is_control(i):
                self.raw[i] = b""
        self.raw[self.unknown] = " ⁇ ".encode()
        self.alphabet = np.zeros(0x110000, bool)
        self.alphabet[[ord(c) for c in self.letters]] = True
        # Merges in the order of their time: equal scores are equal, letters are there from the start.
        times = np.unique([-self.scores[p] for p in self.ids if len(p) > 1])
        self.time = np.zeros(len(self.pieces), np.int64)
        for p, i in self.ids.items():
            if len(p) > 1:
                self.time[i] = np.searchsorted(times, -self.scores[p]) + 1
        self._pairs()
        # Pieces for the binary search, one row of code points each, without those that cross words or cannot come up.
        self.searched = sorted(p for p, i in self.ids.items() if SPACE not in p[1:] and self.whole[i])
        self.codes = np.zeros((len(self.searched), max(map(len, self.searched))), np.int32)
        for row, p in zip(self.codes, self.searched):
            row[: len(p)] = [ord(c) for c in p]
        self.lengths = np.array([len(p) for p in self.searched])
        self.search_ids = np.array([self.ids[p] for p in self.searched])

    def merge(self, symbols: str) -> list[str]:
        """Merge neighbours by highest score, leftmost first."""
        parts, n = list(symbols), len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(i):
            j = right[i] if i >= 0 else n
            if i >= 0 and j < n and parts[i] + parts[j] in self.scores:
                heapq.heappush(queue, (-self.scores[parts[i] + parts[j]], i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or right[i] != j or j >= n or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _pairs(self) -> None:
        """Which two pieces make a third, and the two that merge last where a piece's own letters merge to it."""
        ids, size = self.ids, len(self.pieces)
        splits = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, whole = np.array(sorted(splits), np.int64).reshape(-1, 3).T
        self.pair_keys = np.append(left * size + right, _NEVER)
        self.pair_times = np.append(self.time[whole] * 4 + 1, _NEVER)
        lengths = np.array([len(p) for p in self.pieces])
        self.first_half, self.last_half = np.arange(size), np.arange(size)
        self.whole = np.zeros(size, bool)
        self.whole[[ids[p] for p in self.letters]] = True
        for n in range(2, self.longest + 1):
            at = (lengths[whole] == n) & self.whole[left] & self.whole[right]
            a, b, c = left[at], right[at], whole[at]
            made = self.apart(a, b, merged=True)
            self.whole[c[made]] = True
            self.first_half[c[made]], self.last_half[c[made]] = a[made], b[made]

    def apart(self, a: np.ndarray, b: np.ndarray, merged: bool = False) -> np.ndarray:
        """Whether neighbours a and b, which their own letters merge to, stay as they are when all letters are merged.
        With ``merged``, whether they get there, though they may merge with each other in the end.

        Merges happen by score and, of equal ones, from the left. Going back in time, the later of the two pieces' last
        merges is undone again and again; a merge across the border that comes before it would have prevented it.
        """
        out, rows = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 0 if merged else _NEVER)
        size = len(self.pieces)
        while len(rows):
            key = a * size + b
            at = np.searchsorted(self.pair_keys, key)
            early = (self.pair_keys[at] == key) & (self.pair_times[at] < limit)
            out[rows[early]] = False
            left, right = self.time[a] * 4, self.time[b] * 4 + 2
            on = ~early & ((left > 0) | (right > 2))
            rows, a, b, left, right = rows[on], a[on], b[on], left[on], right[on]
            undo = left > right
            limit = np.where(undo, left, right)
            a, b = np.where(undo, self.last_half[a], a), np.where(undo, b, self.first_half[b])
        return out

    def spaces(self, n: int) -> np.ndarray:
        """Ids of a run of spaces."""
        return np.array([self.ids[x] for x in self.merge(SPACE * n)], np.int32)

    def foreign(self, letter: str) -> np.ndarray:
        """Ids of a letter that is no piece: its bytes, or the unknown piece."""
        raw = letter.encode("utf-8", "replace")
        return np.array([self.bytes[x] for x in raw] if self.bytes else [self.unknown], np.int32)


class SuffixIndex:
    """Suffixes of a text, sorted by as many of their first code points as one number holds."""

    def __init__(self, text: np.ndarray):
        there = np.zeros(int(text.max(initial=0)) + 1, np.uint64)
        there[text] = 1
        self.text, self.rank = text, np.cumsum(there) * there
        self.bits = max(1, int(there.sum()).bit_length())
        self.width = 63 // self.bits
        key = np.zeros(len(text), np.uint64)
        letters = self.rank[text]
        for i in range(self.width):
            key <<= np.uint64(self.bits)
            key[: max(0, len(text) - i)] |= letters[i:]
        self.order = np.argsort(key)
        self.keys = key[self.order]

    def occurrences(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every occurrence of every piece, a padded row of code points each.

        Two binary searches of all pieces at once give the range of suffixes with the same beginning; what a piece has
        beyond the number is compared there.
        """
        known = codes < len(self.rank)
        rank = np.where(known, self.rank[np.where(known, codes, 0)], np.uint64(0))
        inside = np.arange(codes.shape[1]) < lengths[:, None]
        there = np.flatnonzero(((rank > 0) | ~inside).all(axis=1))
        low = np.zeros(len(there), np.uint64)
        for i in range(self.width):
            low <<= np.uint64(self.bits)
            if i < codes.shape[1]:
                low |= np.where(inside[there, i], rank[there, i], np.uint64(0))
        open_ = np.maximum(self.width - lengths[there], 0).astype(np.uint64) * np.uint64(self.bits)
        first = np.searchsorted(self.keys, low)
        last = np.searchsorted(self.keys, low + (np.uint64(1) << open_))
        count = last - first
        at, piece = self.order[flat_ranges(first, count)], np.repeat(there, count)
        long = np.flatnonzero(lengths[piece] > self.width)
        wrong = [long[:0]]
        for i in range(self.width, codes.shape[1]):
            long = long[lengths[piece[long]] > i]
            place = np.minimum(at[long] + i, len(self.text) - 1)
            same = (self.text[place] == codes[piece[long], i]) & (at[long] + i < len(self.text))
            wrong.append(long[~same])
            long = long[same]
        kept = np.ones(len(at), bool)
        kept[np.concatenate(wrong)] = False
        return at[kept], piece[kept]


def encode_words(codes: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words one after the other, and how many each has. Their letters are all pieces, and they have at most one
    space sign, in front."""
    begin = np.cumsum(sizes + 1) - sizes - 1
    word_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    text = np.full(len(word_of), 10, np.int32)  # words are told apart by a newline, which is in no piece
    text[np.arange(len(codes)) + word_of_letters(sizes)] = codes
    start, piece = SuffixIndex(text).occurrences(vocabulary.codes, vocabulary.lengths)
    depth = (start - begin[word_of[start]]) + vocabulary.lengths[piece]  # all edges of one depth are relaxed together
    by = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")
    start, piece, depth = start[by], piece[by], depth[by]
    ids, end = vocabulary.search_ids[piece], start + vocabulary.lengths[piece]
    first = depth == vocabulary.lengths[piece]
    last = np.full(len(text) + 1, -1, np.int64)  # the last piece of the encoding up to a position
    origin = np.full(len(text) + 1, -1, np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
    size = len(vocabulary.pieces)
    for a, b in zip(cuts[:-1], cuts[1:]):
        s, p, e, fits = start[a:b], ids[a:b], end[a:b], first[a:b].copy()
        later = np.flatnonzero(~fits & (last[s] >= 0))
        pairs, inverse = np.unique(last[s[later]] * size + p[later], return_inverse=True)
        fits[later] = vocabulary.apart(*np.divmod(pairs, size))[inverse]
        last[e[fits]], origin[e[fits]] = p[fits], s[fits]
    # The way back of all words at once, one piece of each in every step.
    rows, at, steps = np.arange(len(sizes)), begin + sizes, []
    while len(rows):
        steps.append((rows, last[at]))
        at = origin[at]
        on = at > begin[rows]
        rows, at = rows[on], at[on]
    counts = np.zeros(len(sizes), np.int64)
    for rows, _ in steps:
        counts[rows] += 1
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for i, (rows, found) in enumerate(steps):
        out[ends[rows] - 1 - i] = found
    return out, counts


def word_of_letters(sizes: np.ndarray) -> np.ndarray:
    """The number of the word that each letter belongs to, for words one after the other."""
    return np.repeat(np.arange(len(sizes)), sizes)


def flat_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … for count[0] numbers, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _odd(n: int) -> np.ndarray:
    """An odd number per place of a word, for sums that hash its letters."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


class Encoder:
    """Encodes batches of texts as the model does, without begin and end.

    A text is cut where no piece reaches across: before spaces, before the last of several spaces, and around letters
    that are no piece. Of the words that come out, each different one of a batch is encoded once.
    """

    def __init__(self, model_file: str):
        self.vocabulary = Vocabulary(model_file)
        self._factors = _odd(64)
        self._forget()

    def _forget(self) -> None:
        """Words of earlier batches: their sorted hashes, and for each where its ids start and how many it has."""
        self._hashes = np.full(1, np.iinfo(np.uint64).max, np.uint64)
        self._start, self._count = np.zeros((2, 1), np.int64)
        self._ids = np.empty(0, np.int32)

    def _distinct(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
        """Hashes of 64 bits of the letters of the different words, a word for each, and which one every word is."""
        longest = int(sizes.max(initial=1))
        if longest > len(self._factors):
            self._factors = _odd(2 * longest)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = codes[np.repeat(begin, sizes) + place].astype(np.uint64) * self._factors[place]
        hashes = np.add.reduceat(letters, np.cumsum(sizes) - sizes) if len(sizes) else letters
        return np.unique(mix(hashes ^ sizes.astype(np.uint64)) >> np.uint64(1), return_index=True, return_inverse=True)

    def _words(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, and where those of every word start and how many they are."""
        hashes, one, which = self._distinct(codes, begin, sizes)
        if len(self._hashes) > CACHED_WORDS:
            self._forget()
        fresh = np.flatnonzero(self._hashes[np.searchsorted(self._hashes, hashes)] != hashes)
        begin, sizes, ids, counts, at = begin[one[fresh]], sizes[one[fresh]], [self._ids], [], 0
        total = np.concatenate([[0], np.cumsum(sizes)])
        while at < len(fresh):
            end = max(at + 1, int(np.searchsorted(total, total[at] + INDEX_CHARS, side="right")) - 1)
            part = codes[flat_ranges(begin[at:end], sizes[at:end])]
            found = encode_words(part, sizes[at:end], self.vocabulary)
            ids.append(found[0])
            counts.append(found[1])
            at = end
        if counts:
            count = np.concatenate(counts)
            place = np.searchsorted(self._hashes, hashes[fresh])
            start = np.cumsum(count) - count + len(self._ids)
            self._hashes = np.insert(self._hashes, place, hashes[fresh])
            self._start, self._count = np.insert(self._start, place, start), np.insert(self._count, place, count)
            self._ids = np.concatenate(ids)
        known = np.searchsorted(self._hashes, hashes)
        return self._ids, self._start[known][which], self._count[known][which]

    def _batch(self, parts: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of joined texts that start at ``starts``, and where those of each text begin."""
        v = self.vocabulary
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.int32).copy()
        codes[codes == 32] = ord(SPACE)
        fresh = np.zeros(len(codes), bool)
        fresh[starts] = True
        space, own = codes == ord(SPACE), v.alphabet[codes]
        again = space.copy()  # spaces right after a space of the same text
        again[1:] &= space[:-1]
        again &= ~fresh
        more = np.zeros(len(codes), bool)  # spaces right before one
        more[:-1] = again[1:]
        cut = fresh | ~own | (space & ~more) | (space & ~again)
        cut[1:] |= ~own[:-1]
        begin = np.flatnonzero(cut)
        sizes = np.diff(begin, append=len(codes))
        runs, foreign = more[begin], ~own[begin]
        plain = ~runs & ~foreign
        ids, start, count = self._words(codes, begin[plain], sizes[plain])
        at, n = np.zeros((2, len(begin)), np.int64)
        at[plain], n[plain] = start, count
        table, size = [ids], len(ids)

        def add(rows, values, make):
            nonlocal size
            for value in np.unique(values):
                made = make(value)
                table.append(made)
                same = rows[values == value]
                at[same], n[same] = size, len(made)
                size += len(made)

        rows = np.flatnonzero(foreign)
        add(rows, codes[begin[rows]], lambda code: v.foreign(chr(code)))
        rows = np.flatnonzero(runs)
        lone = v.ids.get(SPACE, -1)
        # Where the word after a run of spaces has a piece for its own space alone, that space belongs to the run.
        joins = ids[at[rows + 1]] == lone if len(rows) else rows
        add(rows, sizes[rows] + joins, lambda k: v.spaces(int(k)))
        at[rows + 1] += joins
        n[rows + 1] -= joins
        before = np.concatenate([[0], np.cumsum(n)])
        return np.concatenate(table)[flat_ranges(at, n)], before[np.searchsorted(begin, starts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        rows, parts, size = [], [], 0

        def flush():
            starts = np.cumsum([0, *map(len, parts)])
            ids, borders = self._batch(parts, starts[:-1])
            for row, a, b in zip(rows, borders, [*borders[1:], len(ids)]):
                out[row].append(ids[a:b])

        for row, text in enumerate(texts):
            for part in text_parts(text):
                if rows and size + len(part) > CHARS:
                    flush()
                    rows, parts, size = [], [], 0
                rows.append(row)
                parts.append(part)
                size += len(part)
        if rows:
            flush()
        return [found[0] if len(found) == 1 else np.concatenate([np.empty(0, np.int32), *found]) for found in out]


def text_parts(text: str) -> Iterator[str]:
    """The text with the space that encoding puts in front, cut before single spaces into parts of about ``CHARS``."""
    at, sign = 0, SPACE
    while at < len(text):
        gap = _SPACES.search(text, at + CHARS) if len(text) - at > CHARS else None
        end = gap.start() if gap else len(text)
        yield sign + text[at:end]
        at, sign = end, ""


def decode_ids(ids, raw: list[bytes]) -> str:
    """The text of piece ids: the space that encoding put in front is taken off, bytes that are no character show as
    U+FFFD."""
    return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


@cache
def encoder(model_file: str) -> Encoder:
    """One encoder per Python worker, with what it has learned from earlier batches."""
    return Encoder(model_file)


def encode(docs: DataFrame, model_file: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """The table with the piece ids of ``text_col`` in the column ``into``, which replaces a column of that name: the
    ids that the model's library gives for the whole text, without begin and end.

    A null or empty text has no ids. Texts of any length are encoded whole, word by word. Ids of rows are not read;
    repeated rows stay. There is no shuffle.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        own = encoder(model_file)
        parts = []
        for at in range(0, len(texts), ROWS):
            found = own.encode([t or "" for t in texts.slice(at, ROWS).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(into, ids(F.col(f"`{text_col}`").cast("string")))


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """The table with the text of ``ids_col`` in the column ``into``, which replaces a column of that name.

    Null ids give a null text, no ids an empty one. The text is the one that was encoded, except that U+2581 comes
    back as a space.
    """

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        raw = encoder(model_file).vocabulary.raw
        return pa.array((decode_ids(x.values.to_numpy().tolist(), raw) if x.is_valid else None for x in ids), pa.string())

    return encoded.withColumn(into, text(F.col(f"`{ids_col}`")))
