"""N-gram Jaccard join by T-occurrence search over inverted lists, and the groups its links form.

Two texts link when the Jaccard similarity of their shingle sets reaches a limit, that is, when they share at least
T = limit / (1 + limit) * (sizes) shingles. Of a text's lists, all but the longest T - 1 must hold at least one partner:
these short lists (the rarest shingles) are where texts meet; the long lists are probed. Distribution follows that:

1. Every set gets a 64-bit fingerprint; equal sets are one node from here on. The same pass counts shingles that are
   common among the texts of a task; sums of these counts name the hot lists, a bounded number.
2. Shingle and node go to the shingle's range of hashes, packed as sorted arrays. There the length of every list (the
   number of sets that hold it) is counted exactly. Lists of one set cannot link anything and end here. Hot lists do
   not pass there: their counts are broadcast, and what they hold goes to the range of its node at once.
3. All lists return to their node, which orders them by length and keeps the short ones as meeting places. Any order
   finds all links as long as it is the same for all nodes; so the counts of hot lists need not be exact.
4. Every node is compared with one hub per meeting place. Links found label whole clusters of copies, so that members
   of one cluster are never compared with each other again.
5. Meeting places with more than one label are searched in blocks of bounded size, across labels only: first by
   counting short lists, then, with whole sets and only for texts that may have a partner, by DivideSkip: a heap merges
   the short lists and jumps over what cannot reach the overlap, long lists are probed.
6. Links are merged to components.

A hash of 64 bits stands for a shingle and a set; everything else is exact and no list, candidate or group is cut short.
"""

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.components import connected_components
from cardwatch.llm.lines import row_key
from cardwatch.llm.skew import hot_rows, join_by_key
from cardwatch.llm.words import mix, shingle_sets
from cardwatch.sources.session import materialize

#: Shingles that meet in one range of hashes, texts in one block of a search, and texts whose shingles are sorted at a time.
RANGE_ROWS = 2_000_000
BLOCK = 2048
TEXTS = 4096

#: Shingles in one block of a search, whatever its number of texts; one text is the least.
BLOCK_SHINGLES = 2_000_000

#: Lists are hot from this length on, and from this part of all shingles on: there are at most HOT_LISTS of them. A
#: shingle is looked at where one of COMMON of the texts that are sorted at a time hold it.
HOT_LIST = 10_000
HOT_LISTS = 1 << 20
COMMON = 256

#: The most tasks that count lists; with more ranges a task takes several, one after the other.
MOST_TASKS = 1 << 15

_SALT = np.uint64(0xD6E8FEB86659FD93)


def fingerprint(found: np.ndarray) -> int:
    """64 bits of a set of shingles as a signed number; 0 for the empty set."""
    if not len(found):
        return 0
    total = np.add.reduce(mix(found ^ _SALT), dtype=np.uint64) + np.uint64(len(found))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sizes(size):
    """Number of shingles and node of every row, and, on the first row of every ``TEXTS`` texts or fewer of a task, the
    shingles that many of their sets hold."""

    def run(batches):
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            n, node, sets = [], [], {}
            for _, s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                node.append(fingerprint(s))
                sets[node[-1]] = s
            common, held = np.unique(np.concatenate([*sets.values(), np.empty(0, np.uint64)]), return_counts=True)
            many = held >= max(4, -(-len(sets) // COMMON))
            noted = [(common[many].view(np.int64), held[many]), *[(None, None)] * (len(n) - 1)][: len(n)]
            columns = [
                batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                pa.array([c for c, _ in noted], pa.list_(pa.int64())), pa.array([h for _, h in noted], pa.list_(pa.int64())),
                *batch.columns[2:],
            ]
            yield pa.record_batch(columns, ["id", "n", "node", "common", "held", *batch.schema.names[2:]])

    return run


_SIZED = "id long, n long, node long, common array<bigint>, held array<bigint>"


def hot_lists(sized: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the hot lists and their counts. Counts add up to ``total`` at most, so the least count of a hot
    list bounds their number: the driver and each executor hold 16 bytes for each of ``HOT_LISTS`` lists at most."""
    each = sized.where("common IS NOT NULL").select(F.explode(F.arrays_zip("common", "held")).alias("x"))
    counts = each.groupBy(F.col("x.common").alias("common")).agg(F.sum("x.held").alias("held"))
    found = counts.where(F.col("held") >= max(HOT_LIST, -(-total // HOT_LISTS))).toArrow()
    hashes, held = (found.column(c).to_numpy() for c in ("common", "held"))
    hashes = hashes.astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], held.astype(np.int64)[order]


def _find(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the known ones, and where."""
    if not len(known):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes, at


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the first one and the steps to the next, in 6 bytes where all steps fit."""
    steps = np.diff(hashes)
    if len(steps) and int(steps.max()) < 1 << 48:
        return b"6" + hashes[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"8" + hashes.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"8":
        return np.frombuffer(data, np.uint64, offset=1)
    steps = np.zeros(((len(data) - 9) // 6 + 1, 8), np.uint8)
    steps[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    steps = steps.view(np.uint64).ravel()
    steps[0] = np.frombuffer(data, np.uint64, 1, offset=1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the ranges of sorted 64-bit keys begin, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _to_ranges(size, bits, hot, copies):
    """Sets by ranges of hashes (from 0 on) and, for hot lists, by ranges of nodes (below 0). Of a node with very many
    rows only rows with its smallest id send their set."""
    names = ["part", "nodes", "sizes", "owner", "hashes"]

    def packed(part, nodes, sizes, owner, hashes):
        used, local = np.unique(owner, return_inverse=True)
        small = local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
        return part, nodes[used].tobytes(), sizes[used].tobytes(), small.tobytes(), _pack(hashes)

    def run(batches):
        known, _ = hot.value
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            sets, ids = {}, batch.column(0).to_pylist()
            for row, s in shingle_sets(batch.column(1), size):
                if len(s):
                    node = fingerprint(s)
                    if node not in sets and copies.value.get(node, ids[row]) == ids[row]:
                        sets[node] = s
            if not sets:
                continue
            nodes = np.array(list(sets), np.int64)
            order = np.argsort(nodes.view(np.uint64))  # owners are in the order of their ranges
            nodes, sets = nodes[order], [s for _, s in sorted(sets.items(), key=lambda x: x[0] % (1 << 64))]
            sizes = np.array([len(s) for s in sets], np.int32)
            hashes = np.concatenate(sets)
            owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), sizes)
            order = np.argsort(hashes)
            hashes, owner = hashes[order], owner[order]
            is_hot, _ = _find(known, hashes)
            rows = []
            if is_hot.any():
                parts = np.searchsorted(_cuts(nodes.view(np.uint64), bits), owner[is_hot], "right") - 1
                order = np.argsort(parts, kind="stable")  # hashes stay in their order within a part
                held, by, parts = hashes[is_hot][order], owner[is_hot][order], parts[order]
                for mine in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
                    rows.append(packed(-1 - int(parts[mine[0]]), nodes, sizes, by[mine], held[mine]))
                hashes, owner = hashes[~is_hot], owner[~is_hot]
            cuts = _cuts(hashes, bits)
            for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    rows.append(packed(part, nodes, sizes, owner[a:b], hashes[a:b]))
            for i in range(0, len(rows), 16):
                columns = zip(zip(*rows[i : i + 16]), [pa.int32(), *[pa.binary()] * 4])
                yield pa.record_batch([pa.array(x, kind) for x, kind in columns], names)

    return run


def _count_lists(bits, hot):
    """Of one range of hashes: the lists of two or more sets, with their lengths, dealt to the nodes' ranges. Of one range
    of nodes: what their hot lists hold, with the counts of these."""

    def run(table: pa.Table) -> pa.Table:
        hashes, nodes, sizes = [], [], []
        for row in zip(*(table.column(c).to_pylist() for c in ("nodes", "sizes", "owner", "hashes"))):
            h = _unpack(row[3])
            owner = np.frombuffer(row[2], np.uint16 if len(row[2]) == 2 * len(h) else np.uint32)
            hashes.append(h)
            nodes.append(np.frombuffer(row[0], np.int64)[owner])
            sizes.append(np.frombuffer(row[1], np.int32)[owner])
        hashes, nodes, sizes = map(np.concatenate, (hashes, nodes, sizes))
        by_node = table.column("part")[0].as_py() < 0
        if not by_node:
            order = np.argsort(hashes, kind="stable")  # merges sorted runs
            hashes, nodes, sizes = hashes[order], nodes[order], sizes[order]
            again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
            keep = again | np.concatenate([again[1:], [False]])
            hashes, nodes, sizes = hashes[keep], nodes[keep], sizes[keep]
        order = np.lexsort((nodes, hashes))
        hashes, nodes, sizes = hashes[order], nodes[order], sizes[order]
        # A set that came from several tasks counts once.
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (nodes[1:] != nodes[:-1])
        hashes, nodes, sizes = hashes[new], nodes[new], sizes[new]
        if by_node:
            known, held = hot.value
            length = held[_find(known, hashes)[1]]
        else:
            start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, int)
            length = np.repeat(np.diff(np.append(start, len(hashes))), np.diff(np.append(start, len(hashes))))
            keep = length > 1
            hashes, nodes, sizes, length = hashes[keep], nodes[keep], sizes[keep], length[keep]
        order = np.argsort(nodes.view(np.uint64), kind="stable")
        hashes, nodes, sizes, length = hashes[order], nodes[order], sizes[order], length[order]
        cuts, rows = _cuts(nodes.view(np.uint64), bits), []
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                first = np.flatnonzero(np.concatenate([[True], nodes[a + 1 : b] != nodes[a : b - 1]]))
                runs = np.diff(np.append(first, b - a)).astype(np.int32)
                rows.append(
                    (part, nodes[a:b][first].tobytes(), sizes[a:b][first].tobytes(), runs.tobytes(),
                     hashes[a:b].tobytes(), length[a:b].astype(np.int64).tobytes())
                )
        kinds = [pa.int32(), *[pa.binary()] * 5]
        columns = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "nodes", "sizes", "runs", "hashes", "lengths"])

    return run


def _short_lists(percent):
    """Of one range of nodes: every node's shared shingles, and those of its short lists in which it meets others."""

    def run(table: pa.Table) -> pa.Table:
        columns = [[] for _ in range(5)]
        for row in zip(*(table.column(c).to_pylist() for c in ("nodes", "sizes", "runs", "hashes", "lengths"))):
            runs = np.frombuffer(row[2], np.int32)
            for out, values in zip(
                columns,
                (
                    np.repeat(np.frombuffer(row[0], np.int64), runs),
                    np.repeat(np.frombuffer(row[1], np.int32), runs),
                    np.frombuffer(row[3], np.uint64),
                    np.frombuffer(row[4], np.int64),
                ),
            ):
                out.append(values)
        nodes, sizes, hashes, lengths = map(np.concatenate, columns[:4])
        order = np.lexsort((hashes, lengths, nodes))
        nodes, sizes, hashes = nodes[order], sizes[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        out = []
        for a, b in zip(first, np.append(first[1:], len(nodes))):
            n = int(sizes[a])
            least = -(-percent * n // 100)  # shingles that any partner shares
            # The n - (b - a) lists of this set alone are the shortest of all.
            meet = n - least + 1 - (n - int(b - a))
            if meet > 0:
                own = hashes[a:b]
                out.append((int(nodes[a]), n, own[:meet].view(np.int64).tolist(), np.sort(own).tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], ["node", "n", "meet", "shared"])

    return run


def _links(both: int, n: int, m: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _verify(percent):
    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
            keep = [
                _links(len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), True)), s, t, percent)
                for p, q, s, t in zip(x, y, n, m)
            ]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def merge_skip(lists, least):
    """(member, number of lists that hold it) of the members of at least ``least`` of the sorted lists.

    A heap holds the next member of every list. Members found too seldom are left together with the next ones, up to
    ``least - 1`` lists in all, and these lists jump to the member that is then on top: none before it can be in
    ``least`` lists.
    """
    heap = [(members[0], k) for k, members in enumerate(lists) if members]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        top, out = heap[0][0], []
        while heap and heap[0][0] == top:
            out.append(heapq.heappop(heap)[1])
        if len(out) >= least:
            yield top, len(out)
            goal = top + 1
        else:
            while heap and len(out) < least - 1:
                out.append(heapq.heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
        for k in out:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))


def divide_skip(sets, sizes, labels, queries, percent):
    """Pairs of positions that link and have different labels: each query against all sets.

    Sets are sorted arrays. A query's lists are ordered by length; the longest L are set aside, a heap merges the
    others, and what occurs at least T - L times in them is looked up in the long lists by binary search. ``labels`` is
    read anew for every query, so the caller may join labels on the way.
    """
    flat = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.lexsort((member, flat))
    flat, member = flat[order], member[order]
    terms, start = np.unique(flat, return_index=True)
    stop = np.append(start[1:], len(flat))
    sizes, labels = np.asarray(sizes, np.int64), np.asarray(labels)
    for q in queries:
        # Both sizes bound what can be shared.
        wanted = (labels != labels[q]) & (100 * sizes >= percent * sizes[q]) & (100 * sizes[q] >= percent * sizes)
        wanted[q] = False
        if not wanted.any():
            continue
        at = np.searchsorted(terms, sets[q])
        lists = [x[wanted[x]] for x in (member[start[i] : stop[i]] for i in at)]
        lists = sorted((x for x in lists if len(x)), key=len)
        needed = -(-percent * int(sizes[q]) // 100)
        if len(lists) < needed:
            continue
        longest = len(lists[-1])
        aside = min(needed - 1, len(lists) - 1, int(needed / (0.01 * math.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        merged = list(merge_skip([x.tolist() for x in short], max(1, needed - aside)))
        if not merged:
            continue
        found, both = np.array(merged, np.int64).T
        for held in long:
            place = np.minimum(np.searchsorted(held, found), len(held) - 1)
            both = both + (held[place] == found)
        for y in found[100 * both >= percent * (sizes[q] + sizes[found] - both)]:
            yield q, int(y)


def _lists(values):
    """Inverted lists of arrays: all values in order, and which array each is from."""
    flat, member = np.concatenate(values), np.repeat(np.arange(len(values)), [len(v) for v in values])
    order = np.argsort(flat, kind="stable")
    return flat[order], member[order]


def _members(lists, wanted):
    flat, member = lists
    cuts = zip(np.searchsorted(flat, wanted), np.searchsorted(flat, wanted, "right"))
    return np.concatenate([member[a:b] for a, b in cuts]) if len(wanted) else member[:0]


def short_list_partners(meets, places, here, sizes, labels, queries, percent):
    """Positions of sets that may have a partner with another label among the queries, or that are such queries.

    Two sets that meet in several places are compared in the first of them only: ``places`` has all places of a set,
    ``here`` is this one.

    Of what two sets share, at most ceil(limit * size) - 1 is in the long lists of the one whose short lists end first.
    So they share at least T minus the larger of these numbers in their short lists, which are counted here.
    """
    by_meet, by_place = _lists(meets), _lists([p[p < here] for p in places])
    sizes, labels = np.asarray(sizes, np.int64), np.asarray(labels)
    aside = -(-percent * sizes // 100) - 1
    may = np.zeros(len(meets), bool)
    for q in queries:
        count = np.bincount(_members(by_meet, meets[q]), minlength=len(meets))
        count[_members(by_place, places[q][places[q] < here])] = 0
        needed = -(-percent * (sizes + sizes[q]) // (100 + percent)) - np.maximum(aside, aside[q])
        partner = (count >= np.maximum(needed, 1)) & (labels != labels[q])
        partner &= (100 * sizes >= percent * sizes[q]) & (100 * sizes[q] >= percent * sizes)
        if partner.any():
            may |= partner
            may[q] = True
    return np.flatnonzero(may)


def by_group(table: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """``function`` of the rows of every group, as an Arrow table. Groups are many and small: they are sorted next to
    each other and cut in Python, which costs far less than one call from the JVM for each."""

    def run(batches):
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if rest is None else pa.concat_tables([rest, held])
            columns = [held.column(k).to_numpy() for k in keys]
            new = np.zeros(max(0, len(held) - 1), bool)
            for c in columns:
                new |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1])
            groups = [held.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]
            rest = held.slice(cuts[-1])
            if groups:
                yield from pa.concat_tables([function(g) for g in groups]).to_batches()
        if rest is not None and len(rest):
            yield from function(rest).to_batches()

    return table.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _screen(percent):
    def run(table: pa.Table) -> pa.Table:
        sizes, labels = (table.column(c).to_numpy() for c in ("n", "label"))
        meets, places = ([np.array(m, np.int64) for m in table.column(c).to_pylist()] for c in ("meet", "places"))
        here = table.column("t")[0].as_py()
        asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        found = short_list_partners(meets, places, here, sizes, labels, asks, percent)
        return table.select(["t", "i", "j", "node", "label", "asks"]).take(pa.array(found, pa.int64()))

    return run


def _search(percent, every):
    def run(table: pa.Table) -> pa.Table:
        nodes, sizes = (table.column(c).to_numpy() for c in ("node", "n"))
        labels = table.column("label").to_numpy().copy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shared").to_pylist()]
        asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        out = []
        for q, y in divide_skip(sets, sizes, labels, asks, percent):
            if every or labels[q] != labels[y]:
                out.append((int(nodes[q]), int(nodes[y])))
            if not every:  # a link between parts that are joined already adds nothing to the components
                labels[labels == labels[y]] = labels[q]
        a, b = zip(*out) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def meeting_places(meets: DataFrame) -> DataFrame:
    """``t``, ``hub`` and the number ``k`` of nodes of the places where two or more nodes meet. Places where the same texts meet are one: texts that
    share a passage share all of its shingles. Any number of nodes may meet in one place."""
    who = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"who{i}") for i in (1, 2)]
    places = meets.groupBy("t").agg(F.min("node").alias("hub"), F.count("*").alias("k"), *who).where("k > 1")
    return places.groupBy("k", "hub", "who1", "who2").agg(F.min("t").alias("t")).select("t", "hub", "k")


def near_duplicate_groups(
    docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Words are runs without ASCII white space, A-Z lowered; a set holds the distinct runs of ``words`` words, or the
    whole sequence of a shorter text. Rows link when 100 * shared >= percent * united. ``component_id`` is the smallest
    id reachable over links, the row's own included. Null, empty and blank texts have the empty set and link with
    nothing. A null id is never a component's id; a row with a null id and no partner has a null component. Rows that
    share an id are judged by their own texts. Other columns are not read. An empty table gives an empty table.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("body"))
    sized = materialize(source.mapInArrow(_sizes(words), _SIZED))
    grouped = _components(source, sized, words, percent)
    first = sized.where("n > 0").groupBy("node").agg(F.min("id").alias("first"))
    grouped = first.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.select("node", "component").join(ids, "component").select("node", "component_id")
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return sized.join(named, "node", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), alone.alias("component_id")
    )


def near_duplicate_rows(
    docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``a``, ``b`` and ``component`` of every row, by the links of ``near_duplicate_groups``.

    ``a`` and ``b`` are the row's key (``row_key`` of id and text, null as empty). ``component`` is the same number for
    all rows, and only those, that are reachable over links, whatever their ids; it is null for the empty set.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("body"))
    key = row_key(F.col("id"), F.coalesce("body", F.lit("")))
    keyed = source.select("id", "body", key.getField("a").alias("a"), key.getField("b").alias("b"))
    sized = materialize(keyed.mapInArrow(_sizes(words), f"{_SIZED}, a long, b long"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    return sized.join(_components(source, sized, words, percent), "node", "left").select(
        F.col("id").alias("doc_id"), "a", "b", component.alias("component")
    )


def near_duplicate_links(
    docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The whole join: ``doc_id``, ``n_shingles``, ``node`` and ``n_links`` of every row, and all links ``a``, ``b`` (a < b)
    between nodes.

    Rows with equal sets are one node, and link with each other; a node stands for its rows, so copies are not expanded
    into pairs. ``n_links`` is the number of other rows that the row links with. The empty set has the node 0 and no
    links. Every pair of different sets that reaches the limit is a link; what is quadratic is this result, so where
    groups of rows are wanted, ``near_duplicate_groups`` costs less. Rows are judged as there.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("body"))
    sized = materialize(source.mapInArrow(_sizes(words), _SIZED))
    sets, members = _meetings(source, sized, words, percent)
    found = _across(sets, members.select("t", "node", "n", F.col("node").alias("label")), percent, every=True)
    links = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rows = sized.where("n > 0").groupBy("node").agg(F.count("*").alias("rows"))
    both = links.select("a", F.col("b").alias("node")).union(links.select(F.col("b").alias("a"), F.col("a").alias("node")))
    others = both.join(rows, "node").groupBy(F.col("a").alias("node")).agg(F.sum("rows").alias("others"))
    counts = rows.join(others, "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    named = sized.join(counts, "node", "left")
    return named.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "node", F.coalesce("n_links", F.lit(0)).alias("n_links")
    ), links


def _components(source: DataFrame, sized: DataFrame, words: int, percent: int) -> DataFrame:
    """``node`` and ``component`` of the nodes that link with another one."""
    sets, members = _meetings(source, sized, words, percent)
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("shared").alias("s1"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("shared").alias("s2"))
    hubs = materialize(
        pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "n2", "s1", "s2")
        .mapInArrow(_verify(percent), "a long, b long")
    )
    label = hubs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    labelled = members.select("t", "node", "n").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return connected_components(hubs.unionByName(_across(sets, labelled, percent, every=False)))


def _meetings(source: DataFrame, sized: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every node with its shared shingles, and ``t``, ``node``, ``n`` and ``hub`` of the nodes of every meeting place."""
    spark = source.sparkSession
    total = sized.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / RANGE_ROWS))))
    hot = spark.sparkContext.broadcast(hot_lists(sized, total))
    # Nodes with very many rows; as many at most as there are hot keys.
    rows = sized.where("n > 0").groupBy("node").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    many = rows.where(F.col("k") >= hot_rows(sized.count())).where("id IS NOT NULL").select("node", "id").collect()
    copies = spark.sparkContext.broadcast({r.node: r.id for r in many})

    packed = source.select("id", "body").mapInArrow(
        _to_ranges(words, bits, hot, copies), "part int, nodes binary, sizes binary, owner binary, hashes binary"
    )
    # A partition per range or so, however many the table has, so that tasks stay as small as ranges.
    tasks = min(MOST_TASKS, max(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counted = packed.repartition(tasks, "part").groupBy("part").applyInArrow(
        _count_lists(bits, hot), "part int, nodes binary, sizes binary, runs binary, hashes binary, lengths binary"
    )
    sets = materialize(
        counted.repartition(tasks, "part").groupBy("part")
        .applyInArrow(_short_lists(percent), "node long, n int, meet array<bigint>, shared binary")
    )
    meets = materialize(sets.select("node", "n", F.explode("meet").alias("t")))
    places = materialize(meeting_places(meets))
    return sets, join_by_key(meets, places, ["t"], "k", meets.count())


def _across(sets: DataFrame, labelled: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links ``a``, ``b`` between nodes that meet and have different labels: all of them, or enough to join what they join."""
    labelled = materialize(labelled)
    # What a place holds: its smallest label is the main one, the nodes of all others ask.
    each = labelled.groupBy("t", "label").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    main = F.min("label"), F.max("label"), F.min_by("k", "label"), F.min_by("s", "label"), F.sum("k"), F.sum("s")
    split = each.groupBy("t").agg(*[c.alias(a) for c, a in zip(main, ("main", "other", "k1", "s1", "k", "s"))])
    blocks = lambda k, s: F.ceil(F.greatest(F.expr(k) / BLOCK, F.expr(s) / BLOCK_SHINGLES)).cast("int")
    split = split.where("main < other").select("t", "main", "k", blocks("k - k1", "s - s1").alias("rb"), blocks("k1", "s1").alias("mb"))
    open_ = (
        join_by_key(labelled, materialize(split), ["t"], "k", labelled.count())
        .withColumn("asks", F.col("label") != F.col("main"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("rb")).otherwise(F.col("mb"))).cast("int"))
    )
    places_of = labelled.groupBy("node").agg(F.array_sort(F.collect_set("t")).alias("places"))
    own = F.col("own")
    # Askers meet each block of the main label, and each other block of askers once.
    asked = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda i: F.struct(i.alias("i"), own.alias("j"))),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("rb") - 1), lambda j: j != own),
            lambda j: F.struct((-1 - F.least(own, j)).alias("i"), F.greatest(own, j).alias("j")),
        ),
    )
    main = F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda j: F.struct(own.alias("i"), j.alias("j")))
    placed = (
        open_.withColumn("place", F.explode(F.when(F.col("asks"), asked).otherwise(main)))
        .select("t", "place.i", "place.j", "node", "label", "asks")
        .join(sets.select("node", "n", "meet"), "node")
        .join(places_of, "node")
    )
    key = ["t", "i", "j"]
    screened = materialize(by_group(placed, key, _screen(percent), "t long, i int, j int, node long, label long, asks boolean"))
    whole = screened.join(sets.select("node", "n", "shared"), "node")
    return by_group(whole, key, _search(percent, every), "a long, b long")
