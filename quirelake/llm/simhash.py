"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits. The bits are put into m groups,
correlated bits together, with thresholds T that sum to radius - m + 1: two linked fingerprints then
differ by T[i] or fewer bits in some group i. How many groups, and which thresholds, is settled by
dynamic programming on estimated candidate counts: second moments of every group's values, and of
the values with one bit left out, from signed sketches over all fingerprints.

A fingerprint is entered in a bucket for its value in each group; at T = 1 also for each value with
one set bit cleared, at T = 2 for each value with one bit flipped. Within a bucket every pair is held
against the radius, by expansion from member to member that visits each fingerprint once, and a
bucket returns a star for each set of linked fingerprints, never all pairs. Equal fingerprints are
one entry, so copies cost nothing.

``keep_one`` tests texts themselves. Its first pairs are the links of the fingerprints of the texts' sets of shingles. These tell
too little of Jaccard similarity to find all pairs (at 0.8 they differ by 9.7 bits on average), so bands of least hashes over
the same sets propose the rest.

Entries travel as arrays of (signature, fingerprint), one row for each task and slot.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is
linked like any other; null ids are kept, and are never a component's id unless all its ids are
null; repeated rows are kept; an empty table gives no rows; a text of any length counts as a whole. ``near_duplicates`` returns
``fp`` and ``component_id`` beside the id, so columns of these names aren't passed on; ``keep_one`` returns all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.components import connected
from quirelake.session import cut, forget

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
GROUP_COUNTS = (2, 3, 4, 5)
ENTRIES_PER_SLOT = 1_000_000
_SKETCH = 512
_ROW_COST = 4.0  # an entry's cost, in comparisons


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle in order, repeated ones too; none for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of XXH64 over word shingles, as an unsigned integer."""
    hashes = shingle_hashes(text, width)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes. Rows are summed 250 at a time in bytes, then in full."""
    n, totals = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 50_000):
        part = hashes[at : at + 50_000]
        whole = np.zeros(-(-len(part) // 250) * 250, np.uint64)
        whole[: len(part)] = part
        bits = np.unpackbits(whole.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.reshape(-1, 250, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(BITS) if 2 * totals[i] > n))


def fingerprint_column(text: Column, width: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t if isinstance(t, str) else None, width) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of each value that a group holds, packed."""
    out = np.zeros(len(values), np.uint64)
    for k, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits; the diagonal counts single bits."""

    def count(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = _bit_matrix(np.ascontiguousarray(batch["fp"].to_numpy(np.int64)).view(np.uint64)).astype(np.float32)
            total += bits.T @ bits
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pd.DataFrame({"i": i, "j": j, "n": total.ravel().astype(np.int64)})

    rows = fps.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r.i, r.j] = r.n
    return out


def group_bits(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of nearly equal size: a group starts with the free bit that correlates most with
    the other free bits and takes the bits that correlate most with it."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    related = np.abs(counts / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(related, 0)
    free, groups = list(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        group = [max(free, key=lambda b: (related[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _sketches(fps: DataFrame, projections: list[list[int]]) -> np.ndarray:
    """Estimated second moments of the values that each list of bits takes."""

    def sketch(batches):
        total = np.zeros((len(projections), _SKETCH), np.int64)
        for batch in batches:
            values = np.ascontiguousarray(batch["fp"].to_numpy(np.int64)).view(np.uint64)
            for k, bits in enumerate(projections):
                keep = np.uint64(sum(1 << b for b in bits))
                h = _mix(values & keep, k)
                sign = (h >> np.uint64(63)).astype(np.int64) * 2 - 1
                total[k] += np.bincount((h % np.uint64(_SKETCH)).astype(np.int64), weights=sign, minlength=_SKETCH).astype(np.int64)
        yield pd.DataFrame({"k": range(len(projections)), "raw": [row.tobytes() for row in total]})

    def merge(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(raw, np.int64) for raw in pdf["raw"])
        return pd.DataFrame({"k": [keys[0]], "moment": [float((total.astype(np.float64) ** 2).sum())]})

    rows = fps.select("fp").coalesce(256).mapInPandas(sketch, "k int, raw binary").groupBy("k").applyInPandas(merge, "k int, moment double").collect()
    out = np.zeros(len(projections))
    for r in rows:
        out[r.k] = r.moment
    return out


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up with the given sum and the least cost; costs[i][t + 1]. Dynamic programming over groups."""
    m, width = costs.shape
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, width - 1):
                key, value = used + t, cost + costs[i][t + 1]
                if key not in after or value < after[key][0]:
                    after[key] = (value, [*chosen, t])
        best = after
    return best.get(total, (float("inf"), []))


def plan(fps: DataFrame, radius: int = RADIUS, group_counts=GROUP_COUNTS) -> tuple[list[list[int]], list[int], int]:
    """Groups of bits, their thresholds, and the number of distinct fingerprints."""
    n = fps.count()
    counts = bit_counts(fps)
    layouts = {m: group_bits(counts, n, m) for m in group_counts if m <= radius + 1}
    projections, place = [], {}
    for m, groups in layouts.items():
        for g, bits in enumerate(groups):
            place[m, g] = len(projections)
            projections += [bits, *[[b for b in bits if b != left] for left in bits]]
    moments = _sketches(fps, projections)
    found = []
    for m, groups in layouts.items():  # T = 2 at most: more groups where the radius is large
        costs = np.full((m, 4), np.inf)
        for g, bits in enumerate(groups):
            at, w = place[m, g], len(bits)
            pairs = np.maximum(moments[at : at + 1 + w] - n, 0) / 2
            same = pairs[0]
            near = same + np.maximum(pairs[1:] - same, 0).sum()
            # pairs two bits apart: every near pair spreads over the other bits of the group
            far = near + near * max(w - 1, 1) / 2
            costs[g] = [0, same + _ROW_COST * n, near * (1 + w / 4) + _ROW_COST * n * (1 + w / 2), far * 2 + _ROW_COST * n * (1 + w)]
        cost, thresholds = allocate(costs, radius - m + 1)
        found.append((cost, m, groups, thresholds))
    _, _, groups, thresholds = min(found, key=lambda x: (x[0], x[1]))
    return groups, thresholds, n


def entries(values: np.ndarray, groups: list[list[int]], thresholds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the index of the fingerprint that each belongs to."""
    signatures, owners = [], []
    everyone = np.arange(len(values))
    for g, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        if t > 2:
            raise ValueError("thresholds above 2 are not planned for")
        keep = np.uint64(sum(1 << b for b in bits))
        own = values & keep
        signatures.append(_mix(own, g))
        owners.append(everyone)
        for b in bits if t else []:
            bit = np.uint64(1 << b)
            who = everyone if t == 2 else np.flatnonzero(own & bit)
            signatures.append(_mix(own[who] ^ bit, g))
            owners.append(who)
    return np.concatenate(signatures), np.concatenate(owners)


def stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join each set of linked values; a value is visited once and is held only against those not yet reached."""
    out, rest = [], np.unique(values)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                queue.extend(reached)
                out += [(int(r), int(at)) for r in reached]
    return out


_SMALL, _MIDDLE = 12, 512


def bucket_links(signatures: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal signatures. Buckets up to ``_MIDDLE`` are compared by shifting the whole array; small
    ones give their links, the others those that ``stars`` finds among values with a link. Larger ones go to ``stars`` as they are."""
    order = np.lexsort((values, signatures))
    s, v = signatures[order], values[order]
    distinct = np.concatenate([[True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])]) if len(s) else np.zeros(0, bool)
    s, v = s[distinct], v[distinct]
    if len(s) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.concatenate([first, [len(s)]]))
    end, small = np.repeat(first + size, size), np.repeat(size <= _SMALL, size)
    a, b, linked = [], [], np.zeros(len(s), bool)
    live, d = np.flatnonzero(np.repeat((size <= _MIDDLE) & (size > 1), size)), 0
    while len(live):
        d += 1
        live = live[live + d < end[live]]
        hit = live[np.bitwise_count(v[live] ^ v[live + d]) <= radius]
        linked[hit] = linked[hit + d] = True
        own = hit[small[hit]]
        a.append(v[own + d])
        b.append(v[own])
    linked |= np.repeat(size > _MIDDLE, size)
    linked &= ~small
    where = np.flatnonzero(linked)
    edges = np.searchsorted(where, np.concatenate([first, [len(s)]]))
    for i in np.flatnonzero(np.diff(edges) > 1).tolist():
        found = stars(v[where[edges[i] : edges[i + 1]]], radius)
        if found:
            pair = np.array(found, np.uint64)
            a.append(pair[:, 0])
            b.append(pair[:, 1])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, entries_per_slot: int = ENTRIES_PER_SLOT, group_counts=GROUP_COUNTS) -> DataFrame:
    """Links a, b that join all distinct fingerprints (column fp) within the radius of each other."""
    groups, thresholds, n = plan(fps, radius, group_counts)
    per_value = sum((0 if t < 0 else 1 if t == 0 else 1 + len(g) / 2 if t == 1 else 1 + len(g)) for g, t in zip(groups, thresholds, strict=True))
    slots = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n * per_value / entries_per_slot) + 1)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush():
            values = np.concatenate(held)
            signatures, owners = entries(values, groups, thresholds)
            slot = (signatures % np.uint64(slots)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            pair = np.stack([signatures[order], values[owners[order]]], axis=1)
            edges = np.searchsorted(slot[order], np.arange(slots + 1))
            used = np.flatnonzero(np.diff(edges))
            return pd.DataFrame({"slot": used, "raw": [pair[edges[i] : edges[i + 1]].tobytes() for i in used]})

        for batch in batches:
            if len(batch):
                held.append(np.ascontiguousarray(batch["fp"].to_numpy(np.int64)).view(np.uint64))
                size += len(batch)
            if size * per_value >= 2_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = np.concatenate([np.frombuffer(raw, np.uint64).reshape(-1, 2) for raw in pdf["raw"]])
        a, b = bucket_links(pair[:, 0], pair[:, 1], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    return fps.select("fp").mapInPandas(spread, "slot long, raw binary").groupBy("slot").applyInPandas(meet, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS,
    extra: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (the smallest id reachable), and ``extra`` columns."""
    keep = [F.col(c) for c in extra or []]
    marked = cut(docs.select(F.col(id_col).alias("k"), fingerprint_column(F.col(text_col), width).alias("fp"), *keep), "fingerprints")
    fps = cut(marked.groupBy("fp").agg(F.min("k").alias("least")), "distinct-fingerprints")
    roots = cut(connected(link_fingerprints(fps, radius)), "fingerprint-components")
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("k").alias(id_col), "fp", "component_id", *(extra or []))


def _shingles(text: str | None, width: int) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _similar(a: str | None, b: str | None, width: int) -> float:
    """Jaccard similarity of two texts' sets of word shingles."""
    one, two = _shingles(a, width), _shingles(b, width)
    both = len(one & two)
    union = len(one) + len(two) - both
    return both / union if union else 1.0


BANDS, ROWS = 30, 5  # at Jaccard 0.8 a pair shares no band with probability (1 - 0.8**5)**30, 7 in a million
_DRAW = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FLIP, _TIMES = _DRAW[0], _DRAW[1] | np.uint64(1)
_ALL_PAIRS, _HUBS = 64, 16
SKETCH_BYTES_PER_SLOT = 32 << 20


def bands(hashes: np.ndarray) -> np.ndarray:
    """Signatures of a set of shingles by its hashes: each is made of the least values of ``ROWS`` permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[None, at : at + 512] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = _mix(out ^ least[r::ROWS], r)
    return out


def _buckets(signatures: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by signature and node, and the edges of the buckets in it."""
    order = np.lexsort((nodes, signatures))
    s = signatures[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)


def bucket_pairs(signatures: np.ndarray, nodes: np.ndarray, roots: np.ndarray, first: int, last: int, near=None) -> tuple[np.ndarray, bool]:
    """Pairs of nodes with equal signature and different roots, and whether some are left for later rounds.

    In each bucket the members from place ``first`` up to ``last``, by node, are paired with all members after them;
    from place 1 on, buckets of up to ``_ALL_PAIRS`` are paired in full. ``near(i, others)`` says which pairs of entries count at all.
    """
    order, edges = _buckets(signatures, nodes)
    v, r = nodes[order], roots[order]
    out, left = [], False

    def after(i, b):
        found = np.arange(i + 1, b)[r[i + 1 : b] != r[i]]
        return found[near(order[i], order[found])] if near is not None and len(found) else found

    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if (r[a:b] == r[a]).all():
            continue
        size = b - a
        stop = size if first and size <= _ALL_PAIRS else min(last, size)
        for i in range(a + first, a + stop):
            other = v[after(i, b)]
            if len(other):
                out.append(np.stack([np.full(len(other), v[i]), other], axis=1))
        left = left or (stop < size - 1 if near is None else any(len(after(i, b)) for i in range(a + stop, b - 1)))
    return (np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)), left


def bucket_trees(signatures: np.ndarray, nodes: np.ndarray, roots: np.ndarray, near) -> np.ndarray:
    """Pairs of nodes that join, in each bucket, all roots that near pairs join: one pair fewer than roots, however many are near."""
    order, edges = _buckets(signatures, nodes)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rest = order[a:b]
        while len(rest) and (roots[rest] != roots[rest[0]]).any():
            mine = roots[rest] == roots[rest[0]]
            queue, rest = rest[mine].tolist(), rest[~mine]
            while queue and len(rest):
                at = queue.pop()
                reached = rest[near(at, rest)]
                if len(reached):
                    joined, one = np.unique(roots[reached], return_index=True)
                    ends = nodes[reached[one]]
                    out.append(np.stack([np.minimum(ends, nodes[at]), np.maximum(ends, nodes[at])], axis=1))
                    mine = np.isin(roots[rest], joined)
                    queue += rest[mine].tolist()
                    rest = rest[~mine]
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def open_entries(signatures: np.ndarray, nodes: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Places of the entries in buckets of more than one root."""
    order, edges = _buckets(signatures, nodes)
    r = roots[order]
    if not len(r):
        return order
    mixed = np.minimum.reduceat(r, edges[:-1]) != np.maximum.reduceat(r, edges[:-1])
    return order[np.repeat(mixed, np.diff(edges))]


_SKETCH_BITS = 4  # for each shingle, at least


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of a set's hashes fall to them, in words; their number is a power of two.

    Two sets that differ in d members have sketches that differ in d bits or fewer, so a pair that differs in more bits than
    the similarity allows members is not alike: sketches reject pairs, but never one that the test would pass.
    """
    words = 1 << max(0, (_SKETCH_BITS * len(hashes) - 1).bit_length() - 6)
    at = _mix(hashes, 64) % np.uint64(64 * words)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * words).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


class Sketches:
    """Which of many sets may be alike, by their sizes and sketches. The longer of two sketches is folded to the other's length."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, raw: bytes, similarity: float):
        self.sizes, self.words, self.similarity = sizes, words, similarity
        line, start = np.frombuffer(raw, np.uint64), np.cumsum(words) - words
        self.at, self.held = np.zeros(len(words), np.int64), {}
        for w in np.unique(words).tolist():
            who = np.flatnonzero(words == w)
            self.at[who] = np.arange(len(who))
            self.held[w, w] = line[start[who][:, None] + np.arange(w)]

    def _folded(self, w: int, to: int) -> np.ndarray:
        if (w, to) not in self.held:
            longer = self._folded(w, 2 * to)
            self.held[w, to] = longer[:, :to] ^ longer[:, to:]
        return self.held[w, to]

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may be alike to set i."""
        n, m, s = self.sizes[i], self.sizes[others], self.similarity
        fits = np.minimum(n, m) >= s * np.maximum(n, m) - 1e-6
        most = (1 - s) / (1 + s) * (n + m) + 1e-6
        own, theirs = int(self.words[i]), self.words[others]
        for w in np.unique(theirs[fits]).tolist():
            some = np.flatnonzero(fits & (theirs == w))
            to = min(w, own)
            differ = self._folded(w, to)[self.at[others[some]]] ^ self._folded(own, to)[self.at[i]]
            fits[some] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most[some]
        return fits


def _packed(entries: DataFrame, slots: int) -> DataFrame:
    """Rows sig, node, root as arrays, one row for each batch and slot: a bucket of any size is few rows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = batch[["sig", "node", "root"]].to_numpy(np.int64)
                slot = (np.ascontiguousarray(rows[:, 0]).view(np.uint64) % np.uint64(slots)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                edges = np.searchsorted(slot[order], np.arange(slots + 1))
                used = np.flatnonzero(np.diff(edges))
                yield pd.DataFrame({"slot": used, "raw": [rows[order[edges[i] : edges[i + 1]]].tobytes() for i in used]})

    return entries.mapInPandas(pack, "slot long, raw binary")


def _rows(pdf: pd.DataFrame, width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(raw, np.int64).reshape(-1, width) for raw in pdf["raw"]])


def _first_with_others(pdf: pd.DataFrame) -> pd.DataFrame:
    e = _rows(pdf, 3)
    return pd.DataFrame(bucket_pairs(e[:, 0], e[:, 1], e[:, 2], 0, 1)[0], columns=["a", "b"])


def _still_open(pdf: pd.DataFrame) -> pd.DataFrame:
    e = _rows(pdf, 3)
    return pd.DataFrame(e[open_entries(e[:, 0], e[:, 1], e[:, 2])], columns=["sig", "node", "root"])


def _packed_sketches(entries: DataFrame, slots: int) -> DataFrame:
    """Rows sig, node, root, size, sketch like ``_packed``; the sketches follow one another in a column of their own."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sketches = batch["sketch"].tolist()
                words = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
                rows = np.column_stack([batch[["sig", "node", "root", "size"]].to_numpy(np.int64), words])
                slot = (np.ascontiguousarray(rows[:, 0]).view(np.uint64) % np.uint64(slots)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                edges = np.searchsorted(slot[order], np.arange(slots + 1))
                parts = [(i, order[edges[i] : edges[i + 1]]) for i in np.flatnonzero(np.diff(edges)).tolist()]
                yield pd.DataFrame([(i, rows[p].tobytes(), b"".join(sketches[k] for k in p.tolist())) for i, p in parts], columns=["slot", "raw", "sketches"])

    return entries.mapInPandas(pack, "slot long, raw binary, sketches binary")


def _proposer(first: int, last: int, similarity: float):
    """Pairs that may be alike: a tree of them for each bucket (``last`` 0), or those of members in the places given. A pair of -1 says that some are left."""

    def propose(pdf: pd.DataFrame) -> pd.DataFrame:
        e = _rows(pdf, 5)
        near = Sketches(e[:, 3], e[:, 4], b"".join(pdf["sketches"]), similarity).near
        if last:
            pairs, left = bucket_pairs(e[:, 0], e[:, 1], e[:, 2], first, last, near)
        else:
            pairs = bucket_trees(e[:, 0], e[:, 1], e[:, 2], near)
            left = len(pairs) > 0
        return pd.DataFrame(np.concatenate([pairs, [[-1, -1]]]) if left else pairs, columns=["a", "b"])

    return propose


def shared_bands(texts: DataFrame, slots: int) -> DataFrame:
    """Rows sig, node for the signatures (column bands, packed) that two or more nodes have."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 20_000):
                part = batch.iloc[at : at + 20_000]
                sig = np.frombuffer(b"".join(part["bands"]), np.uint64)
                pair = np.stack([sig, np.repeat(part["node"].to_numpy(np.int64).view(np.uint64), BANDS)], axis=1)
                slot = (sig % np.uint64(slots)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                edges = np.searchsorted(slot[order], np.arange(slots + 1))
                used = np.flatnonzero(np.diff(edges))
                yield pd.DataFrame({"slot": used, "raw": [pair[order[edges[i] : edges[i + 1]]].tobytes() for i in used]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = np.concatenate([np.frombuffer(raw, np.uint64).reshape(-1, 2) for raw in pdf["raw"]])
        pair = pair[np.argsort(pair[:, 0])]
        same = pair[1:, 0] == pair[:-1, 0]
        pair = pair[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        return pd.DataFrame({"sig": pair[:, 0].copy().view(np.int64), "node": pair[:, 1].copy().view(np.int64)})

    return texts.select("node", "bands").mapInPandas(spread, "slot long, raw binary").groupBy("slot").applyInPandas(meet, "sig long, node long")


def similar_roots(texts: DataFrame, rows: DataFrame, first_pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """node, root for texts (node, bands) joined by links of at least the similarity; ``rows`` has their text ``t`` by ``row``.

    ``first_pairs`` (a < b) are tested first, then one member of each bucket with the others. Buckets with texts that no verified links join yet
    go on with sketches of their texts' sets, which reject pairs that can't be alike where they meet: first a tree of the pairs that may be
    alike is tested in each, then, round by round, those of more and more members, until each pair of a bucket is joined, rejected or has
    been tested. So a pair that fails leaves both texts open to all others, a group of like texts costs one link each, and texts that
    have much in common, but too little, are not paired on.
    """
    spark = texts.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.count() * BANDS // ENTRIES_PER_SLOT + 1)
    entries = cut(shared_bands(texts, slots), "shared-bands")
    ends = [first_pairs.select(F.col(c).alias("row")) for c in "ab"]
    needed = entries.select(F.col("node").alias("row")).unionByName(ends[0]).unionByName(ends[1]).distinct()
    held = cut(rows.select("row", "t").join(needed.hint("shuffle_hash"), "row"), "compared-texts")
    side = lambda p: held.select(F.col("row").alias(p), F.col("t").alias(f"t{p}"))

    @F.pandas_udf("size long, sketch binary")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t if isinstance(t, str) else None, width)) for t in texts]
        return pd.DataFrame({"size": np.array([len(h) for h in sets], np.int64), "sketch": [odd_sketch(h).tobytes() for h in sets]})

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_similar(x, y, width) >= similarity for x, y in zip(a, b, strict=True)], dtype=bool)

    test = lambda pairs: cut(pairs.join(side("a"), "a").join(side("b"), "b").where(alike("ta", "tb")).select("a", "b"), "text-links")
    links, tested = test(first_pairs), first_pairs
    roots = cut(connected(links), "text-components")
    rooted = lambda e: e.select("sig", "node").join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    narrowed = lambda e: cut(_packed(rooted(e), slots).groupBy("slot").applyInPandas(_still_open, "sig long, node long, root long"), "open-bands")
    found = _packed(rooted(entries), slots).groupBy("slot").applyInPandas(_first_with_others, "a long, b long").distinct()
    still, sketches, first, last = entries, None, 0, 0
    while True:
        found = cut(found.join(tested, ["a", "b"], "left_anti"), "text-pairs")
        left, pairs = sketches is None or found.where("a < 0").limit(1).count() > 0, found.where("a >= 0")
        more = test(pairs)
        links, tested = links.unionByName(more), tested.unionByName(pairs)
        if more.limit(1).count():
            roots = cut(connected(links), "text-components")
        before, still = still, narrowed(still) if left else still
        if left:
            forget(before)
        if not left or still.isEmpty():
            for table in (held, still, *([] if sketches is None else [sketches])):
                forget(table)
            return roots
        if sketches is None:
            who = still.select(F.col("node").alias("row")).distinct()
            sketches = cut(held.join(who.hint("shuffle_hash"), "row").select(F.col("row").alias("node"), sketched("t").alias("s")).select("node", "s.*"), "sketches")
        met = still.join(sketches, "node")
        bytes_met = met.agg(F.sum(F.octet_length("sketch"))).first()[0] or 0
        found = _packed_sketches(met, max(slots, bytes_met // SKETCH_BYTES_PER_SLOT + 1)).groupBy("slot").applyInPandas(_proposer(first, last, similarity), "a long, b long").distinct()
        first, last = (last, last + 4 * (last - first)) if last else (1, 1 + _HUBS)


def fingerprint_pairs(texts: DataFrame, radius: int) -> DataFrame:
    """a < b: pairs of texts (node, fp) that join all texts of equal or linked fingerprints."""
    fps = cut(texts.groupBy("fp").agg(F.min("node").alias("rep")), "distinct-fingerprints")
    same = texts.join(fps, "fp").where(F.col("node") != F.col("rep")).select(F.col("rep").alias("a"), F.col("node").alias("b"))
    ends = lambda c: fps.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}"))
    near = link_fingerprints(fps, radius).join(ends("a"), "a").join(ends("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    return cut(same.unionByName(near).distinct(), "fingerprint-pairs")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``docs`` without all but one document of each group: the one with the smallest id (nulls last).

    A group is joined by equal texts and by pairs of texts whose sets of shingles have at least the given Jaccard
    similarity. Pairs are proposed by fingerprints within the radius and by equal bands of least hashes over these sets, and
    each is tested on the texts.
    """
    columns = docs.columns

    @F.pandas_udf("bands binary, fp long")
    def signed(texts: pd.Series) -> pd.DataFrame:
        sets = (np.unique(shingle_hashes(t if isinstance(t, str) else None, width)) for t in texts)
        rows = [(bands(h).tobytes(), majority(h) if len(h) else 0) for h in sets]
        return pd.DataFrame({"bands": [b for b, _ in rows], "fp": np.array([f for _, f in rows], np.uint64).view(np.int64)})

    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("k"), text.alias("t"), signed(text).alias("signed"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("tg"),
        F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col]).alias("rest"),
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "marked-documents")
    order = F.struct(F.col("k").isNull().alias("n"), "k", "row", "signed.bands", "signed.fp")
    # one node for each distinct text
    texts = cut(rows.select("th", "tg", order.alias("o")).groupBy("th", "tg").agg(F.min("o").alias("o")).select("o.n", "o.k", F.col("o.row").alias("node"), "o.bands", "o.fp"), "distinct-texts")
    roots = similar_roots(texts, rows, fingerprint_pairs(texts, radius), width, similarity)
    nodes = texts.select(F.struct("n", "k", "node").alias("o"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = nodes.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.node").alias("row"))
    out = rows.select("row", "t", "rest").join(kept.hint("shuffle_hash"), "row", "left_semi")  # texts needn't be sorted
    return out.select(*[(F.col("t") if c == text_col else F.col("rest").getField(c)).alias(c) for c in columns])


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
