"""Repeated passages across documents, exact or fuzzy: shared k-mer seeds, collinear chains, aligned passages.

Words are lower-cased (A-Z) runs of anything but ASCII white space. Seeds are minimisers of the 5-word k-mers (the
least hash of each window). Proposals are linear in the text, whatever the size of a group that shares some:
1. A seed links each of its documents to the least one that holds it; pairs with two such seeds are aligned, and those with
   one that hardly any other document holds.
2. Seeds of a document that no passage found so covers are open, and so are those up to ``min_words`` before one. In all
   documents that hold an open seed, each run of ``min_words`` words that begins at most a window before it
   gives a key, and so does the seed with each of the next three open ones; a run's key links its documents to the least
   that holds it, a pair's to the least of either half of its documents, as the key's own hash parts them, so that an
   earlier document with short pieces of a passage does not hide the whole one.
An exact run of ``min_words`` words has a minimiser in its first window, so step 2 links any such run with an uncovered
seed to the first document that holds the very same run: of an exact repeat, a few words between seeds or
beyond the first or last one are left uncovered at most. Fuzzy repeats need two shared seeds, or a rare one.
For each linked pair, cut to the words around its seeds, runs of common k-mers on a diagonal are segments; a Fenwick
tree of prefix maxima chains segments that are ordered in both texts, at a cost for each word of gap; chains are cut at
long gaps, extended and aligned word by word. A passage is reported for the later document, with its place in the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernels as K
from .common import bounded_batches, drop_materialised, materialise, unused

K_WORDS, WINDOW, MIN_WORDS, MIN_IDENTITY, MAX_GAP, GAP_COST, REACH = 5, 5, 50, 0.75, 24, 0.2, 32
#: One seed proposes a pair if so many documents hold it at most.
RARE = 3


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each w successive values: len(x) - w + 1 of them."""
    size, out = 1, x
    while 2 * size <= w:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(x) - w + 1], out[w - size :][: len(x) - w + 1]) if size < w else out


def occurrences(words: K.Words, k: int = K_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, row, place) of all minimisers, by row and place; a row with fewer k-mers than a window gives its least one."""
    h, row, at = K.shingles(words, k)
    chosen = np.zeros(len(h), bool)
    edges = np.searchsorted(row, np.arange(len(words.counts) + 1))
    if len(h) >= window:
        low = _slide(h, window, np.minimum)
        low[row[: len(low)] != row[window - 1 :]] = 0  # a window over two rows
        pad = np.zeros(window - 1, np.uint64)
        chosen = _slide(np.concatenate([pad, low, pad]), window, np.maximum) == h
    short = np.flatnonzero((np.diff(edges) > 0) & (np.diff(edges) < window))
    if len(short):
        lengths = np.diff(edges)[short]
        those = K.ragged(edges[:-1][short], lengths)
        least = np.minimum.reduceat(h[those], np.cumsum(lengths) - lengths)
        chosen[those] = h[those] == np.repeat(least, lengths)
    chosen[words.counts[row] < k] = False
    return h[chosen], row[chosen], (at - words.first[:-1][row])[chosen]


def minimisers(words: K.Words, k: int = K_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, row, first place, last place), distinct in each row."""
    h, row, place = occurrences(words, k, window)
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16) if len(words.counts) < 1 << 16 else row[order], kind="stable")]  # 16 bits by radix
    h, row, place = h[order], row[order], place[order]
    edge = np.ones(len(h), bool)
    edge[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(edge)
    if not len(at):
        return h, row, place, place
    return h[at], row[at], np.minimum.reduceat(place, at), np.maximum.reduceat(place, at)


def _seeds(ids: pa.DataType, k: int, window: int):
    """(doc_id, seed, span): the first place in the span's low 32 bits, how far the last one is from it in the others. As
    every seed moves twice, a row is as narrow as can be."""
    schema = pa.schema([("doc_id", ids), ("seed", pa.int64()), ("span", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                h, row, low, high = minimisers(K.Words(data, offsets, lower=True), k, window)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array((high - low << 32) + low)], schema=schema)

    return run


class Fenwick:
    """Prefix maxima with the item that has them."""

    def __init__(self, n: int):
        self.best, self.item = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, item: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i], self.item[i] = value, item
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """The greatest of positions 0 to i - 1."""
        value, item = float("-inf"), -1
        while i > 0:
            if self.best[i] > value:
                value, item = self.best[i], self.item[i]
            i -= i & -i
        return value, item


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, x in that order), equal values by their place: a fast sort, and a second one of the ties alone."""
    order = np.argsort(x)
    ranked = x[order]
    tie = np.zeros(len(x), bool)
    tie[1:] = ranked[1:] == ranked[:-1]
    tie[:-1] |= tie[1:]
    at = np.flatnonzero(tie)
    order[at] = order[at][np.lexsort((order[at], ranked[at]))]
    return order, ranked


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values: the j-th occurrence in a goes with the j-th in b, or with b's last."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (oa, sa), (ob, sb) = _ranked(a), _ranked(b)
    new = np.ones(len(sa), bool)
    new[1:] = sa[1:] != sa[:-1]
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(sa)))
    low, high = np.searchsorted(sb, sa[head], "left"), np.searchsorted(sb, sa[head], "right")
    found = high > low
    head, n, low, high = head[found], n[found], low[found], high[found]
    at = K.ragged(head, n)
    other = np.minimum(at + np.repeat(low - head, n), np.repeat(high, n) - 1)
    partner = np.full(len(a), -1)
    partner[oa[at]] = ob[other]
    x = np.flatnonzero(partner >= 0)
    return x, partner[x]


def segments(pair: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(pair, x, y, words) of the runs of matches along a diagonal, of matches by pair and x."""
    if not len(x):
        return pair, x, y, x
    cut = np.flatnonzero((np.diff(x) != 1) | (np.diff(y) != 1) | (np.diff(pair) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]]) - 1
    return pair[first], x[first], y[first], x[last] - x[first] + k


def diagonal_runs(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, pair: np.ndarray, diagonal: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(pair, x, y, words) of the runs of k words or more that agree where y = x - diagonal: a and b are where the
    texts of each pair begin in hashes, na and nb their words. Pieces of a million words, or one diagonal."""
    low = np.maximum(diagonal, 0)
    n = np.minimum(na[pair], nb[pair] + diagonal) - low
    good = n >= k
    pair, diagonal, low, n = pair[good], diagonal[good], low[good], n[good]
    for i, j in K.chunks(np.concatenate([[0], np.cumsum(n)])):
        p, d, x, m = pair[i:j], diagonal[i:j], low[i:j], n[i:j]
        begin = np.cumsum(m + 1) - m  # with a word that differs between two diagonals
        same = np.zeros(begin[-1] + m[-1] + 1, bool)
        same[K.ragged(begin, m)] = hashes[K.ragged(a[p] + x, m)] == hashes[K.ragged(b[p] + x - d, m)]
        turn = np.flatnonzero(same[1:] != same[:-1]) + 1
        start, size = turn[::2], turn[1::2] - turn[::2]
        start, size = start[size >= k], size[size >= k]
        line = np.searchsorted(begin, start, "right") - 1
        x = x[line] + start - begin[line]
        yield p[line], x, x - d[line], size


def chains(parts: list[tuple[int, int, int]], cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of segments that follow each other in both texts, best first.

    A chain's score is its words less ``cost`` for each word of gap on either side. As that cost is linear, the best
    predecessor is a prefix maximum over ends in y of score + cost * (x end + y end), among segments that end before.
    """
    ys = sorted({y + n for _, y, n in parts} | {y for _, y, _ in parts})
    place = {v: i for i, v in enumerate(ys)}
    tree, score, parent = Fenwick(len(ys)), [0.0] * len(parts), [-1] * len(parts)
    starts = sorted(range(len(parts)), key=lambda i: parts[i][:2])
    ends = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    done = 0
    for i in starts:
        x, y, n = parts[i]
        while done < len(ends) and parts[ends[done]][0] + parts[ends[done]][2] <= x:
            j = ends[done]
            xe, ye = parts[j][0] + parts[j][2], parts[j][1] + parts[j][2]
            tree.put(place[ye], score[j] + cost * (xe + ye), j)
            done += 1
        value, j = tree.top(place[y] + 1)
        gain = value - cost * (x + y)
        score[i], parent[i] = n + max(0.0, gain), j if gain > 0 else -1
    out, used = [], [False] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(parts[i])
            i = parent[i]
        if chain:
            out.append(chain[::-1])
    return out


def edit_distance(a: list, b: list) -> int:
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2:  # most gaps
        return len(b) - (len(a) == 1 and a[0] in b)
    row = list(range(len(b) + 1))
    for i, u in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, v in enumerate(b, 1):
            corner, row[j] = row[j], min(corner + (u != v), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _extend(a: np.ndarray, b: np.ndarray, drop: int = 3) -> tuple[int, int]:
    """(words, errors) that a and b run on alike: words score 1 or -1; ends once the score has fallen by drop."""
    score = top = words = errors = wrong = at = 0
    size = 16
    while at < len(a):
        for same in (a[at : at + size] == b[at : at + size]).tolist():
            at += 1
            if same:
                score += 1
                if score > top:
                    top, words, errors = score, at, wrong
            else:
                score, wrong = score - 1, wrong + 1
                if score <= top - drop:
                    return words, errors
        size = min(4 * size, 4096)
    return words, errors


def passages(
    a: np.ndarray, b: np.ndarray, *, k: int = K_WORDS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, max_gap: int = MAX_GAP, diagonals: tuple[int, ...] = ()
) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in b, end in b, identity) of the passages of two sequences of word hashes.

    Runs of common words on the given diagonals are segments whatever else their k-mers match; of the others, the j-th
    occurrence of a k-mer goes with the j-th in b.
    """
    first, lines = np.array([0, len(a), len(a) + len(b)]), np.array(diagonals, np.int64)
    found = passages_of_pairs(
        np.concatenate([a, b]), first, np.array([0]), np.array([1]), np.zeros(len(lines), np.int64), lines, k=k, min_words=min_words, min_identity=min_identity, max_gap=max_gap
    )
    return [p[1:] for p in found]


def passages_of_pairs(
    hashes: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray, diagonals: np.ndarray,
    *, k: int = K_WORDS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, max_gap: int = MAX_GAP,
) -> list[tuple[int, int, int, int, int, float]]:
    """(pair, *passage) as passages() has them for each pair of texts, a[i] with b[i]. Text j is the words from first[j] to
    first[j + 1] of hashes; diagonals are those of the pairs in of. Segments are found for all pairs at once."""
    size = np.diff(first)
    wide = (size[a] >= min_words) & (size[b] >= min_words)
    equal = np.flatnonzero(wide & (size[a] == size[b]))
    if len(equal):
        n = size[a[equal]]
        alike = hashes[K.ragged(first[a[equal]], n)] == hashes[K.ragged(first[b[equal]], n)]
        equal = equal[np.logical_and.reduceat(alike, np.cumsum(n) - n)]
        wide[equal] = False
    out = [(p, 0, n, 0, n, 1.0) for p, n in zip(equal.tolist(), size[a[equal]].tolist(), strict=True)]
    rest = np.flatnonzero(wide)
    if not len(rest):
        return out
    at_a, at_b, na, nb = first[a[rest]], first[b[rest]], size[a[rest]], size[b[rest]]
    kmers = sum((hashes[j : len(hashes) - k + 1 + j] * K._STEP[j] for j in range(k)), np.zeros(len(hashes) - k + 1, np.uint64))
    ia, ib = K.ragged(at_a, na - k + 1), K.ragged(at_b, nb - k + 1)
    pa, pb = np.repeat(np.arange(len(rest)), na - k + 1), np.repeat(np.arange(len(rest)), nb - k + 1)
    # a k-mer matches in its own pair alone
    x, y = matches(kmers[ia] + pa.astype(np.uint64) * K._STEP[k], kmers[ib] + pb.astype(np.uint64) * K._STEP[k])
    p = pa[x]
    parts = [segments(p, ia[x] - at_a[p], ib[y] - at_b[p], k)]
    slot = np.full(len(a), -1)
    slot[rest] = np.arange(len(rest))
    asked = slot[of] >= 0
    parts += diagonal_runs(hashes, at_a, at_b, na, nb, slot[of[asked]], diagonals[asked], k)
    table = np.stack([np.concatenate(c) for c in zip(*parts, strict=True)])
    table = table[:, np.lexsort(table[::-1])]
    new = np.ones(table.shape[1], bool)
    new[1:] = (table[:, 1:] != table[:, :-1]).any(axis=0)
    table = table[:, new]
    edges = np.searchsorted(table[0], np.arange(len(rest) + 1)).tolist()
    rows = list(zip(*table[1:].tolist(), strict=True))
    for i, (pair, u, v, m, n) in enumerate(zip(rest.tolist(), at_a.tolist(), at_b.tolist(), na.tolist(), nb.tolist(), strict=True)):
        if edges[i + 1] > edges[i]:
            out += [(pair, *p) for p in _chained(hashes[u : u + m], hashes[v : v + n], rows[edges[i] : edges[i + 1]], min_words, min_identity, max_gap)]
    return out


def _chained(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int]], min_words: int, min_identity: float, max_gap: int) -> list[tuple[int, int, int, int, float]]:
    """The passages that chains of the segments of a and b extend to."""
    out = []
    for chain in chains(parts):
        run: list[tuple[int, int, int]] = []
        for part in [*chain, None]:
            if run and (part is None or part[0] - run[-1][0] - run[-1][2] > max_gap or part[1] - run[-1][1] - run[-1][2] > max_gap):
                x0, y0 = run[0][:2]
                x1, y1 = run[-1][0] + run[-1][2], run[-1][1] + run[-1][2]
                n = min(x0, y0)
                more, wrong = _extend(a[x0 - n : x0][::-1], b[y0 - n : y0][::-1])
                x0, y0, errors = x0 - more, y0 - more, wrong
                n = min(len(a) - x1, len(b) - y1)
                more, wrong = _extend(a[x1 : x1 + n], b[y1 : y1 + n])
                x1, y1, errors = x1 + more, y1 + more, errors + wrong
                if x1 - x0 >= min_words:
                    for (x, y, n), (u, v, _) in zip(run, run[1:], strict=False):
                        errors += edit_distance(a[x + n : u].tolist(), b[y + n : v].tolist())
                    identity = 1 - errors / max(x1 - x0, y1 - y0)
                    if identity >= min_identity:
                        out.append((x0, x1, y0, y1, identity))
                run = []
            if part:
                run.append(part)
    return sorted(set(out))


def _slices(ids: pa.DataType, slack: int):
    """Cuts texts to the words from low - slack to high + slack, with the place and the byte where the cut begins."""
    schema = pa.schema(
        [("doc_id", ids), ("source_doc_id", ids), ("side", pa.int32()), ("diagonals", pa.list_(pa.int64())), ("digest", pa.int64()), ("first_word", pa.int64()), ("first_byte", pa.int64()), ("text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                # rows of a join on the text's id: what is asked of one text stands together, and its words are made once
                digest, size = part.column(4).to_numpy(), np.diff(offsets)
                new = np.ones(len(digest), bool)
                new[1:] = (digest[1:] != digest[:-1]) | (size[1:] != size[:-1])
                text, once = np.cumsum(new) - 1, np.flatnonzero(new)
                data = data[K.ragged(offsets[once], size[once])]
                offsets = np.concatenate([[0], np.cumsum(size[once])])
                words = K.Words(data, offsets, lower=True)
                low = np.maximum(part.column(5).to_numpy() - slack, 0)
                high = np.minimum(part.column(6).to_numpy() + slack, words.counts[text]) - 1
                good = np.flatnonzero(high >= low)  # an id may stand on a shorter text too
                of = text[good]
                a, b = words.starts[words.first[of] + low[good]], words.ends[words.first[of] + high[good]]
                at = np.concatenate([[0], np.cumsum(b - a)])
                texts = pa.Array.from_buffers(pa.string(), len(good), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[K.ragged(a, b - a)])])
                take = pa.array(good)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in range(5)), pa.array(low[good].astype(np.int64)), pa.array(a - offsets[of]), texts], schema=schema)

    return run


def _align(ids: pa.DataType, options: dict):
    """Passages of pairs. Rows are sorted by pair and side (0 the document, 1 its source): a pair has a row of each side,
    more where rows repeat an id. A pair's rows may stand in two batches."""
    schema = pa.schema(
        [("doc_id", ids), ("source_doc_id", ids), ("digest", pa.int64()), *((c, pa.int64()) for c in ("start_word", "end_word", "source_start_word", "source_end_word", "start_byte", "end_byte")), ("identity", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, kept = None, []  # the documents of the block's last pair: (digest, first word, diagonals, hashes, starts, ends)
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                words = K.Words(data, offsets, lower=True)
                shift = np.repeat(part.column(6).to_numpy() - offsets[:-1], words.counts)
                digests, firsts, lines, hashes, starts, ends = ([x[c] for x in kept] for c in range(6))
                first = np.cumsum([0, *map(len, hashes), *words.counts])
                hashes, starts, ends = np.concatenate([*hashes, words.hashes]), np.concatenate([*starts, words.starts + shift]), np.concatenate([*ends, words.ends + shift])
                digest, word = (np.concatenate([np.array(x, np.int64), part.column(c).to_numpy()]) for x, c in ((digests, 4), (firsts, 5)))
                n_lines = np.concatenate([np.array([*map(len, lines)], np.int64), part.column(3).value_lengths().fill_null(0).to_numpy()])
                lines = np.concatenate([*lines, part.column(3).flatten().to_numpy()])
                line = np.concatenate([[0], np.cumsum(n_lines)])
                documents, a, b = list(range(len(kept))), [], []
                for r, (doc, source, side) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True), len(kept)):
                    if (doc, source) != pair:
                        pair, documents = (doc, source), []
                    if not side:
                        documents.append(r)
                    else:
                        a += documents
                        b += [r] * len(documents)
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                of = np.repeat(np.arange(len(a)), n_lines[a])
                diagonals = lines[K.ragged(line[a], n_lines[a])] - (word[a] - word[b])[of]
                found = passages_of_pairs(hashes, first, a, b, of, diagonals, **options)
                if found:
                    p, x0, x1, y0, y1 = (np.array(c, np.int64) for c in list(zip(*found, strict=True))[:5])
                    a, b, take = a[p], b[p], pa.array(b[p] - len(kept))
                    columns = (digest[a], word[a] + x0, word[a] + x1, word[b] + y0, word[b] + y1, starts[first[a] + x0], ends[first[a] + x1 - 1], np.array([f[5] for f in found]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *map(pa.array, columns)], schema=schema)
                kept = [(digest[d], word[d], lines[line[d] : line[d + 1]], *(c[first[d] : first[d + 1]].copy() for c in (hashes, starts, ends))) for d in documents]

    return run


def _keys(ids: pa.DataType, k: int, window: int, length: int):
    """(key, doc_id, place, whole) of the texts that hold open seeds: for each run of ``length`` words that begins at most
    a window before one, and for each pair of one with one of the next three within REACH words. Distinct in a text."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", ids), ("place", pa.int32()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.text_blocks(batch):
                words = K.Words(data, offsets, lower=True)
                h, row, place = occurrences(words, k, window)
                lists = part.column(1)
                asked = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                seeds = lists.flatten().to_numpy().view(np.uint64)
                # a seed is open in its own row alone
                held = np.isin(K.mix(h) + row.astype(np.uint64) * K._STEP[0], K.mix(seeds) + asked.astype(np.uint64) * K._STEP[0])
                h, row, place = h[held], row[held], place[held]
                up, down = K.powers(len(words.hashes) + 1)
                run_sum = np.zeros(len(words.hashes) + 1, np.uint64)
                np.cumsum(words.hashes * up[: len(words.hashes)], out=run_sum[1:])
                begin = (place[:, None] - np.arange(window)).reshape(-1)
                of = np.repeat(row, window)
                good = (begin >= 0) & (begin + length <= words.counts[of])
                begin, of = begin[good], of[good]
                at = begin + words.first[:-1][of]
                found = [(K.mix((run_sum[at + length] - run_sum[at]) * down[at] + np.uint64(length)), of, begin, np.ones(len(of), bool))]
                for gap in (1, 2, 3):
                    a, b = np.arange(max(len(h) - gap, 0)), np.arange(gap, max(len(h), gap))
                    near = (row[a] == row[b]) & (place[b] - place[a] <= REACH)
                    a, b = a[near], b[near]
                    found.append((K.mix(h[a] * K._STEP[1] + h[b] * K._STEP[2] + np.uint64(1)), row[a], place[a], np.zeros(len(a), bool)))
                key, of, at, whole = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((at, key, of))
                key, of, at, whole = key[order], of[order], at[order], whole[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), part.column(0).take(pa.array(of[first])), pa.array(at[first].astype(np.int32)), pa.array(whole[first])], schema=schema)

    return run


def _linked(held: DataFrame, key: str, place: str) -> DataFrame:
    """held with earlier documents of each key and the key's place in them, where it has two documents or more: the least
    for a whole run, the least of either half of the documents otherwise."""
    doc = F.struct("doc_id", F.col(place).alias("at"))
    half = F.when(F.col("whole"), 0).otherwise(F.pmod(F.xxhash64(key, "doc_id"), F.lit(2)))
    by = held.groupBy(key).agg(F.min(F.when(half == 0, doc)).alias("one"), F.min(F.when(half == 1, doc)).alias("two"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    least = by.where("first < last").select(key, F.explode(F.array_compact(F.array("one", "two"))).alias("least"))
    return held.join(least.select(key, F.col("least.doc_id").alias("source_doc_id"), F.col("least.at").alias("at")), key).where("source_doc_id < doc_id")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_seeds: int = 2, **options) -> DataFrame:
    """A row for each passage of a document that an earlier one (by id) holds too: doc_id, source_doc_id, word and
    byte ranges, identity (share of words that agree), n_words, digest (xxhash64 of the document's text).

    Options are those of passages(): min_words, min_identity, max_gap, k. Rows with a null id or text take no part;
    rows that repeat an id count as one document and are not compared with each other. Texts of fewer than min_words
    words have no passage. Other columns, whatever their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    k, length = options.get("k", K_WORDS), options.get("min_words", MIN_WORDS)
    kind = docs.schema[id_col].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    seeds = materialise(read.mapInArrow(_seeds(arrow, k, window), f"doc_id {name}, seed long, span long"), "seeds")
    least = seeds.groupBy("seed").agg(F.min("doc_id").alias("source_doc_id"), F.count("*").cast("int").alias("holders")).where("holders > 1")
    low = F.expr("cast(span & 4294967295 as int)").alias("low")
    held = seeds.join(least, "seed").select("seed", "doc_id", low, (low + F.expr("cast(shiftright(span, 32) as int)")).alias("high"), "source_doc_id", "holders")
    held = materialise(held, "held")
    drop_materialised(seeds)
    later = held.where("doc_id <> source_doc_id")
    placed = later.join(held.where("doc_id = source_doc_id").select("seed", F.col("low").alias("at")), "seed")
    spans = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("at").alias("source_low"), F.max("at").alias("source_high"), F.collect_set(F.expr("cast(low - at as bigint)")).alias("diagonals")]
    pairs = placed.groupBy("doc_id", "source_doc_id").agg(F.count("*").alias("n"), F.min("holders").alias("rarest"), *spans)
    pairs = materialise(pairs.where((F.col("n") >= least_seeds) | (F.col("rarest") <= RARE)).drop("n", "rarest"), "pairs")
    found = materialise(_aligned(read, pairs, window, k, options), "passages")
    # open seeds, and all that hold them
    covered = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    inside = f"coalesce(exists(spans, x -> x.start_word <= low and x.end_word >= high + {k}), false)"
    marked = later.join(covered, "doc_id", "left").select("doc_id", "seed", F.explode(F.array_distinct(F.array("low", "high"))).alias("place"), F.expr(f"not {inside}").alias("open"))
    # a run that holds an uncovered seed begins with one that may be covered
    ahead = Window.partitionBy("doc_id").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    open_seeds = marked.withColumn("next", F.min(F.expr("if(open, place, null)")).over(ahead)).where(f"next <= place + {length - k}").select("seed").distinct()
    places = held.join(open_seeds, "seed", "left_semi").groupBy("doc_id").agg(F.collect_list("seed").alias("seeds"))
    keys = places.join(read.hint("merge"), "doc_id").select("doc_id", "seeds", "text").mapInArrow(_keys(arrow, k, window, length), f"key long, doc_id {name}, place int, whole boolean")
    keys = materialise(keys, "keys")
    met = _linked(keys, "key", "place").withColumns({"low": F.col("place"), "high": F.col("place")})
    met = met.groupBy("doc_id", "source_doc_id").agg(F.max("whole").alias("whole"), *spans)
    # pairs of seeds whose words were aligned already say nothing new
    first = pairs.select("doc_id", "source_doc_id", F.col("low").alias("l"), F.col("high").alias("h"))
    more = met.join(first, ["doc_id", "source_doc_id"], "left").where("whole or l is null or low < l or high > h").drop("whole", "l", "h")
    more = materialise(more, "pairs")
    # of the passages found then, those within another of the same document say nothing more
    out = found.withColumn("late", F.lit(0)).unionByName(_aligned(read, more, window, k, options).withColumn("late", F.lit(1)))
    longest_first = Window.partitionBy("doc_id", "digest").orderBy("start_word", F.desc("end_word"), "late", "source_doc_id", "source_start_word")
    out = out.withColumn("until", F.max("end_word").over(longest_first.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.where("late = 0 or until is null or end_word > until").drop("late", "until")
    return out.withColumn("n_words", F.col("end_word") - F.col("start_word"))


def _aligned(read: DataFrame, pairs: DataFrame, window: int, k: int, options: dict) -> DataFrame:
    """The passages of pairs, around the words from low to high of the document, source_low to source_high of the source.
    Each text is cut to what its pairs ask for before anything moves to the pair."""
    kind = read.schema["doc_id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    slack = options.get("min_words", MIN_WORDS) + window + k
    sides = [("doc_id", F.lit(0), F.col("diagonals"), "low", "high"), ("source_doc_id", F.lit(1), F.lit(None).cast("array<bigint>"), "source_low", "source_high")]
    parts = [pairs.select("doc_id", "source_doc_id", side.alias("side"), lines.alias("diagonals"), F.col(low).alias("low"), F.col(high).alias("high"), F.col(of).alias("of")) for of, side, lines, low, high in sides]
    asked = parts[0].unionByName(parts[1])
    texts = read.select(F.col("doc_id").alias("of"), "text").hint("merge")
    rows = asked.join(texts, "of").select("doc_id", "source_doc_id", "side", "diagonals", F.xxhash64("text").alias("digest"), "low", "high", "text")
    slices = rows.mapInArrow(_slices(arrow, slack), f"doc_id {name}, source_doc_id {name}, side int, diagonals array<bigint>, digest long, first_word long, first_byte long, text string")
    both = slices.repartition("doc_id", "source_doc_id").sortWithinPartitions("doc_id", "source_doc_id", "side")
    return both.mapInArrow(
        _align(arrow, options),
        f"doc_id {name}, source_doc_id {name}, digest long, start_word long, end_word long, source_start_word long, source_end_word long, start_byte long, end_byte long, identity double",
    )


def by_document(found: DataFrame) -> DataFrame:
    """A row for each document with repeated passages: doc_id, source_doc_ids, passages (word ranges by their start),
    n_passages, longest. The passages of a document are as many as it has, whatever the size of the corpus."""
    p = F.struct("start_word", "end_word", "source_doc_id", "source_start_word", "source_end_word", "identity")
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(p)).alias("passages"), F.max("n_words").alias("longest"))
    return rows.select("doc_id", F.array_sort(F.array_distinct(F.transform("passages", lambda x: x["source_doc_id"]))).alias("source_doc_ids"), "passages", F.size("passages").alias("n_passages"), "longest")


def cut(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that repeated_passages() found, n_chars (if there) counted anew. A document without
    any word left goes; what stands between two cuts is joined by a line feed. Where rows repeat an id, each loses the
    passages of its own text. Rows with a null id or text stay as they are."""
    new_id, new_digest, new_spans, new_text = unused(docs, "__id", "__digest", "__spans", "__text")
    spans = found.groupBy(F.col("doc_id").alias(new_id), F.col("digest").alias(new_digest)).agg(F.array_sort(F.collect_set(F.struct("start_byte", "end_byte"))).alias(new_spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans or ():
                    if s["start_byte"] > at:
                        parts.append(text[at : s["start_byte"]])
                    at = max(at, s["end_byte"])
                parts.append(text[at:])
                texts.append(b"\n".join(x for x in (p.strip() for p in parts) if x).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], names=[new_text, *batch.schema.names[2:]])

    whole = docs.join(spans, (F.col(id_col) == F.col(new_id)) & (F.xxhash64(text_col) == F.col(new_digest)), "left")
    plain = whole.where(F.col(new_spans).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    touched = whole.where(F.col(new_spans).isNotNull()).select(F.col(text_col), new_spans, *(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    schema = ", ".join([f"`{new_text}` string", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns if c != text_col)])
    touched = touched.mapInArrow(run, schema).withColumnRenamed(new_text, text_col).where(F.length(text_col) > 0)
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return plain.union(touched.select(*(F.col(f"`{c}`") for c in docs.columns)))
