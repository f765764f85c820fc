"""Operator 7, benchmark decontamination by the q-gram lemma.

A document is contaminated by an item if some `core` consecutive characters of the item (all of
them if it is shorter) occur in it with at most `rate` edits a character.  By the q-gram lemma
two such regions of length w within e edits share at least w + 1 - q (e + 1) q-grams, on
diagonals within e of one another.

1. Every q-gram of a document is looked up among the items' q-grams; stretches with fewer hits
   than the lemma demands are dropped at once.  Items so short that the lemma would demand
   nothing have shorter q-grams, w / (e + 1) long.
2. The hits left are spread over (item, diagonal) and counted in bands 2e wide that overlap by
   half, within windows of document positions; bands below the bound cannot hold a match.
3. What is left is verified by banded alignment: exactly whether some `core` characters of the
   item lie on the band's diagonals within the budget.

Documents are read once, without a shuffle.  The items' q-grams are broadcast in blocks of at
most `block_chars` characters (the bound of what is broadcast); more items mean more blocks.

Case of A-Z and the kind and length of white space do not matter.  Defined results: null, empty or
blank texts, documents or items, match nothing; items shorter than `q` must occur exactly, and not
inside a longer word; a null doc_id or item_id is carried along; repeated rows each come out; no
rows, no result; other columns are ignored."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, mix, own, prepare, table

Q, CORE, RATE, BLOCK_CHARS = 11, 100, 0.06, 4_000_000
#: Places in items that are held at once while a document is matched.
MOST_HITS = 2_000_000


def characters(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points with A-Z lowered and every run of ASCII white space as one space, and where each
    was in the text."""
    a = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 65) & (a <= 90)] += 32
    a[(a >= 9) & (a <= 13)] = 32
    blank = a == 32
    at = np.flatnonzero(~(blank[1:] & blank[:-1])) if len(a) else np.zeros(0, np.int64)
    at = np.append(at, len(a) - 1) if len(a) else at  # the last blank of a run stands for it
    return a[at], at


def grams(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q consecutive code points."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    base, h, done = 0x9E3779B97F4A7C15, a.astype(U64) + U64(1), 1
    one = h
    while done < q:  # doubles the width, or adds one, by Horner's rule
        if 2 * done <= q:
            h = h[: len(h) - done] * U64(pow(base, done, 1 << 64)) + h[done:]
            done *= 2
        else:
            h = h[:-1] * U64(base) + one[done : done + len(h) - 1]
            done += 1
    return mix(h)


def align(c: np.ndarray, a: np.ndarray, low: int, high: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Banded alignment of every `width` consecutive characters of the item `c` with the document `a`
    on the diagonals low..high: (start in the item, diagonal at its end, edits) of the one with the
    fewest edits, or None if all need more than `most`.

    For each start and diagonal it keeps how far into the item the edits so far reach; runs of
    equal characters are looked up, so the work is edits x starts x diagonals."""
    n, starts, diagonals = len(c), np.arange(len(c) - width + 1), np.arange(low, high + 1)
    at = np.arange(n)[None, :] + diagonals[:, None]
    inside = (at >= 0) & (at < len(a))
    differs = np.ones((len(diagonals), n + 1), bool)
    differs[:, :n] = ~inside | (c[None, :] != a[np.clip(at, 0, len(a) - 1)])
    # the next difference at or after each position
    stop = np.minimum.accumulate(np.where(differs, np.arange(n + 1), n)[:, ::-1], axis=1)[:, ::-1]
    row = np.arange(len(diagonals))[:, None]
    reach = stop[row, starts[None, :]]  # a start is free on every diagonal
    for edits in range(most + 1):
        if edits:
            new = reach + 1  # another character
            new[1:] = np.maximum(new[1:], reach[:-1])  # one more in the document
            new[:-1] = np.maximum(new[:-1], reach[1:] + 1)  # one less
            reach = stop[row, np.minimum(new, n)]
        done = reach >= starts[None, :] + width
        if done.any():
            d, i = np.unravel_index(np.argmax(done), done.shape)
            return int(starts[i]), int(diagonals[d]), edits
    return None


def _wordlike(c: int) -> bool:
    return chr(c).isalnum() if c < 0xD800 or c > 0xDFFF else False


class Short:
    """Items of one length, too short for the lemma, found exactly."""

    def __init__(self, numbers: list[int], chars: list[np.ndarray]) -> None:
        self.numbers, self.chars, self.width = numbers, chars, len(chars[0])
        self.of: dict[int, list[int]] = {}
        for i, c in enumerate(chars):
            self.of.setdefault(int(grams(c, self.width)[0]), []).append(i)
        self.keys = np.array(sorted(self.of), U64)

    def matches(self, a: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        g, found = grams(a, self.width), set()
        for at in np.flatnonzero(np.isin(g, self.keys)).tolist():
            end = at + self.width
            for i in self.of[int(g[at])]:
                c = self.chars[i]
                if i in found or not np.array_equal(c, a[at:end]):
                    continue
                if at and _wordlike(int(c[0])) and _wordlike(int(a[at - 1])) or end < len(a) and _wordlike(int(c[-1])) and _wordlike(int(a[end])):
                    continue
                found.add(i)
                yield self.numbers[i], at, end, 0


class Items:
    """One block of benchmark items, by what finds them: q-grams of a length, or exactly."""

    def __init__(self, rows: list[tuple[int | None, str | None]], q: int, core: int, rate: float) -> None:
        self.ids = [r[0] for r in rows]
        short, long = defaultdict(list), defaultdict(list)
        for i, (_, text) in enumerate(rows):
            c = characters((text or "").strip(" \t\n\v\f\r"))[0]
            width = min(len(c), core)
            if 0 < width < q:
                short[width].append((i, c))
            elif width:
                long[min(q, width // (int(width * rate) + 1))].append((i, c))
        self.parts: list[Short | Indexed] = [Short(*map(list, zip(*x, strict=True))) for x in short.values()]
        self.parts += [Indexed(*map(list, zip(*x, strict=True)), n, core, rate) for n, x in sorted(long.items())]

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, edits) of the best contaminated stretch for each item."""
        a, at = characters(text)
        return sorted((i, int(at[s]), int(at[e - 1]) + 1, x) for part in self.parts for i, s, e, x in part.matches(a) if s < e)


class Indexed:
    """Items indexed by q-gram, with at least one to share in every match."""

    def __init__(self, numbers: list[int], chars: list[np.ndarray], q: int, core: int, rate: float) -> None:
        self.q, self.numbers, self.chars = q, numbers, chars
        parts = [grams(c, q) for c in self.chars]
        h = np.concatenate(parts) if parts else np.zeros(0, U64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.keys, start = np.unique(h[order], return_index=True)
        self.start, self.end = start, np.append(start[1:], len(h))[: len(start)]
        self.item, self.at = item[order], at[order]
        self.bits = max(16, int(np.ceil(np.log2(max(len(h), 1)))) + 4)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(h >> U64(64 - self.bits)).astype(np.int64)] = True
        self.length = np.array([len(c) for c in self.chars])
        self.width = np.minimum(self.length, core)
        self.budget = np.floor(self.width * rate).astype(np.int64)
        self.need = self.width + 1 - q * (self.budget + 1)  # 1 at least, by the choice of q
        self.least, self.span = int(self.need.min()), int((self.width + self.budget).max())

    def matches(self, a: np.ndarray) -> list[tuple[int, int, int, int]]:
        g = grams(a, self.q)
        if not len(g) or not len(self.keys):
            return []
        pos = np.flatnonzero(self.maybe[(g >> U64(64 - self.bits)).astype(np.int64)])
        if len(pos) < self.least:
            return []
        k = np.minimum(np.searchsorted(self.keys, g[pos]), len(self.keys) - 1)
        hit = self.keys[k] == g[pos]
        pos, k = pos[hit], k[hit]
        # stretches with too few hits of any kind
        inside = np.searchsorted(pos, pos + self.span) - np.arange(len(pos))
        rich = np.flatnonzero(inside >= self.least)
        if not len(rich):
            return []
        edge = np.zeros(len(pos) + 1, np.int64)
        np.add.at(edge, rich, 1)
        np.add.at(edge, np.minimum(rich + inside[rich], len(pos)), -1)
        keep = np.cumsum(edge)[:-1] > 0
        pos, k = pos[keep], k[keep]
        n = self.end[k] - self.start[k]
        found: dict[int, tuple[int, int, int]] = {}
        for lo, hi in self._stretches(pos, n):
            settled = {i for i, best in found.items() if not best[2]}  # no better match is left to find
            for i, best in self._spread(a, pos[lo:hi], k[lo:hi], n[lo:hi], settled):
                if i not in found or best[2] < found[i][2]:
                    found[i] = best
        return [(self.numbers[i], *best) for i, best in found.items()]

    def _stretches(self, pos: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cuts a document's hits where they stand for more than `MOST_HITS` places in items, as
        runs of one character or word do; stretches overlap by a whole match, so none is lost."""
        total, lo = np.concatenate(([0], np.cumsum(n))), 0
        while lo < len(pos):
            cut = max(lo + 1, int(np.searchsorted(total, total[lo] + MOST_HITS, "right")) - 1)
            if cut >= len(pos):
                yield lo, len(pos)
                return
            yield lo, int(np.searchsorted(pos, pos[cut - 1] + self.span, "right"))
            lo = cut

    def _spread(self, a: np.ndarray, pos: np.ndarray, k: np.ndarray, n: np.ndarray, settled: set[int]) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """(item number, its best match) among hits at the document positions `pos`, but for items
        that are settled."""
        occ = np.repeat(self.start[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        dpos, item, ipos = np.repeat(pos, n), self.item[occ], self.at[occ]
        order = np.argsort(item, kind="stable")
        dpos, item, ipos = dpos[order], item[order], ipos[order]
        bounds = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            i = int(item[lo])
            if hi - lo >= self.need[i] and i not in settled:
                best = self._verify(a, i, dpos[lo:hi], ipos[lo:hi])
                if best is not None:
                    yield i, best

    def _verify(self, a: np.ndarray, i: int, dpos: np.ndarray, ipos: np.ndarray) -> tuple[int, int, int] | None:
        e, w, need, c = int(self.budget[i]), int(self.width[i]), int(self.need[i]), self.chars[i]
        band = 2 * max(e, 1)
        diagonal = dpos - ipos + len(c)  # never negative
        best = None
        for shift in (0, band // 2):  # bands overlap by half: within e of one another is within one band
            which = (diagonal + shift) // band
            order = np.argsort(which, kind="stable")
            heads, first = np.unique(which[order], return_index=True)
            for d, mine in zip(heads.tolist(), np.split(order, first[1:]), strict=True):
                if len(mine) < need:
                    continue
                p = np.unique(dpos[mine])  # items repeat q-grams: a document position counts once
                if len(p) < need or (np.searchsorted(p, p + w + e) - np.arange(len(p))).max() < need:
                    continue
                low = d * band - shift - len(c)
                found = align(c, a, low - e, low + band - 1 + e, w, e)
                if found is not None and (best is None or found[2] < best[2]):
                    at = found[0] + found[1]  # to within the edits
                    best = (max(0, at), min(len(a), at + w), found[2])
                    if not found[2]:
                        return best
        return best


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("items")
        items: Items = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc, items.ids[i], s, e, x) for i, s, e, x in items.matches(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "edits"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, core: int = CORE, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): a row for each document and item it contains;
    start and end are character positions of a matching stretch, to within its edits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, start long, end long, edits long"
    shared = [docs.sparkSession.sparkContext.broadcast(Items(b, q, core, rate)) for b in _blocks(benchmark, block_chars)]
    return reduce(DataFrame.union, [rows.mapInArrow(_scan(s), schema) for s in shared])


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Blocks of items, one at a time on the driver; at least one, if an empty one."""
    block, n, given = [], 0, False
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        n += len(r["text"] or "")
        if n >= block_chars:
            yield block
            block, n, given = [], 0, True
    if block or not given:
        yield block


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _keep(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("items")
        items: Items = shared.value
        for b in batches:
            yield b.filter(pa.array([not items.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, core: int = CORE, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item."""
    for block in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, q, core, rate))
        docs = docs.mapInArrow(_keep(shared, docs.columns.index("text")), docs.schema)
    return docs
