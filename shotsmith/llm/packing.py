"""Best-fit packing of token pieces into sequences by bin completion.

1. ``tokenize``: each document's ids (public word BPE, then id 0) are cut into
   pieces; only documents longer than a sequence are cut.
2. ``pack``: pieces are dealt to groups of about ``GROUP`` by a hash of their
   key, and each group is solved on its own: a bin is built around the largest
   open piece from the undominated fillings of the space left, of any number of
   pieces and made one by one, and branch and bound over those fillings prunes
   by the waste a better packing may still spend.  The incumbent is the best-fit
   packing; most groups end there, because it meets the lower bound.  Above it
   a quick search over short fillings goes first, then all fillings in two
   orders.  Each search ends with its node budget, so a group may stay above
   the lower bound; one whose ways were all tried is optimal.  Groups are independent, so
   the work spreads over the cluster and a lost group is solved again with the
   same result.  A group costs at most about half a sequence of extra waste.

Null text counts as empty (one piece: id 0).  A piece as long as a sequence
is a sequence of its own.  Equal rows (the same document id twice) stay
separate pieces.
"""

from __future__ import annotations

import bisect
import re
import zlib
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import by_chars, write_once

END = re.compile(rb"([a-z])([,.])(?=[ \n])")
GROUP = 4096            # pieces solved together
BRANCHES = 3            # fillings that the first search tries around one piece
NODES = 1000            # bins that branch and bound may open beyond the first descent
DROPPED = 16            # dominated branches that count as one bin
WORDS_KEPT = 600_000    # words in the per-process id table


class Tokens:
    """Whole-text ids through a per-process table of words.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are the joined ids of its words.
    """

    _open: dict[str, "Tokens"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True   # their strings are ordinary text
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Tokens":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of every text."""
        out = []
        for a, b in by_chars(texts):
            cut = [self._cut(t.encode()) for t in texts[a:b]]
            if len(self.known) > WORDS_KEPT // 2:
                self.older, self.known = self.known, {}
            known, older = self.known, self.older
            new = [w for w in set().union(*cut) if w not in known]
            known.update((w, older[w]) for w in new if w in older)
            new = [w for w in new if w not in older]
            for i in range(0, len(new), 2048):
                known.update(self._words(new[i:i + 2048]))
            out.extend(b"".join(map(known.__getitem__, c)) for c in cut)
        return out


    @staticmethod
    def _cut(raw: bytes) -> list[bytes]:
        """Words between spaces and 0x09-0x0D (what bytes.split takes).

        The tokenizer lower-cases, so A-Z are lowered before words are looked
        up, unless the text holds combining marks (U+0300-U+037F) that could
        compose with them first.  A comma or stop between a letter and white
        space is a token group of its own and is looked up on its own."""
        if b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        return END.sub(rb"\1 \2", raw).split()

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word: one call over the words joined by spaces, split
        again at the character offsets the tokenizer reports."""
        text = [w.decode() for w in words]
        got = self.model.encode(" ".join(text), add_special_tokens=False)
        start = np.cumsum([0] + [len(w) + 1 for w in text])
        at = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
        cut = 4 * np.searchsorted(at, start)
        ids = np.array(got.ids, "<u4").tobytes()
        return {w: ids[a:b] for w, a, b in zip(words, cut[:-1].tolist(), cut[1:].tolist())}


def tokenize(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document.
    Ids are digested where they are made; ``tokenize_ids`` returns them."""
    return _pieces(docs, path, size, False)


def tokenize_ids(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """As ``tokenize``, with the ids themselves (ids ARRAY<INT>)."""
    return _pieces(docs, path, size, True)


def _pieces(docs: DataFrame, path: str, size: int, keep: bool) -> DataFrame:
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokens.of(path)
        for pdf in batches:
            rows = []
            texts = [t if t is not None else "" for t in pdf["text"]]
            for key, ids in zip(pdf["doc_id"], tok.encode(texts)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at: at + 4 * size]
                    row = (key, k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if keep else row)
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep
    schema = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"
    # ids travel as text: pandas turns a bigint column that holds a null into doubles
    made = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema + ", ids array<int>" * keep)
    return made.withColumn("doc_id", F.col("doc_id").cast("bigint"))


class _Stock:
    """Open pieces: the count of every length, and the lengths in stock as bits."""

    def __init__(self, count: np.ndarray):
        self.count = count.tolist()
        self.lengths = np.flatnonzero(count).tolist()
        self.bits = sum(1 << s for s in self.lengths)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if self.count[size] == 0:
            self.bits ^= 1 << size

    def give(self, size: int) -> None:
        if self.count[size] == 0:
            self.bits ^= 1 << size
        self.count[size] += 1


class _Floors(_Stock):
    """With arrays beside: counts, and the largest length held at or below any."""

    def __init__(self, count: np.ndarray):
        super().__init__(count)
        self.held = count.copy()
        self.floor = np.maximum.accumulate(np.where(count > 0, np.arange(len(count)), 0))

    def take(self, size: int) -> None:
        super().take(size)
        self.held[size] -= 1
        if self.held[size] == 0:
            below = self.floor[size - 1]
            stop = size
            while stop < len(self.floor) and self.floor[stop] == size:
                stop += 1
                if stop - size > 64:
                    stop += int(np.argmax(np.append(self.floor[stop:] != size, True)))
                    break
            self.floor[size:stop] = below

    def give(self, size: int) -> None:
        super().give(size)
        self.held[size] += 1
        if self.held[size] == 1:
            part = self.floor[size:]
            np.maximum(part, size, out=part)


class _Budget:
    """What the search may still spend: a bin opened is 1, a branch dropped 1 / DROPPED."""

    def __init__(self, left: float):
        self.left = left


def _few(stock: _Floors, space: int, least: int, budget: _Budget) -> list[tuple[int, ...]]:
    """The best fillings of one, two or three pieces: a quick first search that
    leaves short pieces for later bins.  ``_fillings`` makes all the others.

    A pair is kept only when it fills more than the best single piece, and a
    triple only when it fills more than the best pair.
    """
    count, floor = stock.held, stock.floor
    one = int(floor[space])
    if one == 0:
        return [()] if least <= 0 else []
    found = [(one,)]
    best = one
    if best < space:
        a = np.flatnonzero(count[1:one + 1]) + 1
        a = a[::-1]
        b = floor[space - a]
        b = np.minimum(b, a)
        same = (b == a) & (count[a] < 2)
        b = np.where(same, floor[np.maximum(a - 1, 0)], b)
        b = np.where(a + b <= space, b, 0)
        total = np.where(b > 0, a + b, 0)
        order = np.argsort(-total, kind="stable")[:BRANCHES]
        for i in order.tolist():
            if total[i] > one:
                found.append((int(a[i]), int(b[i])))
                best = max(best, int(total[i]))
        if best < space:
            for x in a[:8].tolist():
                rest = space - x
                c = np.flatnonzero(count[1:min(x, rest) + 1]) + 1
                c = c[c < rest]
                if not len(c):
                    continue
                d = np.minimum(floor[rest - c], c)
                use = (d > 0) & (count[c] - (c == x) - (c == d) >= 1) & (count[d] - (d == x) - (c == d) >= 1)
                total = np.where(use, x + c + d, 0)
                i = int(np.argmax(total))
                if total[i] > best:
                    best = int(total[i])
                    found.append((x, int(c[i]), int(d[i])))
                if best == space:
                    break
    found.sort(key=lambda f: (-sum(f), len(f)))
    return [f for f in found[:BRANCHES] if sum(f) >= least]


def _sums(stock: _Stock, lengths: list[int], space: int) -> list[int]:
    """Bits of the sums up to ``space`` that the first 0, 1, 2 ... lengths make."""
    every = (2 << space) - 1
    now, out = 1, [1]
    for s in lengths:
        left, part = min(stock.count[s], space // s), 1
        while left > 0 and now != every:
            now |= now << s * min(part, left) & every
            left, part = left - part, 2 * part
        out.append(now)
    return out


def _above(sums: int, waste: int) -> int:
    """Bits t + 1 .. t + ``waste`` of every bit t."""
    out, width = (sums << 1 if waste else 0), 1
    while width < waste:
        step = min(width, waste - width)
        out |= out << step
        width += step
    return out


def _fillings(stock: _Stock, space: int, least: int, budget: _Budget, even: bool = False):
    """Undominated fillings of ``space`` that fill ``least`` or more, of any
    number of pieces, least waste first, each made when it is asked for.  Of
    equal waste, those with the longest pieces come first, or, when ``even``,
    those whose longest piece is shortest.

    A filling is dominated when a piece left over could replace some of its
    pieces (or none): a longer piece that still fits, or one piece as long as
    several.  Pieces are added longest first, so a branch is dropped as soon as
    a piece at least as long as the last one shows that.
    """
    if stock.bits >> space & 1 and space:
        yield (space,)
        return
    lengths = [s for s in stock.lengths[:bisect.bisect_right(stock.lengths, space)] if stock.count[s]]
    sums = _sums(stock, lengths, space)

    def extend(i: int, rest: int, waste: int, over: int, some: int, many: int):
        """``rest`` filled exactly by lengths before place i.  ``over``: lengths
        left over; ``some``, ``many``: sums of any, of two or more pieces taken."""
        top = min(i, bisect.bisect_right(lengths, rest))
        places = range(bisect.bisect_left(range(top), 1, key=lambda j: sums[j + 1] >> rest & 1), top)
        for j in places if even else reversed(places):
            s = lengths[j]
            for k in range(min(stock.count[s], rest // s), 0, -1):
                after = rest - k * s
                if not sums[j] >> after & 1:
                    continue
                left = over if stock.count[s] > k else over ^ 1 << s
                a, m = some, many
                for _ in range(k):
                    a, m = a | a << s, m | (a ^ 1) << s
                worse = left & (m | _above(a, waste))
                if worse >> s if after else worse:
                    budget.left -= 1 / DROPPED
                    if budget.left < 0:
                        return
                elif after:
                    for more in extend(j, after, waste, left, a, m):
                        yield (*(s,) * k, *more)
                else:
                    yield (s,) * k
                if budget.left < 0:
                    return

    for total in range(space, max(least, 1) - 1, -1):
        if sums[-1] >> total & 1:
            yield from extend(len(lengths), total, space - total, stock.bits, 1, 0)
        if budget.left < 0:
            return
    if least <= 0 and not lengths:
        yield ()


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs.  For every small length k: pieces above
    capacity - k share with nothing of k or more, pieces above half share with
    each other never, and what the latter leave open must hold the rest."""
    size = np.arange(capacity + 1)
    n = np.concatenate(([0], np.cumsum(count)))                 # pieces below a length
    w = np.concatenate(([0], np.cumsum(count * size)))
    half = capacity // 2
    k = np.arange(half + 1)
    above, mid = n[-1] - n[capacity - k + 1], n[capacity - k + 1] - n[half + 1]
    open_ = mid * capacity - (w[capacity - k + 1] - w[half + 1])
    rest = w[half + 1] - w[k]
    more = np.maximum(0, -(-(rest - open_) // capacity))
    return int((above + mid + more).max())


def best_fit(count: np.ndarray, capacity: int) -> list[list[int]]:
    """The incumbent: longest piece first, each into the fullest bin it fits."""
    spaces: list[int] = []                     # distinct open spaces, ascending
    at: dict[int, list[list[int]]] = {}        # space -> its bins
    bins = []
    for s in np.flatnonzero(count)[::-1].tolist():
        for _ in range(int(count[s])):
            i = bisect.bisect_left(spaces, s)
            if i < len(spaces):
                space = spaces[i]
                b = at[space].pop()
                if not at[space]:
                    del at[space], spaces[i]
            else:
                space, b = capacity, []
                bins.append(b)
            b.append(s)
            if space > s:
                if space - s not in at:
                    at[space - s] = []
                    bisect.insort(spaces, space - s)
                at[space - s].append(b)
    return bins


def complete(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of piece lengths) for one group of pieces."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    full = [[capacity]] * int(count[capacity])
    count[capacity] = 0
    weight = int((count * np.arange(capacity + 1)).sum())
    bound = lower_bound(count, capacity)

    def descend(stock: _Stock, fillings, allowed: int, budget: _Budget) -> list | None:
        """Depth first from no bins; None when every way wastes more than
        ``allowed`` or the node budget ends.  A bin keeps how many of its
        fillings were made: the next ones are made again from its stock, twice
        as many each time, so a long path holds no open enumerations."""
        waste = 0
        path = []                              # [largest, made, fillings to try, filling]
        while stock.bits:
            big = stock.bits.bit_length() - 1
            stock.take(big)
            path.append([big, 0, [], ()])
            while True:
                big, made, ways, _ = bin_ = path[-1]
                space = capacity - big
                if not ways:
                    least = space - (allowed - waste)
                    bin_[2] = ways = list(islice(fillings(stock, space, least, budget),
                                                 made, made + max(1, made)))[::-1]
                    bin_[1] = made + len(ways)
                budget.left -= 1
                if budget.left < 0:
                    return None
                if ways:
                    break
                path.pop()                         # every filling is tried: go back
                stock.give(big)
                if not path:
                    return None
                for s in path[-1][3]:
                    stock.give(s)
                waste -= capacity - path[-1][0] - sum(path[-1][3])
            bin_[3] = pick = ways.pop()
            for s in pick:
                stock.take(s)
            waste += space - sum(pick)
        return [[big, *pick] for big, _, _, pick in path]

    best = best_fit(count, capacity)
    for kind, fillings in ((_Floors, _few), (_Stock, _fillings), (_Stock, partial(_fillings, even=True))):
        budget = _Budget(NODES)
        while len(best) > bound and budget.left > 0:
            budget.left += len(best)
            better = descend(kind(count), fillings, (len(best) - 1) * capacity - weight, budget)
            if better is None:
                break
            best = better
        if len(best) == bound or budget.left >= 0 and fillings is not _few:
            break                              # every way was tried, or the bound is met
    return full + best


def pack(pieces: DataFrame, size: int = 2048, group: int = GROUP,
         key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (length, any more columns) with ``sequence_id`` and ``offset``.
    Lengths lie between 1 and ``size``.  ``key`` deals the pieces to groups: rows
    of equal keys share a group, so it should tell rows apart."""
    total = pieces.count()
    groups = max(1, -(-total // group))
    cols = pieces.columns

    def solve(pdf):
        pdf = pdf.sort_values(["length", *key], kind="stable").reset_index(drop=True)
        length = pdf["length"].to_numpy(np.int64)
        bins = complete(length, size)
        at = np.searchsorted(length, np.arange(size + 2))
        nxt = at[:-1].tolist()
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        base = int(pdf["_g"].iloc[0]) if len(pdf) else 0
        for k, b in enumerate(bins):
            place = 0
            for s in b:
                seq[nxt[s]], off[nxt[s]] = base + k * groups, place
                nxt[s] += 1
                place += s
        return pdf[cols].assign(sequence_id=seq, offset=off)

    keyed = pieces.withColumn("_g", F.pmod(F.xxhash64(*key), F.lit(groups)))
    # 64-bit columns travel as text: pandas turns them into doubles beside a null
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    wide = [c for c, kind in kinds.items() if kind == "bigint" and c != "length"]
    keyed = keyed.withColumns({c: F.col(c).cast("string") for c in wide})
    schema = ", ".join(f"`{c}` {'string' if c in wide else kind}" for c, kind in kinds.items())
    packed = keyed.groupBy("_g").applyInPandas(solve, schema + ", sequence_id bigint, offset bigint")
    return packed.withColumns({c: F.col(c).cast("bigint") for c in wide})


def pack_documents(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Tokenise, cut and pack ``docs``; the pieces are written once, so the
    tokenizer does not run again when groups are counted or solved anew.

    Pieces are dealt by a row number that is written with them: rows that repeat
    one id, or have none, spread over the groups like any others."""
    pieces = tokenize(docs, path, size).withColumn("_row", F.monotonically_increasing_id())
    return pack(write_once(pieces, "pieces"), size, key=("_row",)).drop("_row")
