"""N-gram Jaccard join: documents whose word-shingle sets agree to 75 % or more.

1. Each document's distinct 5-word shingles (64-bit hashes) get a fixed order,
   rare ones first (``Order``, estimated on one document in ``SAMPLE``; only the
   order depends on it, never the result): at most ``FREQUENT`` frequent shingles
   come last, the others go by how common their words are, then by hash.  Two
   documents that link share a shingle among the first ``n - ceil(0.75 n) + 1`` of
   each.  Rare ones first, since what is shared by chance or from a template grows
   with the input, and with its square in pairs.
2. Rows with the same set become one class, with its smallest id.
3. Shingles held by at most ``SMALL`` classes pair them (sizes within 4:3), and
   a pair goes on only if it shares as many leading shingles as the overlap
   needs.  A shingle held by more classes ties them all to one tile instead.
4. Classes connected this way form a tile; more than ``BLOCK`` are cut along
   their size order into blocks, each a tile.  In a tile, hashed bitmaps bound the
   overlap of two sets from above; only pairs that pass and are not yet connected
   get the exact sorted-array intersection.
5. Pairs of blocks whose sizes can agree meet as bitmaps, a few bits a shingle: a
   text is sent to a pair of blocks only if a class there may link to it and is not
   yet in its component.  First one pair of classes for two components, then, of
   what is still apart, all.
6. Links are joined to components; each class member gets its class's.

No pair that meets the threshold is lost: every step drops only pairs that
cannot meet it, or that are connected already.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; fewer than five words
make one shingle of the whole sequence; no words (or null text): empty set, no
links.  Rows repeating an id stay rows of their own sets, linked to each other
by definition (a row without words is linked with nothing, whatever its id); the
result has a row for each.  A row without an id links with nothing: its
component and class are null.  Classes are numbered once, in a written table, so
no step takes an id for the key of a set.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shotsmith.llm.common import by_chars, drop_copy, mix, windows, with_columns, word_spans, write_once
from shotsmith.llm.components import components

SHINGLE = 5
NUM, DEN = 3, 4          # threshold 75 / 100
SMALL = 48               # classes of a shingle that are paired directly
BLOCK = 1024             # classes in a block of a large tile
SAMPLE = 8
FREQUENT = 200_000
WORDS = 65_536           # words whose frequency the order knows
PLACES = 18              # bits of a word's place in the table of costs


def _words(text: str | None) -> np.ndarray:
    return word_spans((text or "").encode(), lower=True)[2]


def _shingles(words: np.ndarray) -> np.ndarray:
    """The shingle hash at every word that begins one."""
    if 0 < len(words) < SHINGLE:
        return mix(windows(words, len(words)) + np.uint64(len(words)))
    return mix(windows(words, SHINGLE))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(_shingles(_words(text)))


def lead(n):
    """How many leading shingles must hold a common one."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def need(a, b):
    """Least overlap of sets of sizes a and b that links them."""
    return -(-NUM * (a + b) // (NUM + DEN))


class Order:
    """Ranks shingles, rare ones first.  ``hot``: sorted hashes that come last;
    ``cost``: by the top bits of a word's hash, how common the word is (words that
    share a place share the larger cost: that moves shingles, for all texts alike)."""

    def __init__(self, hot: np.ndarray, words: np.ndarray, counts: np.ndarray):
        self.hot = np.sort(hot.view(np.uint64))
        self.cost = np.zeros(1 << PLACES, np.int16)
        np.maximum.at(self.cost, self._place(words.view(np.uint64)), (8 * np.log2(1.0 + counts)).astype(np.int16))

    @staticmethod
    def _place(words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - PLACES)).astype(np.int64)

    def sets(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of a text, and its leading ones."""
        words = _words(text)
        s, at = np.unique(_shingles(words), return_index=True)
        if not len(s):
            return s, s
        total = np.concatenate(([0], np.cumsum(self.cost[self._place(words)], dtype=np.int64)))
        size = min(SHINGLE, len(words))
        key = total[at + size] - total[at]
        if len(self.hot):
            near = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
            key[self.hot[near] == s] += 1 << 14       # above every sum of SHINGLE costs
        return s, s[np.argsort(key.astype(np.int16), kind="stable")[: lead(len(s))]]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): ``key`` tells texts of one id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn(
        "key", F.xxhash64("text"))


def order(docs: DataFrame) -> Order:
    """The order of shingles, from the documents of a sample: every shingle of
    theirs is counted, not the leading ones, since what is put last lets others lead."""
    def run(batches):
        for pdf in batches:
            texts = [t for t in pdf["text"] if t]
            for a, b in by_chars(texts):
                words = [_words(t) for t in texts[a:b]]
                for word, part in ((True, words), (False, [np.unique(_shingles(w)) for w in words])):
                    h, c = np.unique(np.concatenate(part), return_counts=True)
                    yield pd.DataFrame({"word": word, "h": h.view(np.int64), "c": c.astype(np.int64)})

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"h": [pdf["h"].to_numpy(np.int64).tobytes()], "c": [pdf["c"].to_numpy(np.int64).tobytes()]})

    def most(kind: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
        got = (counted.where(kind).orderBy(F.desc("c"), "h").limit(limit).select("h", "c")
               .mapInPandas(pack, "h binary, c binary").collect())
        return tuple(np.frombuffer(b"".join(bytes(r[k]) for r in got), np.int64) for k in ("h", "c"))

    counted = write_once(
        docs.where("doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
        .select("text").mapInPandas(run, "word boolean, h bigint, c bigint")
        .groupBy("word", "h").agg(F.sum("c").alias("c"))
        .where(F.col("word") & (F.col("c") > 1) | (F.col("c") > max(2, SMALL // SAMPLE))), "frequent")
    made = Order(most("NOT word", FREQUENT)[0], *most("word", WORDS))
    drop_copy(counted)
    return made


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sets(rows: DataFrame, order: Order) -> DataFrame:
    """(doc_id, key, n, sig, lead): set size, set digest, packed leading shingles."""
    sent = rows.sparkSession.sparkContext.broadcast(order)    # at most FREQUENT hashes and a table of costs

    def run(texts):
        made = []
        for text in texts:
            s, first = sent.value.sets(text)
            made.append((len(s), digest(s), first.tobytes()))
        return tuple(zip(*made)) if made else ((), (), ())

    return with_columns(rows, ["text"], run, {"n": "bigint", "sig": "binary", "lead": "binary"}, drop=("text",))


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(u, v) between classes (rep, n, lead) that may link, or that share a tile."""
    def run(batches):
        for pdf in batches:
            part = [np.frombuffer(x, np.int64) for x in pdf["lead"]]
            size = [len(p) for p in part]
            if sum(size):
                yield pd.DataFrame({"h": np.concatenate(part), "d": np.repeat(pdf["rep"].to_numpy(), size),
                                    "n": np.repeat(pdf["n"].to_numpy(np.int64), size)})

    by_shingle = W.partitionBy("h")
    entries = (classes.mapInPandas(run, "h bigint, d bigint, n bigint")
               .withColumn("m", F.count("*").over(by_shingle)).where("m > 1")
               .withColumn("first", F.min("d").over(by_shingle)))
    entries = write_once(entries, "shared")
    star = entries.where(F.col("m") > SMALL).where("d <> first").select(
        F.col("d").alias("u"), F.col("first").alias("v")).distinct()
    pairs = (entries.where(F.col("m") <= SMALL).groupBy("h")
             .agg(F.array_sort(F.collect_list(F.struct("n", "d"))).alias("l"))
             .select(F.explode(F.expr(
                 "flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, size(l)), "
                 f"y -> {NUM} * y.n <= {DEN} * x.n), y -> struct(x.d AS a, y.d AS b, x.n AS na, y.n AS nb))))"
             )).alias("p")).groupBy("p.a", "p.b", "p.na", "p.nb").agg(F.count("*").alias("c")))
    beyond = lambda n: n - (n - F.floor((NUM * n + DEN - 1) / DEN) + 1)
    least = (F.ceil(NUM * (F.col("na") + F.col("nb")) / (NUM + DEN))
             - F.greatest(beyond(F.col("na")), beyond(F.col("nb"))))
    close = pairs.where(F.col("c") >= least).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return star.unionByName(close)


def _bitmaps(arrays: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(arrays), bits // 64), np.uint64)
    for i, s in enumerate(arrays):
        at = (s % np.uint64(bits)).astype(np.int64)
        np.bitwise_or.at(out[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def link_tile(ids: list[int], arrays: list[np.ndarray], left: np.ndarray, right: np.ndarray,
              root: np.ndarray | None = None) -> list[tuple]:
    """Links (a spanning forest) between rows flagged ``left`` and ``right``,
    in size order: bitmap bound first, exact intersection after.  Rows of equal
    ``root`` are connected already."""
    size = np.array([len(s) for s in arrays], np.int64)
    bits = 1 << min(13, max(6, int(2 * size.mean()).bit_length()))
    maps = _bitmaps(arrays, bits)
    root = np.arange(len(ids)) if root is None else root.copy()
    links = []
    reach = np.searchsorted(size, size * DEN // NUM, side="right")
    for i in range(len(ids)):
        j = np.arange(i + 1, reach[i])
        if left[i] and right[i]:
            pass
        elif left[i]:
            j = j[right[j]]
        else:
            j = j[left[j]]
        j = j[root[j] != root[i]]
        if not len(j):
            continue
        most = np.minimum(size[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1, dtype=np.int64),
                          size[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1, dtype=np.int64))
        for k in j[most >= need(size[i], size[j])].tolist():
            if root[k] == root[i]:
                continue
            both = np.intersect1d(arrays[i], arrays[k], assume_unique=True)
            if DEN * len(both) >= NUM * (size[i] + size[k] - len(both)):
                links.append((ids[i], ids[k]))
                root[root == root[k]] = root[i]
    return links


def full_map(s: np.ndarray) -> np.ndarray:
    """A set's bitmap of two to four bits a member: a power of two, so that it folds."""
    return _bitmaps([s], 1 << max(6, int(2 * len(s) - 1).bit_length()))[0]


def _fold(maps: list[np.ndarray], words: int) -> np.ndarray:
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, words)) for m in maps])


def may_link(size: np.ndarray, maps: list[np.ndarray], left: np.ndarray, component: np.ndarray,
             every: bool) -> np.ndarray:
    """Flags the rows with a partner on the other side that is in another component
    and whose bitmap allows a link: all of them (``every``), or the likeliest pair
    of each two components."""
    a = np.flatnonzero(left)
    b = np.flatnonzero(~left)
    out = np.zeros(len(size), bool)
    if not len(a) or not len(b):
        return out
    b = b[np.argsort(size[b], kind="stable")]
    words = min(map(len, maps))
    x, y = _fold([maps[i] for i in a], words), _fold([maps[i] for i in b], words)
    over_x = size[a] - np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    over_y = size[b] - np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k, i in enumerate(a.tolist()):
        first = np.searchsorted(size[b], -(-NUM * size[i] // DEN))
        last = np.searchsorted(size[b], size[i] * DEN // NUM, side="right")
        j = np.arange(first, last)
        j = j[component[b[j]] != component[i]]
        if not len(j):
            continue
        both = np.bitwise_count(y[j] & x[k]).sum(axis=1, dtype=np.int64)
        spare = both + np.minimum(over_x[k], over_y[j]) - need(size[i], size[b[j]])
        j, spare = j[spare >= 0], spare[spare >= 0]
        if every:
            out[b[j]] = True
            out[i] |= len(j) > 0
            continue
        j = j[np.argsort(-spare, kind="stable")]
        spare = np.sort(spare)[::-1]
        for c, at in zip(*(v.tolist() for v in np.unique(component[b[j]], return_index=True))):
            if (pair := (int(component[i]), c)) not in best or best[pair][0] < spare[at]:
                best[pair] = (int(spare[at]), i, int(b[j[at]]))
    for _, i, j in best.values():
        out[[i, j]] = True
    return out


def blocks(members: DataFrame) -> DataFrame:
    """(rep, tile, component, band, slice) of every class that has others in its
    component, from (rep, n, component).  A component up to BLOCK classes is one
    tile, without band and slice; a larger one has a tile for each size band and
    hash slice of at most about BLOCK classes."""
    size = members.groupBy("component").agg(F.count("*").alias("members"))
    rows = members.join(size, "component").where("members > 1")
    small = rows.where(F.col("members") <= BLOCK).select(
        "rep", F.concat_ws("/", "component").alias("tile"), "component",
        F.lit(None).cast("int").alias("band"), F.lit(None).cast("int").alias("slice"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int")
    large = rows.where(F.col("members") > BLOCK).withColumn("band", band)
    held = large.groupBy("component", "band").agg(F.count("*").alias("k")).withColumn(
        "slices", F.ceil(F.col("k") / BLOCK).cast("int"))
    large = large.join(held.select("component", "band", "slices"), ["component", "band"]).withColumn(
        "slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    return small.unionByName(large.select(
        "rep", F.concat_ws("/", "component", "band", "slice").alias("tile"), "component", "band", "slice"))


def block_pairs(large: DataFrame) -> DataFrame:
    """(rep, tile, left): the two sides of every pair of blocks of a component whose
    sizes can agree, from (rep, component, band, slice)."""
    one = large.select("component", "band", "slice").distinct()
    other = one.select("component", F.col("band").alias("band2"), F.col("slice").alias("slice2"))
    pair = one.join(other, "component").where(
        "band2 = band AND slice2 > slice OR band2 = band + 1").withColumn(
        "tile", F.concat_ws("/", "component", "band", "slice", "band2", "slice2"))
    sides = [pair.select("component", F.col(x).alias("band"), F.col(y).alias("slice"), "tile", F.lit(z).alias("left"))
             for x, y, z in (("band", "slice", True), ("band2", "slice2", False))]
    return large.join(sides[0].unionByName(sides[1]), ["component", "band", "slice"]).select("rep", "tile", "left")


def _flagged(docs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with ``_maybe``: false for most rows whose ``keys`` are not in ``wanted``,
    true for all others.  A bitmap of hashed keys, at most 16 MB, is sent to the scan, so
    that few texts are shuffled for nothing."""
    bits = min(1 << 27, 1 << max(15, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    chunk, at = F.floor(place / 32768), place % 32768
    maps = wanted.select(chunk.alias("_chunk"), (at + 1).alias("_at")).groupBy("_chunk").agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0
    return (docs.withColumns({"_chunk": chunk, "_bit": at}).join(F.broadcast(maps), "_chunk", "left")
            .select(*docs.columns, F.coalesce(bit, F.lit(False)).alias("_maybe")))


def _some_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` without most rows whose (doc_id, key) is not in ``wanted``."""
    return _flagged(docs, wanted, ["doc_id", "key"]).where("_maybe").drop("_maybe")


def same_id(every: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v) between the classes of rows that repeat an id."""
    held = every.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "sig")
    low = held.groupBy("doc_id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high")
    ties = held.join(low.select("doc_id", "low"), "doc_id").where("sig <> low").select("sig", "low").distinct()
    return (ties.join(classes.select("sig", F.col("rep").alias("u")), "sig")
            .join(classes.select(F.col("sig").alias("low"), F.col("rep").alias("v")), "low").select("u", "v"))


def link_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row."""
    docs = _rows(docs)
    full = write_once(sets(docs, order(docs)), "sets")
    # equal sets have equal leading shingles, so any member's serve the class
    led = write_once(
        full.where("doc_id IS NOT NULL AND n > 0").groupBy("sig")
        .agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min("n").alias("n"), F.min("lead").alias("lead"))
        .select("sig", "first.doc_id", "first.key", "n", "lead", F.monotonically_increasing_id().alias("rep")),
        "led")
    # leading shingles are a quarter of all: kept only as long as they are read
    every = write_once(full.drop("lead"), "rows")
    drop_copy(full)
    classes = write_once(led.drop("lead"), "classes")
    found = components(candidate_edges(led.select("rep", "n", "lead")))
    drop_copy(led)
    members = write_once(found.withColumnRenamed("id", "rep").join(classes.select("rep", "n"), "rep"), "members")
    routed = write_once(blocks(members), "tiles")
    wanted = routed.select("rep", "tile").join(classes.select("rep", "doc_id", "key", "sig"), "rep")
    texts = _some_of(docs, wanted).join(wanted.hint("shuffle_hash"), ["doc_id", "key"]).select("rep", "sig", "tile", "text")
    if every.count() > every.select("doc_id", "key").distinct().count():
        # rows repeated whole: one of them is enough
        texts = texts.distinct()
    texts = write_once(texts, "texts")

    def own(pdf):
        """One row a class, in size order: rows may repeat, and another text of the id may have the key."""
        arrays = [shingles(t) for t in pdf["text"]]
        reps = pdf["rep"].tolist()
        first = {r: i for i, r in enumerate(reps) if digest(arrays[i]) == pdf["sig"].iat[i]}
        at = sorted(first.values(), key=lambda i: (len(arrays[i]), reps[i]))
        return pdf.iloc[at], [arrays[i] for i in at]

    def solve(pdf):
        pdf, arrays = own(pdf)
        if "left" in pdf:
            left = pdf["left"].to_numpy(bool)
            part = pdf["component"].to_numpy(np.int64)      # the links of components, not of classes
            got = link_tile(part.tolist(), arrays, left, ~left, part)
        else:
            one = np.ones(len(pdf), bool)
            got = link_tile(pdf["rep"].tolist(), arrays, one, one)
        return pd.DataFrame(got, columns=["u", "v"], dtype="int64")

    def mapped(batches):
        for pdf in batches:
            pdf, arrays = own(pdf)
            yield pd.DataFrame({"rep": pdf["rep"], "n": np.array([len(s) for s in arrays], np.int64),
                                "map": [full_map(s).tobytes() for s in arrays]})

    def meet(every):
        def run(pdf):
            keep = may_link(pdf["n"].to_numpy(np.int64), [np.frombuffer(m, np.uint64) for m in pdf["map"]],
                            pdf["left"].to_numpy(bool), pdf["component"].to_numpy(np.int64), every)
            return pdf.loc[keep, ["tile", "rep", "left", "component"]]
        return run

    links = texts.groupBy("tile").applyInPandas(solve, "u bigint, v bigint")
    joined = components(links.unionByName(same_id(every, classes)))
    large = routed.where("band IS NOT NULL").select("rep", "component", "band", "slice")
    if not large.isEmpty():
        maps = write_once(texts.select("rep", "sig", "text").join(large.select("rep"), "rep", "left_semi")
                          .mapInPandas(mapped, "rep bigint, n bigint, map binary").dropDuplicates(["rep"]), "maps")
        for all_pairs in (False, True):
            sides = (block_pairs(large).join(maps, "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
                     .withColumn("component", F.coalesce("component", "rep")))
            near = write_once(sides.groupBy("tile").applyInPandas(
                meet(all_pairs), "tile string, rep bigint, left boolean, component bigint"), "near")
            if near.isEmpty():
                break
            moved = components(near.join(texts.select("rep", "sig", "text"), "rep").groupBy("tile")
                               .applyInPandas(solve, "u bigint, v bigint"))
            to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
            joined = write_once(joined.join(to, "component", "left").select(
                "id", F.coalesce("to", "component").alias("component")).unionByName(
                moved.join(joined, "id", "left_anti")), "joined")
    numbered = classes.select("sig", "rep", F.col("doc_id").alias("class_id")).join(
        joined.withColumnRenamed("id", "rep"), "rep", "left")
    least = numbered.where("component IS NOT NULL").groupBy("component").agg(F.min("class_id").alias("least"))
    classed = numbered.join(least, "component", "left").select(
        "sig", "class_id", F.coalesce("least", "class_id").alias("component_id"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return every.join(classed, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the smallest id.  Rows
    without an id stay."""
    go = write_once(link_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")), "gone")
    return without(docs, go)


def without(docs: DataFrame, go: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``go`` (_gone).  Only rows that may go are shuffled."""
    marked = _flagged(docs.withColumn("_id", F.col("doc_id").cast("bigint")),
                      go.select(F.col("_gone").alias("_id")), ["_id"]).drop("_id")
    some = marked.where("_maybe")
    some = some.join(go.hint("shuffle_hash"), some["doc_id"] == go["_gone"], "left_anti")
    return marked.where("NOT _maybe").unionByName(some).drop("_maybe")
