"""Language identification by words first, shorter character n-grams after.

Training counts, over all training rows:

* words -- runs of letters in lower case, cut to pieces of ``LONGEST`` --
  per language; counted in the tasks, then summed;
* character n-grams of ``GRAMS`` down to 1 characters of those words, with a
  mark at both ends, weighted by the words' counts: made from the summed word
  table, so no text is read twice.

The model is the ``ENTRIES`` most frequent (level, key, language) counts, the
totals of each level and language, and the languages' shares of the training
rows.  It is bounded whatever the corpus, and sent to the tasks; a word beyond
it counts as unseen, which the method answers with n-grams.

A known word adds its log frequency in every language (add ``SMOOTH``).  An
unseen word adds the mean log frequency of its n-grams of the greatest length
of which the model knows any.  The sums start from the log shares; the greatest
wins (ties: the lesser name), and ``score`` is its probability among all.

Null text, or text without a letter, is ``und`` with score 0, and so is every
text if no row could be learned from.  Texts are whole, in slices.  Rows
without an id or language are not learned from; a language is any non-null
value.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import with_columns, write_once

LONGEST = 40
GRAMS = 5
ENTRIES = 200_000
SMOOTH = 0.1
SLICE = 1 << 18
UNKNOWN = "und"
EDGE = " "               # marks both ends of a word in its n-grams
CACHE = 1 << 20          # numbers kept of words already looked up, per task
HELD = 200_000           # counts a task holds before it gives them away
GIVE = 20_000            # rows of one output batch

# A word: a run of letters.  [^\W\d_] also holds the few numerals that are not
# decimal digits; words with one are cut at it (``clean``).
WORD = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[\W\d_]")


def word_lists(text: str) -> Iterator[list[str]]:
    """Raw words of ``text`` in lower case, slice by slice."""
    low = text.lower()
    at = 0
    while at < len(low):
        end = len(low)
        if end - at > SLICE:
            gap = GAP.search(low, at + SLICE)
            end = gap.start() if gap else end
        yield WORD.findall(low, at, end)
        at = end


def clean(found: dict[str, int]) -> dict[str, int]:
    """Counts of words: letters only, in pieces of at most LONGEST."""
    if not found or max(map(len, found)) <= LONGEST and "".join(found).isalpha():
        return found
    out = Counter()
    for word, n in found.items():
        for part in [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split():
            for i in range(0, len(part), LONGEST):
                out[part[i: i + LONGEST]] += n
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out()).select("lang", "text")


def given(keys: list, part: dict[str, int], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """``part`` as batches of at most GIVE rows (``keys``, key, n)."""
    rest = iter(part.items())
    while some := list(islice(rest, GIVE)):
        words, counts = zip(*some)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k] * len(some), kind) for k, kind in zip(keys, kinds)]
            + [pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=names + ["key", "n"])


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, key, n) of the words of (lang, text)."""
    def run(batches):
        total: dict[str, Counter] = {}

        def give():
            for lang, part in total.items():
                yield from given([lang], clean(part), ["lang"], [pa.string()])
            total.clear()

        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                part = total.setdefault(batch.column(0)[i].as_py(), Counter())
                for words in word_lists(text or ""):
                    held -= len(part)
                    part.update(words)
                    held += len(part)
                    if held > HELD:
                        yield from give()
                        held, part = 0, Counter()
                        total[batch.column(0)[i].as_py()] = part
        yield from give()

    return (rows.select("lang", "text").mapInArrow(run, "lang string, key string, n bigint")
            .groupBy("lang", "key").agg(F.sum("n").alias("n")))


def count_grams(words: DataFrame) -> DataFrame:
    """(level, lang, key, n): level 0 holds the words, level g their g-grams."""
    def run(batches):
        total: dict[tuple, dict[str, int]] = {}

        def give():
            for (level, lang), part in total.items():
                yield from given([level, lang], part, ["level", "lang"], [pa.int32(), pa.string()])
            total.clear()

        for batch in batches:
            for j, (lang, key, n) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                padded = EDGE + key + EDGE
                for g in range(1, min(GRAMS, len(padded)) + 1):
                    part = total.setdefault((g, lang), {})
                    for i in range(g == 1, len(padded) - g + 1 - (g == 1)):     # no bare mark
                        gram = padded[i: i + g]
                        part[gram] = part.get(gram, 0) + n
                if j % 256 == 0 and sum(map(len, total.values())) > HELD:
                    yield from give()
        yield from give()

    schema = "level int, lang string, key string, n bigint"
    return words.select(F.lit(0).alias("level"), "lang", "key", "n").unionByName(
        words.select("lang", "key", "n").mapInArrow(run, schema)
        .groupBy("level", "lang", "key").agg(F.sum("n").alias("n")))


class Model:
    """Bounded tables of log frequencies: per level the keys' numbers, and per
    number the languages that have the key (all others are at the floor)."""

    def __init__(self, langs: list[str], shares: np.ndarray, entries: list[tuple], totals: dict):
        """``entries``: (level, key, lang number, n); ``totals``: (level, lang number) -> (n, keys)."""
        self.langs, self.prior = langs, np.log(shares)
        self.keys: list[dict[str, int]] = [{} for _ in range(GRAMS + 1)]
        scale = np.ones((GRAMS + 1, len(langs)))
        for level in range(GRAMS + 1):
            own = [totals.get((level, i), (0, 0)) for i in range(len(langs))]
            scale[level] = [n for n, _ in own]
            scale[level] += SMOOTH * max([keys for _, keys in own] + [1])
        self.floor = np.log(SMOOTH / scale)
        made = 0
        at = np.empty(len(entries), np.int64)
        for i, (level, key, _, _) in enumerate(entries):
            at[i] = self.keys[level].setdefault(key, made)
            made += at[i] == made
        level, lang, n = (np.array([e[j] for e in entries], np.int64) for j in (0, 2, 3))
        order = np.argsort(at, kind="stable")
        self.start = np.searchsorted(at[order], np.arange(made + 1))
        self.lang = lang[order]
        # what the entry adds to the floor
        self.gain = (np.log((n + SMOOTH) / scale[level, lang]) - self.floor[level, lang])[order]

    def numbers(self, word: str) -> tuple[int, list[int]]:
        """The level that answers for a word, and its keys' numbers there: the
        word itself, else its longest known n-grams."""
        own = self.keys[0].get(word)
        if own is not None:
            return 0, [own]
        padded = EDGE + word + EDGE
        for g in range(min(GRAMS, len(padded)), 0, -1):
            known = self.keys[g]
            got = [known[k] for i in range(len(padded) - g + 1) if (k := padded[i: i + g]) in known]
            if got:
                return g, got
        return 0, []

    def words(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words, one row each (no known n-gram: zeros)."""
        found = [self.numbers(w) for w in words]
        out = np.zeros((len(words), len(self.langs)))
        size = np.array([len(got) for _, got in found])
        flat = np.array([i for _, got in found for i in got], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        n = self.start[flat + 1] - self.start[flat]
        at = np.repeat(self.start[flat] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(word, n) * len(self.langs) + self.lang[at]
        gain = np.bincount(cell, self.gain[at], minlength=out.size).reshape(out.shape)
        some = size > 0
        out[some] = (gain[some] / size[some, None]
                     + self.floor[np.array([level for level, _ in found], np.int64)[some]])
        return out


class Scorer:
    """Predicts texts; words already looked up stay in a bounded table."""

    def __init__(self, model: Model):
        self.model = model
        self.limit = max(1024, CACHE // max(1, len(model.langs)))
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(model.langs)))

    def _add(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            a, b = len(self.known), len(self.known) + len(new)
            if b > len(self.table):
                grown = np.empty((2 * b, len(self.model.langs)))
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[a:b] = self.model.words(new)
            self.known.update(zip(new, range(a, b)))
        return counts @ self.table[[self.known[w] for w in words]]

    def predict(self, text: str | None) -> tuple[str, float]:
        total, letters = self.model.prior.copy(), False
        for words in word_lists(text or ""):
            found = clean(Counter(words))
            if not found:
                continue
            letters = True
            words, counts = list(found), np.fromiter(found.values(), float, len(found))
            for a in range(0, len(words), 1024):
                total += self._add(words[a: a + 1024], counts[a: a + 1024])
        if not letters or not len(total):
            return UNKNOWN, 0.0
        at = int(np.argmax(total))
        return self.model.langs[at], float(1 / np.exp(total - total[at]).sum())


def fit(docs: DataFrame, entries: int = ENTRIES) -> Model:
    """The model of all training rows of ``docs`` (doc_id, lang, text)."""
    rows = training_rows(docs)
    words = write_once(count_words(rows), "langwords")
    counts = write_once(count_grams(words), "langcounts")
    kept = write_once(counts.orderBy(F.desc("n"), "level", "key", "lang").limit(entries), "langmodel")
    # languages of the model, by name: at most ``entries`` rows reach the driver
    named = kept.select("lang").distinct()
    shares = rows.groupBy("lang").count().join(F.broadcast(named), "lang", "left_semi").orderBy("lang").collect()
    langs = [r["lang"] for r in shares]
    number = {lang: i for i, lang in enumerate(langs)}
    totals = {(r["level"], number[r["lang"]]): (r["n"], r["keys"]) for r in
              counts.groupBy("level", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
              .join(F.broadcast(named), "lang", "left_semi").collect()}
    part = np.array([r["count"] for r in shares], float)
    return Model(langs, part / max(1.0, part.sum()),
                 [(r["level"], r["key"], number[r["lang"]], r["n"]) for r in kept.toLocalIterator()], totals)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; no other column is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)      # at most ENTRIES counts
    state: dict = {}

    def make(texts):
        if "scorer" not in state:       # one per task
            state["scorer"] = Scorer(sent.value)
        got = [state["scorer"].predict(t) for t in texts]
        return [[g[0] for g in got], [g[1] for g in got]]

    return with_columns(docs, ["text"], make, {"lang_pred": "string", "score": "double"})
