"""Secret scans: fixed patterns plus a battery of randomness tests.

Only DataFrame functions: no Python runs in the tasks.

Base spans come from three patterns (``assign``, ``access``, ``hex``).  The
battery adds ``random`` spans: long runs of key characters whose symbols look
drawn at random from the alphabet of their inferred encoding.  Each run gets
three statistics -- chi-squared against the uniform alphabet, Wald-Wolfowitz
runs of low and high symbols, lag-1 serial correlation -- as normal scores,
combined to one probability of randomness.

The decision is made per length band with the Benjamini-Hochberg procedure at
level ``q`` on the battery's own probabilities, so every corpus has what it
needs: the runs it rejects are not random, the others are ``random`` spans.  Of
the runs rejected at most a share of about ``q`` are keys.  That is no bound on
words among the spans; README gives their share for identifiers of program
code.  Letter runs of one case count as words: never spans, and not counted.
The histograms cover all documents; their size is BANDS x LEVELS rows.

Null text is empty: no spans.  Positions count code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import write_once

# Fixed patterns of the base kinds, and the least characters of a match
# (``assign``: of group 2).
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    "access": (r"AKIA[A-Z0-9]+", 16),
    "hex": (r"[0-9a-f]{32,}", 32),       # every maximal run of 32 or more
}
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
BANDS = (20, 32, 48, 64)                  # lower ends of the length bands
END = 2 ** 31 - 1                         # beyond every position
LEVELS = 256                              # eighths of a power of two: level l holds 2**(-l/8) and below
ALPHABETS = {
    "hex": "0123456789abcdef",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-+/",
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: Spark repeats an
    expression inside a lambda function wherever it is named."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, best) -> Column:
    """Running total of an integer array under ``best`` (associative), first to
    last.  Every pass meets each place with the one twice as far before it as
    the last pass did, so n places take log2(n) passes and no array grows."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    steps = F.transform(passes, lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda done, step: F.transform(
        done, lambda x, i: best(x, F.get(done, i - step))))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """ARRAY<STRUCT<start, stop, body>> of the matches of ``pattern``, leftmost
    first.  ``split`` and ``regexp_extract_all`` walk the same matches, so match
    i ends where the running lengths of pieces and matches up to it do."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    size = F.transform(match, F.length)
    gap = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(match))
    ends = _running(F.zip_with(gap, size, lambda g, n: g + n),
                    lambda x, before: x + F.coalesce(before, F.lit(0)))
    walked = F.transform(
        F.arrays_zip(ends.alias("stop"), size.alias("len"), body.alias("body")),
        lambda x: F.struct((x["stop"] - x["len"]).alias("start"), x["stop"].alias("stop"),
                           x["body"].alias("body")))
    none = F.expr("array()").cast("array<struct<start:int,stop:int,body:string>>")
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _spans(text: Column, kind: str) -> Column:
    pattern, least = PATTERNS[kind]
    found = _found(text, pattern, 1 if kind == "assign" else 0)
    return F.transform(F.filter(found, lambda x: F.length(x["body"]) >= least), lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["stop"].alias("stop")))


# --- the battery ---------------------------------------------------------

def _phi(z: Column) -> Column:
    """Normal distribution function (logistic form, error below 2e-4)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565992 * z * z * z)))


def _chi_score(x: Column, df: Column) -> Column:
    """Normal score of a chi-squared value (Wilson-Hilferty)."""
    v = 2 / (9 * df)
    return (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)


def _battery(body: Column, alphabet: Column) -> Column:
    """Probability that ``body`` is a random draw from ``alphabet``."""
    def coded(x):
        code = F.transform(F.split(x["body"], ""), lambda c: F.instr(x["alphabet"], c).cast("double") - 1)
        counts = F.transform(F.split(x["alphabet"], ""), lambda c: (
            F.length(x["body"]) - F.length(F.replace(x["body"], c, F.lit("")))).cast("double"))
        return F.struct(F.length(x["alphabet"]).cast("double").alias("size"),
                        F.filter(code, lambda c: c >= 0).alias("code"),
                        F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"))

    def tallied(x):
        size, mean = x["size"], (x["size"] - 1) / 2
        low = F.aggregate(x["code"], F.lit(0.0), lambda a, c: a + F.when(c < size / 2, 1.0).otherwise(0.0))
        walk = F.aggregate(
            x["code"], F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("prod"),
                                F.lit(0.0).alias("sq")),
            lambda a, c: F.struct(
                c.alias("last"),
                (a["runs"] + F.when((a["last"] < 0) | ((a["last"] < size / 2) != (c < size / 2)), 1.0)
                 .otherwise(0.0)).alias("runs"),
                (a["prod"] + F.when(a["last"] < 0, 0.0).otherwise((a["last"] - mean) * (c - mean))).alias("prod"),
                (a["sq"] + (c - mean) * (c - mean)).alias("sq")))
        return F.struct(size.alias("size"), x["squares"].alias("squares"), low.alias("low"), walk.alias("walk"),
                        F.size(x["code"]).cast("double").alias("n"))

    def combined(x):
        size, n, low, walk = x["size"], x["n"], x["low"], x["walk"]
        high = n - low
        chi = _chi_score(x["squares"] * size / n - n, size - 1)
        expect = 1 + 2 * low * high / n
        spread = F.greatest(F.sqrt(F.greatest(2 * low * high * (2 * low * high - n) / (n * n * (n - 1)),
                                              F.lit(0.0))), F.lit(0.5))
        serial = walk["prod"] / F.greatest(walk["sq"], F.lit(1e-9)) * F.sqrt(n)
        scores = F.struct(chi.alias("chi"), ((walk["runs"] - expect) / spread).alias("runs"), serial.alias("serial"))
        total = _let(scores, lambda z: z["chi"] * z["chi"] + z["runs"] * z["runs"] + z["serial"] * z["serial"])
        return F.when(n >= 8, 1 - _let(_chi_score(total, F.lit(3.0)), _phi)).otherwise(F.lit(0.0))

    given = F.struct(body.alias("body"), alphabet.alias("alphabet"))
    return _let(given, lambda x: _let(coded(x), lambda y: _let(tallied(y), combined)))


def _runs(text: Column) -> Column:
    """ARRAY<STRUCT<start, stop, body, encoding>> of the candidate runs."""
    def encoding(b):
        return (F.when(b.rlike("^[A-Z]?[a-z]+$|^[A-Z]+$"), F.lit("lower"))
                .when(b.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), F.lit("hex"))
                .when(b.rlike("^[A-Z2-7]+=*$"), F.lit("base32"))
                .when(b.rlike("^[A-Z0-9]+$"), F.lit("upper36"))
                .otherwise(F.lit("base64")))
    return F.transform(_found(text, RUN), lambda x: F.struct(
        x["start"].alias("start"), x["stop"].alias("stop"), x["body"].alias("body"),
        encoding(x["body"]).alias("encoding")))


def candidates(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """(``keep``, base spans, scored runs): one pass over the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(keep, *[_spans(text, k).alias(f"_{k}") for k in KINDS[:3]],
                     _runs(text).alias("_runs"))

    def rate(x):
        plain = F.when(x["encoding"].isin("lower", "hex"), F.lower(x["body"])).otherwise(x["body"])
        names = list(ALPHABETS)
        alphabet = F.lit(ALPHABETS[names[-1]])
        for k in names[:-1]:
            alphabet = F.when(x["encoding"] == k, F.lit(ALPHABETS[k])).otherwise(alphabet)
        return F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"),
            (x["encoding"] == "lower").alias("word"),
            _band(x["stop"] - x["start"]).alias("band"),
            F.least(F.floor(-8 * F.log2(F.greatest(_battery(plain, alphabet), F.lit(2.0 ** -LEVELS)))),
                    F.lit(LEVELS - 1)).cast("int").alias("level"))

    return df.withColumn("_runs", F.transform("_runs", rate))


def _band(length: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(BANDS[1:], 1):
        out = F.when(length >= low, F.lit(i)).otherwise(out)
    return out


def thresholds(scored: DataFrame, q: float) -> dict[int, int]:
    """Lowest rejected level of each length band (LEVELS: none), from histograms
    over all documents.  At most BANDS x LEVELS rows reach the driver."""
    hist = (scored.select(F.explode("_runs").alias("r")).where("NOT r.word")
            .groupBy("r.band", "r.level").agg(F.count("*").alias("n")))
    count = {(r["band"], r["level"]): r["n"] for r in hist.collect()}
    out = {}
    for band in range(len(BANDS)):
        total = sum(count.get((band, k), 0) for k in range(LEVELS))
        out[band], tail = LEVELS, 0
        for k in range(LEVELS - 1, -1, -1):
            tail += count.get((band, k), 0)
            if tail and 2 ** (-k / 8) <= q * tail / total:
                out[band] = k
    return out


def scan(docs: DataFrame, q: float = 0.05, keep: str = "doc_id") -> DataFrame:
    """(``keep``, base, spans): one row per row of ``docs``; spans are ARRAY<STRUCT<start, kind, stop>> by start, then kind;
    ``kind`` indexes KINDS.  A random run that overlaps a base span is not added."""
    scored = write_once(candidates(docs, keep), "secretruns")
    least = thresholds(scored, q)
    limit = lambda band: F.element_at(F.array(*[F.lit(least[i]) for i in range(len(BANDS))]), band + 1)
    base = F.concat("_assign", "_access", "_hex")
    extra = F.transform(F.filter("_runs", lambda r: ~r["word"] & (r["level"] < limit(r["band"]))),
                        lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"),
                                           r["stop"].alias("stop")))
    return scored.select(keep, F.sort_array(base).alias("base"),
                         _apart(F.sort_array(F.concat(base, extra))).alias("spans"))


def _apart(spans: Column) -> Column:
    """Sorted ``spans`` without the random ones that overlap a base span: one
    that starts no later must have ended, the next must not have begun."""
    def kept(all_):
        stops = F.transform(all_, lambda s: F.when(s["kind"] < 3, s["stop"]).otherwise(0))
        starts = F.transform(F.reverse(all_), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(END))
        return F.filter(
            F.arrays_zip(all_.alias("span"), _running(stops, F.greatest).alias("early"),
                         F.reverse(_running(starts, F.least)).alias("late")),
            lambda x: (x["span"]["kind"] < 3)
            | (x["early"] <= x["span"]["start"]) & (x["late"] >= x["span"]["stop"]))
    return F.transform(_let(spans, kept), lambda x: x["span"])


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, mark: str = "[SECRET]", q: float = 0.05) -> DataFrame:
    """``docs`` with every secret's characters replaced by ``mark`` (for
    ``assign`` the whole assignment); other columns and clean texts untouched.
    The rows are written with their spans, so each is cut by its own, whatever
    its id."""
    found = scan(docs.select("text", F.struct(*docs.columns).alias("_row")), q, "_row")
    text = F.col("_row.text")
    ends = _running(F.transform("spans", lambda s: s["stop"]), F.greatest)
    # a span that starts inside earlier ones only lengthens them
    cuts = F.filter(F.transform(
        F.arrays_zip(F.col("spans").alias("span"), F.concat(F.array(F.lit(0)), ends).alias("at")),
        lambda x: F.struct(x["at"].alias("at"), x["span"]["start"].alias("start"))),
        lambda x: x["start"].isNull() | (x["start"] >= x["at"]))
    cut = _let(F.encode(text, "UTF-32"), lambda code: F.array_join(
        F.transform(cuts, lambda x: _piece(code, x["at"], x["start"])), mark))
    masked = F.when(F.size("spans") > 0, cut).otherwise(text).alias("text")
    return found.select(*[masked if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def _piece(code: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` (null: the end) of a text in UTF-32,
    four bytes each, so that a piece is reached without walking the text.  The
    order mark in front keeps one that belongs to the text."""
    stop = F.coalesce(stop, F.floor(F.octet_length(code) / 4).cast("int"))
    piece = F.substring(code, start * 4 + 1, (stop - start) * 4)
    return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), piece), "UTF-32")
