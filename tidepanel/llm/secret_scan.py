"""Secret scan with a battery of randomness tests, in built-in functions only.

Base kinds are found by pattern and always stay. Beyond them, every long token is a candidate: its
encoding is inferred from its characters, and over that alphabet it takes three tests of randomness:
chi-squared uniformity of its symbols, runs above and below the middle of the alphabet, and lag-1
serial correlation. Fisher's method combines their p-values; a token that the battery tells from
random ones is dropped.

For the others the chi-squared statistic is held against word-like text, which strays from
uniformity by a fixed amount per character (``STRAY``). The p-value of that comparison shrinks with the
length of a random token, so short tokens must be clearer than long ones can be. Within each encoding and
length band, Benjamini-Hochberg over all candidates of the corpus keeps the rate of false finds at
``FDR``; p-values are counted in bins of a tenth of a power of ten, so only a few hundred counts per
stratum, at most ``len(ENCODINGS) * len(BANDS)`` strata, are gathered, and one cut-off per stratum reaches
the driver.

Spans are (kind, start, end) in code points, end exclusive, of whole matches. A found token that
overlaps a base span is left out. Null and empty texts have no spans; a text is read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.llm.common import materialize, running_total

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
# Encoding, its pattern, its alphabet and the squared stray of word-like text from uniformity.
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS, 0.5),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef", 1.0),
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF", 1.0),
    ("base32", "^[A-Z2-7]+$", _LOWER.upper() + "234567", 1.1),
    ("base36", "^[a-z0-9]+$", _LOWER + _DIGITS, 1.4),
    ("base64", "^[A-Za-z0-9+/]+$", _LOWER.upper() + _LOWER + _DIGITS + "+/", 3.2),
    ("base64url", "", _LOWER.upper() + _LOWER + _DIGITS + "-_", 3.2),
)
STRAY = {name: stray for name, _, _, stray in ENCODINGS}
BANDS = (20, 28, 40, 64, 128)
FDR = 0.01
BATTERY = 0.001
BINS = 400


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, end, kind, body) of all matches whose ``group`` has ``least`` or more characters.

    Matches and the gaps between them alternate, so running lengths give the places.
    """
    def found() -> Column:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
        gaps = running_total(F.transform(F.split(text, F.lit(pattern), -1), lambda g: F.char_length(g).cast("bigint")))
        lengths = F.transform(matches, lambda m: F.char_length(m).cast("bigint"))
        ends = F.zip_with(gaps, running_total(lengths), lambda g, m: g + m)
        full = F.transform(
            F.arrays_zip(ends.alias("end"), lengths.alias("size"), bodies.alias("body")),
            lambda x: F.struct(
                (x["end"] - x["size"]).alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["body"].alias("body")
            ),
        )
        return F.filter(full, lambda x: F.char_length(x["body"]) >= least)

    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,body:string>>")
    return F.when(text.rlike(pattern), found()).otherwise(empty)


def _tail(z: Column) -> Column:
    """Upper tail of the normal law, to a quarter of a percent, in the far tail as well."""
    x = F.abs(z)
    q = F.exp(-x * x / 2) / (math.sqrt(2 * math.pi) * (0.656 * x + 0.344 * F.sqrt(x * x + 5.334)))
    return F.when(z >= 0, q).otherwise(1 - q)


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-300)))


def battery(candidates: DataFrame) -> DataFrame:
    """Add encoding, band, p_random and p_text to rows with a ``body``."""
    encoding = F.lit(ENCODINGS[-1][0])
    for name, pattern, _, _ in reversed(ENCODINGS[:-1]):
        encoding = F.when(F.col("body").rlike(pattern), name).otherwise(encoding)
    band = F.lit(0)
    for i, low in enumerate(BANDS):
        band = F.when(F.char_length("body") >= low, i).otherwise(band)

    def by_encoding(values: dict[str, object]) -> Column:
        out = F.lit(None)
        for name, value in values.items():
            out = F.when(F.col("encoding") == name, F.lit(value)).otherwise(out)
        return out

    df = candidates.withColumns({"encoding": encoding, "band": band})
    df = df.withColumns({
        "alphabet": by_encoding({n: a for n, _, a, _ in ENCODINGS}), "stray": by_encoding(STRAY),
        "chars": F.filter(F.split("body", ""), lambda c: c != ""), "n": F.char_length("body").cast("double"),
    })
    df = df.withColumns({
        "v": F.transform("chars", lambda c: F.position(c, F.col("alphabet")).cast("double")),
        "a": F.char_length("alphabet").cast("double"),
        "squares": F.aggregate(
            F.array_distinct("chars"), F.lit(0.0),
            lambda s, c: s + F.pow(F.col("n") - F.char_length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2)),
        ),
    })
    n, a = F.col("n"), F.col("a")
    df = df.withColumns({
        "chi": a / n * F.col("squares") - n, "mean": F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / n,
        "high": F.transform("v", lambda x: x > F.col("a") / 2),
    })
    later, before = F.slice("v", 2, F.size("v")), F.slice("v", 1, F.size("v") - 1)
    changes = F.zip_with(F.slice("high", 2, F.size("high")), F.slice("high", 1, F.size("high") - 1), lambda x, y: F.when(x != y, 1.0).otherwise(0.0))
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda s, x: s + x)
    df = df.withColumns({
        "runs": total(changes) + 1, "up": total(F.transform("high", lambda x: F.when(x, 1.0).otherwise(0.0))),
        "spread": total(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean")))),
        "lagged": total(F.zip_with(later, before, lambda x, y: (x - F.col("mean")) * (y - F.col("mean")))),
    })
    up, down = F.col("up"), n - F.col("up")
    expected = 2 * up * down / n + 1
    z_chi = (F.col("chi") - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    z_runs = F.when((up < 1) | (down < 1) | (expected <= 2), 40.0).otherwise(
        (F.col("runs") - expected) / F.sqrt((expected - 1) * (expected - 2) / (n - 1))
    )
    z_serial = F.when(F.col("spread") <= 0, 40.0).otherwise((F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n))
    df = df.withColumn("half_x", -(_log(_tail(z_chi)) + _log(2 * _tail(F.abs(z_runs))) + _log(2 * _tail(F.abs(z_serial)))))
    x = F.greatest(F.col("half_x"), F.lit(0.0))
    far = (a - 1 + (n - 1) * F.col("stray") - F.col("chi")) / F.sqrt(2 * (a - 1) + 4 * n * F.col("stray"))
    return df.withColumns({"p_random": F.exp(-x) * (1 + x + x * x / 2), "p_text": _tail(far)}).drop(
        "alphabet", "stray", "chars", "n", "v", "a", "squares", "chi", "mean", "high", "runs", "up", "spread", "lagged", "half_x"
    )


def _bin(p_random: Column, p_text: Column) -> Column:
    """Tenths of a power of ten of the p-value; tokens told from random ones count with p = 1."""
    return F.when(p_random < BATTERY, 0).otherwise(F.least(F.floor(-10 * F.log10(F.greatest(p_text, F.lit(1e-300)))), F.lit(BINS)).cast("int"))


def cut_offs(tested: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], int]:
    """Least accepted bin of each (encoding, band) by Benjamini-Hochberg over all candidates."""
    counts = tested.groupBy("encoding", "band", "bin").agg(F.count(F.lit(1)).alias("k"))
    stratum = Window.partitionBy("encoding", "band")
    steps = counts.withColumn("m", F.sum("k").over(stratum)).withColumn("at_least", F.sum("k").over(stratum.orderBy(F.desc("bin"))))
    passed = steps.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= fdr * F.col("at_least") / F.col("m"))
    least = passed.groupBy("encoding", "band").agg(F.min("bin").alias("bin")).collect()  # at most one row a stratum
    return {(r["encoding"], r["band"]): r["bin"] for r in least}


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """All rows and columns of ``docs`` but the text, plus base and found: arrays of (start, end, kind).

    One scan of the texts: what it finds is stored without them, and the cut-offs read that.
    """
    kept = [c for c in docs.columns if c not in (text, "base", "found")]
    column = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(spans(column, ASSIGN, "assign", 2, 8), spans(column, ACCESS, "access"), spans(column, HEX, "hex"))
    rows = docs.select(*kept, base.alias("base"), spans(column, TOKEN, "random").alias("tokens"))
    rows = rows.select(
        *kept, F.transform("base", lambda b: F.struct(b["start"], b["end"], b["kind"])).alias("base"),
        F.filter(
            "tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        ).alias("tokens"),
    )
    # The number of a row is stored with it, so both reads below see the same one.
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    bodies = rows.select(F.explode("tokens.body").alias("body")).distinct()
    tested = materialize(
        battery(bodies).select("body", "encoding", "band", _bin(F.col("p_random"), F.col("p_text")).alias("bin")), "tested"
    )
    cuts = cut_offs(tested, fdr)
    least = F.lit(None).cast("int")
    for (encoding, band), cut in sorted(cuts.items()):
        least = F.when((F.col("encoding") == encoding) & (F.col("band") == band), cut).otherwise(least)
    random = tested.where(F.col("bin") >= least).select("body")
    spots = (
        rows.select("_row", F.explode("tokens").alias("t")).join(random, F.col("t.body") == F.col("body"), "left_semi")
        .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("t.start", "t.end", "t.kind"))).alias("found"))
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    return rows.join(spots, "_row", "left").select(*kept, "base", F.coalesce("found", empty).alias("found"))


def as_text(spans_: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    ordered = F.array_sort(spans_, lambda x, y: F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(x["kind"] - y["kind"]))
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
