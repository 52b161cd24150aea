"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Fixed kinds are found leftmost and non-overlapping; matches that fail their rule are dropped. The method adds
spans of kind ``random``: every run of 16 or more key characters that no fixed span touches gets an encoding
(digits, hex, letters of one case, base32, base62, base64), and three tests against uniform random characters of that alphabet:
chi-squared of the character counts, Wald-Wolfowitz runs of the lower and upper half, lag-1 serial correlation.
Their p-values are combined by Fisher's sum: small for random text, large for ordinary text.

What is ordinary is learnt for each encoding and length class from the corpus itself: every document gives one window, a
piece of its text with all characters outside the encoding's alphabet left out, of a length and encoding picked
by hash (no such window where the text has too few). The windows' median and spread of the sum's logarithm are the null
distribution. Each cell starts from a fixed null (``NULLS``) that counts as much as LEAST_WINDOWS windows, so every
cell has one at every size. A run's p-value is its lower tail there, so what counts as small depends on length and
encoding, and Benjamini-Hochberg within each length class, over all runs of the corpus, keeps the share of false
finds at ``rate``. p-values are counted in bins of a tenth of a decade, so only a small table leaves the executors.

Positions come from split pieces and matches side by side; all counts are in code points.

Defined results: null text is empty; texts without a find give zero counts, the digest of an empty string and
empty spans; repeated rows give equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
#: kind, pattern, group whose length counts, least length
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
RATE, LEAST_WINDOWS = 0.01, 30
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, pattern, alphabet in its order; text is brought to the case that an alphabet has
ENCODINGS = (
    ("digits", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", r"^[A-Z]?[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base62", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"", UPPER + LOWER + DIGITS + "+/"),
)
#: Length classes: half octaves from 16 characters to 256 and more. A window has the least length of its class.
SHORTEST, CLASSES = 8, 9
LENGTHS = [int(-(-(2 ** (k / 2)) // 1)) for k in range(SHORTEST, SHORTEST + CLASSES)]
#: Least width of a null: identifiers are less regular than prose without being random.
LEAST_WIDTH = 0.35
#: Middle and width of log_sum over ordinary windows by encoding, from the shortest length class to the longest: about 1,600 windows
#: of the documents at sf0.1 for each cell. Middle is the median, width the larger of its distance to the 16th percentile and half of that
#: to the 2.5th. Digits of ordinary numbers look random at any length, so none are found by their digits alone.
NULLS = {
    "digits": ((1.6, 0.9),) * 9,
    "hex": ((4.71, 0.35), (4.72, 0.35), (4.72, 0.35), (4.72, 0.35), (4.72, 0.35), (4.72, 0.35), (4.73, 0.35), (4.73, 0.35), (4.73, 0.35)),
    "HEX": ((4.71, 0.35), (4.72, 0.35), (4.72, 0.35), (4.72, 0.35), (4.72, 0.35), (4.72, 0.35), (4.73, 0.35), (4.73, 0.35), (4.73, 0.35)),
    "lower": ((2.61, 0.60), (2.98, 0.56), (3.37, 0.48), (3.89, 0.42), (4.08, 0.35), (4.11, 0.35), (4.12, 0.35), (4.15, 0.35), (4.19, 0.35)),
    "upper": ((2.56, 0.61), (2.96, 0.57), (3.39, 0.54), (3.90, 0.43), (4.08, 0.35), (4.11, 0.35), (4.13, 0.35), (4.15, 0.35), (4.19, 0.35)),
    "base32": ((2.78, 0.60), (3.24, 0.51), (3.67, 0.48), (4.06, 0.35), (4.10, 0.35), (4.10, 0.35), (4.12, 0.35), (4.14, 0.35), (4.17, 0.35)),
    "base62": ((3.43, 0.64), (4.03, 0.53), (4.08, 0.35), (4.09, 0.35), (4.10, 0.35), (4.12, 0.35), (4.12, 0.35), (4.15, 0.35), (4.17, 0.35)),
    "base64": ((3.46, 0.62), (4.03, 0.50), (4.08, 0.35), (4.09, 0.35), (4.10, 0.35), (4.11, 0.35), (4.13, 0.35), (4.14, 0.35), (4.18, 0.35)),
}
SPANS = "array<struct<s:int,e:int,v:string>>"


def located(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """array<struct<s, e, v>> of the matches of a pattern; v is the group, kept where it has at least that length.

    Lengths are summed in about sqrt(n) parts of sqrt(n) matches, so a text with very many matches stays cheap.
    """
    quoted = F.lit(pattern)
    text = F.coalesce(text, F.lit(""))
    whole = F.regexp_extract_all(text, quoted, F.lit(0))
    parts = let(whole, lambda m: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("p"), m.alias("m"), (F.regexp_extract_all(text, quoted, F.lit(group)) if group else m).alias("v")))
    found = let(parts, lambda z: let(F.greatest(F.lit(1), F.sqrt(F.size(z)).cast("int")), lambda k: _placed(F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / k).cast("int")), lambda i: F.slice(z, i * k + 1, k)))))
    return F.when(text.rlike(pattern), F.filter(found, lambda x: F.length(x["v"]) >= least)).otherwise(F.array().cast(SPANS))


def _placed(parts: Column) -> Column:
    """Parts of (piece before, match, value) -> one array of (start, end, value)."""
    size = lambda part: F.aggregate(part, F.lit(0), lambda b, x: b + F.length(x["p"]) + F.length(x["m"]))
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda a, part: F.concat(a, F.array(F.element_at(a, F.lit(-1)) + size(part))))
    inside = lambda part, at: F.aggregate(
        part,
        F.struct(at.alias("at"), F.array().cast(SPANS).alias("o")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.concat(a["o"], F.array(F.struct((a["at"] + F.length(x["p"])).alias("s"), (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("e"), x["v"].alias("v")))).alias("o"),
        ),
        lambda a: a["o"],
    )
    return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), inside))


def _tail(z: Column) -> Column:
    """The lower tail of the normal distribution at z, by a logistic curve within 0.0002."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def _log_tail(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-12)))


def encoding(run: Column) -> Column:
    """The place in ENCODINGS of the narrowest alphabet that a run fits."""
    out = F.lit(len(ENCODINGS) - 1)
    for k, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        out = F.when(run.rlike(pattern), k).otherwise(out)
    return out


def battery(run: Column, code: Column | None = None) -> Column:
    """struct<code, class, log_sum> of a run: its encoding (or the one given), class of length and the logarithm of Fisher's sum of the three tests."""
    alphabets, sizes = F.array(*[F.lit(e[2]) for e in ENCODINGS]), F.array(*[F.lit(len(e[2])) for e in ENCODINGS])

    def tests(x: Column, code: Column) -> Column:
        k, n = F.get(sizes, code), F.length(x)
        places = F.transform(F.split(x, ""), lambda c: F.instr(F.get(alphabets, code), c).cast("double"))
        return let(places, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, y: a + y) / n, lambda mean: combined(x, code, k, n, p, mean)))

    def combined(x, code, k, n, p, mean) -> Column:
        squares = F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(x, c, F.lit(""))), F.lit(2.0)))
        chi = F.greatest(k * squares / n - n, F.lit(0.0)) / (k - 1)
        z_chi = (F.cbrt(chi) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
        bits = F.array_join(F.transform(p, lambda y: F.when(y * 2 <= k, "0").otherwise("1")), "")
        ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
        twice = 2 * ones * (n - ones)
        variance = twice * (twice - n) / (n * n * (n - 1.0))
        seen = F.size(F.array_remove(F.split(bits, "1+"), "")) + F.size(F.array_remove(F.split(bits, "0+"), ""))
        z_runs = F.when(variance > 0, (seen - 1 - twice / n) / F.sqrt(variance)).otherwise(F.lit(8.0))
        spread = F.aggregate(p, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
        lagged = F.aggregate(F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, y: a + y)
        z_serial = F.when(spread > 0, lagged / spread * F.sqrt(n)).otherwise(F.lit(8.0))
        fisher = -2 * (_log_tail(_tail(-z_chi)) + _log_tail(F.least(F.lit(1.0), 2 * _tail(-F.abs(z_runs)))) + _log_tail(F.least(F.lit(1.0), 2 * _tail(-F.abs(z_serial)))))
        return F.struct(code.alias("code"), F.greatest(F.lit(SHORTEST), F.least(F.lit(SHORTEST + CLASSES - 1), F.floor(2 * F.log2(n) + 1e-9))).cast("int").alias("class"), F.log(F.greatest(fisher, F.lit(1e-3))).alias("log_sum"))

    def plain(code: Column) -> Column:
        name = F.get(F.array(*[F.lit(e[0]) for e in ENCODINGS]), code)
        return F.when(name == "lower", F.lower(run)).when(name == "base64", F.translate(run, "-_=", "+/")).otherwise(F.translate(run, "=", ""))

    return let(encoding(run) if code is None else code, lambda code: let(plain(code), lambda x: tests(x, code)))


def null_table(windows: DataFrame) -> list[tuple[float, float]]:
    """Middle and width for every encoding and length class, in order: the fixed null and that of the corpus's windows, weighted by LEAST_WINDOWS and their number."""
    q = windows.groupBy("code", "class").agg(F.percentile_approx("log_sum", [0.025, 0.16, 0.5], 10_000).alias("q"), F.count("log_sum").alias("n"))
    own = {(r["code"], r["class"]): (r.n, r.q[2], max(r.q[2] - r.q[1], (r.q[2] - r.q[0]) / 2, LEAST_WIDTH)) for r in q.collect()}
    out = []
    for code, (name, _, _) in enumerate(ENCODINGS):
        for k, fixed in enumerate(NULLS[name], SHORTEST):
            n, *seen = own.get((code, k), (0, *fixed)) if name != "digits" else (0, *fixed)
            out.append(tuple((LEAST_WINDOWS * f + n * o) / (LEAST_WINDOWS + n) for f, o in zip(fixed, seen)))
    return out


def of_cell(x: Column, nulls: list, place: int) -> Column:
    """What holds for the encoding and class of a tested run."""
    table = F.split(F.lit(",".join(f"{row[place]:.6f}" for row in nulls)), ",").cast("array<double>")
    return F.get(table, x["code"] * CLASSES + x["class"] - SHORTEST)


def p_bin(log_sum: Column, middle, width) -> Column:
    """The bin of a run's p-value under the null: ten times its decimal logarithm, rounded up."""
    return F.ceil(10 * F.log10(_tail((log_sum - middle) / width))).cast("int")


def thresholds(tested: DataFrame, windows: DataFrame, rate: float = RATE) -> tuple[list, dict[int, int]]:
    """The null table, and for each length class the largest bin that Benjamini-Hochberg accepts."""
    nulls = null_table(windows)
    x = F.struct("code", "class")
    counts = tested.groupBy("class", p_bin(F.col("log_sum"), of_cell(x, nulls, 0), of_cell(x, nulls, 1)).alias("bin")).agg(F.count("*").alias("runs"))
    by_class = counts.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("bin", "runs"))).alias("bins"), F.sum("runs").alias("total"))
    accepted = F.expr(f"""aggregate(bins, struct(0L as seen, -1000 as best),
        (a, x) -> struct(a.seen + x.runs as seen, if(total * pow(10, x.bin / 10D) <= {rate} * (a.seen + x.runs), x.bin, a.best) as best), a -> a.best)""")
    return nulls, {r["class"]: r.best for r in by_class.select("class", accepted.alias("best")).collect()}


def window(text: Column) -> Column:
    """struct<code, class, log_sum> of a document's piece of ordinary text; null where it is too short for one."""
    h = F.pmod(F.xxhash64(text, F.lit(9)), F.lit(len(ENCODINGS) * CLASSES))

    def taken(cell: Column) -> Column:
        code, size = (cell / CLASSES).cast("int"), F.get(F.array(*[F.lit(n) for n in LENGTHS]), (cell % CLASSES).cast("int"))
        stream = F.lit(None).cast("string")
        for k, (_, _, alphabet) in enumerate(ENCODINGS):
            cased = F.lower(text) if alphabet == alphabet.lower() else F.upper(text) if alphabet == alphabet.upper() else text
            stream = F.when(code == k, F.regexp_replace(cased, f"[^{alphabet}]+", "")).otherwise(stream)
        return let(stream, lambda s: F.when(F.length(s) >= size, battery(F.substr(s, F.pmod(F.xxhash64(s), F.length(s) - size + 1).cast("int") + 1, size), code)))

    return let(h, taken)


def _grouped(spans: Column) -> Column:
    """Sorted spans in groups of about the square root of their number, with where each group begins and ends."""
    size = F.greatest(F.lit(1), F.sqrt(F.size(spans)).cast("int"))
    group = lambda part: F.struct(part[0]["s"].alias("s"), F.array_max(F.transform(part, lambda x: x["e"])).alias("e"), part.alias("spans"))
    parts = let(size, lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / k).cast("int")), lambda i: F.slice(spans, i * k + 1, k)))
    return F.when(F.size(spans) > 0, F.transform(parts, group))


def _touched(x: Column, groups: Column) -> Column:
    """Whether a run overlaps one of the grouped spans."""
    over = lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"])
    return F.coalesce(F.exists(groups, lambda g: over(g) & F.exists(g["spans"], over)), F.lit(False))


def with_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, text, base (fixed spans, in order) and runs (array of struct<s, e, v>): those that no fixed span touches."""

    def spans(found: Column, o: int, kind: str) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    base = F.array_sort(F.concat(*[spans(located(F.col("text"), p, g, n), o, k) for o, (k, p, g, n) in enumerate(KINDS)]))
    d = docs.select("doc_id", "text").withColumn("base", base)
    free = let(_grouped(F.col("base")), lambda groups: F.filter(located(F.col("text"), RUN), lambda x: ~_touched(x, groups)))
    return d.withColumn("runs", F.when(F.coalesce("text", F.lit("")).rlike(RUN), free).otherwise(F.array().cast(SPANS)))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, text -> doc_id, base and random: arrays of struct<s, o, kind, e> (start, place of the kind, kind, end), in order."""
    text = F.coalesce("text", F.lit(""))
    # One pass writes each document's finds and its window; what follows reads this slim table. A run is judged at once, so its text isn't written.
    found = with_runs(docs).withColumns({"tested": F.transform("runs", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["v"]).alias("x"))), "window": window(text)})
    found = stored(found.select("doc_id", "base", "tested", "window"), "secret-finds")
    tested = found.select(F.explode("tested").alias("t")).select("t.x.*")
    nulls, best = thresholds(tested, found.filter("window is not null").select("window.*"), rate)
    accepted = F.create_map(*[F.lit(y) for pair in best.items() for y in pair]) if best else F.lit(None).cast("map<int,int>")

    def random(x: Column) -> Column:
        return F.coalesce(p_bin(x["log_sum"], of_cell(x, nulls, 0), of_cell(x, nulls, 1)) <= F.element_at(accepted, x["class"]), F.lit(False))

    kept = F.filter("tested", lambda t: random(t["x"]))
    span = lambda t: F.struct(t["s"].alias("s"), F.lit(len(KINDS)).alias("o"), F.lit("random").alias("kind"), t["e"].alias("e"))
    return found.select("doc_id", "base", F.transform(kept, span).alias("random"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op9_secret_scan(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k[0]) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "random"))).alias("spans"))
