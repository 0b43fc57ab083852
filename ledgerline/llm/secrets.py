"""Secret scan with DataFrame functions only.

Base kinds are patterns: ``assign`` (a value assigned to a password-like
name), ``access`` (access key ids) and ``hex`` (long hexadecimal runs).

The kind ``random`` is found by a battery of randomness tests on every run of
20 or more token characters.  The run's encoding (decimal, hex, base32, letters
of one case, lower-case or upper-case base36, base62 or base64) is inferred from
its characters, and its characters become numbers 1 to K in that alphabet.

* chi-squared uniformity: how often two characters are equal;
* runs test: how often neighbours change between groups of characters, which
  are lower case, upper case, digits and signs, or in an encoding of one of
  them the frequent and the rare half of its alphabet;
* serial correlation of neighbouring symbols.

Each test is read twice.  Against "uniformly random" (exact mean and variance
for the length), a run that any of them rejects is out.  Against "written by
people" (the figures of ``NATURAL``), each gives evidence in standard
deviations; the three are added as if each two were correlated by one half, and
the upper tail of the sum is the p-value of the discovery.  Benjamini-Hochberg
control of these p-values at ``FDR`` runs over all candidates of the corpus in
each length class, because short runs are both more frequent and weaker
evidence.  P-values are rounded up to a grid, so the counts that the control
needs are one small bounded table at any corpus size.

Figures of natural text differ little from chance where the alphabet is small:
most runs of random letters of one case are found from about 40 characters on.
Digits alone are hardly ever told from ordinary numbers; from 24 characters on
they are the base kind ``hex`` in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Failing runs cannot hold a longer one, so the length can stand in the pattern.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: Parameters of the battery.
REJECT = 0.001  # a test against uniformity below this says "not random"
#: What people write: chance that two characters are equal, that three are, that
#: neighbours change group, and the correlation of neighbours (none: no evidence).
NATURAL = {
    "digits": (0.13, 0.02, 0.46, None),
    "hex": (0.09, 0.011, 0.1, 0.3),
    "letters": (0.0655, 0.0055, 0.3, None),
    "letters and digits": (0.0655, 0.0055, 0.1, 0.3),
    "mixed": (0.05, 0.0035, 0.1, 0.3),
}
FDR = 0.01
GRID = 20  # steps of the p-value grid for each power of ten
GRID_MAX = 300  # powers of ten
LENGTHS = (24, 32, 48, 64, 96, 128)  # upper ends of the length classes


#: Matches whose places are summed in one go; a text of many matches copies no growing list.
_RUN = 256


def matches(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Array of structs (s, e): leftmost non-overlapping matches, in code points.

    ``keep``: an array of booleans, one for each match, for those that count.
    The text between matches gives their places, as split() cuts at the same ones.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<s:int,e:int>>")
    last = F.greatest(F.size(found) - 1, F.lit(0))

    def step(acc: Column, i: Column) -> Column:
        begin = acc["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(F.get(found, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("s"), end.alias("e")))).alias("out"))

    def run(acc: Column, i: Column) -> Column:
        some = F.aggregate(F.sequence(i, F.least(i + _RUN - 1, last)), F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return _let(some, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int>>>").alias("out"))
    spans = F.flatten(F.aggregate(F.sequence(F.lit(0), last, F.lit(_RUN)), start, run, lambda acc: acc["out"]))
    if keep is not None:
        spans = F.filter(spans, lambda x, i: F.get(keep, i))
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def _tail(z: Column) -> Column:
    """Upper tail of the normal law for z >= 0 (Abramowitz and Stegun 26.2.17, error below 1e-7; beyond z = 5 the bound by density / z)."""
    t = 1 / (1 + 0.2316419 * z)
    density = F.exp(-z * z / 2) * 0.3989422804014327
    near = density * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z > 5, density / z).otherwise(near)


# Letters and digits in the order in which natural text uses them.
_LOWER, _DIGITS = "etaoinshrdlucmfwypvbgkjqxz", "1023456789"
_UPPER = _LOWER.upper()
_CODE = (  # a whole token's pattern, alphabet, kind of natural text
    ("^[0-9]+$", _DIGITS, "digits"),
    ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", "hex"),
    ("^([a-z]+)$", _LOWER, "letters"),
    ("^([A-Z]+)$", _UPPER, "letters"),
    ("^[A-Z2-7]+$", _UPPER + "234567", "letters and digits"),
    ("^[0-9a-z]+$", _LOWER + _DIGITS, "letters and digits"),
    ("^[0-9A-Z]+$", _UPPER + _DIGITS, "letters and digits"),
    ("^[0-9A-Za-z]+$", _LOWER + _UPPER + _DIGITS, "mixed"),
    ("^.*$", _LOWER + _UPPER + _DIGITS + "+/", "mixed"),
)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _encoding(token: Column) -> Column:
    """Alphabet and natural figures of the first encoding that holds the whole token."""
    out = F
    for pattern, alphabet, kind in _CODE:
        pair, triple, change, serial = NATURAL[kind]
        given = {"alphabet": alphabet, "pair": pair, "triple": triple, "change": change, "serial": serial or 0.0, "grouped": serial is not None}
        out = out.when(token.rlike(pattern), F.struct(*(F.lit(v).alias(k) for k, v in given.items())))
    return out


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))


def _capped(z: Column) -> Column:
    """Upper tail for z, which may be negative (then 1, which no test turns on)."""
    return _let(F.greatest(z, F.lit(0.0)), lambda v: F.when(v > 0, _tail(v)).otherwise(1.0))


def battery(token: Column) -> Column:
    """Struct (stratum, uniform, score) of a run of at least 20 token characters.

    ``uniform``: no test rejects uniformity.  ``score``: grid step of the
    discovery p-value, rounded towards 1.  ``stratum``: length class.
    """
    plain = F.translate(token, "-_", "+/")
    plain = F.when(token.rlike("^[0-9A-F]+$"), F.lower(plain)).otherwise(plain)
    n = F.length(token).cast("double")
    steps = F.sequence(F.lit(0), F.length(token) - 2)
    kinds = F.transform(F.split(token, ""), lambda c: F.when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).when(c.between("0", "9"), 3).otherwise(4))
    changes = lambda a: _sum(steps, lambda i: (F.get(a, i) != F.get(a, i + 1)).cast("double"))

    def figures(k: Column, x: Column) -> Column:
        """x: the symbols as numbers 1 to k."""
        squares = _sum(F.array_distinct(x), lambda s: F.pow(F.size(F.filter(x, lambda y: y == s)).cast("double"), 2.0))
        halves = F.transform(x, lambda v: v > k / 2)
        mean = _sum(x, lambda v: v) / n

        def serial(m: Column) -> Column:
            spread = _sum(x, lambda v: (v - m) * (v - m))
            return _let(spread, lambda v: F.when(v > 0, _sum(steps, lambda i: (F.get(x, i) - m) * (F.get(x, i + 1) - m)) / v).otherwise(1.0))

        high = _sum(halves, lambda v: v.cast("double"))
        return F.struct(squares.alias("squares"), _let(halves, changes).alias("flips"), high.alias("high"), _let(mean, serial).alias("serial"))

    def judged(e: Column, k: Column, f: Column) -> Column:
        chi = (k / n * f["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        both = 2 * f["high"] * (n - f["high"])
        spread = F.sqrt(F.greatest(both * (both - n), F.lit(0.0)) / (n * n * (n - 1)))
        runs = F.when(spread > 0, F.abs(f["flips"] - both / n) / spread).otherwise(99.0)
        serial = F.abs(f["serial"] + 1 / n) * F.sqrt(n)
        uniform = (_capped(chi) >= REJECT) & (2 * _capped(runs) >= REJECT) & (2 * _capped(serial) >= REJECT)

        pairs = n * (n - 1) / 2
        square = e["pair"] * e["pair"]
        equal = (pairs * e["pair"] - (f["squares"] - n) / 2) / F.sqrt(pairs * (e["pair"] - square) + n * (n - 1) * (n - 2) * (e["triple"] - square))
        moves = F.when(e["grouped"], _let(kinds, changes)).otherwise(f["flips"])
        moved = (moves - (n - 1) * e["change"]) / F.sqrt((n - 1) * e["change"] * (1 - e["change"]))
        loose = (e["serial"] - f["serial"]) * F.sqrt(n)
        evidence = F.when(e["grouped"], (equal + moved + loose) / 6**0.5).otherwise((equal + moved) / 3**0.5)
        power = -F.log10(F.greatest(_capped(evidence), F.lit(10.0**-GRID_MAX)))
        return F.struct(uniform.alias("uniform"), F.floor(power * GRID).cast("int").alias("score"))

    def verdict(e: Column) -> Column:
        k = F.length(e["alphabet"]).cast("double")
        symbols = F.transform(F.split(plain, ""), lambda c: F.call_function("instr", e["alphabet"], c).cast("double"))
        return _let(_let(symbols, lambda x: figures(k, x)), lambda f: judged(e, k, f))

    stratum = F.lit(len(LENGTHS))
    for i, top in reversed(list(enumerate(LENGTHS))):
        stratum = F.when(n <= top, i).otherwise(stratum)
    return _let(_let(_encoding(token), verdict), lambda v: F.struct(stratum.alias("stratum"), v["uniform"].alias("uniform"), v["score"].alias("score")))


def thresholds(tested: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Benjamini-Hochberg in each length class: the least score that is a discovery.

    The table it reads has at most a row for each length class and grid step,
    whatever the corpus; classes without a discovery are left out.
    """
    rows = tested.groupBy("stratum", F.when(F.col("uniform"), F.col("score")).otherwise(0).alias("score")).count().collect()
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in rows}:
        own = sorted(((r["score"], r["count"]) for r in rows if r["stratum"] == stratum), reverse=True)
        m, above = sum(c for _, c in own), 0
        for score, count in own:
            above += count
            if score and 10 ** (-score / GRID) <= fdr * above / m:
                out[stratum] = score
    return out


def _candidates(df: DataFrame, text: Column) -> DataFrame:
    """The battery's verdict on every token run of every row."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return df.select(F.explode(F.transform(found, battery)).alias("b")).select("b.*")


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with ``out``: array of structs (s, k, e), k the index in KINDS, ordered by s, then k.

    Offsets are code points, ends exclusive.  ``random`` spans that overlap a
    base span are left out.  A null text counts as empty and has no spans; an
    empty table gives an empty table; repeated rows get equal spans, and each
    counts for the thresholds; of spans that begin together the kind listed
    first comes first.  Texts of any length are read whole.  An input column
    called ``out`` is replaced; columns called ``__base``, ``__free`` or
    ``__found`` are refused.  Two passes: one over the candidates for the corpus-wide
    thresholds, one that marks the spans.
    """
    if clash := {"__base", "__free", "__found"} & {*df.columns}:
        raise ValueError(f"columns {sorted(clash)} are reserved")
    body = F.coalesce(F.col(text), F.lit(""))
    cut = thresholds(_candidates(df, body))

    values = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    assign = matches(body, ASSIGN, F.transform(values, lambda v: F.length(v) >= 6))
    base = [assign, matches(body, ACCESS_LONG), matches(body, HEX_LONG)]
    tag = lambda spans, k: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    df = df.withColumn("__base", F.concat(*(tag(x, k) for k, x in enumerate(base))))
    if not cut:
        return df.withColumn(out, F.array_sort("__base")).drop("__base")
    # Runs that might be discoveries are tested again, each where it stands.
    found = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))
    runs = F.zip_with(matches(body, TOKEN), found, lambda r, t: F.struct(r["s"].alias("s"), r["e"].alias("e"), t.alias("t")))
    free = F.filter(runs, lambda r: ~F.exists("__base", lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))
    df = df.withColumn("__free", free)
    least = F.create_map(*(F.lit(x) for pair in cut.items() for x in pair))
    passes = lambda b: b["uniform"] & (b["score"] >= F.coalesce(F.try_element_at(least, b["stratum"]), F.lit(GRID * GRID_MAX + 1)))
    df = df.withColumn("__found", F.filter("__free", lambda r: passes(battery(r["t"]))))
    return df.withColumn(out, F.array_sort(F.concat("__base", tag(F.col("__found"), 3)))).drop("__base", "__free", "__found")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["s"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _is(k: int):
    return lambda x: x["k"] == k


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["k"] < 3)
    counts = [F.size(F.filter("secrets", _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
