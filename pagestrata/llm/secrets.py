"""Secret scans: base patterns, and character Markov models that find further random strings.

Base spans come from three patterns (assignments, access keys, hexadecimal runs). Two first-order
Markov models over ``ALPHABET`` add spans: one of random strings, trained on the values that the base
patterns find in the corpus, one of ordinary identifiers, trained on the other words of a sample of
``SAMPLE`` documents. A run of ``RUN`` and more characters of the alphabet with a letter and a digit
is a secret if the mean log-likelihood ratio of its transitions is ``MIN_RATIO`` or more and it
touches no base span. Ratios are whole thousandths, so sums do not depend on their order.

Everything is DataFrame functions. A pattern's places come from the lengths of what it leaves
between its matches. The ratio table is a literal of ``len(ALPHABET) ** 2`` numbers.

Defined cases: a null or empty text has no spans; without labelled values the models are flat and add
nothing; repeated rows are scanned alike; an empty table gives no rows. Other columns may have any
name that does not begin with ``_s``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.common import WORD, pin

ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = 20
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
SAMPLE = 2000
# Words without digits but a few at their end: what the model of ordinary identifiers learns from.
ORDINARY = r"""[^0-9]*[0-9]{0,4}[.,;:!?)"]*"""
MIN_RATIO = 1.0
LEAN = 16


def spans_of(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Array of (start, kind, end, value) of a pattern's leftmost matches whose ``group`` has ``least`` characters."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    matches = F.arrays_zip(between.alias("gap"), whole.alias("whole"), value.alias("value"))
    matches = F.slice(F.transform(matches, lambda m: F.struct(m["gap"].alias("gap"), m["whole"].alias("whole"), m["value"].alias("value"))), 1, F.size(whole))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(a, m):
        start = a["at"] + m["gap"]
        end = start + F.length(m["whole"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(matches, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda a: a["spans"])


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_s_text`` and the base spans ``_s_assign``, ``_s_access``, ``_s_hex``."""
    df = pin(docs, _s_text=F.coalesce(F.col("text"), F.lit("")))
    text = F.col("_s_text")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return pin(
        df, _s_assign=spans_of(text, ASSIGN, 0, 6, 2), _s_hex=spans_of(text, HEX, 2),
        _s_access=F.when(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS, 1, 20)).otherwise(empty),
    )


def _transitions(strings: DataFrame, name: str) -> DataFrame:
    """Counts of neighbouring characters of the alphabet in the strings of column ``_s_value``."""
    at = F.explode(F.sequence(F.lit(1), F.length("_s_value") - 1)).alias("_s_at")
    pairs = strings.where(F.length("_s_value") >= 2).select("_s_value", at)
    pairs = pairs.select(F.substring(F.col("_s_value"), F.col("_s_at"), F.lit(2)).alias("_s_pair"))
    return pairs.where(F.col("_s_pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("_s_pair").agg(F.count(F.lit(1)).alias(name))


def fit(docs: DataFrame, sample: int = SAMPLE) -> list[int]:
    """Log-likelihood ratios (thousandths) of all transitions, by first and second character."""
    based = with_base(docs.select("doc_id", "text"))
    values = based.select(F.explode(F.concat("_s_assign", "_s_access", "_s_hex")).alias("_s")).select(F.col("_s.value").alias("_s_value"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    some = docs.select("doc_id", "text").withColumn("_s_order", order).orderBy("_s_order", F.col("text").asc_nulls_first()).limit(sample)
    rest = with_base(some)
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = rest.withColumn("_s_text", F.regexp_replace("_s_text", pattern, " "))
    ordinary = rest.select(F.explode(F.regexp_extract_all("_s_text", F.lit(WORD), F.lit(0))).alias("_s_value"))
    ordinary = ordinary.where(F.col("_s_value").rlike(rf"^{ORDINARY}\z"))
    counts = _transitions(values, "n_random").join(_transitions(ordinary, "n_plain"), "_s_pair", "full").collect()  # at most one row per transition
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}

    def model(name: str) -> list[float]:
        """Log-probabilities of all transitions; rare ones lean on how common their second character is."""
        seen = [[0] * size for _ in range(size)]
        for row in counts:
            seen[place[row["_s_pair"][0]]][place[row["_s_pair"][1]]] += row[name] or 0
        single = [sum(column) + 1 for column in zip(*seen)]
        every = sum(single)
        return [math.log((n + LEAN * single[b] / every) / (sum(line) + LEAN)) for line in seen for b, n in enumerate(line)]

    ratios = [math.floor(1000 * (r - p) + 0.5) for r, p in zip(model("n_random"), model("n_plain"))]
    return ratios


def scan(docs: DataFrame, ratios: list[int] | None = None, run: int = RUN, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with ``_s_base`` and ``_s_spans``: arrays of (start, kind, end, value) in order of start and kind."""
    ratios = fit(docs) if ratios is None else ratios
    table = F.from_json(F.lit(json.dumps(ratios)), "array<int>")
    df = with_base(docs)
    df = pin(df, _s_base=F.array_sort(F.concat("_s_assign", "_s_access", "_s_hex")), _s_runs=spans_of(F.col("_s_text"), TOKEN, 3, run))

    alphabet = F.lit(ALPHABET)

    def ratio(value):
        def one(total, i):
            first, second = F.instr(alphabet, F.substring(value, i, F.lit(1))), F.instr(alphabet, F.substring(value, i + 1, F.lit(1)))
            return total + F.element_at(table, (first - 1) * len(ALPHABET) + second)
        return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0), one)

    def random_looking(s):
        free = ~F.exists("_s_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        mixed = s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        return F.when(mixed & free, ratio(s["value"]) >= F.lit(int(1000 * min_ratio)) * (F.length(s["value"]) - 1)).otherwise(F.lit(False))

    df = df.withColumn("_s_spans", F.array_sort(F.concat("_s_base", F.filter("_s_runs", random_looking))))
    return df.select(*docs.columns, "_s_base", "_s_spans")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every stretch covered by spans replaced by ``mark``; other texts are untouched."""
    found = scan(docs, **options)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        seen = F.greatest(a["at"], s["end"])
        gap = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        return F.struct(seen.alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], gap, F.lit(mark))).alias("out"))

    def close(a):
        return F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))

    hit = F.size("_s_spans") > 0
    df = found.withColumn("_s_new", F.when(hit, F.aggregate("_s_spans", start, step, close)).otherwise(F.col("text")))
    df = df.withColumn("text", F.col("_s_new"))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)
