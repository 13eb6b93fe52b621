"""Operator 1: benchmark decontamination by template windows.  DataFrame functions only.

Canonical form.  A text is cut into words and numbers.  Numbers become ``<num>``,
numbers with a unit ``<qty>``, names (capitalised words inside a sentence)
``<name>``; all other words are lower-cased.  What a placeholder stands for is its
slot value.

Join.  Windows of ``window`` tokens are hashed in three forms: the lower-cased
words, the canonical tokens, and the canonical tokens with capitalised words that begin a
sentence as names too.  The first form finds verbatim passages in any case and
however many numbers they hold; the second needs ``literals`` words that are no
placeholders, the third one less of its own.  An item of fewer than ``window`` tokens is one window,
found as a whole under the same rules.  The benchmark's windows are joined with those of
every text.  The benchmark side is broadcast only if it has at most
``BROADCAST_WINDOWS`` windows (counted first); else hashes and places alone are shuffled, and
the words of the texts that were hit are fetched after it.

Slots.  Windows of one text and item on one diagonal (equal distance of places)
must map slot values consistently: a value of the item always to the same value of
the text.  Copies do so trivially, re-parameterised questions by their new
numbers and names.  Where windows contradict each other the diagonal is cut and
its consistent parts count; a window that contradicts itself is dropped.

A text is contaminated by an item if consistent windows cover ``share`` of the
item's tokens or ``run`` tokens in a row.

Defined cases: null and empty texts and items match nothing; an item of one or two words
is found in every text that holds them in a row; rows with
equal ids and texts are one document; ids may be null; repeated items are
reported once each id; an empty table on either side gives no row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm._common import few_beside, spread, written

WINDOW, LITERALS, RUN, SHARE = 8, 5, 13, 0.5
#: The forms of a text whose windows are hashed.
FORMS = ("words", "tokens", "named")
#: Windows (about 100 bytes each) up to which the benchmark side is broadcast.
BROADCAST_WINDOWS = 300_000

# The units a number may carry.
UNITS = (
    "km cm mm nm m kg mg g lb lbs oz l ml cl km/h mph s ms h min hz khz mhz ghz kb mb gb tb w kw mw v kv a ma j kj n pa hpa bar mol k c f "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms "
    "pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months "
    "year years dollar dollars euro euros cent cents percent degree degrees"
).split()
_UNIT = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*(?:\s?(?:%|°|€|\$|£|(?i:" + _UNIT + r")(?![\p{L}\p{N}])))?"
_TOKEN = r"(?:[.!?\n][^\p{L}\p{N}]*)?(?:" + _NUMBER + r"|\p{L}+(?:['’]\p{L}+)*)"
_LEAD = r"^[^\p{L}\p{N}]+"


def _is_number(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def _bare(x: Column) -> Column:
    """A token without the sentence mark before it."""
    return F.when((x < "A") & ~_is_number(x), F.regexp_replace(x, _LEAD, "")).otherwise(x)


def _canonical(x: Column, i: Column) -> Column:
    number = lambda c: F.when(c.rlike("[0-9]$"), "<num>").otherwise("<qty>")
    starts = (x < "A") & ~_is_number(x)
    low, bare = F.lower(x), F.regexp_replace(x, _LEAD, "")
    name = (i > 0) & (x != low) & (F.length(x) > 1) & (F.substring(x, 2, 1 << 30) == F.lower(F.substring(x, 2, 1 << 30)))
    return F.when(_is_number(x), number(x)).when(starts, F.when(_is_number(bare), number(bare)).otherwise(F.lower(bare))).when(name, F.lit("<name>")).otherwise(low)


def template(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add ``raw`` (tokens), ``words`` (lower-cased), ``tokens`` (canonical) and ``named`` (canonical, sentence-initial capitals as names too)."""
    name = lambda x: (F.length(x) > 1) & (x != F.lower(x)) & (F.substring(x, 2, 1 << 30) == F.lower(F.substring(x, 2, 1 << 30)))
    rows = rows.withColumn("raw", F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0)))
    rows = rows.withColumns({"words": F.transform("raw", lambda x: F.lower(_bare(x))), "tokens": F.transform("raw", _canonical)})
    return rows.withColumn("named", F.zip_with("raw", "tokens", lambda x, t: F.when((x == t) | F.startswith(t, F.lit("<")), t).when(name(_bare(x)), "<name>").otherwise(t)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashes(form: str, size: int) -> Column:
    """Hashes of the windows of ``size`` tokens, one per token; those of the last ``size - 1`` places mean nothing.

    Two windows that cover a longer one make its hash, so a window costs some three hashes of two numbers, not a copy of its tokens.
    """
    value, reach = F.col(form), 1
    while reach < size:
        step = min(reach, size - reach)
        reach += step
        both = lambda a, b: F.xxhash64(a, b, F.lit(reach))  # noqa: B023, E731  (called at once)
        value = _bound(value, lambda p: F.zip_with(p, F.slice(p, F.lit(step + 1), F.size(p)), both))  # noqa: B023
    return value


def _token_hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"h_{f}": F.transform(f, lambda t: F.xxhash64(t)) for f in FORMS})


def _item_windows(benchmark: DataFrame, window: int, literals: int) -> DataFrame:
    """A row per item, place and form of window: ``(item_id, n, w, at, h, item_values)``; items shorter than a window are one window."""
    items = template(benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct())
    sized = _token_hashes(items).withColumn("n", F.size("tokens")).withColumn("w", F.least("n", F.lit(window)))
    whole = lambda f: F.coalesce(*(F.when(F.col("w") == size, _hashes(f"h_{f}", size)) for size in range(1, window + 1)))
    forms = F.arrays_zip(*(F.slice(whole(f), F.lit(1), F.col("n") - F.col("w") + 1).alias(f"h_{f}") for f in FORMS))
    placed = sized.withColumn("all", F.when(F.col("n") > 0, forms)).select("item_id", "n", "w", "words", "tokens", "named", F.posexplode_outer("all").alias("at", "x")).where("x is not null")
    cut = lambda form: F.slice(form, F.col("at") + 1, F.col("w"))
    count = lambda form: F.size(F.filter(cut(form), lambda t: ~F.startswith(t, F.lit("<"))))
    template_ok = count("tokens") >= literals
    chosen = F.array(F.col("x.h_words"), F.when(template_ok, F.col("x.h_tokens")), F.when(template_ok & (count("named") >= literals - 1), F.col("x.h_named")))
    values = F.zip_with(cut("words"), cut("tokens"), lambda a, t: F.struct(a.alias("a"), F.startswith(t, F.lit("<")).alias("slot")))
    return placed.select("item_id", "n", "w", "at", F.explode(F.array_distinct(F.array_compact(chosen))).alias("h"), values.alias("item_values"))


def _parts(windows: Column, w: Column) -> Column:
    """Follow the windows of a diagonal; ``longest`` is the longest run of tokens in which slot values are consistent.

    ``live`` are the windows of the run so far.  A window that contradicts some of them starts the run anew after the last of those.
    """
    zero = F.struct(F.filter(windows, lambda _: F.lit(False)).alias("live"), F.lit(0).alias("longest"))
    clash = lambda x, y: F.exists(x["pairs"], lambda p: F.exists(y["pairs"], lambda q: (p["a"] == q["a"]) & (p["b"] != q["b"])))

    def step(s: Column, x: Column) -> Column:
        far = x["at"] - w
        bad = F.aggregate(s["live"], F.lit(-1), lambda last, y: F.when((y["at"] < far) & (F.element_at(s["live"], -1)["at"] < far) | clash(x, y), y["at"]).otherwise(last))
        live = _bound(bad, lambda last: F.concat(F.filter(s["live"], lambda y: y["at"] > last), F.array(x)))
        return _bound(live, lambda now: F.struct(now.alias("live"), F.greatest(s["longest"], x["at"] + w - F.element_at(now, 1)["at"]).alias("longest")))

    return F.aggregate(windows, zero, step)["longest"]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, run: int = RUN, share: float = SHARE) -> DataFrame:
    """Pairs ``(doc_id, text_hash, item_id, n_item_tokens, n_covered, longest_run, n_slots, n_changed)``."""
    side = _item_windows(benchmark, window, literals)
    few = side.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    sizes = sorted({window, *(r.w for r in side.where(F.col("w") < window).select("w").distinct().collect())})
    texts = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    # windows past the end of a text match nothing; the outer form below keeps the
    # optimizer from computing the hashes twice, for a filter and for the rows
    hashes = F.when(F.size("words") > 0, F.concat(*(_hashes(f"h_{form}", size) for size in sizes for form in FORMS)))
    parsed = _token_hashes(template(texts).drop("text"))
    found = parsed.withColumn("hashes", hashes).select("doc_id", "text_hash", "words", F.posexplode_outer("hashes").alias("pos", "h"))
    if not few:
        hit = found.drop("words").join(side.select("h").distinct(), "h")
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
        found = hit.join(parsed.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "words").dropDuplicates(["__id", "__hash"]), same)
    place = F.col("pos") % F.size("words")
    zipped = F.zip_with("item_values", F.slice("words", place + 1, F.col("w")), lambda a, b: F.struct(a["a"].alias("a"), b.alias("b"), (a["slot"] | (a["a"] != b)).alias("slot")))
    pairs = F.array_distinct(F.transform(F.filter(zipped, lambda p: p["slot"]), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))
    hits = found.join(F.broadcast(side) if few else side, "h").select("doc_id", "text_hash", "item_id", "n", "w", "at", (place - F.col("at")).alias("diagonal"), pairs.alias("pairs"))
    steady = lambda p: F.size(p) == F.size(F.array_distinct(F.transform(p, lambda x: x["a"])))
    # windows that contradict themselves go after the grouping: pushed into the join, the test would take it out of generated code
    runs = hits.groupBy("doc_id", "text_hash", "item_id", "n", "w", "diagonal").agg(F.array_sort(F.collect_set(F.struct("at", "pairs"))).alias("windows"))
    runs = runs.withColumn("windows", F.filter("windows", lambda x: steady(x["pairs"])))
    runs = runs.select("doc_id", "text_hash", "item_id", "n", "w", "windows", F.col("windows.at").alias("at"), F.array_distinct(F.flatten("windows.pairs")).alias("pairs"))
    whole = steady(F.col("pairs"))
    runs = runs.select("doc_id", "text_hash", "item_id", "n", "w", "at", "pairs", F.when(whole, F.col("at")).alias("whole"), F.when(~whole, _parts(F.col("windows"), F.col("w"))).alias("longest"))
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    pair = runs.groupBy("doc_id", "text_hash", "item_id", "n", "w").agg(together("at").alias("at"), together("whole").alias("whole"), F.max("longest").alias("longest"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    zero = F.struct((-F.col("w")).alias("last"), F.lit(0).alias("total"), F.lit(0).alias("length"), F.lit(0).alias("longest"))
    w = F.col("w")

    def step(s: Column, at: Column) -> Column:
        new = F.least(w, at - s["last"])
        length = F.when(at - s["last"] <= w, s["length"] + new).otherwise(w)
        return F.struct(at.alias("last"), (s["total"] + new).alias("total"), length.alias("length"), F.greatest(s["longest"], length).alias("longest"))

    measured = pair.select("doc_id", "text_hash", "item_id", "n", "pairs", F.aggregate("at", zero, step)["total"].alias("total"), F.greatest(F.aggregate("whole", zero, step)["longest"], "longest").alias("longest"))
    return measured.where((F.col("longest") >= run) | (F.col("total") >= share * F.col("n"))).select(
        "doc_id",
        "text_hash",
        "item_id",
        F.col("n").cast("long").alias("n_item_tokens"),
        F.col("total").cast("long").alias("n_covered"),
        F.col("longest").cast("long").alias("longest_run"),
        F.size("pairs").cast("long").alias("n_slots"),
        F.size(F.filter("pairs", lambda p: p["a"] != p["b"])).cast("long").alias("n_changed"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.  Those are written and counted first: if they are few enough, no text is shuffled to take them out."""
    bad = written(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    return rows.join(few_beside(bad), F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti").select("row.*")
