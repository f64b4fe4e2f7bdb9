"""Personal data in texts: fixed patterns, and boosted trees over wider candidates.

Fixed patterns with their checks give the base spans. Wider generators propose overlapping candidates; those that lie on base spans of
their kind teach boosted trees what personal data look like from format and context, those that do not teach the opposite. Candidates
elsewhere are added where the calibrated score of their kind is high enough. All of it is column expressions, SQL and Spark's own trees.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.linking import bounded
from talkframe.llm.storage import settle

KINDS = ["email", "ip", "card", "phone"]
TREES = 12
DEPTH = 3
#: Share of right candidates that a threshold must reach on the calibration part, and how many it must rest on.
PRECISION = 0.99
LEAST_CALIBRATION = 20
#: Characters of context on each side.
CONTEXT = 24
#: Characters of the stretches that context is taken from; longer than a context.
_STRETCH = 1024
#: Candidates and base spans meet by the cells of so many characters that they lie in.
_CELL = 64

# The patterns may repeat groups possessively: nothing that follows could take a character back, and long runs need no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a pattern is tried.
HINT = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,6}",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,21}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![A-Za-z0-9])",
}
WIDE_HINT = {"email": r"@|\(at\)|\[at\]| at ", "ip": "[0-9]\\[?[.]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9][ ._/-]{0,2}[0-9]", "phone": "[0-9]\\)?[ ./-]"}

_SPAN = "array<struct<start: bigint, value: string>>"
_WIDE = "array<struct<kind: int, start: bigint, end: bigint, value: string, left: string, right: string>>"
#: Spans that are gathered before they are put with the others, so that long lists are not copied for each span.
_BLOCK = 256


def matches(text: Column, pattern: str, hint: str) -> Column:
    """All matches of a pattern, leftmost and apart, with their starts in code points.

    The text between matches gives the places: one fold over both, in which nothing is searched twice.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    none = F.array().cast(_SPAN)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("done"), none.alias("open"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        full = F.size(state["open"]) >= _BLOCK
        span = F.array(F.struct(start.alias("start"), x["value"].alias("value")))
        moved = F.struct(
            (start + F.length(x["value"])).alias("at"), F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full, span).otherwise(F.concat(state["open"], span)).alias("open"),
        )
        return F.when(x["value"].isNull(), state).otherwise(moved)

    placed = F.aggregate(both, begin, add, lambda state: F.flatten(F.concat(state["done"], F.array(state["open"]))))
    return F.when(text.rlike(hint), placed).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of at least one digit is right."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(kind: str, text: Column) -> Column:
    """Spans ``(start, value)`` of the fixed pattern of a kind that pass its check."""
    return F.filter(matches(text, BASE[kind], HINT[kind]), lambda s: _valid(kind, s["value"]))


def _with_context(kind: str, text: Column, spans: Column) -> Column:
    """Spans with kind, end and the text around them, which is taken from the stretch that holds it and not from the whole text."""
    def widen(stretches: Column, s: Column) -> Column:
        end = s["start"] + F.length(s["value"])
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))

        def near(at: Column, size: Column) -> Column:
            i = F.floor(at / _STRETCH).cast("int")
            two = F.concat(F.coalesce(F.get(stretches, i), F.lit("")), F.coalesce(F.get(stretches, i + 1), F.lit("")))
            return F.substring(two, (at % _STRETCH).cast("int") + 1, size)

        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), end.alias("end"), s["value"].alias("value"),
            near(begin, (s["start"] - begin).cast("int")).alias("left"), near(end, F.lit(CONTEXT)).alias("right"),
        )

    # Through arrays of one, so that the text is cut and searched once.
    cut = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_STRETCH}}}"), F.lit(0)))
    placed = F.transform(cut, lambda stretches: F.transform(spans, lambda s: widen(stretches, s)))
    return F.when(text.rlike(WIDE_HINT[kind]), F.flatten(placed)).otherwise(F.array().cast(_WIDE))


def _with_kind(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end")))


def _count(kind: int, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def find_candidates(documents: DataFrame) -> DataFrame:
    """``(row, doc_id, base, candidates)`` of every row: spans of the fixed patterns, and those of the wide ones with context."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    text = F.col("text")
    base = [_with_kind(i, base_spans(k, text)) for i, k in enumerate(KINDS)]
    wide = [_with_context(k, text, matches(text, WIDE[k], WIDE_HINT[k])) for k in KINDS]
    possible = text.rlike(r"[0-9]|@|\(at\)|\[at\]| at |[0-9A-Fa-f]:[0-9A-Fa-f]")
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")
    none_wide = F.array().cast(_WIDE)
    return some.select("row", "doc_id", F.when(possible, F.concat(*base)).otherwise(none).alias("base"), F.when(possible, F.concat(*wide)).otherwise(none_wide).alias("candidates"))


_WORDS = ["tel|phone|fax|call|mobil", "card|visa|credit|payment", "mail|contact|write", "ip|host|address|server", "token|key|secret|password|hash|id", "version|license|section|chapter|page|isbn"]


def features(candidate: Column) -> dict[str, Column]:
    """Format and context of a candidate as numbers; what makes a base span is not among them."""
    value, left, right = candidate["value"], F.lower(candidate["left"]), F.lower(candidate["right"])
    digits = digits_of(value)
    groups = F.transform(F.filter(F.split(value, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    before, after = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    numbers = {f"is_{k}": candidate["kind"] == i for i, k in enumerate(KINDS)}
    numbers |= {
        "length": F.length(value), "digits": F.length(digits), "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")), "spaces": F.length(F.regexp_replace(value, "[^ ]", "")),
        "marks": F.length(F.regexp_replace(value, "[A-Za-z0-9 ]", "")), "groups": F.size(groups), "longest": F.coalesce(F.array_max(groups), F.lit(0)), "shortest": F.coalesce(F.array_min(groups), F.lit(0)),
        "luhn": F.when(F.length(digits) > 0, luhn(digits)).otherwise(False), "small_parts": F.forall(F.split(digits, "x"), lambda g: F.length(g) <= 12),
        "dots": F.length(F.regexp_replace(value, "[^.]", "")), "bracket": value.contains("("), "at": value.rlike(r"@|\(at\)|\[at\]"),
        "before_word": before.rlike("[a-z0-9_]"), "after_word": after.rlike("[a-z0-9_]"), "before_mark": before.rlike("[^a-z0-9 \n]"), "after_mark": after.rlike("[^a-z0-9 \n]"),
    }
    numbers |= {f"near_{i}": F.concat(left, F.lit(" "), right).rlike(rf"\b(?:{w})") for i, w in enumerate(_WORDS)}
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in numbers.items()}


def labelled_candidates(found: DataFrame) -> DataFrame:
    """Features of every candidate of ``found``, whether it ``touches`` a base span of its row, and its ``label``: 1 on a base span of its kind.

    ``found`` is a written table of ``find_candidates``. Spans meet by cells of a text, so a row with very many of them costs no more a span than others.
    """
    def in_cells(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / _CELL), F.floor((end - 1) / _CELL))).alias("cell")

    one = found.select("row", F.explode("candidates").alias("c"))
    asked = one.select("row", "c.kind", "c.start", "c.end", in_cells(F.col("c.start"), F.col("c.end")))
    base = found.select("row", F.explode("base").alias("b")).select("row", "b", in_cells(F.col("b.start"), F.col("b.end")))
    met = asked.join(base, ["row", "cell"]).filter((F.col("b.start") < F.col("end")) & (F.col("start") < F.col("b.end")))
    covers = (F.col("b.kind") == F.col("kind")) & (F.least("b.end", "end") - F.greatest("b.start", "start") >= 0.6 * (F.col("end") - F.col("start")))
    met = bounded(settle(met.groupBy("row", "kind", "start").agg(F.max(covers).alias("covered")), "pii-touching"))
    given = features(F.col("c"))
    table = one.select("row", F.col("c.kind").alias("kind"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), *[v.alias(k) for k, v in given.items()])
    label = F.coalesce("covered", F.lit(False)).cast("double")
    return table.join(met, ["row", "kind", "start"], "left").withColumns({"touches": F.col("covered").isNotNull(), "label": label}).drop("covered")


def added_spans(found: DataFrame) -> DataFrame:
    """``(row, added)``: candidates apart from all base spans of their row whose calibrated score is high enough.

    ``found`` is a written table of ``find_candidates``. Without candidates of both sorts nothing is added. Trees learn from all candidates of two
    thirds of the rows, thresholds count all of the others: candidates with the same features are one row, whose weight is their number.
    """
    table = settle(labelled_candidates(found), "pii-candidates")
    given = [c for c in table.columns if c not in ("row", "kind", "start", "end", "touches", "label")]
    empty = found.sparkSession.createDataFrame([], "row bigint, added array<struct<kind: int, start: bigint, end: bigint>>")
    counts = table.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not counts["n"] or counts["ones"] in (0, counts["n"]):
        return empty
    assembler = VectorAssembler(inputCols=given, outputCol="features")
    calibrates = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(3)) == 0
    taught = settle(table.groupBy("kind", "label", calibrates.alias("calibrates"), *given).agg(F.count("*").cast("double").alias("weight")), "pii-taught")
    learnt = taught.filter("not calibrates")
    if learnt.select("label").distinct().count() < 2:
        return empty
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=9, maxBins=16, weightCol="weight").fit(assembler.transform(learnt).select("features", "label", "weight"))
    chance = vector_to_array("probability")[1].alias("chance")
    scored = model.transform(assembler.transform(taught.filter("calibrates"))).select("kind", "label", "weight", F.floor(chance * 50).alias("level"))
    levels = scored.groupBy("kind", "level").agg(F.sum(F.col("label") * F.col("weight")).alias("ones"), F.sum("weight").alias("n")).collect()
    least = {}
    for kind in range(len(KINDS)):
        ones = n = 0.0
        for row in sorted((r for r in levels if r["kind"] == kind), key=lambda r: -r["level"]):
            ones, n = ones + row["ones"], n + row["n"]
            if n >= LEAST_CALIBRATION and ones / n >= PRECISION:
                least[kind] = row["level"] / 50
    if not least:
        return empty
    bound = F.get(F.array(*[F.lit(least.get(k, 2.0)) for k in range(len(KINDS))]), F.col("kind"))
    chosen = model.transform(assembler.transform(table.filter("not touches"))).filter(vector_to_array("probability")[1] >= bound)
    spans = chosen.groupBy("row").agg(F.collect_list(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")).alias("spans"))
    # Of overlapping ones the first stays, the longer one first.
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    kept = F.aggregate(ordered, F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>"), lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]), done).otherwise(F.concat(done, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["less"]).alias("end"))))))
    return spans.select("row", kept.alias("added"))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` of every row of ``documents`` (``doc_id``, ``text``): spans ``(kind, start, end)`` in order of kind and start.

    ``kind`` counts in ``KINDS``; positions are code points, the end outside. ``spans`` are the base spans and the added ones. A null or empty text has
    none. Repeated rows and rows without an id are searched each. Other columns are not read. An empty table gives no rows.
    """
    found = settle(find_candidates(documents), "pii-found")
    added = bounded(settle(added_spans(found), "pii-added"))
    joined = found.join(added, "row", "left")
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def redact(documents: DataFrame, spans: DataFrame, mark: str = "▮") -> DataFrame:
    """``(doc_id, text)`` with every character of the spans replaced; ``spans`` has one row for each ``doc_id``."""
    joined = documents.select("doc_id", "text").join(spans.select("doc_id", "spans"), "doc_id", "left")
    pieces = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def hide(text: Column, s: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), s["start"].cast("int")), F.repeat(F.lit(mark), (s["end"] - s["start"]).cast("int")), F.substring(text, s["end"].cast("int") + 1, F.length(text)))

    return joined.select("doc_id", F.when(F.size("spans") > 0, F.aggregate(pieces, F.col("text"), hide)).otherwise(F.col("text")).alias("text"))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans of every document."""
    found = find_personal_data(spark.read.parquet(f"{folder}/documents.parquet"))
    counts = [_count(i, F.col("base")).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))
