"""Language of pages and documents from several sources of evidence.

The text gives a likelihood by letter trigrams, whose counts are summed over all labelled documents. Its posterior alone says how often each
declared markup language and each address ending goes with a language, and what each host publishes; a host's prior leans on that of its
domain, and that on the prior of all. All evidence is then multiplied.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.linking import bounded
from talkframe.llm.storage import column, pieces, settle

#: Trigrams fall into so many buckets.
BUCKETS = 1 << 15
#: Trigrams of a text count like this many independent ones at most: neighbours say much the same.
EFFECTIVE = 60.0
#: Weight of the wider prior, in pages, and of a uniform one in the tables of declared languages and endings.
WIDER = 10.0
UNIFORM = 0.5

_LETTER = np.array([chr(c).isalpha() for c in range(0x250)])
_DROPPED = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)")


def trigram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams of the texts in a row, and how many each text has; marks and digits are spaces."""
    lowered = pc.utf8_lower(pa.array([f" {t} " for t in texts], pa.large_string())).to_pylist()
    lengths = np.array([len(t) for t in lowered], np.int64)
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = code < len(_LETTER)
    code[low] = np.where(_LETTER[code[low]], code[low], 32)
    rolled = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D) if len(code) > 2 else np.zeros(0, np.uint32)
    rolled ^= rolled >> np.uint32(15)
    buckets = ((rolled * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1)
    counts = np.maximum(lengths - 2, 0)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    # A trigram of spaces alone says nothing.
    blank = (code[at] == 32) & (code[at + 1] == 32) & (code[at + 2] == 32)
    owner = np.repeat(np.arange(len(texts)), counts)[~blank]
    return buckets[at[~blank]], np.bincount(owner, minlength=len(texts))


def trigram_counts(documents: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over all documents with a ``lang``; tasks add up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in pieces(batches, chars=1 << 19):
            buckets, counts = trigram_buckets(texts)
            ends = np.cumsum(counts)
            langs = column(batch, "lang").to_pylist()
            for lang in set(langs):
                own = [buckets[e - c:e] for e, c, x in zip(ends.tolist(), counts.tolist(), langs) if x == lang]
                sums[lang] = sums.get(lang, 0) + np.bincount(np.concatenate(own), minlength=BUCKETS)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(total[some])], ["lang", "bucket", "n"])

    known = documents.filter("lang is not null and text is not null").select("lang", "text")
    return known.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class TextModel:
    """Log likelihoods of buckets by language; at most ``BUCKETS`` numbers a language."""

    def __init__(self, counts: DataFrame):
        rows = counts.collect()  # bounded by buckets and languages
        self.languages = sorted({r["lang"] for r in rows})
        place = {x: i for i, x in enumerate(self.languages)}
        table = np.full((len(self.languages), BUCKETS), 0.05)
        for r in rows:
            table[place[r["lang"]], r["bucket"]] += r["n"]
        self.sizes = table.sum(axis=1)
        self.table = np.log(table / self.sizes[:, None]).T.astype(np.float32) if self.languages else np.zeros((BUCKETS, 0), np.float32)

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Tempered log likelihoods: one row a text."""
        buckets, counts = trigram_buckets(texts)
        total = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(counts)
        if len(full) and self.languages:
            starts = np.cumsum(counts)[full] - counts[full]
            total[full] = np.add.reduceat(self.table[buckets].astype(np.float64), starts, axis=0)
        return total * (np.minimum(counts, EFFECTIVE) / np.maximum(counts, 1))[:, None]


def page_parts(pages: DataFrame) -> DataFrame:
    """``(page_id, text, declared, ending, host, domain)`` from ``page_id``, ``url`` and ``html``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in pieces(batches, "html"):
            found = [_DECLARED.search(s) for s in sources]
            texts = [html.unescape(_DROPPED.sub(" ", s)) for s in sources]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([m and m[1].lower() for m in found], pa.string())], ["page_id", "url", "text", "declared"])

    parsed = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(parse, "page_id bigint, url string, text string, declared string")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    folder = F.lower(F.regexp_extract("url", r"^[^:]+://[^/]+/([A-Za-z]{2})(?:/|$)", 1))
    ending = F.concat_ws("/", F.element_at(F.split(host, r"\."), -1), F.when(folder != "", folder))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return parsed.select("page_id", "text", "declared", F.when(ending != "", ending).alias("ending"), host.alias("host"), F.when(domain != "", domain).otherwise(host).alias("domain"))


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def _sums(rows: DataFrame, key: str | None, width: int) -> DataFrame:
    """Sums of ``alone`` by ``key``, combined before the shuffle."""
    sums = F.array(*[F.sum(F.col("alone")[i]) for i in range(width)]).alias("sums")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(sums) if key else rows.agg(sums)


def identify(parts: DataFrame, model: TextModel) -> DataFrame:
    """Adds ``lang``, ``probability``, ``text_lang`` to rows of ``text``, ``declared``, ``ending``, ``host`` and ``domain``; drops ``text``.

    Missing evidence is left out: a row with nothing but a host has its host's prior. A null text is empty. Without any labelled document
    ``lang`` is null. Ties go to the first language by name.
    """
    width = len(model.languages)
    kept = [f for f in parts.schema if f.name != "text"]
    if not width:
        nothing = F.lit(None).cast("string")
        return parts.drop("text").select("*", nothing.alias("lang"), F.lit(None).cast("double").alias("probability"), nothing.alias("text_lang"))
    sent = parts.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, chars=1 << 19):
            logs = sent.value.likelihoods(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([*[column(batch, f.name) for f in kept], lists], [*[f.name for f in kept], "logs"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    measured = parts.mapInArrow(measure, f"{fields}, logs array<double>")
    measured = settle(measured.withColumn("alone", _posterior(F.col("logs"))), "language-evidence")

    everything = _sums(measured, None, width).first()["sums"]
    total = sum(x or 0.0 for x in everything)
    prior = [((x or 0.0) + 1.0) / (total + width) for x in everything]
    priors = F.array(*[F.lit(p) for p in prior])
    # What a language is declared as and where it is published, given the language.
    likely = measured
    for key in ("declared", "ending"):
        sums = settle(_sums(measured, key, width), f"language-{key}")
        kinds = sums.count()
        given = F.transform("sums", lambda x, i: F.log((x + UNIFORM) / (F.get(priors, i) * total + UNIFORM * max(1, kinds))))
        likely = likely.join(bounded(sums.select(key, given.alias(f"by_{key}"))), key, "left")

    def lean(sums: Column, wider: Column) -> Column:
        n = F.aggregate(sums, F.lit(0.0), lambda s, x: s + x)
        return F.transform(sums, lambda x, i: (x + WIDER * F.get(wider, i)) / (n + WIDER))

    domains = settle(_sums(measured, "domain", width).select("domain", lean(F.col("sums"), priors).alias("domain_prior")), "language-domains")
    owners = measured.filter("host is not null").select("host", "domain").distinct()
    hosts = settle(_sums(measured, "host", width).join(owners, "host").join(domains, "domain", "left").select("host", lean(F.col("sums"), F.coalesce("domain_prior", priors)).alias("host_prior")), "language-hosts")
    joined = likely.join(hosts, "host", "left")
    zero = F.lit(0.0)

    def fused(x: Column, i: Column) -> Column:
        declared, ending = (F.coalesce(F.get(F.col(f"by_{k}"), i), zero) for k in ("declared", "ending"))
        return x + F.log(F.get(F.coalesce(F.col("host_prior"), priors), i)) + declared + ending

    chances = joined.withColumn("chances", _posterior(F.transform("logs", fused)))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.array_position("chances", F.array_max("chances")).cast("int") - 1
    alone = F.array_position("alone", F.array_max("alone")).cast("int") - 1
    return chances.select(*[f.name for f in kept], F.get(names, best).alias("lang"), F.array_max("chances").alias("probability"), F.get(names, alone).alias("text_lang"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every page and of every document; a document's source stands for a host, and its label is not used for itself."""
    documents, pages = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/pages.parquet")
    model = TextModel(trigram_counts(documents))
    nothing = F.lit(None).cast("string")
    own = documents.select(F.col("doc_id").cast("bigint"), F.lit(None).cast("bigint").alias("page_id"), "text", nothing.alias("declared"), nothing.alias("ending"), F.col("source").alias("host"), nothing.alias("domain"))
    web = page_parts(pages).select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", "text", "declared", "ending", "host", "domain")
    return identify(own.unionByName(web), model).select("doc_id", "page_id", "host", "declared", "lang", "probability", "text_lang")
