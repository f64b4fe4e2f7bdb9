"""Column expressions: times, urls, dates, languages and text keys.

All are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkframe.functions import fixed_values as fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(value, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to even."""
    scale = float(10**digits)
    return F.rint(_col(value) * scale) / scale


def none_if_empty(value) -> Column:
    return F.nullif(_col(value), F.lit(""))


def words(value) -> Column:
    """White-space separated tokens; no tokens for blank text."""
    return F.array_remove(F.split(_col(value), r"(?U)\s+"), "")


def strip(value) -> Column:
    """Cut (Unicode) white space at both ends, line breaks included."""
    return F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", "")


# --- times -------------------------------------------------------------------

def format_timestamp(seconds, separator: str = ".") -> Column:
    """``HH:MM:SS.mmm``. Negative times show as 0; 1000 ms carry into the seconds only."""
    t = F.greatest(_col(seconds).cast("double"), F.lit(0.0))
    hours = F.floor(t / 3600)
    minutes = F.floor((t - hours * 3600) / 60)
    rest = t - hours * 3600 - minutes * 60
    whole = F.floor(rest)
    millis = F.rint((rest - whole) * 1000).cast("long")
    carry = millis == 1000
    return F.format_string(
        f"%02d:%02d:%02d{separator}%03d",
        hours,
        minutes,
        F.when(carry, whole + 1).otherwise(whole),
        F.when(carry, F.lit(0)).otherwise(millis),
    )


def format_clock(seconds) -> Column:
    """``HH:MM:SS`` with the fraction cut off."""
    t = F.floor(_col(seconds))
    return F.format_string(
        "%02d:%02d:%02d", F.floor(t / 3600), F.floor(F.pmod(t, F.lit(3600)) / 60), F.pmod(t, F.lit(60))
    )


def format_duration(seconds) -> Column:
    """``H:MM:SS``, ``M:SS`` under an hour, and a dash where unknown."""
    t = _col(seconds).cast("long")
    hours = F.floor(t / 3600)
    minutes = F.floor(F.pmod(t, F.lit(3600)) / 60)
    rest = F.pmod(t, F.lit(60))

    def two(number: Column) -> Column:
        return F.lpad(number.cast("string"), 2, "0")

    return (
        F.when(t.isNull(), F.lit("—"))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest)))
        .otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(rest)))
    )


def parse_timestamp(value) -> Column:
    """Seconds of ``MM:SS``, ``HH:MM:SS`` or a number; null where malformed or negative."""
    parts = F.transform(F.split(F.trim(_col(value)), ":"), lambda p: F.trim(p))
    number = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))
    well_formed = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.rlike(number))
    return F.when(well_formed & (total >= 0), total)


def parse_yyyymmdd(value) -> Column:
    """Date of exactly eight digits, else null."""
    v = _col(value)
    return F.when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd"))


def chunk_count(size, limit) -> Column:
    """Number of pieces so that each stays under 95 % of ``limit``; 1 where it fits whole."""
    size, limit = _col(size).cast("long"), _col(limit).cast("long")
    target = F.floor(limit * 0.95)
    pieces = F.floor((size + target - 1) / target)
    return F.when(size <= limit, F.lit(1).cast("long")).otherwise(F.greatest(pieces, F.lit(2).cast("long")))


# --- urls and ids ------------------------------------------------------------

def platform_of(url) -> Column:
    """Platform by host name inside the url; ``unknown`` where there is none."""
    lowered = F.lower(F.coalesce(_col(url), F.lit("")))
    out = None
    for platform, hosts in fixed.PLATFORM_HOSTS.items():
        hit = lowered.contains(hosts[0])
        for host in hosts[1:]:
            hit = hit | lowered.contains(host)
        out = F.when(hit, platform) if out is None else out.when(hit, platform)
    return out.otherwise("unknown")


def youtube_id(url) -> Column:
    return none_if_empty(F.regexp_extract(_col(url), fixed.YOUTUBE_ID_PATTERN, 1))


def instagram_shortcode(url) -> Column:
    return none_if_empty(F.regexp_extract(_col(url), fixed.INSTAGRAM_CODE_PATTERN, 1))


def channel_kind(url) -> Column:
    """``<platform>:profile`` or ``<platform>:post``; null for any other url. Profiles win."""
    u = _col(url)
    out = None
    for kind, patterns in (("profile", fixed.PROFILE_PATTERNS), ("post", fixed.POST_PATTERNS)):
        for platform, pattern in patterns.items():
            label = f"{platform}:{kind}"
            out = F.when(u.rlike(pattern), label) if out is None else out.when(u.rlike(pattern), label)
    return out


def is_video_id(value) -> Column:
    return F.coalesce(_col(value).rlike(fixed.VIDEO_ID_PATTERN), F.lit(False))


# --- languages ---------------------------------------------------------------

def script_of(text) -> Column:
    """Most frequent writing system; the order of the ranges breaks ties; null where none occurs."""
    t = F.coalesce(_col(text), F.lit(""))
    names = F.array(*[F.lit(name) for name in fixed.SCRIPT_RANGES])
    counts = F.array(*[F.length(F.regexp_replace(t, others + "+", "")) for others in fixed.SCRIPT_RANGES.values()])

    def most(found):
        return F.when(F.array_max(found) > 0, F.get(names, (F.array_position(found, F.array_max(found)) - 1).cast("int")))

    # Through an array of one, so that each script is counted once and not per comparison.
    return F.get(F.transform(F.array(counts), most), F.lit(0))


def script_of_language(language) -> Column:
    lang = _col(language)
    out = None
    for script, languages in fixed.SCRIPT_LANGUAGES.items():
        hit = lang.isin(languages)
        out = F.when(hit, script) if out is None else out.when(hit, script)
    return out.otherwise("latin")


def anchor_language(hint, query, languages) -> Column:
    """The hint if listed, else the first language in the query's script, else the first listed."""
    hint, langs = _col(hint), _col(languages)

    def listed(script):
        same_script = F.filter(langs, lambda x: script_of_language(x) == script)
        return F.when(F.size(same_script) > 0, F.get(same_script, F.lit(0))).otherwise(F.get(langs, F.lit(0)))

    # Through an array of one, so that the script is worked out once and not per language.
    by_script = F.get(F.transform(F.array(script_of(query)), listed), F.lit(0))
    return F.when((hint != "") & F.array_contains(langs, hint), hint).otherwise(by_script)


def report_type(video_type) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.REPORT_TYPES.items() for x in pair])
    return F.coalesce(table[_col(video_type)], F.lit(fixed.DEFAULT_REPORT_TYPE))


# --- text --------------------------------------------------------------------

def slug(name) -> Column:
    """Lower-case ASCII name with single hyphens; ``memory`` where nothing is left."""
    s = F.lower(F.trim(F.coalesce(_col(name), F.lit(""))))
    s = F.regexp_replace(s, "[_ ]", "-")
    s = F.regexp_replace(s, r"[^a-z0-9\-]+", "")
    s = F.regexp_replace(s, "-{2,}", "-")
    s = F.trim(s, F.lit("-"))
    return F.when(s == "", F.lit("memory")).otherwise(s)


def split_fixed(text, size: int) -> Column:
    """Pieces of ``size`` characters in order; one empty piece for empty text.

    One regular-expression pass, so the cost grows with the text and not with
    its square.
    """
    t = F.coalesce(_col(text), F.lit(""))
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(t == "", F.array(F.lit(""))).otherwise(pieces)


def compare_key(text) -> Column:
    """Comparison form of a phrase: lower case, runs of non-word characters as one space."""
    return F.trim(F.lower(F.regexp_replace(_col(text), r"(?U)[\W_]+", " ")))


def canon_number(token) -> Column:
    """Digits and inner dots of a number as written."""
    return F.trim(F.regexp_replace(_col(token), r"[^\d.]", ""), F.lit("."))


def failure_hint(stage, error) -> Column:
    """What to do about a failed video; null where no rule applies. The first rule wins."""
    s = F.lower(F.coalesce(_col(error), F.lit("")))
    stage = _col(stage)
    return (
        F.when(s.contains("ipblocked") | s.contains("ip blocked"), "add_cookies_or_use_smart_backend")
        .when(s.contains("subtitles unavailable"), "use_smart_backend")
        .when(
            (stage == "download") & (s.contains("403") | s.contains("bot") | s.contains("sign in")),
            "add_cookies",
        )
        .when((stage == "backend") & F.replace(s, F.lit(" "), F.lit("")).contains("api_key"), "set_api_key")
        .when(s.contains("resource_exhausted") | s.contains("429"), "quota_wait_or_use_smart_backend")
    )


def case_folded(text) -> Column:
    """A form in which any text that a case-insensitive pattern takes for a lower-case literal holds that literal."""
    # Not lower(upper()) alone, which the optimizer takes for lower().
    return F.lower(F.translate(F.upper(_col(text)), "\u0130", "i"))


def pattern_hits(text, folded, patterns: list[str]) -> Column:
    """How many of the patterns occur in ``text``, case ignored, word edges as in Unicode.

    A pattern is only tried where ``folded``, the text by :func:`case_folded`, holds one of its leading literals, and
    patterns of Cyrillic letters only where there is such a letter.
    """
    text, folded = _col(text), _col(folded)

    def hit(pattern):
        found, heads = text.rlike("(?iU)" + pattern), fixed.leading_literals(pattern)
        if not heads:
            return found.cast("int")
        held = folded.contains(heads[0])
        for head in heads[1:]:
            held = held | folded.contains(head)
        return F.when(held, found.cast("int")).otherwise(0)

    def total(some):
        out = F.lit(0)
        for pattern in some:
            out = out + hit(pattern)
        return out

    def cyrillic(pattern):
        heads = fixed.leading_literals(pattern)
        return bool(heads) and all(re.search("[а-яё]", head) for head in heads)

    rest, apart = [p for p in patterns if not cyrillic(p)], [p for p in patterns if cyrillic(p)]
    return total(rest) + F.when(folded.rlike("[а-яё]"), total(apart)).otherwise(0) if apart else total(rest)


def moment_kind(text) -> Column:
    """``procedure`` where the text stacks step words and actions, else ``showcase``."""
    def told(both):
        return pattern_hits(both["t"], both["low"], fixed.ACTION_PATTERNS), pattern_hits(both["t"], both["low"], fixed.CONNECTIVE_PATTERNS)

    def kind(found):
        actions, connectives = found["a"], found["c"]
        stepwise = (connectives >= 3) | ((actions >= 2) & (connectives >= 1)) | (actions >= 3)
        return F.when(stepwise, "procedure").otherwise("showcase")

    # Through arrays of one, so that the text and its hits are worked out once and not per use.
    t = F.coalesce(_col(text), F.lit(""))
    texts = F.transform(F.array(t), lambda x: F.struct(x.alias("t"), case_folded(x).alias("low")))
    hits = F.transform(texts, lambda x: F.struct(*[h.alias(n) for h, n in zip(told(x), "ac")]))
    return F.get(F.transform(hits, kind), F.lit(0))
