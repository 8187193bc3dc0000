"""Text expressions, evaluated in the JVM but for canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import SPACE

#: Where a sentence ends, and what stands before a letter in place of either of these two in a text.
MARK, ESCAPE = "\U0010fffe", "\U0010fffd"
#: Sentence ends: CJK enders with their closers, Latin enders before white space or the end, runs of newlines.
SENTENCE_END = r"[。！？；…]+[」』”’）】》]*[ \t]*|[.!?;]+[\"')\]]*(?=[ \t\n]|\z)[ \t]*|\n+"
# Names that file systems reserve, and the name of what has none.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
UNNAMED = "未命名"


def strip(text: Column) -> Column:
    """Without white space at either end, as Python's str.strip sees it."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def visible_chars(text: Column) -> Column:
    """Characters that are not white space; null 0."""
    return F.coalesce(F.length(F.regexp_replace(text, rf"[{SPACE}]+", "")), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: inside functions of arrays, what is not an argument is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sentences(text: Column) -> Column:
    """The text cut after each sentence end; blank pieces join the piece before. Joined they give the text back.

    The mark between pieces may be in the text too: there it is written as ESCAPE and a letter meanwhile.
    """
    plain = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}a")), F.lit(MARK), F.lit(f"{ESCAPE}b"))
    marked = F.regexp_replace(plain, SENTENCE_END, f"$0{MARK}")
    joined = F.regexp_replace(marked, rf"{MARK}(?=[{SPACE}]*(?:{MARK}|\z))", "")  # no mark before a blank piece
    pieces = F.filter(F.split(joined, MARK), lambda p: p != "")
    return F.transform(pieces, lambda p: F.when(F.contains(p, F.lit(ESCAPE)), F.replace(F.replace(p, F.lit(f"{ESCAPE}b"), F.lit(MARK)), F.lit(f"{ESCAPE}a"), F.lit(ESCAPE))).otherwise(p))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, their lines stripped and joined by a space; empty ones left out."""
    blocks = F.split(text, rf"\n[{SPACE}]*\n")
    lined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""), " "))
    return F.filter(lined, lambda b: b != "")


def escape_tags(text: Column) -> Column:
    """`<` that could open a tag becomes an entity."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(?=[A-Za-z/!?])", "&lt;")


def markdown_cell(text: Column) -> Column:
    """A cell of a Markdown table: tags and bars escaped, newlines as <br>."""
    out = F.replace(escape_tags(text), F.lit("|"), F.lit("\\|"))
    return strip(F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("<br>")))


def safe_filename(name: Column, longest: int = 100) -> Column:
    """A name that any file system takes."""
    trim_end = lambda c: F.regexp_replace(c, "[ .]+$", "")
    clean = trim_end(strip(F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")))
    short = F.when(F.length(clean) > longest, trim_end(F.substring(clean, 1, longest))).otherwise(clean)
    named = F.when(short == "", F.lit(UNNAMED)).otherwise(short)
    return F.when(F.upper(F.substring_index(named, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), named)).otherwise(named)


def image_ref(ref: Column) -> Column:
    """A picture's path below assets/, without steps out of it; empty if there is none."""
    parts = F.filter(F.split(F.replace(F.coalesce(ref, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    inner = F.when(F.get(parts, F.lit(0)) == "assets", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(F.size(inner) > 0, F.concat(F.lit("assets/"), F.array_join(inner, "/"))).otherwise(F.lit(""))


def heading_tail(path: Column) -> Column:
    """The last label of a heading path."""
    return strip(F.substring_index(F.coalesce(path, F.lit("")), ">", -1))


def heading_path(labels: Column, longest_label: int = 60, longest: int = 240) -> Column:
    """Labels joined by `>`; a long label is cut, a long path keeps its deepest labels behind an ellipsis."""
    tidy = F.filter(F.transform(labels, lambda x: strip(F.regexp_replace(x, rf"[{SPACE}]+", " "))), lambda x: x != "")
    cut = F.transform(tidy, lambda x: F.when(F.length(x) > longest_label, F.concat(F.substring(x, 1, longest_label - 1), F.lit("…"))).otherwise(x))
    whole = F.array_join(cut, ">")
    kept = F.aggregate(
        F.reverse(cut), F.struct(F.slice(cut, 1, 0).alias("labels"), F.lit(1).alias("size"), F.lit(True).alias("open")),
        lambda a, x: F.struct(
            F.when(a["open"] & (a["size"] + F.length(x) + 1 <= longest), F.concat(F.array(x), a["labels"])).otherwise(a["labels"]).alias("labels"),
            F.when(a["open"] & (a["size"] + F.length(x) + 1 <= longest), a["size"] + F.length(x) + 1).otherwise(a["size"]).alias("size"),
            (a["open"] & (a["size"] + F.length(x) + 1 <= longest)).alias("open"),
        ),
    )
    return F.when(F.length(whole) <= longest, whole).otherwise(F.concat(F.lit("…>"), F.array_join(kept["labels"], ">")))


def json_list(raw: Column) -> Column:
    """A JSON array as strings; a scalar is an array of one; what is no JSON is split at commas; blank gives none."""
    parsed = F.from_json(raw, "array<string>")
    cut = F.filter(F.transform(F.split(raw, ","), strip), lambda x: x != "")
    scalar = F.try_parse_json(raw)
    return (
        F.when(F.coalesce(strip(raw), F.lit("")) == "", F.array().cast("array<string>"))
        .when(raw.rlike(rf"^[{SPACE}]*\["), F.coalesce(parsed, cut))
        .when(scalar.isNotNull(), F.array(F.coalesce(F.try_variant_get(scalar, "$", "string"), raw))).otherwise(cut)
    )


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a column number that counts from 1 (at most 18278: three letters)."""
    n = index.cast("long")
    last, rest = (n - 1) % 26, F.floor((n - 1) / 26).cast("long")
    mid, top = (rest - 1) % 26, F.floor((rest - 1) / 26).cast("long")
    letter = lambda k: F.char(k + 65)
    return F.concat(F.when((rest > 0) & (top > 0), letter((top - 1) % 26)).otherwise(F.lit("")), F.when(rest > 0, letter(mid)).otherwise(F.lit("")), letter(last))


def bytes_label(n: Column) -> Column:
    """A size for people: B below 1024, then one decimal in KB, MB or GB."""
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))


def version_triple(version: Column) -> Column:
    """The first three numbers of a version; what is missing or no number counts 0."""
    parts = F.split(F.regexp_replace(F.coalesce(version, F.lit("")), r"^[vV]|[-+].*$", ""), r"\.")
    return F.array(*[F.coalesce(F.regexp_extract(F.coalesce(F.get(parts, F.lit(k)), F.lit("")), r"^(\d+)", 1).try_cast("int"), F.lit(0)) for k in range(3)])


def milliseconds_label(ms: Column) -> Column:
    """A span for people: whole milliseconds, seconds with one decimal, then minutes and seconds; nothing known: a dash."""
    s = ms / 1000
    return F.when(ms.isNull() | F.isnan(ms.cast("double")), "—").when(ms < 1000, F.format_string("%dms", F.floor(ms + 0.5))).when(s < 60, F.format_string("%.1fs", s)).otherwise(F.format_string("%dm%ds", F.floor(s / 60), F.floor(s % 60 + 0.5)))


def duration_label(start: Column, end: Column) -> Column:
    """The time between two moments in its two largest units; a dash where it isn't known or negative."""
    ms = F.unix_millis(end) - F.unix_millis(start)
    s = F.floor(ms / 1000)
    return (
        F.when(ms.isNull() | (ms < 0), "—").when(ms < 1000, "<1s").when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh%dm", F.floor(s / 3600), F.floor(s / 60) % 60))
    )


def percent_value(share: Column) -> Column:
    """A share (0 to 1) or a percentage as a percentage."""
    return F.when(share <= 1, share * 100).otherwise(share)


def percent_label(share: Column, digits: int = 0) -> Column:
    return F.when(share.isNull() | F.isnan(share.cast("double")), "—").otherwise(F.format_string(f"%.{digits}f%%", percent_value(share).cast("double")))


def progress_value(done: Column) -> Column:
    """Progress, given either way, from 0 to 100; unknown 0."""
    return F.coalesce(F.least(F.greatest(percent_value(F.nanvl(done.cast("double"), F.lit(0.0))), F.lit(0.0)), F.lit(100.0)), F.lit(0.0))


def shortened(text: Column, longest: int) -> Column:
    """A text cut behind so many characters, with an ellipsis."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…"))).otherwise(text)


def canonical_json(text: Column) -> Column:
    """JSON of any depth with the keys of all objects sorted, no white space between its parts and no escapes but needed
    ones: equal values have equal texts. Of equal keys the last counts; null for what is no JSON."""

    @F.pandas_udf("string")
    def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(_canonical)

    return written(text)


def _canonical(text: object) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError, RecursionError):
        return None
