"""Token estimates as a column: no tokenizer, no Python worker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, in a syntax that Java and RE2 share.
#: Ideographs, kana and Hangul: one token a character.
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{20000}-\x{3134f}"
#: What Python's str.isspace accepts.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTER = r"\p{L}\p{Nl}\p{No}"
#: Runs that cost tokens, tried in this order; inline white space and non-ASCII digits cost nothing.
RUN = rf"[{CJK}]+|[0-9]+|[{LETTER}]+|\n+|[^{SPACE}\p{{L}}\p{{N}}_]+|_+"
LETTERS_PER_TOKEN, DIGITS_PER_TOKEN = 4, 3

# Without a CJK character after another letter, every token is one match, and counting matches is enough.
_ONE_BY_ONE = rf"[{CJK}]|[0-9]{{1,3}}|[{LETTER}]{{1,4}}|\n+|[^{SPACE}\p{{L}}\p{{N}}_]|_"


def _run_cost(run: Column) -> Column:
    n = F.length(run)
    return (
        F.when(run.rlike(rf"^[{CJK}]"), n).when(run.rlike("^[0-9]"), F.ceil(n / DIGITS_PER_TOKEN))
        .when(run.rlike(rf"^[{LETTER}]"), F.ceil(n / LETTERS_PER_TOKEN)).when(run.startswith("\n"), 1).otherwise(n).cast("long")
    )


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text: CJK one a character, digits one per three, letters one per four, a run of newlines one,
    other symbols one each. A run of letters is billed whole, also where CJK follows other letters in it. Null: 0.
    """
    runs = F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))
    exact = F.aggregate(runs, F.lit(0).cast("long"), lambda total, run: total + _run_cost(run))
    counted = F.regexp_count(text, F.lit(_ONE_BY_ONE)).cast("long")
    return F.coalesce(F.when(text.rlike(rf"[{LETTER}][{CJK}]"), exact).otherwise(counted), F.lit(0).cast("long"))


def count_tokens(text: Column, file: str | None = None) -> Column:
    """Tokens by a tokenizer file, in batches; where there is none, or it can't be read, the estimate. Null: 0.

    The file's content travels with the plan, so executors need no copy of it.
    """
    try:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(file).to_str() if file else None
    except Exception:  # the library raises no narrower kind
        model = None
    if model is None:
        return estimate_tokens(text)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Tokenizer.from_str(model)
        for texts in batches:
            found = coder.encode_batch([t if isinstance(t, str) else "" for t in texts], add_special_tokens=False)
            yield pd.Series([len(x.ids) for x in found], dtype="int64")

    return F.coalesce(counted(text), F.lit(0).cast("long"))
