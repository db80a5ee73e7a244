"""Quality rules as one projection, without user functions.

A table of thresholds (``RULES``) is compiled into one boolean column over a
few measured columns: lengths, symbols, stop words, repeated lines and repeated
word windows. Everything is a built-in function over the text's own arrays, so
the plan is one scan and one chain of projections without a shuffle.

Defined results: a null or empty text has no words and fails the base rules; a very
long text is measured whole; a
rule whose ratio has denominator 0 sees ratio 0; rows are judged one by one, so
ties and repeated rows change nothing; other columns pass through under their
own names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, require, spare

#: Frequent short words of English, German, French and Spanish; texts of running prose hold some.
STOP_WORDS = "the of and to in is a that it for on with as was be by at from this der die und das den ist von zu mit ein eine le la de et les des un une que en du pour el los se por con del al no para".split()

#: (name, measure, lowest, highest): a text whose measure is outside fails the rule.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    ("symbols_to_words", "n_symbols / n_words", None, 0.5),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    ("stop_words", "n_stop_words / n_words", 0.01, None),
    ("shouting", "n_capitals / n_words", None, 0.5),
    ("pipes", "n_pipes / n_words", None, 0.2),
)

_SPACE = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame, *, text_col: str = "text", window: int = 5, stop_words: Iterable[str] = STOP_WORDS, prefix: str = "") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the measured columns, and their names by measure.

    Names that ``docs`` has already are lengthened by underscores.
    """
    require(docs, text_col)
    name = {}

    all_stops = [v for x in stop_words for v in dict.fromkeys((x, x.capitalize(), x.upper()))]

    def put(df: DataFrame, **columns: Column) -> DataFrame:
        for k in columns:
            name[k] = spare(df, prefix + k)
        return df.withColumns({name[k]: c for k, c in columns.items()})

    df = put(docs, text=F.coalesce(F.col(text_col), F.lit("")))
    text = F.col(name["text"])
    df = put(
        df,
        words=F.filter(F.split(text, _SPACE), lambda w: w != ""),
        lines=F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD_PATTERN))),
    )
    words, lines = F.col(name["words"]), F.col(name["lines"])
    w = f"`{name['words']}`"
    df = put(df, hashes=F.transform(words, lambda x: F.xxhash64(x)))
    h = f"`{name['hashes']}`"
    df = put(
        df,
        n_words=F.size(words).cast("bigint"),
        n_lines=F.size(lines).cast("bigint"),
        word_chars=F.length(F.array_join(words, "")).cast("bigint"),
        n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        n_pipes=F.regexp_count(text, F.lit(r"\|")).cast("bigint"),
        n_capitals=F.regexp_count(text, F.lit(r"\p{Lu}{2,}")).cast("bigint"),
        n_stop_words=F.size(F.filter(words, lambda x: x.isin(all_stops))).cast("bigint"),
        n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        grams=F.expr(
            f"case when size({w}) >= {window} then transform(sequence(0, size({w}) - {window}),"
            f" i -> xxhash64({', '.join(f'{h}[i + {k}]' for k in range(window))})) else array() end"
        ),
    )
    # Only where a hash occurs twice: (hash, place) in order, so that equal windows stand side by side.
    g = f"`{name['grams']}`"
    df = put(df, windows=F.expr(f"case when size(array_distinct({g})) < size({g}) then sort_array(transform({g}, (h, i) -> struct(h, i))) end"))
    s = f"`{name['windows']}`"

    def same(there: str) -> str:
        """The window at x has the words (not the hash alone) of its neighbour in the order."""
        return f"x.h = {s}[{there}].h and " + " and ".join(f"{w}[x.i + {k}] = {w}[{s}[{there}].i + {k}]" for k in range(window))

    df = put(
        df,
        places=F.expr(
            f"sort_array(transform(filter({s}, (x, j) -> case when j > 0 and {same('j - 1')} then true"
            f" when j + 1 < size({s}) then {same('j + 1')} else false end), x -> x.i))"
        ),
    )
    p = f"`{name['places']}`"
    df = put(df, n_repeat_words=F.expr(f"cast(coalesce(aggregate({p}, named_struct('n', 0, 'to', 0), (a, i) -> named_struct('n', a.n + {window} - greatest(0, a.to - i), 'to', i + {window}), a -> a.n), 0) as bigint)"))
    return df, name


def verdict(name: dict[str, str], rules=RULES, *, min_words: int = 10, max_repeat_percent: int = 20) -> tuple[Column, Column, Column]:
    """Columns: fails the base rules; passes the whole table; names of failed rules."""
    base = (F.col(name["n_words"]) < min_words) | (100 * F.col(name["n_repeat_words"]) > max_repeat_percent * F.col(name["n_words"]))
    failed = []
    for rule, measure, low, high in rules:
        over, under = (F.col(name[k.strip()]) for k in measure.split("/"))
        ratio = F.when(under > 0, over / under).otherwise(F.lit(0.0))
        bad = F.lit(False)
        if low is not None:
            bad = bad | (ratio < low)
        if high is not None:
            bad = bad | (ratio > high)
        failed.append((rule, bad))
    passes = ~base
    for _, bad in failed:
        passes = passes & ~bad
    return base, passes, F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in failed]), lambda x: x.isNotNull())


def judge(docs: DataFrame, *, text_col: str = "text", rules=RULES, window: int = 5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """``docs`` with measures, base_failed, kept and failed_rules added.

    A measure that bears the name of a column of ``docs`` is named with an
    underscore more.
    """
    df, name = measures(docs, text_col=text_col, window=window)
    base, passes, failed = verdict(name, rules, min_words=min_words, max_repeat_percent=max_repeat_percent)
    extra = {spare(docs, k): c for k, c in (("base_failed", base), ("kept", passes), ("failed_rules", failed))}
    return df.withColumns(extra).drop(*(name[k] for k in ("text", "words", "lines", "hashes", "grams", "windows", "places")))
