"""Normalisation, trimming, hashing and formatting of text, as Column functions."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Fixed value: what counts as white space when an answer is trimmed or split.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MARKS = re.compile(r"[^\w\s]")
ARTICLES = ("a", "an", "the")


def strip(c: Column) -> Column:
    """c without white space at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def answer_tokens(c: Column, articles: bool = True) -> Column:
    """Lower-cased tokens without ASCII punctuation; articles=False drops a, an and the. Null has none."""
    words = F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), string.punctuation, ""), rf"{SPACE}+")
    return F.filter(words, lambda w: (w != "") & (F.lit(True) if articles else ~w.isin(*ARTICLES)))


def normalize_answer(c: Column, articles: bool = False) -> Column:
    """Lower case, no ASCII punctuation, single spaces; without articles unless articles=True."""
    return F.array_join(answer_tokens(c, articles), " ")


def normalize_query(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, rf"{SPACE}+", " ")))


def _folded(v: str | None) -> str:
    if v is None or v != v:
        return ""
    return v.replace("_", " ").lower() if v.isascii() else unicodedata.normalize("NFKC", v).replace("_", " ").casefold()


def folded_title(values: pd.Series) -> pd.Series:
    """NFKC, underscores as spaces, full case folding, single spaces; punctuation stays."""
    return pd.Series([" ".join(_folded(v).split()) for v in values], dtype=object)


def folded_text(values: pd.Series) -> pd.Series:
    """As folded_title, with everything but word characters as spaces."""
    return pd.Series([" ".join(_MARKS.sub(" ", _folded(v)).split()) for v in values], dtype=object)


def _each(fold: Callable[[pd.Series], pd.Series]) -> Callable:
    """fold for arrays of strings, all of a batch at once."""

    @pandas_udf(ArrayType(StringType()))
    def run(values: pd.Series) -> pd.Series:
        lengths = [0 if v is None else len(v) for v in values]
        flat = iter(fold(pd.Series([x for v in values if v is not None for x in v], dtype=object)).tolist())
        return pd.Series([None if v is None else list(islice(flat, n)) for v, n in zip(values, lengths, strict=True)], dtype=object)

    return run


# Column functions: a title and a text, and arrays of them.
normalize_title, normalize_text = (pandas_udf(f, StringType()) for f in (folded_title, folded_text))
normalize_titles, normalize_texts = _each(folded_title), _each(folded_text)


def stable_id(namespace: str, payload: dict[str, Column]) -> Column:
    """namespace_ and 20 hex digits of the SHA-256 of the payload's JSON with sorted keys; the order of keys doesn't matter."""
    canonical = F.to_json(F.struct(*[payload[k].alias(k) for k in sorted(payload)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(namespace + "_"), F.substring(F.sha2(canonical, 256), 1, 20))


def content_hash(c: Column) -> Column:
    return F.md5(strip(c))


def title_and_body(contents: Column) -> tuple[Column, Column]:
    """First line without quotes and white space, and the rest; without a line break all is title."""
    at = F.instr(contents, "\n")
    head = F.when(at > 0, F.substring(contents, 1, at - 1)).otherwise(contents)
    title = F.regexp_replace(strip(head), r'\A"+|"+\z', "")
    return title, F.when(at > 0, F.substring(contents, at + 1, F.length(contents))).otherwise("")


def sentences(c: Column) -> Column:
    """Pieces that end in . ! or ? before white space."""
    return F.filter(F.split(strip(c), rf"(?<=[.!?]){SPACE}+"), lambda s: s != "")


def first_sentence(c: Column) -> Column:
    return F.coalesce(F.try_element_at(sentences(c), F.lit(1)), F.lit(""))


def is_content_word(word: Column, content_words: Column) -> Column:
    """Whether any of the content words stands in the word."""
    return F.exists(content_words, lambda w: F.contains(word, w))


def token_length(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != ""))


def salvage_json(c: Column) -> Column:
    """The JSON from the first { to the last }, as VARIANT; null when it can't be read."""
    return F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0))


def few_shot_prompt(question: Column, demos: list[tuple[str, str]] = ()) -> Column:
    """Question and Answer lines of the demonstrations, then the question with an open answer."""
    shown = "".join(f"Question: {q}\nAnswer: {a}\n\n" for q, a in demos)
    return F.concat(F.lit(shown + "Question: "), question, F.lit("\nAnswer:"))


def passages_text(passages: Column) -> Column:
    """`Doc i(Title: t) text` lines of an array of struct(rank, title, text), in the order of ranks."""
    line = lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), p["title"], F.lit(") "), p["text"], F.lit("\n"))
    return F.array_join(F.transform(F.array_sort(passages), line), "")


def tree_value(q: Column, n: Column) -> Column:
    """Mean value of a tree node, 0 without visits."""
    return F.when(n > 0, q / n).otherwise(F.lit(0.0))


def score_bucket(score: Column, epsilon: float = 1e-12) -> Column:
    return F.when(score >= 1 - epsilon, "correct").when(score > epsilon, "partial").otherwise("wrong")


def benefit_bucket(benefit: Column, epsilon: float = 1e-12) -> Column:
    return F.when(benefit > epsilon, "positive").when(benefit < -epsilon, "negative").otherwise("zero")


def accuracy_flip(before: Column, after: Column) -> Column:
    return F.when((before < 1) & (after >= 1), "wrong_to_correct").when((before >= 1) & (after < 1), "correct_to_wrong").otherwise("same")
