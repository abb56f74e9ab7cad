"""Text expressions: normalisation, n-grams, field and query match scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, for which Spark has no expression; see ``folded``. Of several columns, one worker a task does all, as it takes no iterator."""
    return texts.str.normalize("NFKC")


# Characters that the compatibility form leaves as they are: ASCII, Latin and Cyrillic letters, Han, and usual marks of these.
_SETTLED = "^[\\x00-\\x7F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0400-\\u045F\\u2013\\u2014\\u2018-\\u201D\\u3001\\u3002\\u300A-\\u3011\\u3400-\\u4DBF\\u4E00-\\u9FFF]*$"


def folded(text: Column) -> Column:
    """The compatibility form. Only texts with characters that it may change leave the JVM."""
    settled = text.rlike(_SETTLED)
    return F.coalesce(nfkc(F.when(~settled, text)), text)


def squeeze(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def normalize(text: Column, unicode: bool = False) -> Column:
    """Compatibility form, lower case, white space collapsed. Without ``unicode`` the compatibility step is left out."""
    return squeeze(folded(text)) if unicode else squeeze(text)


def char_bigrams(text: Column) -> Column:
    """The distinct two-character pieces of a text without its spaces; of one character, itself."""
    s = F.regexp_replace(text, " ", "")
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) == 1, F.array(s)).otherwise(many)


def tokens_of(query: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(query, " "), ""))


def dense_of(field: Column) -> Column:
    return F.replace(field, F.lit(" "), F.lit(""))


def field_match(query: Column, field: Column, dense: Column | None = None, tokens: Column | None = None, grams: Column | None = None) -> Column:
    """1 if a normalised field equals the query, 0.9 if it contains it, else by its share of the query's distinct tokens and bigrams.

    Where a field or a query meets many, ``dense_of`` the one and ``tokens_of`` and ``char_bigrams`` of the other are made before and given here.
    """
    tokens, grams = tokens_of(query) if tokens is None else tokens, char_bigrams(query) if grams is None else grams
    covered = F.size(F.filter(tokens, lambda t: F.contains(field, t))) / F.greatest(F.size(tokens), F.lit(1))
    # A field has a pair of characters if its text without spaces contains them: its own bigrams need not be made.
    dense = dense_of(field) if dense is None else dense
    held = F.filter(grams, lambda g: F.when(F.length(g) == 2, F.contains(dense, g)).otherwise(dense == g))
    shared = F.size(held) / F.greatest(F.size(grams), F.lit(1))
    partial = F.least(F.lit(1.0), F.greatest(0.8 * covered, 0.7 * shared))
    return F.when((query == "") | (field == ""), 0.0).when(query == field, 1.0).when(F.contains(field, query), 0.9).otherwise(partial)


def text_score(title: Column, tags: Column, content: Column) -> Column:
    """Weighted sum of the three fields' match scores."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.55 * title + 0.30 * tags + 0.15 * content))


def match_count(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text contains, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for t in terms:
        total = total + F.when(F.contains(low, F.lit(t.lower())), 1.0).otherwise(0.0)
    return total


def contains_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\x{3400}-\\x{9FFF}]"), F.lit(False))


# Phrases that carry no search intent, and the characters that separate words.
LOW_INFORMATION = (
    "为什么", "应该", "怎么", "如何", "什么", "哪些", "需要", "可以", "是否", "能否", "附近", "有人", "问题", "处理",
    "方面", "时候", "一下", "还是", "请问", "求助", "吐槽", "里的", "这个", "那个", "一种", "一些", "一个", "和",
    "与", "及", "的", "了", "在", "对", "为", "吗", "呢",
)
SEPARATORS = "?？!！,，。.;；:：、/\\|()[]{}<>《》“”\"'`~…—_-"


def query_terms(query: str, max_text: int = 24, max_tags: int = 32) -> tuple[list[str], list[str]]:
    """(text terms, tag terms) of a query, a driver-side analysis of one short string."""
    import re
    import unicodedata

    plain = unicodedata.normalize("NFKC", query).lower().strip()[:500]
    for phrase in sorted(LOW_INFORMATION, key=len, reverse=True):
        plain = plain.replace(phrase, " ")
    for c in SEPARATORS:
        plain = plain.replace(c, " ")
    tokens = re.findall(r"[a-z0-9]+|[㐀-䶿一-鿿]+", plain)
    text: list[str] = []
    tags: list[str] = []
    for t in tokens:
        if t.isascii():
            text.append(t)
            tags.append(t)
            continue
        if 2 <= len(t) <= 8:
            tags.append(t)
        tags += [t[i : i + 2] for i in range(0, len(t) - 1, 2)]
        if len(t) >= 3:
            text += [t, *(t[i : i + n] for n in (4, 3) for i in range(len(t) - n + 1))]
    fall = " ".join(tokens) or query.strip().lower()
    return list(dict.fromkeys(text))[:max_text] or [fall], list(dict.fromkeys(tags))[:max_tags] or [fall]


def preview(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts are cut and end in an ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))).otherwise(s)


def embedding_text(title: Column, category: Column, tags: Column, content: Column) -> Column:
    """The labelled lines that a document encoder reads; blank fields are left out."""

    def line(label: str, value: Column) -> Column:
        v = F.trim(F.coalesce(value, F.lit("")))
        return F.when(v != "", F.concat(F.lit(label), v))

    return F.concat_ws("\n", line("标题：", title), line("类别：", category), line("标签：", F.array_join(tags, " ")), line("正文：", content))


QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："


def query_text(query: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), F.trim(query))
